"""Secrets out of intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxengine.functions.text import squeeze, strip

#: What is replaced, in this order.
SECRETS = [
    r"(?i)\b(api[_-]?key|token|secret|password|passwd|authorization)\b\s*[:=]\s*\S+",
    r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*",
    r"(?i)\b(sk|pk|rk|ghp|gho|xox[baprs])-[A-Za-z0-9\-_]{8,}",
    r"https?://[^\s]*[?&](signature|token|key|sig)=[^\s&]+",
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
]
MARK = "[REDACTED]"


def redact(c: Column) -> Column:
    for p in SECRETS:
        c = F.regexp_replace(c, p, MARK)
    return c


def minimize(c: Column, most: int = 500) -> Column:
    """White space squeezed, secrets replaced, at most so many characters."""
    out = redact(squeeze(strip(c)))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 1), F.lit("…"))).otherwise(out)
