"""Order-dependent rewriting of a session's items, one group of rows for each session."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Changed lines of a compact delta; what a delta may cost; shortest folded runs.
COMPACT, SLACK, RUN_LINES, RUN_CHARS, SHORT_LINE = 12, 80, 3, 40, 4


class Reads:
    """Versions of paths; what a later read of a path needs to say."""

    def __init__(self):
        self.seen: dict[str, str] = {}

    def take(self, path: str, text: str) -> tuple[str, str]:
        """(text to show, how): first, unchanged, subset, delta or whole."""
        old = self.seen.get(path)
        if old is None:
            self.seen[path] = text
            return text, "first"
        if old == text:
            return f"[unchanged: {path}]", "unchanged"
        n, m = len(text.splitlines()), len(old.splitlines())
        if text and text in old:
            return f"[subset read: {path}, {n}/{m}L — see earlier read]", "subset"
        self.seen[path] = text
        diff = list(difflib.unified_diff(old.splitlines(), text.splitlines(), lineterm="", n=3))[2:]
        added = [x for x in diff if x[:1] == "+"]
        removed = [x for x in diff if x[:1] == "-"]
        body = added + removed if len(added) + len(removed) <= COMPACT else diff
        shown = "\n".join([f"[DELTA {path} +{len(added)}/-{len(removed)}]", *body])
        return (text, "whole") if len(shown) >= len(text) + SLACK else (shown, "delta")


class Folder:
    """Runs of lines that an earlier turn's output has already."""

    def __init__(self):
        self.at: dict[str, list[tuple[int, int]]] = {}
        self.turns: list[tuple[int, list[str]]] = []

    def take(self, turn: int, text: str, protected: bool) -> str:
        rows = text.split("\n")
        out: list[str] = []
        i = 0
        while i < len(rows):
            best = (0, 0, 0)
            if not protected and len(rows[i].strip()) >= SHORT_LINE:
                for t, j in self.at.get(rows[i].strip(), [])[:16]:
                    n = 0
                    there = self.turns[t][1]
                    while i + n < len(rows) and j + n < len(there) and rows[i + n] == there[j + n]:
                        n += 1
                    best = max(best, (n, -t, -j))
            n, t = best[0], -best[1]
            if n >= RUN_LINES and sum(map(len, rows[i : i + n])) >= RUN_CHARS:
                out.append(f"[↑{n}L same as msg {self.turns[t][0]}: '{rows[i].strip()[:20]}']")
                i += n
            else:
                out.append(rows[i])
                i += 1
        own = len(self.turns)
        self.turns.append((turn, out))
        for j, line in enumerate(out):
            if len(line.strip()) >= SHORT_LINE:
                self.at.setdefault(line.strip(), []).append((own, j))
        return "\n".join(out)


def rewritten(items: DataFrame, roles_kept: tuple[str, ...] = ("system",), frozen: Column | None = None) -> DataFrame:
    """items with new content, and how: reads as deltas of earlier ones, repeated runs of lines folded.

    items: session_id, pos, content, content_type, source and others, which stay. One group is
    one session, which a context window bounds. Frozen items stay as they are."""
    frozen = F.lit(False) if frozen is None else F.coalesce(frozen, F.lit(False))
    path = F.when(F.col("content_type").isin("code", "text") & (F.coalesce("source", F.lit("")) != "") & ~frozen, F.col("source"))
    rows = items.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("__path", path).withColumn("__kept", frozen | F.coalesce(F.col("source").isin(*roles_kept), F.lit(False)))
    schema = StructType([*items.schema.fields, StructField("how", StringType())])

    def run(pdf):
        reads, folds, out = Reads(), Folder(), []
        pdf = pdf.sort_values("pos")
        for pos, text, path, kept in zip(pdf["pos"], pdf["content"], pdf["__path"], pdf["__kept"], strict=True):
            text, how = reads.take(path, text) if isinstance(path, str) else (text, "item")
            out.append((folds.take(int(pos), text, bool(kept)), how))
        pdf = pdf.drop(columns=["__path", "__kept"])
        return pdf.assign(content=[t for t, _ in out], how=[h for _, h in out])

    return rows.groupBy("session_id").applyInPandas(run, schema)
