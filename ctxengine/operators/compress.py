"""Compressors of one text by its type, in a registry from which Arrow functions are made.

A compressor takes (text, aggressiveness, query) and returns a shorter text, or None to leave it.
`register` adds one; the dispatcher takes the shortest result among those for the type, and
keeps the text unless at least 3 % are saved.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxengine.operators import slicing
from ctxengine.operators.structured import TEMPLATE, segments
from ctxengine.operators.tools import folded

#: What must be saved; rows that stay; keys that say nothing without a query.
LEAST_SAVED = 0.03
PROTECTED = re.compile(r"error|fatal|critical|exception|failed|panic|traceback|warning", re.I)
QUIET_KEYS = {"email", "phone", "address", "avatar", "uuid", "page", "per_page", "has_more", "extra_data"}
LEVEL = [("error", re.compile(r"\b(ERROR|FATAL|CRITICAL|PANIC)\b|Exception|Traceback|FAILED", re.I)), ("warning", re.compile(r"\bWARN", re.I)), ("debug", re.compile(r"\b(DEBUG|TRACE)\b", re.I))]
HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")
SIGNATURE = re.compile(r"^\s*(?:(?:export|public|private|static|async|pub)\s+)*(?:def|class|function|fn|func|interface|struct|impl|type)\b")
#: What stands between segments that were compressed apart; result lines of pytest;
#: characters of a shown line and of a template.
SEPARATOR = "\n\n---\n\n"
TEST_RESULT = re.compile(r"^=+ .*\b\d+ (?:passed|failed|error)")
TEST_PASSED = re.compile(r"^\S+::\S+ PASSED\b|^PASSED ")
TEST_ERROR = re.compile(r"^(?:E\s{2,}\S|\S+::\S+ FAILED\b|FAILED )")
SHOWN, KEY = 97, 120
STAMP = re.compile(r"^\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?Z?\]?\s*")

COMPRESSORS: dict[str, tuple[set[str], Callable[[str, float, str], str | None]]] = {}


def register(name: str, *kinds: str):
    """Decorator: a compressor for content types."""

    def add(f):
        COMPRESSORS[name] = (set(kinds), f)
        return f

    return add


def _tabular(rows) -> bool:
    return isinstance(rows, list) and bool(rows) and all(isinstance(r, dict) for r in rows)


@register("toon", "json")
def toon(text: str, a: float, query: str) -> str | None:
    """A list of objects with the same keys as a header and tab-separated rows; nothing is lost."""
    rows = _loads(text)
    if not _tabular(rows) or any(r.keys() != rows[0].keys() for r in rows):
        return None
    def cell(v):
        if v is None:
            return ""
        return json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else re.sub(r"[\t\n]", " ", str(v))
    return "\n".join([f"# TOON {len(rows)} rows", "\t".join(rows[0]), *("\t".join(map(cell, r.values())) for r in rows)])


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def row_scores(rows: list, query: str) -> list[float]:
    """First and last 100, protected 1000, 10 for each query term, outliers 5 z."""
    shown = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    terms = set(query.lower().split())
    out = [1000.0 * bool(PROTECTED.search(s)) + 10 * sum(t in s.lower() for t in terms) for s in shown]
    out[0] += 100
    out[-1] += 100
    if _tabular(rows):
        common = set.intersection(*(set(r) for r in rows[:10]))
        fields = sorted(k for k in common if not re.search("error|fail|exception|status|level|severity|code", k) and sum(isinstance(r.get(k), (int, float)) for r in rows[:20]) >= 3)[:5]
        for k in fields:
            at = [(i, float(r[k])) for i, r in enumerate(rows) if isinstance(r.get(k), (int, float)) and not math.isnan(r[k])]
            mean = sum(v for _, v in at) / len(at)
            sd = math.sqrt(sum((v - mean) ** 2 for _, v in at) / len(at))
            for i, v in at:
                if sd * sd >= 1e-9 and abs(v - mean) / sd > 2:
                    out[i] += 5 * abs(v - mean) / sd
    return out


@register("smart_rows", "json")
def smart_rows(text: str, a: float, query: str) -> str | None:
    """Lists of five or more: the rows that tell most, what all share, how many there were."""
    data = _loads(text)

    def cut(rows: list):
        keep = max(5, int(len(rows) * max(0.05, 1 - 0.9 * a)))
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], i))[:keep] if (scores := row_scores(rows, query)) else []
        kept = [rows[i] for i in sorted(best)]
        out = {"_items": kept, "_total": len(rows), "_kept": len(kept)}
        if _tabular(rows):
            same = {k: v for k, v in rows[0].items() if all(k in r and json.dumps(r[k], sort_keys=True) == json.dumps(v, sort_keys=True) for r in rows)}
            if same:
                out["_constants"] = same
                out["_items"] = [{k: v for k, v in r.items() if k not in same} for r in kept]
        return out

    if isinstance(data, list) and len(data) >= 5:
        return json.dumps(cut(data), separators=(",", ":"), ensure_ascii=False)
    if isinstance(data, dict) and any(isinstance(v, list) and len(v) >= 5 for v in data.values()):
        out = {}
        for k, v in data.items():
            if isinstance(v, list) and len(v) >= 5:
                own = cut(v)
                out[k], out[f"_{k}_total"] = own["_items"], own["_total"]
            else:
                out[k] = v
        return json.dumps(out, separators=(",", ":"), ensure_ascii=False)
    return None


@register("json", "json")
def nested(text: str, a: float, query: str) -> str | None:
    """Depth, list lengths and long strings are bounded; keys that say nothing go unless asked for."""
    data = _loads(text)
    if not isinstance(data, (dict, list)):
        return None
    items, depth = max(2, int(8 * (1 - a))), max(2, int(8 * (1 - a / 2)))
    terms = query.lower().split()

    def walk(v, d):
        if isinstance(v, dict):
            if d >= depth:
                return f"<object:{len(v)} keys>"
            return {k: walk(x, d + 1) for k, x in v.items() if k.lower() not in QUIET_KEYS or any(t in k.lower() for t in terms)}
        if isinstance(v, list):
            if len(v) <= items:
                return [walk(x, d + 1) for x in v]
            scores = row_scores(v, query)
            best = sorted(sorted(range(len(v)), key=lambda i: (-scores[i], i))[:items])
            return {"_items": [walk(v[i], d + 1) for i in best], "_total": len(v)}
        return v[:350] + f"...[{len(v) - 350} chars]" if isinstance(v, str) and len(v) > 500 else v

    return json.dumps(walk(data, 0), separators=(",", ":"), ensure_ascii=False)


def _template(line: str) -> str:
    for pattern, by in TEMPLATE:
        line = re.sub(pattern, by, line)
    return line[:KEY]


@register("log", "log", "terminal")
def log(text: str, a: float, query: str) -> str | None:
    """Errors with the ends of their stacks, warnings, the commonest other lines, and counts.

    Other lines are counted by their templates and shown by the first of each; results of a test
    run stay, and its passed tests are a number."""
    rows = text.splitlines()
    if len(rows) <= 5:
        return None
    errors, warnings, results, other, first, debug, passed = [], [], [], Counter(), {}, 0, 0
    stack = False
    for line in rows:
        level = next((n for n, p in LEVEL if p.search(line)), "info")
        bare = STAMP.sub("", line).rstrip()
        if TEST_RESULT.match(line):
            results.append(line.strip("= "))
            continue
        if TEST_PASSED.match(line):
            passed += 1
            continue
        level = "error" if TEST_ERROR.match(line) else level
        if stack and re.match(r"\s+\S", line) and level == "info":
            continue  # frames: the exception behind them says what happened
        stack = line.startswith("Traceback") or bool(re.match(r"\s*at .+\(", line))
        if level == "error":
            if not errors or errors[-1] != bare:
                errors.append(bare)
        elif level == "warning":
            warnings.append(bare)
        elif level == "debug":
            debug += 1
        elif bare:
            key = _template(bare)
            other[key] += 1
            first.setdefault(key, bare if len(bare) <= SHOWN + 3 else bare[:SHOWN] + "...")
    out = errors[: max(5, int(20 * (1 - a / 2)))]
    if not errors or a < 0.5:
        out += [w if n == 1 else f"[×{n}] {w}" for w, n in Counter(warnings).most_common(max(3, int(10 * (1 - a / 2))))]
        out += [first[k] if n == 1 else f"[×{n}] {first[k]}" for k, n in other.most_common(max(2, int(5 * (1 - a))))]
    if len(errors) > len(out):
        out.append(f"... {len(errors) - len(out)} more errors")
    out += results
    if passed and not results:
        out.append(f"{passed} passed")
    out.append(f"({len(rows)} lines: {len(errors)} errors, {len(warnings)} warnings, {debug} debug)")
    return "\n".join(out)


@register("diff", "diff")
def diff(text: str, a: float, query: str) -> str | None:
    """The hunks that change most, with less context."""
    rows = text.splitlines()
    if len(rows) <= 30:
        return None
    context, most = max(1, int(3 * (1 - a))), max(5, int(20 * (1 - a / 2)))
    head, hunks = [], []
    for line in rows:
        if line.startswith(("diff --git", "--- ", "+++ ")) or not (hunks or HUNK.match(line)):
            head.append(line)
        elif HUNK.match(line):
            hunks.append([line])
        else:
            hunks[-1].append(line)
    changed = lambda h: sum(x[:1] in "+-" and bool(x) for x in h)
    chosen = sorted(range(len(hunks)), key=lambda i: (-changed(hunks[i]), i))[:most]
    out = head[:10]
    for i in chosen:
        h = hunks[i]
        at = [j for j, x in enumerate(h) if x[:1] in ("+", "-")]
        near = {0} | {k for j in at for k in range(max(0, j - context), min(len(h), j + context + 1))}
        out += [h[j] for j in sorted(near)]
    if len(hunks) > most:
        out.append(f"... {len(hunks) - most} more hunks omitted ({len(hunks)} total)")
    return "\n".join(out)


@register("code", "code")
def code(text: str, a: float, query: str) -> str | None:
    """Imports, signatures, and the bodies that the query names; other bodies are their size."""
    if a < 0.3 or len(text) < 500:
        return None
    terms = {t for t in re.split(r"\W+", query.lower()) if len(t) > 2}
    out, hidden, keep = [], 0, False
    for line in text.splitlines():
        head = bool(SIGNATURE.match(line))
        if head:
            keep = any(t in line.lower() for t in terms)
        if head or keep or re.match(r"(import|from|use|#include|package|const|let|var)\b", line):
            if hidden:
                out.append(f"    ... {hidden} lines")
                hidden = 0
            out.append(line)
        elif line.strip():
            hidden += 1
    if hidden:
        out.append(f"    ... {hidden} lines")
    return "\n".join(out)


@register("slice", "code")
def of_query(text: str, a: float, query: str) -> str | None:
    """The parts of the code that the query asks for."""
    return slicing.sliced(text, query) if query else None


def best(text: str, kind: str, a: float, query: str, registry: dict | None = None) -> tuple[str, str]:
    """(content, strategy): the shortest result of the compressors for the type. Blocks of lines
    that a text repeats go first, and alone where that is all there is to do."""
    own = COMPRESSORS if registry is None else registry
    once = text if kind == "json" else folded(text)
    found = [(len(out), k, out, name) for k, (name, (kinds, f)) in enumerate(own.items()) if kind in kinds and (out := f(once, a, query))]
    size, _, out, name = min([*found, (len(once), -1, once, "blocks")])
    return (out, name) if size <= len(text) * (1 - LEAST_SAVED) else (text, "none")


def compressed(text: Column, kind: Column, a: float | Column = 0.85, query: Column | None = None) -> Column:
    """struct<content, strategy>; types without a compressor and null texts stay as they are."""
    registry = dict(COMPRESSORS)  # as it is now, wherever the function runs

    @F.pandas_udf("content string, strategy string")
    def run(texts: pd.Series, kinds: pd.Series, queries: pd.Series, hard: pd.Series) -> pd.DataFrame:
        out = [(t, "none") if t is None else best(t, k, x, q or "", registry) for t, k, q, x in zip(texts, kinds, queries, hard, strict=True)]
        return pd.DataFrame(out, columns=["content", "strategy"])

    return run(text, kind, F.lit("") if query is None else F.coalesce(query, F.lit("")), a if isinstance(a, Column) else F.lit(float(a)))


def routed(items: DataFrame, key: list[str], text: str, a: float = 0.85, query: Column | None = None) -> DataFrame:
    """key, content, strategies: each segment of a text by the compressors of its kind, in order.

    A null text is one empty segment. Segments of one text are put together again, no more."""
    parts = segments(items, key, text).withColumn("c", compressed(F.col("content"), F.col("kind"), a, query))
    out = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("segment", "c"))).alias("z"))
    return out.select(*key, F.array_join(F.transform("z", lambda x: x["c"]["content"]), SEPARATOR).alias("content"), F.array_join(F.transform("z", lambda x: x["c"]["strategy"]), ",").alias("strategies"))


#: Keys of tool schemas that say nothing to a model; names that explain themselves.
DROP_KEYS = {"$id", "$schema", "$comment", "deprecated", "examples", "example", "markdownDescription", "readOnly", "title", "writeOnly"}
PLAIN_NAMES = set(
    "query search filter sort order limit offset page per_page cursor after before owner repo repository org organization user username email name title "
    "id number count url path file filename branch tag sha commit ref key token".split()
)


def short(description: str, most: int = 120) -> str:
    """The first sentence where it fits, else a cut."""
    d = (description or "").strip()
    m = re.match(r"(.+?[.!?])\s", d)
    return d if len(d) <= most else m[1] if m and len(m[1]) <= most else d[: most - 3].rstrip() + "..."


def compact_schema(v, name: str = ""):
    if isinstance(v, list):
        return [compact_schema(x) for x in v]
    if not isinstance(v, dict):
        return v
    out = {}
    for k, x in v.items():
        if k in DROP_KEYS and not isinstance(x, dict):
            continue
        if k == "description" and isinstance(x, str):
            if name.lower() not in PLAIN_NAMES:
                out[k] = short(x)
        elif k == "properties" and isinstance(x, dict):
            out[k] = {n: compact_schema(s, n) for n, s in x.items()}
        else:
            out[k] = compact_schema(x)
    return out


def tool_line(tool: dict, level: str) -> str:
    """low: signature and description; medium: its first sentence; high: signature; max: name."""
    schema = tool.get("inputSchema") or tool.get("parameters") or {}
    names = list(schema.get("properties") or {})
    needed = set(schema.get("required") or [])
    args = ", ".join(sorted(names, key=lambda n: n not in needed))
    line = tool.get("name", "unknown") + (f"({args})" if args else "")
    d = (tool.get("description") or "").strip()
    if level == "max":
        return tool.get("name", "unknown")
    if level == "high" or not d:
        return line
    m = re.match(r"(.+?[.!?])(?:\s|$)", d)
    return f"{line}: {d if level == 'low' else m[1] if m else d.splitlines()[0][:120]}"


def compact_tools(tools, level: str = "medium"):
    """tools (catalog_id, pos, name, description, schema_json) with compact_json and line."""
    @F.pandas_udf("compact_json string, line string")
    def run(raw: pd.Series) -> pd.DataFrame:
        out = []
        for text in raw:
            tool = _loads(text or "")
            tool = tool if isinstance(tool, dict) else {}
            out.append((json.dumps(compact_schema(tool), separators=(",", ":"), ensure_ascii=False), tool_line(tool, level)))
        return pd.DataFrame(out, columns=["compact_json", "line"])

    return tools.withColumn("__c", run("schema_json")).select("*", "__c.compact_json", "__c.line").drop("__c")


def lazy_catalog(tools, level: str | None = None):
    """catalog_id, catalog, tools, full_chars, catalog_chars: one line for each tool, in order.

    Without a level: high from 50 tools on, max from 100 on, else medium."""
    n = tools.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("__n"))
    def made(lv, rows):
        return compact_tools(rows, lv)
    if level:
        rows = made(level, tools)
    else:
        sized = tools.join(n, "catalog_id")
        rows = made("medium", sized.where("__n < 50").drop("__n")).unionByName(made("high", sized.where("__n between 50 and 99").drop("__n"))).unionByName(made("max", sized.where("__n >= 100").drop("__n")))
    out = rows.groupBy("catalog_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("z"), F.sum(F.length("schema_json")).alias("full_chars"), F.count(F.lit(1)).alias("tools"))
    out = out.withColumn("catalog", F.array_join(F.transform("z", lambda x: x["line"]), "\n"))
    return out.select("catalog_id", "catalog", "tools", "full_chars", F.length("catalog").cast("long").alias("catalog_chars"))
