"""Passes over a session's file reads: gutters, stale and superseded reads, covered greps, stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.functions.relevance import CRITICAL, OBSOLETE, is_file_read
from ctxengine.functions.text import lines, squeeze, strip

#: Paths that a status need not show.
NOISE = (
    r"(?i)(?:^|/)(?:node_modules|__pycache__|\.pytest_cache|\.venv|venv|dist|coverage|\.idea|\.vscode|\.mypy_cache|\.ruff_cache|build|\.tox|\.nox|htmlcov|\.egg-info|\.coverage)(?:/|$)|"
    r"(?:^|/)(?:debug\.log|tmp_[\w.-]+|\.env(?:\.[\w.-]+)?)$|^(?:\*\.(?:pyc|pyo|swp|swo|egg-info)|\*~|\.DS_Store|Thumbs\.db|package-lock\.json|yarn\.lock|pip-log\.txt|pip-delete-this-directory\.txt)/?$"
)


def strip_gutters(c: Column) -> Column:
    """Line numbers and their separators before lines."""
    return F.regexp_replace(c, r"(?md)^\s*\d+[|:]\s?", "")


def n_lines(c: Column) -> Column:
    return F.size(lines(c))


def stale(items: DataFrame, session: str = "session_id", path: str = "source") -> DataFrame:
    """items with is_stale and last_pos: a later read of the path exists in the session."""
    last = F.max("pos").over(Window.partitionBy(session, path))
    return items.withColumn("last_pos", last).withColumn("is_stale", F.col("pos") < F.col("last_pos"))


def stale_stub(path: Column, content: Column) -> Column:
    return F.concat(F.lit("[stale read: "), path, F.lit(", "), n_lines(content).cast("string"), F.lit("L — superseded by later read]"))


def superseded(items: DataFrame, session: str = "session_id") -> DataFrame:
    """items with superseded: a later item of the path is a delta (column read_delta)."""
    last = F.max(F.when(F.col("read_delta"), F.col("pos"))).over(Window.partitionBy(session, "source"))
    return items.withColumn("superseded", F.coalesce((F.col("pos") < last) & ~F.col("read_delta") & F.col("content_type").isin("code", "text"), F.lit(False)))


def superseded_stub(path: Column, content: Column) -> Column:
    return F.concat(F.lit("[first read: "), path, F.lit(", "), n_lines(content).cast("string"), F.lit("L — see DELTA below]"))


def grep_stub(matches: Column, content: Column) -> Column:
    """Names the matched files in their order."""
    paths = F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?md)^([^:\s]+):\d+:"), 1))
    return F.concat(F.lit("[grep: "), matches.cast("string"), F.lit(" matches in "), F.array_join(paths, ", "), F.lit(" — see earlier read]"))


def covered_greps(greps: DataFrame, reads: DataFrame, session: list[str], key: str) -> DataFrame:
    """session, key, matches, covered: whether every matched line lies in the read of its file.

    greps: session, key, content of `file:number:line` lines. reads: session, path, content; the
    last read of a path counts."""
    at = greps.select(*session, key, F.explode(lines(F.col("content"))).alias("l")).select(*session, key, F.regexp_extract("l", r"^([^:\s]+):(\d+):(.*)$", 1).alias("path"), strip(F.regexp_extract("l", r"^([^:\s]+):(\d+):(.*)$", 3)).alias("text")).where("path <> ''")
    last = reads.groupBy(*session, "path").agg(F.max_by("content", "pos").alias("body"))
    hit = at.join(last, [*session, "path"], "left").select(*session, key, F.coalesce(F.contains("body", "text"), F.lit(False)).alias("in_read"))
    return hit.groupBy(*session, key).agg(F.count(F.lit(1)).alias("matches"), F.bool_and("in_read").alias("covered"))


def obsolete_stub(content: Column, tier: Column) -> Column:
    """Null where the item stays."""
    return F.when((tier == "discardable") & content.rlike(OBSOLETE), F.concat(F.lit("[obsolete note: "), F.substring(squeeze(strip(content)), 1, 80), F.lit("]")))


def irrelevant_stub(content: Column, tier: Column, source: Column, kind: Column, bm25: Column) -> Column:
    low = tier.isin("low", "discardable") | ((tier == "medium") & (F.coalesce(bm25, F.lit(0.5)) < 0.08))
    return F.when(low & is_file_read(source, kind) & ~content.rlike(CRITICAL), F.concat(F.lit("[irrelevant read: "), source, F.lit(", "), n_lines(content).cast("string"), F.lit("L]")))


def outline(content: Column) -> Column:
    """The first four imports and six signatures of a file."""
    imports = F.slice(F.regexp_extract_all(content, F.lit(r"(?md)^(?:import|from|use|#include|require)\b.*$"), 0), 1, 4)
    names = F.slice(F.regexp_extract_all(content, F.lit(r"(?md)^\s*(?:async\s+)?(?:def|class|function|fn|func|interface|struct)\s+(\w{1,48})"), 1), 1, 6)
    return F.array_join(F.concat(imports, names), "; ")


def pointer(items: DataFrame, session: str = "session_id", asked: Column | None = None) -> DataFrame:
    """items with pointer: a large read off the task is its path, size and outline, or null.

    Sessions with much code collapse smaller reads, and where there is a task (asked) reads of any
    size. Reads on the task (column on_task) and critical text stay."""
    asked = F.lit(False) if asked is None else asked
    code = F.sum(F.when(F.col("content_type") == "code", F.col("token_count")).otherwise(0)).over(Window.partitionBy(session))
    big = F.when(code >= 200, (n_lines(F.col("content")) >= 15) | (F.length("content") >= 400)).otherwise((n_lines(F.col("content")) >= 35) | (F.length("content") >= 800))
    long_ = F.concat(F.lit("[CBM: "), F.col("source"), F.lit(" — "), n_lines(F.col("content")).cast("string"), F.lit("L omitted. "), outline(F.col("content")), F.lit("]"))
    short = F.concat(F.lit("[omit:"), F.col("source"), F.lit("|"), n_lines(F.col("content")).cast("string"), F.lit("L]"))
    fits = F.when(F.length(long_) < F.length("content"), long_).otherwise(short)
    return items.withColumn("pointer", F.when((big | asked) & is_file_read(F.col("source"), F.col("content_type")) & ~F.col("on_task") & ~F.col("content").rlike(CRITICAL), fits))


def signal_paths(paths: Column) -> Column:
    return F.filter(paths, lambda p: ~p.rlike(NOISE))
