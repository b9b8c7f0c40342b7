"""A session under a budget: read passes, ranking, selection, compression, assembly, guard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.functions import detect, relevance, tokens
from ctxengine.operators import cli, compress, dedup, ranking, rewrite, semantic, session, tools
from ctxengine.sources.tables import written

#: How hard each quality compresses; what an item must save; headers that show savings.
QUALITY = {"maximum": 0.25, "balanced": 0.85, "economy": 0.85}
LEAST_SAVED, HEADER_SAVED, HEADER_ORIGINAL, INLINE = 0.03, 15, 50, 120
#: Items that no pass has replaced; only those are ranked down, compared and compressed.
WHOLE = ("item", "first", "whole")


@dataclass(frozen=True)
class Config:
    """budget: tokens of a session, cut only where it comes near them; without one, a share of its
    own, or (None) all of it. quality: maximum, balanced or economy."""

    budget: int | None = None
    budget_share: float | None = 0.5
    quality: str = "balanced"
    pointers: bool = True
    compress: bool = True
    semantic: bool = True


def _replaced(rows: DataFrame, stub: Column, how: str, when: Column | None = None) -> DataFrame:
    """Whole items whose stub is there and shorter become it."""
    rows = rows.withColumn("__stub", stub)
    fits = F.col("how").isin(*WHOLE) & (F.length("__stub") < F.length("content")) & (F.lit(True) if when is None else when)
    rows = rows.withColumn("__fits", F.coalesce(fits, F.lit(False)))
    return rows.withColumns({"content": F.when(F.col("__fits"), F.col("__stub")).otherwise(F.col("content")), "how": F.when(F.col("__fits"), how).otherwise(F.col("how"))}).drop("__fits", "__stub")


def _asked(rows: DataFrame) -> DataFrame:
    terms, symbols = relevance.query_terms(F.coalesce("task_query", F.lit("")))
    return rows.withColumn("terms", terms).withColumn("symbols", symbols)


def _prepared(items: DataFrame, config: Config) -> DataFrame:
    """Counts, the task, gutters, pointers and covered greps."""
    rows = items.select("session_id", "pos", "id", "content_type", "source", F.coalesce("content", F.lit("")).alias("content"))
    rows = rows.withColumn("plain", F.col("content")).withColumn("original_tokens", tokens.estimate(F.col("content")))
    task = F.min(F.when(F.col("source") == "user", F.struct("pos", F.substring("content", 1, 300).alias("q")))).over(Window.partitionBy("session_id"))
    kind = F.when(F.coalesce("content_type", F.lit("unknown")) == "unknown", detect.content_type(F.col("content"))).otherwise(F.col("content_type"))
    rows = rows.withColumn("task_query", task["q"]).withColumn("content_type", kind).withColumn("how", F.lit("item"))
    rows = rows.withColumn("content", F.when(F.col("content_type").isin("code", "text"), session.strip_gutters(F.col("content"))).otherwise(F.col("content")))
    if config.pointers:
        asked = F.coalesce("task_query", F.lit("")) != ""
        on_task = relevance.path_matches(F.coalesce("source", F.lit("")), F.coalesce("task_query", F.lit("")), F.col("terms"), F.col("symbols"))
        rows = _asked(rows).withColumn("on_task", asked & on_task).withColumn("token_count", tokens.estimate(F.col("content")))
        rows = _replaced(session.pointer(rows, asked=asked), F.col("pointer"), "pointer").drop("terms", "symbols", "on_task", "token_count", "pointer")
    greps = rows.where("content_type = 'search'")
    reads = rows.where("content_type = 'code' and how = 'item'").select("session_id", "pos", F.col("source").alias("path"), "content")
    rows = rows.join(session.covered_greps(greps, reads, ["session_id"], "pos"), ["session_id", "pos"], "left")
    return _replaced(rows, session.grep_stub(F.col("matches"), F.col("content")), "grep", F.col("covered")).drop("matches", "covered")


def _reads(rows: DataFrame) -> DataFrame:
    """Later reads as deltas, repeated runs folded; earlier reads that a later one replaces as stubs.

    A read followed by a delta is superseded, one followed by a whole version is stale; deltas stay,
    as later text needs them."""
    rows = rows.withColumnRenamed("how", "__was")
    rows = rewrite.rewritten(rows, frozen=F.col("__was") != "item").withColumn("how", F.when(F.col("__was") != "item", F.col("__was")).otherwise(F.col("how"))).drop("__was")
    rows = session.superseded(rows.withColumn("read_delta", F.col("how") == "delta"))
    rows = _replaced(rows, session.superseded_stub(F.col("source"), F.col("content")), "superseded", F.col("superseded"))
    read = relevance.is_file_read(F.col("source"), F.col("content_type"))
    again = F.max(F.when(read & F.col("how").isin("first", "whole"), F.col("pos"))).over(Window.partitionBy("session_id", "source"))
    rows = rows.withColumn("__again", again)
    return _replaced(rows, session.stale_stub(F.col("source"), F.col("content")), "stale", read & (F.col("pos") < F.col("__again"))).drop("read_delta", "superseded", "__again")


def _ranked(rows: DataFrame) -> DataFrame:
    """Duplicates, tiers, BM25 against the task; what is a copy, obsolete or off the task as stubs.

    A session without a task has no BM25, and nothing in it is off the task."""
    whole = rows.where(F.col("how").isin(*WHOLE)).select("session_id", "pos", "content")
    pairs = dedup.exact(whole, "session_id", "pos").unionByName(dedup.contained(whole, "session_id", "pos").select("session_id", F.col("outer").alias("keep"), F.col("inner").alias("dup")))
    keeps = pairs.groupBy("session_id", F.col("dup").alias("pos")).agg(F.min("keep").alias("keep"))
    names = rows.select("session_id", F.col("pos").alias("keep"), F.col("id").alias("keep_id"))
    rows = rows.join(keeps.join(names, ["session_id", "keep"]), ["session_id", "pos"], "left")
    queries = rows.where("task_query is not null").select("session_id", "task_query").distinct()
    scores = ranking.bm25(rows.select("session_id", "pos", "content"), queries, ["pos"], ["session_id"]).select("session_id", "pos", F.col("score").alias("bm25"))
    rows = rows.join(scores, ["session_id", "pos"]).withColumn("bm25", F.when(F.coalesce("task_query", F.lit("")) != "", F.col("bm25")))
    rows = _asked(rows).withColumn("token_count", tokens.estimate(F.col("content")))
    copy = F.col("keep").isNotNull()
    tier = relevance.tier(F.col("content"), F.col("content_type"), F.col("token_count"), F.col("source"), F.col("task_query"), F.col("terms"), F.col("symbols"), role=F.col("source"), is_duplicate=copy)
    rows = rows.withColumn("tier", tier).drop("terms", "symbols")
    rows = _replaced(rows, dedup.stub(F.col("keep_id"), F.coalesce("source", F.lit(""))), "duplicate", copy)
    rows = rows.withColumn("tier", F.when(F.col("how") == "duplicate", "redundant").otherwise(F.col("tier")))
    rows = _replaced(rows, session.obsolete_stub(F.col("content"), F.col("tier")), "obsolete")
    rows = _replaced(rows, session.irrelevant_stub(F.col("content"), F.col("tier"), F.col("source"), F.col("content_type"), F.col("bm25")), "irrelevant")
    score = F.coalesce("bm25", F.lit(0.0)) + relevance.tier_boost(F.col("tier")) + relevance.error_boost(F.col("content")) + 0.001
    return rows.withColumn("token_count", tokens.estimate(F.col("content"))).withColumn("score", score).drop("keep", "keep_id")


def _compressed(rows: DataFrame, config: Config) -> DataFrame:
    """Whole items by the compressors of their type; one that saves too little stays as it was."""
    base = QUALITY[config.quality]
    open_ = F.col("kept") & F.col("how").isin(*WHOLE)
    hard = relevance.aggressiveness(F.col("tier"), F.col("bm25"), base)
    own = tools.compressed(F.when(open_ & ~F.col("content_type").isin("log", "json", "code", "message"), F.col("content")), hard, F.col("task_query"))
    rows = rows.withColumn("__o", own)
    tool = F.when(F.col("__o.compressed"), F.col("__o")).otherwise(cli.compressed(F.col("content"), a=base))
    by_type = compress.compressed(F.when(open_, F.col("content")), F.col("content_type"), hard, F.col("task_query"))
    rows = rows.withColumn("__c", by_type).withColumn("__t", F.when(open_ & ~F.col("content_type").isin("log", "json", "code", "message"), tool))
    use_tool = F.coalesce(F.col("__t.compressed"), F.lit(False))
    text = F.when(use_tool, F.col("__t.content")).otherwise(F.col("__c.content"))
    name = F.when(use_tool, F.col("__t.strategy")).otherwise(F.col("__c.strategy"))
    rows = rows.withColumn("__text", text).withColumn("__name", name).withColumn("__n", tokens.estimate(F.col("__text")))
    good = F.coalesce(open_ & (F.col("__name") != "none") & (F.col("__n") < F.col("token_count") * (1 - LEAST_SAVED)), F.lit(False))
    rows = rows.withColumn("__good", good).withColumn("content", F.when(F.col("__good"), F.col("__text")).otherwise(F.col("content"))).withColumn("how", F.when(F.col("__good"), F.col("__name")).otherwise(F.col("how")))
    return rows.drop("__c", "__t", "__o", "__text", "__name", "__n", "__good")


def shown(content: Column, ident: Column, kind: Column, source: Column, before: Column, now: Column) -> Column:
    """An item behind its id; stubs of left-out items and messages of user and system stand alone."""
    alone = content.startswith("[dropped:") | content.startswith("[omit:") | content.startswith("[irrelevant read:") | (ident == "input") | ((kind == "message") & F.coalesce(source, F.lit("")).isin("user", "system"))
    head = F.concat(F.lit("["), ident, F.when((before - now >= HEADER_SAVED) & (before >= HEADER_ORIGINAL), F.concat(F.lit("|"), before.cast("string"), F.lit("→"), now.cast("string"), F.lit("tok"))).otherwise(""), F.lit("]"))
    inline = semantic.stub_tag(content).isNotNull() | semantic.starts(content, semantic.KEPT) | (~F.contains(content, F.lit("\n")) & (F.length(content) <= INLINE))
    return F.when(alone, content).otherwise(F.concat(head, F.when(inline, " ").otherwise("\n"), content))


def optimize_context(items: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(items_out, sessions_out) of items (session_id, pos, id, content, content_type, source).

    The passes run in the order of `_prepared`, `_reads`, `_ranked`, selection, `_compressed`; every
    pass sees the text of the one before, and none makes an item longer. A session is its items
    behind their ids, or its labelled sections where these are fewer tokens, and never more than
    its plain text. Sessions are bounded by a context window, and every key holds the session; two
    tables are written on the way: what ranking and comparing read several times, and the items of
    both results.
    Null contents are empty, null types are detected, other columns are left out."""
    rows = written(_reads(_prepared(items, config)), "context")
    rows = ranking.select(_ranked(rows), config.budget_share, config.budget, hybrid=True)
    rows = _replaced(rows, ranking.dropped_stub(F.col("id"), F.col("token_count")), "dropped", ~F.col("kept"))
    if config.compress:
        rows = _compressed(rows, config)
    rows = rows.withColumn("token_count", tokens.estimate(F.col("content")))
    rows = rows.select("session_id", "pos", "id", "source", "content_type", "tier", "how", "kept", F.round("score", 6).alias("score"), "original_tokens", "token_count", "content", "plain")
    out = written(rows, "context")
    line = shown(F.col("content"), F.col("id"), F.col("content_type"), F.col("source"), F.col("original_tokens"), F.col("token_count"))
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), "plain")))
    joined = out.groupBy("session_id").agg(parts.alias("p"), F.count(F.lit(1)).alias("items"), F.sum(F.col("kept").cast("long")).alias("kept"), F.sum(F.size(detect.volatile(F.col("content")))).alias("volatile"))
    joined = joined.select("session_id", "items", "kept", "volatile", F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("l"), F.array_join(F.transform("p", lambda x: x["plain"]), "\n\n").alias("o"))
    if config.semantic:
        joined = joined.join(semantic.sections(out, long_labels=config.quality == "maximum"), "session_id")
    else:
        joined = joined.withColumn("semantic", F.lit(None).cast("string"))
    count = tokens.estimate
    joined = joined.withColumn("original_tokens", count(F.col("o"))).withColumn("__l", count(F.col("l"))).withColumn("__s", F.when((F.col("items") > 1) & (F.col("semantic") != ""), count(F.col("semantic"))))
    strategy = F.when((F.col("__s") < F.col("__l")) & (F.col("__s") < F.col("original_tokens")), "semantic").when(F.col("__l") < F.col("original_tokens"), "optimized").otherwise("plain")
    sessions = joined.withColumn("strategy", strategy)
    sessions = sessions.withColumn("content", F.when(F.col("strategy") == "semantic", F.col("semantic")).when(F.col("strategy") == "optimized", F.col("l")).otherwise(F.col("o")))
    sessions = sessions.select("session_id", "items", "kept", "volatile", "strategy", "original_tokens", "content", count(F.col("content")).alias("optimized_tokens"))
    return out.drop("plain"), sessions.withColumn("ratio", F.round((F.col("original_tokens") - F.col("optimized_tokens")) / F.greatest(F.lit(1), F.col("original_tokens")), 6))
