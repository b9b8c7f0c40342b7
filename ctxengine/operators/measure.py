"""What texts and sessions weigh, what a rewriting saved, and whether it kept what it must."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxengine.functions import tokens
from ctxengine.operators import dedup

#: Lines and marks that a rewriting adds; from how many tokens on an item is large.
OVERHEAD = r"(?md)^(?:O|OMIT):.*$|<<ccr:[0-9a-f]+>>"
LARGE, NAMED = 2000, 5


def stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """The table with tokens, chars and cost of each text as input; a null text is empty."""
    own = F.coalesce(F.col(text), F.lit(""))
    n = tokens.estimate(own).cast("long")
    return texts.select("*", n.alias("tokens"), F.length(own).cast("long").alias("chars"), F.round(tokens.cost(n, F.lit(0)), 9).alias("cost"))


def omission(ident: Column, keep: Column, content: Column) -> Column:
    """The line that stands for a copy, with the handle by which it can be read back."""
    return F.concat(F.lit("OMIT: "), ident, F.lit(" = "), keep, F.lit(" <<ccr:"), F.substring(F.sha2(content, 256), 1, 12), F.lit(">>"))


def net(items: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """by, original, compressed, overhead, net: the saved share without what the rewriting added."""
    added = F.aggregate(F.regexp_extract_all(after, F.lit(OVERHEAD), 0), F.lit(0), lambda n, x: n + tokens.estimate(x))
    sums = items.groupBy(by).agg(F.sum(tokens.estimate(F.col(before))).alias("original"), F.sum(tokens.estimate(F.col(after))).alias("compressed"), F.sum(added).alias("overhead"))
    return sums.select("*", F.round((F.col("original") - F.col("compressed") - F.col("overhead")) / F.greatest("original", F.lit(1)), 6).alias("net"))


def failures(ratios: DataFrame, limits: DataFrame) -> DataFrame:
    """level, key, message: what saves less than its floor.

    ratios: level (total, category, fixture), key, ratio. limits: level, key, floor. A key without
    a floor cannot fail."""
    low = ratios.join(limits, ["level", "key"]).where("ratio < floor")
    shown = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    name = F.when(F.col("level") == "total", "TOTAL ratio").when(F.col("level") == "category", F.concat(F.lit("category "), "key", F.lit(":"))).otherwise(F.concat("key", F.lit(":")))
    return low.select("level", "key", F.concat_ws(" ", name, shown("ratio"), F.lit("below"), F.when(F.col("level") == "total", "baseline").otherwise("floor"), shown("floor")).alias("message"))


def analysis(items: DataFrame, large: int = LARGE) -> DataFrame:
    """session_id, items, tokens, critical, discardable, redundant, duplicates, recommendations.

    items: session_id, pos (long), id, content, tier, token_count. Duplicates are equal or
    contained items of a session; their tokens count once for each pair."""
    pairs = dedup.exact(items, "session_id", "pos").select("session_id", "keep", "dup")
    pairs = pairs.union(dedup.contained(items, "session_id", "pos").select("session_id", "outer", "inner")).distinct()
    weight = items.select("session_id", F.col("pos").alias("dup"), F.col("token_count").cast("long").alias("n"))
    pairs = pairs.join(weight, ["session_id", "dup"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("duplicates"), F.sum("n").alias("redundant"))
    n = F.col("token_count").cast("long")
    big = F.col("token_count") > large
    low = F.col("tier").isin("low", "discardable")
    sums = items.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(n).alias("tokens"), F.sum(F.when(F.col("tier") == "critical", n).otherwise(0)).alias("critical"),
        F.sum(F.when(F.col("tier").isin("redundant", "discardable"), n).otherwise(0)).alias("discardable"), F.count_if(big).alias("big"),
        F.array_sort(F.collect_list(F.when(big, F.struct("pos", "id")))).alias("named"), F.count_if(low).alias("low"), F.sum(F.when(low, n).otherwise(0)).alias("low_n"),
    )
    rows = sums.join(pairs, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("duplicates", "redundant")})
    first = F.array_join(F.transform(F.slice("named", 1, NAMED), lambda x: x["id"]), ", ")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = F.array(
        F.when(F.col("duplicates") > 0, text("Remove ", F.col("duplicates"), " duplicate item(s) (~", F.col("redundant"), " tokens)")),
        F.when(F.col("big") > 0, text("Compress ", F.col("big"), " large item(s): ", first)),
        F.when(F.col("low") > 0, text("Consider dropping ", F.col("low"), " low-relevance items (~", F.col("low_n"), " tokens)")),
    )
    return rows.select("session_id", "items", "tokens", "critical", "discardable", "redundant", "duplicates", F.array_join(said, "\n").alias("recommendations"))
