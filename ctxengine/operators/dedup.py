"""Duplicates among items: equal after normalization, contained, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.functions.text import content_hash, normalized, strip

#: Shortest items that are compared, shortest contained ones, words of a probe.
LEAST, CONTAINED = 50, 40


def exact(items: DataFrame, session: str, order: str) -> DataFrame:
    """session, keep, dup: of equal items the first in the session's order is kept."""
    rows = items.where(F.length(strip(F.col("content"))) >= LEAST).select(session, order, content_hash(F.col("content")).alias("h"))
    first = rows.groupBy(session, "h").agg(F.min(order).alias("keep"))
    return rows.join(first, [session, "h"]).where(F.col(order) > F.col("keep")).select(session, "keep", F.col(order).alias("dup"))


def contained(items: DataFrame, session: str, order: str) -> DataFrame:
    """session, outer, inner: items whose normalized text (40 characters or more) lies in another's.

    Of equal texts the first is the outer one. Not all pairs are formed: inside another text,
    an item's rarest inner word of those that the session has is found again, so candidates
    share that word, and only they are compared."""
    rows = items.where(F.length(strip(F.col("content"))) >= LEAST).select(session, F.col(order).alias("o"), normalized(F.col("content")).alias("t"))
    words = rows.select(session, "o", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    often = words.groupBy(session, "w").agg(F.count(F.lit(1)).alias("n"))
    # The first and last words of a text may be parts of longer ones in the outer text.
    inner = F.slice(F.split("t", " "), 2, F.greatest(F.lit(0), F.size(F.split("t", " ")) - 2))
    probe = rows.where(F.length("t") >= CONTAINED).select(session, "o", F.explode(F.array_distinct(inner)).alias("w")).join(often, [session, "w"])
    probe = probe.groupBy(session, "o").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    near = probe.join(words.withColumnRenamed("o", "other"), [session, "w"]).where("o <> other").select(session, "o", "other")
    # Texts of one or two words have no inner word; they are compared with all of their session.
    short = rows.where((F.length("t") >= CONTAINED) & (F.size(F.split("t", " ")) <= 2)).select(session, "o")
    near = near.unionByName(short.join(rows.select(session, F.col("o").alias("other")), session).where("o <> other"))
    a = rows.select(session, F.col("o").alias("other"), F.col("t").alias("outer_t"))
    found = near.join(rows, [session, "o"]).join(a, [session, "other"]).where(F.contains("outer_t", "t") & ((F.col("outer_t") != F.col("t")) | (F.col("other") < F.col("o"))))
    return found.select(session, F.col("other").alias("outer"), F.col("o").alias("inner"))


def repeated_lines(items: DataFrame, key: str, least: int = 4) -> DataFrame:
    """line_hash, items, lines: lines of `least` characters or more that occur again."""
    rows = items.select(key, F.explode(F.split("content", "\n")).alias("line")).where(F.length(strip(F.col("line"))) >= least)
    return rows.groupBy(F.sha2(strip(F.col("line")), 256).alias("line_hash")).agg(F.countDistinct(key).alias("items"), F.count(F.lit(1)).alias("lines")).where("lines > 1")


def stub(keep: Column, source: Column) -> Column:
    return F.concat(F.lit("[same as "), keep.cast("string"), F.lit(": "), source, F.lit("]"))


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
