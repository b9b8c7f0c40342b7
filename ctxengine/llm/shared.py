"""Names, words and connected components of an edge table, for all operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxengine.sources.tables import written

#: What counts as a word, the same in every operator that counts words.
WORD = r"[^\x20\x09-\x0D]+"
__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "components", "fresh", "written"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each made longer until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def _loose(edges: DataFrame) -> int:
    """Nodes that keep edges (u > v) from being a forest of stars around each smallest node."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    edges: columns a, b (long). Alternates large-star and small-star contraction until all
    that is left is a forest of stars. Each round is a written table, so both sides of each
    join are plain scans and a node with very many edges is split by the skew join.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    while _loose(e):
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = written(both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
        large = both.join(least, "n").where(F.col("o") > F.col("n")).select(F.col("o").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
