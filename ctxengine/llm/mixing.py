"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, epoch after epoch. A document's virtual
finish time is the number of words that its source has sent by then, over the source's target.
A long document is sent in packets of a few words, each with a finish time of its own. All
sources' packets are sorted by finish time, and the mix is what comes first, up to the total
budget; the packet that reaches it is cut. So a source differs from its target by what is
left of the packet that it was sending.

The global order is cut up by ranges of finish time: their sums tell in which range the budget
ends, and the running sum of single packets is only taken in there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.llm.shared import WORD, written

#: Fixed value: words of a packet.
PACKET = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes (key, source_size, a row per source) with weight and target.

    Sources in the order of their keys weigh `weights`, repeating, and share `share` times all
    sizes; a target stops at `cap` times its source's size and the excess is shared again by
    weight. This is a water level: with sources in the order of what one unit of weight may
    take, the first one that the level does not fill sets it. All rows here are sources.
    """
    order = Window.orderBy("key")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("room", F.col("most") / F.col("weight"))
    w = Window.orderBy("room", "key")
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    down = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = Window.partitionBy()
    ranked = ranked.withColumn("budget", F.sum("source_size").over(full) * F.lit(float(share)))
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(up), F.lit(0.0))) / F.sum("weight").over(down))
    ranked = ranked.withColumn("water", F.first(F.when(F.col("level") < F.col("room"), F.col("level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("key", "source_size", "weight", F.coalesce(F.least(F.col("most"), F.col("water") * F.col("weight")), F.col("most")).alias("target"))


def _finish(sent: Column) -> Column:
    """Virtual finish time of what ends when its source has sent so many words."""
    return F.try_divide(sent.cast("double"), F.col("target"))


def _slots(epoch: int, slots: int) -> Column:
    """(slot, words) of a document's packets in an epoch. A slot is a range of finish times; a
    document that lies in one of them needs no packets there."""
    start = F.col("at") + F.lit(epoch) * F.col("source_size")

    def slot(end: Column) -> Column:
        return F.floor(_finish(start + end) * F.lit(slots))

    first, last = slot(F.least(F.col("size"), F.lit(PACKET))), slot(F.col("size"))
    each = F.transform(
        F.sequence(F.lit(1), F.ceil(F.col("size") / PACKET)),
        lambda j: F.struct(slot(F.least(F.col("size"), j * PACKET)).alias("slot"), (F.least(F.col("size"), j * PACKET) - (j - 1) * PACKET).alias("words")),
    )
    return F.when(first == last, F.array(F.struct(last.alias("slot"), F.col("size").alias("words")))).otherwise(each)


def _cut(rows: DataFrame, budget: int, epochs: int, slots: int) -> tuple[float, str, int] | None:
    """(finish time, source, words) of the packet that reaches the budget, and how much of it is
    before that; None if all packets are. rows: key, at, size, source_size, target, all positive.

    Within a source finish times differ, so with the source they order all packets."""
    sums = rows.select(F.explode(F.flatten(F.array(*[_slots(e, slots) for e in range(epochs)]))).alias("p")).groupBy("p.slot").agg(F.sum("p.words").alias("words"))
    order = Window.orderBy("slot")
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = sums.where((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).first()
    if here is None:
        return None
    # Only packets of this slot are looked at one by one.

    def packets(epoch: int) -> Column:
        start = F.col("at") + F.lit(epoch) * F.col("source_size")

        def one(j):
            end = F.least(F.col("size"), j * PACKET)
            return F.struct(_finish(start + end).alias("finish"), F.col("key").alias("key"), (end - (j - 1) * PACKET).alias("words"))

        first, last = (F.floor(_finish(start + x) * F.lit(slots)) for x in (F.least(F.col("size"), F.lit(PACKET)), F.col("size")))
        return F.when((first <= here["slot"]) & (last >= here["slot"]), F.transform(F.sequence(F.lit(1), F.ceil(F.col("size") / PACKET)), one))

    packet = rows.select(F.explode(F.array(*[packets(e) for e in range(epochs)])).alias("e")).select(F.explode("e").alias("p")).select("p.*")
    packet = packet.where(F.floor(F.col("finish") * F.lit(slots)) == here["slot"])
    run = F.sum("words").over(Window.orderBy("finish", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(here["before"])
    last = packet.withColumn("run", run).where(F.col("run") >= budget).orderBy("run", "finish", "key").first()
    return last["finish"], last["key"], last["words"] - (last["run"] - budget)


def served(docs: DataFrame, weights=(5, 2, 1), share=1.5, cap=2.0, keep=("doc_id",)) -> DataFrame:
    """The columns `keep`, named k_0, k_1 and so on, and size, source_size, target, key, passes for every document.

    passes has a (finish, epoch, words) for each of ceil(cap) epochs: virtual finish time and
    the words that the mix takes. Documents are shuffled by a digest of doc_id and text; a null
    one counts as an empty one, repeated rows are documents of their own. Null source is a
    source, the last. Documents without words take nothing and have no finish time.

    A source may hold most rows: the shuffled order is cut into buckets by the digest, sums of
    (source, bucket) give each bucket its offset, and only a bucket's rows meet in one task.
    Neither buckets nor their rows grow faster than the square root of the number of documents.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], key.alias("key"), size_of(F.col("text")).alias("size"), digest.alias("digest"))
    sums = written(rows if "text" not in keep else rows.select("key", "digest", "size"), "sized")
    rows = sums if "text" not in keep else rows
    whole = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).first()
    buckets = max(16, math.isqrt(whole["n"]))
    bucket = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets / 2**32)
    parts = written(sums.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "parts")
    aim = targets(parts.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    offsets = written(offsets.join(aim, "key").select("key", "bucket", "offset", "source_size", "target"), "offsets")
    within = Window.partitionBy("key", "bucket").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)

    def queued(x: DataFrame) -> DataFrame:
        x = x.withColumn("bucket", bucket).join(offsets, ["key", "bucket"])
        return x.withColumn("at", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("bucket", "offset")

    epochs = math.ceil(cap)
    queue = written(queued(sums), "queue")
    cut = _cut(queue.where("size > 0 and target > 0"), math.floor(share * (whole["words"] or 0)), epochs, buckets)
    rows = queue if "text" not in keep else queued(rows)

    def sent(epoch: int):
        start = F.col("at") + F.lit(epoch) * F.col("source_size")
        finish = F.when((F.col("size") > 0) & (F.col("target") > 0), _finish(start + F.col("size")))
        if cut is None:
            words = F.when(finish.isNotNull(), F.col("size"))
        else:
            at, who, rest = F.lit(cut[0]), F.lit(cut[1]), F.lit(cut[2])

            def taken(j):
                end = F.least(F.col("size"), j * PACKET)
                own = _finish(start + end)
                return F.when((own < at) | ((own == at) & (F.col("key") < who)), end - (j - 1) * PACKET).when((own == at) & (F.col("key") == who), rest).otherwise(F.lit(0))

            some = F.aggregate(F.sequence(F.lit(1), F.ceil(F.col("size") / PACKET)), F.lit(0).cast("long"), lambda acc, j: acc + taken(j))
            words = F.when(finish < at, F.col("size")).when(finish.isNotNull() & (_finish(start) <= at), some)
        return F.struct(finish.alias("finish"), F.lit(epoch).alias("epoch"), F.coalesce(words, F.lit(0)).cast("long").alias("words"))

    passes = F.array(*[sent(e) for e in range(epochs)])
    return rows.select(*[f"k_{i}" for i in range(len(keep))], "size", "source_size", "target", "key", "digest", passes.alias("passes"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: size, source_size and target of its source, words taken in all
    epochs, virtual finish time of its first pass; sorted globally by that time, the mix's
    order. An empty table gives an empty one."""
    rows = served(docs, **options)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    rows = rows.select(F.col("k_0").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.col("passes")[0]["finish"].alias("finish"), "key", "digest")
    return rows.repartitionByRange("finish", "key", "digest").sortWithinPartitions("finish", "key", "digest").drop("key", "digest")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each document as often as the mix takes it, sorted globally by virtual finish time.

    A document being sent at the cut is kept when half of it or more is before the cut.
    Documents without words are not taken. The columns are those of docs, whatever their names."""
    rows = served(docs, keep=tuple(docs.columns), **options)
    rows = rows.select(*[f"k_{i}" for i in range(len(docs.columns))], "size", "key", F.inline("passes")).where((F.col("words") > 0) & (2 * F.col("words") >= F.col("size")))
    rows = rows.repartitionByRange("finish", "key").sortWithinPartitions("finish", "key", "epoch")
    return rows.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(docs.columns)])
