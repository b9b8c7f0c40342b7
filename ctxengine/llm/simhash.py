"""SimHash near-dedup by bit-sliced comparison.

Fingerprints that are compared lie side by side: word w of plane b holds bit b of 64 of them.
XOR with one fingerprint's bits gives, plane by plane, where 64 fingerprints differ at once;
carry-save counters add these bits up, and a block is left as soon as each of its distances
exceeds the radius.

Which fingerprints are compared: cut into m blocks of bits, two that differ in r bits at most
agree in m - r blocks, so they share one of the C(m, r) choices of blocks. m follows the number
of fingerprints, so that a choice has as many bits as tell them apart.

Texts that are to share most shingles, but not nearly all, differ in more bits than blocks can
serve. deduplicated() takes wider fingerprints, whose bands of bits find them with a stated
recall, compares bits in the same way, and then the shingles themselves of what is near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxengine.llm.shared import components, fresh, written

SEED = 42
#: Of deduplicated(): bits that are compared, rows of a block of texts, and how far apart, in
#: standard deviations, the bits of two texts may lie from what their similarity makes likely.
COMPARED, TEXT_BLOCK, DEVIATIONS = 128, 256, 3.5
#: Rows of a compared block; buckets above it are cut into pairs of blocks.
BLOCK = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, k: int) -> list[bytes]:
    """Of k words each, repeats included; the whole sequence if it is shorter; none of no words."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    columns = [words[i : len(words) - k + 1 + i] for i in range(k)]
    return [b" ".join(x) for x in zip(*columns, strict=True)]


def _spread(h: np.ndarray) -> np.ndarray:
    """Another hash of each hash, by the finaliser of SplitMix64."""
    z = h + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, k: int, bits: int = 64, distinct: bool = False) -> bytes:
    """Big-endian; a bit is 1 if set in over half of the shingles' hashes. Zero without words.

    Words of 64 bits after the first are made of hashes of the hashes. With distinct, a shingle
    counts once however often it occurs."""
    found = shingles(text, k)
    return _fingerprint(list(set(found)) if distinct else found, bits)


def _fingerprint(found: list[bytes], bits: int) -> bytes:
    total = np.zeros((bits // 64, 64), np.int64)
    for at in range(0, len(found), 65536):
        h = np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in found[at : at + 65536]]), ">u8").astype(np.uint64)
        for word in range(bits // 64):
            total[word] += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            h = _spread(h)
    return np.packbits(2 * total.ravel() > len(found)).tobytes()


def fingerprints(docs: DataFrame, k: int, bits: int = 64, distinct: bool = False) -> DataFrame:
    """doc_id, fp and same (binary), mark (long) for every row of docs: its fingerprint, a digest
    of its words, equal where they are, and xxhash64 of its text. Null text is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fps, same, mark = [], [], []
                for t in part.column(1):
                    text = t.as_py() or ""
                    fps.append(fingerprint(text, k, bits, distinct))
                    same.append(xxhash.xxh3_128_digest(b" ".join(text.encode().translate(_LOWER).split())))
                    mark.append(xxhash.xxh64_digest(text.encode(), SEED))
                marks = np.frombuffer(b"".join(mark), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary()), pa.array(same, pa.binary()), pa.array(marks)], ["doc_id", "fp", "same", "mark"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp binary, same binary, mark long")


def planes(words: np.ndarray) -> np.ndarray:
    """(n, w) words of 64 bits as (64 * w, n / 64) words, bit planes; n is filled up with zeros."""
    n = -(-len(words) // 64) * 64
    bits = np.zeros((n, words.shape[1] * 64), np.uint8)
    bits[: len(words)] = np.unpackbits(words.astype(">u8").view(np.uint8), axis=1)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b (n, w) that differ in `radius` bits at most; radius < 64.

    Counters are kept in carry-save form: c[i] holds bit i of 64 counts at once. They start so
    far below a power of two that the radius is exceeded as the last counter carries over."""
    sliced = planes(b)
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    left, right = [], []
    valid = np.packbits(np.arange(sliced.shape[1] * 64) < len(b)).view(np.uint64)
    step = max(1, 65536 // max(1, sliced.shape[1]))
    for at in range(0, len(a), step):
        rows = np.arange(at, min(at + step, len(a)))
        bits = np.unpackbits(a[rows].astype(">u8").view(np.uint8), axis=1).astype(bool)
        over = np.broadcast_to(~valid, (len(rows), sliced.shape[1])).copy()
        counts = [np.full_like(over, ones if start >> i & 1 else 0) for i in range(size)]
        for plane in range(len(sliced)):
            carry = sliced[plane][None, :] ^ np.where(bits[:, plane], ones, np.uint64(0))[:, None]
            for i in range(size):
                counts[i], carry = counts[i] ^ carry, counts[i] & carry
            over |= carry
            if plane % 8 == 7:
                alive = (over != ones).any(axis=1)
                if not alive.any():
                    break
                if alive.mean() < 0.5:
                    rows, bits, over, counts = rows[alive], bits[alive], over[alive], [c[alive] for c in counts]
        else:
            hit = np.unpackbits((~over).view(np.uint8), axis=1).astype(bool)
            i, j = np.nonzero(hit)
            left.append(rows[i])
            right.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component), one for each other node.

    Stars need fewer rounds of contraction than chains. A hub may have very many edges:
    components() aggregates them before the shuffle and splits them in its joins."""
    nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = ends[: len(i)], ends[len(i) :]
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), -1).astype(np.uint64)


def blocks_for(n: int, bits: int, radius: int) -> int:
    """The fewest blocks of bits of which any choice has the bits that n fingerprints need."""
    m = radius + 1
    while bits // m * (m - radius) < n.bit_length() - 2 and m < 2 * radius + 2:
        m += 1
    return m


def shown(fp: str, bits: int) -> Column:
    """The bits of a binary column as text."""
    return F.concat(*[F.lpad(F.conv(F.substring(F.hex(fp), 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(bits // 32)])


def block_keys(n: int, bits: int, radius: int) -> Column:
    """One key for each choice of blocks, of a column `shown`."""
    m = blocks_for(n, bits, radius)
    cut = [bits * i // m for i in range(m + 1)]
    choices = list(combinations(range(m), m - radius))
    return F.array(*[F.xxhash64(F.lit(k), F.concat(*[F.substring("shown", cut[i] + 1, cut[i + 1] - cut[i]) for i in c])) for k, c in enumerate(choices)])


def paired(rows: DataFrame, block: int) -> DataFrame:
    """rows with pair and side, for comparing those that share a `key` (long).

    Keys with one row are left out. A key with more than a block of rows is cut into blocks by
    id; each pair of blocks is a pair of its own, so that no task needs all rows of a key."""
    rows = written(rows, "keys")
    size = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    rows = rows.join(size, "key").withColumn("many", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(low == high, F.lit(0)).otherwise((F.col("block") == high).cast("int"))
    return rows.withColumn("side", side).withColumn("pair", F.xxhash64("key", low, high)).drop("many", "block", "other", "n", "key")


def linked(rows: DataFrame, radius: int, every: bool = False) -> DataFrame:
    """a, b: pairs of ids that share a key and whose fingerprints differ in `radius` bits at most.

    rows: id (long, unique), fp, keys (array of long). With every, all of them; else for each compared chunk as many as join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def compare(pair, side, ids, words):
            if side.any() and (pair == pair[0]).all():
                i, j = near_pairs(words[side == 0], words[side == 1], radius)
                i, j = ids[side == 0][i], ids[side == 1][j]
            else:
                i, j = near_pairs(words, words, radius)
                i, j = ids[i], ids[j]
            keep = i != j
            i, j = i[keep], j[keep]
            if len(i) and not every:
                i, j = forest(i, j)
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64())], ["a", "b"])

        def chunks(last: bool):
            """Whole pairs, many small ones together; the last pair waits for more rows."""
            pair, side, ids, words = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            ends = np.r_[starts[1:], len(pair)]
            stop = len(starts) if last else len(starts) - 1
            k = 0
            while k < stop:
                e = k + 1
                mixed = side[starts[k] : ends[k]].any()
                while e < stop and not mixed and ends[e] - starts[k] <= BLOCK and not side[starts[e] : ends[e]].any():
                    e += 1
                yield slice(starts[k], ends[e - 1]), pair, side, ids, words
                k = e
            if stop < len(starts):
                rest = slice(starts[stop], None)
                held.append((pair[rest], side[rest], ids[rest], words[rest]))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _words(batch.column(3).to_pylist())))
            for at, *columns in chunks(False):
                yield compare(*[c[at] for c in columns])
        if held:
            for at, *columns in chunks(True):
                yield compare(*[c[at] for c in columns])

    rows = paired(rows.select("id", "fp", F.explode("keys").alias("key")), BLOCK).select("pair", "side", "id", "fp")
    rows = rows.repartition("pair").sortWithinPartitions("pair", "side")
    return rows.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (binary), component_id for every row of docs.

    Documents whose fingerprints of k-word shingles differ in `radius` bits at most are linked;
    component_id is the smallest doc_id that links reach. Texts without words have fingerprint
    zero and are linked like any others. A null doc_id is larger than all others, and takes
    part; a component of only such rows has a null component_id. Equal fingerprints are one
    row from here on, so a group of copies, however large, is one fingerprint.
    """
    fps = written(fingerprints(docs, k).select("doc_id", "fp"), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # A class is named by its own fingerprint's bits, which order nothing; its least doc_id does.
    number = F.conv(F.hex("fp"), 16, -10).cast("long")
    classes = written(classes.select(number.alias("id"), "fp", "least"), "classes")
    keyed = classes.select("id", "fp", shown("fp", 64).alias("shown")).select("id", "fp", block_keys(classes.count(), 64, radius).alias("keys"))
    edges = linked(keyed, radius)
    groups = components(edges)
    member = classes.join(groups, F.col("id") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "id").alias("group"))
    member = written(member, "members")
    least = member.groupBy("group").agg(F.min("least").alias("component_id"))
    member = written(member.join(least, "group").select("fp", "component_id"), "members")
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def agreement(similarity: float) -> float:
    """The chance that a bit is equal in two sets of equal size with that Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def bands_for(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a band, bands): bands tell n fingerprints apart, and two texts of that very
    similarity share a band with chance `recall`; more similar ones share one more surely."""
    bits = max(12, n.bit_length() - 5)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agreement(similarity) ** bits))


def similar(sets: list[np.ndarray], others: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets with that Jaccard similarity or more; sets are sorted and distinct."""
    m, n = len(sets), len(others)
    sizes = np.array([len(s) for s in sets]), np.array([len(s) for s in others])
    values, at = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    owner = np.repeat(np.arange(m + n), np.concatenate(sizes))
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((m, n), np.float32)
    for low in range(0, len(values), 4096):
        s, e = np.searchsorted(at, [low, low + 4096])
        here = np.zeros((m + n, 4096), np.float32)
        here[owner[s:e], at[s:e] - low] = 1
        both += here[:m] @ here[m:].T
    return np.nonzero(both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(t.as_py(), k)], np.uint64)).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], ["key", "id", "shingles"])

    return docs.mapInArrow(run, "key long, id long, shingles binary")


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest doc_id.

    Texts whose sets of k-word shingles have that Jaccard similarity or more are linked, and
    links make groups; texts with the same words always are. Null text is the empty text. A
    null doc_id is larger than all others; rows of one doc_id and text are one document.
    Columns are those of docs, whatever their names. Pairs are found by bands of a wide
    fingerprint (`recall` is the chance for the least similar ones), compared bit by bit, and
    confirmed by their shingles; no group of copies meets as a whole in one task. Fingerprints are
    of distinct shingles, as the sets are, so a passage that a text repeats moves no bit.
    """
    n = docs.count()
    bits, bands = bands_for(n, similarity, recall)
    width = max(COMPARED, -(-bits * bands // 64) * 64)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    fps = written(fingerprints(docs, k, width, distinct=True), "fingerprints")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    classes = fps.groupBy("same").agg(F.min("doc_id").alias("least"), F.min_by("mark", first).alias("mark"), F.min("fp").alias("fp"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("shown", 1 + i * bits, bits)) for i in range(bands)])
    keyed = classes.select("id", "fp", shown("fp", width).alias("shown")).select("id", F.substring("fp", 1, COMPARED // 8).alias("fp"), keys.alias("keys"))
    chance = 1 - agreement(similarity)
    radius = math.ceil(COMPARED * chance + DEVIATIONS * math.sqrt(COMPARED * chance * (1 - chance)))
    groups = components(linked(keyed, radius))
    # One text for each class, that of its smallest doc_id.
    chosen = written(classes.join(groups, F.col("id") == F.col("node")).select("id", F.col("component").alias("key"), "least", "mark"), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("own"), mark.alias("own_mark"), "text")
    one = chosen.hint("shuffle_hash").join(texts, F.col("least").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark"))).select("key", "id", "text")
    sets = _sets(one, k).dropDuplicates(["key", "id"])

    def confirm(key, pdf):
        import pandas as pd

        own = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        ids, side = pdf["id"].to_numpy(), pdf["side"].to_numpy()
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if side.any() else first
        i, j = similar([own[x] for x in first], [own[x] for x in second], similarity)
        i, j = ids[first[i]], ids[second[j]]
        keep = i != j
        a, b = forest(i[keep], j[keep]) if keep.any() else (i[:0], j[:0])
        return pd.DataFrame({"a": a, "b": b})

    edges = paired(sets, TEXT_BLOCK).groupBy("pair").applyInPandas(confirm, "a long, b long")
    linked_ = components(written(edges, "links"))
    member = classes.join(linked_.withColumnRenamed("node", "id"), "id", "left").select("same", "least", "mark", F.coalesce("component", "id").alias("group"))
    member = written(member, "members")
    # The document of each group that stays; its doc_id may be null, or that of other groups too.
    first = F.struct(F.col("least").isNull(), "least", "mark")
    least = member.groupBy("group").agg(F.min("least").alias("least_of_group"), F.min_by("mark", first).alias("mark_of_group"))
    member = written(member.join(least, "group").select("same", "least_of_group", "mark_of_group"), "members")
    placed = fps.join(member, "same")
    chosen = F.col("doc_id").eqNullSafe(F.col("least_of_group")) & (F.col("mark") == F.col("mark_of_group"))
    its, of = fresh(docs.columns, "__id", "__mark")
    gone = written(placed.where(~chosen).select(F.col("doc_id").alias(its), F.col("mark").alias(of)).distinct(), "gone")
    stay = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(its)) & (mark == F.col(of)), "left_anti")
    # One document may be several rows.
    if placed.where(chosen).groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        own = stay.withColumn(its, F.col("doc_id").cast("long")).withColumn(of, mark)
        stay = own.dropDuplicates([its, of]).drop(its, of)
    return stay
