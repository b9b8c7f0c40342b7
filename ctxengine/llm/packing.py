"""Vector best-fit packing of documents into sequences of tokens.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths).
Pieces come in the order of decreasing length; each goes to the bin that it fits under every
capacity and whose residual vector after it has the smallest weighted norm, or the largest
weighted dot product with the piece. Pieces of one length are alike, and so are bins of one
residual vector, so the plan is made of runs: the driver sees a count for each length, at most
as many as a bin has tokens, and the plan's size does not follow the number of documents.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.llm.shared import written

#: The end of a document; pieces of a length that are ranked in one task.
END, BUCKET_ROWS = 0, 2000
#: Fixed value: how a byte-level vocabulary cuts text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the two engines of regular expressions may not both call white space.
UNLIKE = "[\x1c-\x1f\x85]"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents and attention cost, None for as much of these
    two as the tokens allow (a piece of all tokens costs their square, so a lower bound on the
    cost asks for shorter pieces). weights: of the residual tokens, documents and attention
    cost, each as a share of its capacity. score: `norm` or `dot`. The values here are those of
    the query: 512 documents bind where they have four tokens or fewer on average."""

    tokens: int = 2048
    docs: int | None = 512
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    score: str = "norm"

    def full(self) -> np.ndarray:
        return np.array([self.tokens, min(self.docs or self.tokens, self.tokens), self.attention or self.tokens**2], np.int64)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, all others, in their order, for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_merges(path: str):
    """The file's vocabulary for the faster of two libraries, or None where ids could differ:
    pieces must be byte-level ones, merged in the order of the ids that they make."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
    if model["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or made != sorted(made):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    code = byte_of()
    ranks = {bytes(code[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Texts to the bytes of their ids (little-endian, unsigned, 32 bits).

    The ids are those of the tokenizer of the file at `path`: none is added, and a text that
    holds the string of a special token has that token's id there. A faster library with the
    same vocabulary finds the ids where both are known to agree."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = same_merges(path)
        with open(path, encoding="utf-8") as f:
            added = [re.escape(t["content"]) for t in json.load(f).get("added_tokens", [])]
        self.slow = re.compile("|".join([UNLIKE, *added]))

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = {i: None for i, t in enumerate(texts) if self.fast is None or self.slow.search(t)}
        out = [b"" if i in slow else self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for i, t in enumerate(texts)]
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, tokens: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document's ids and END, cut into
    pieces of `tokens` where there are more; the first piece is the one that may be shorter.

    Null text is the empty text, whose only id is END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                out: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, stop, k = 0, (n - 1) % tokens + 1, 0
                    while start < n:
                        own = ids[4 * start : 4 * stop]
                        for column, value in zip(out, (doc, k, start, stop - start, zlib.crc32(own), own if keep_ids else None), strict=True):
                            column.append(value)
                        start, stop, k = stop, stop + tokens, k + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


def plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, pieces in each bin, offset): the piece of
    rank k goes to bin first + (k - first rank) // each, behind `offset` and those before it.

    Equal to best-fit over single pieces: as the bin just served has the smallest residual, it
    is served again while it can be, and so is each bin of its kind in turn."""
    full = capacity.full()
    weights = np.array(capacity.weights) / full.astype(float) ** 2
    runs = []
    state = np.zeros((0, 3), np.int64)  # residuals of a run of bins
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length**2], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity {full.tolist()}")
        rank, count = 0, counts[length]
        while rank < count:
            fits = np.flatnonzero((state >= need).all(axis=1))
            if len(fits):
                rest = (state[fits] - need).astype(float)
                score = (rest**2 @ weights) if capacity.score == "norm" else -(state[fits].astype(float) * need @ weights)
                at = int(fits[np.lexsort((first[fits], score))[0]])
                each = int((state[at] // need).min()) if capacity.score == "norm" else 1
            else:
                # Nothing else fits, so a new bin is filled up before the next one is opened.
                each = int((full // need).min())
                extra = -(-(count - rank) // each)
                state, first, many = np.vstack([state, full]), np.append(first, bins), np.append(many, extra)
                bins += extra
                at = len(state) - 1
            left = count - rank
            whole = min(int(many[at]), left // each)
            served = []
            if whole:
                served.append((whole, each))
            if whole < many[at] and left - whole * each > 0 and left - whole * each < each:
                served.append((1, left - whole * each))
            bin0, offset, was, had = int(first[at]), int(full[0] - state[at][0]), state[at].copy(), int(many[at])
            new_state, new_first, new_many = [], [], []
            for n, k in served:
                runs.append((length, rank, rank + n * k, bin0, k, offset))
                rank += n * k
                new_state.append(was - k * need)
                new_first.append(bin0)
                new_many.append(n)
                bin0, had = bin0 + n, had - n
            if had:
                new_state.append(was)
                new_first.append(bin0)
                new_many.append(had)
            state = np.vstack([np.delete(state, at, 0), *new_state])
            first = np.append(np.delete(first, at), new_first)
            many = np.append(np.delete(many, at), new_many)
            open_ = (state > 0).all(axis=1)
            state, first, many = state[open_], first[open_], many[open_]
    return runs


def buckets_of(n: int) -> int:
    """Buckets for n pieces of a length: neither their number nor their rows grow faster than
    the square root of n."""
    return 1 if n <= BUCKET_ROWS else math.isqrt(n)


def packed(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset, a row for every piece.

    Ranks within a length are found without its rows meeting: a length with many is cut into
    buckets by a hash, the buckets' sizes give their offsets. Only the counts of lengths reach
    the driver, and what is broadcast is bounded by the capacity in tokens: a row for each
    length and the plan's runs.
    Repeated rows are documents of their own. An empty table gives an empty one."""
    spark = docs.sparkSession
    own = pieces(docs, tokenizer, capacity.tokens, keep_ids)
    # The partition keeps rows that are equal in all else from meeting in one bucket.
    rows = written(own.withColumn("part", F.spark_partition_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "run_length long, first long, end long, bin long, each long, at long")
    # A row for each length, so this is as small as the capacity in tokens.
    cut = spark.createDataFrame([(k, buckets_of(n)) for k, n in counts.items()], "length long, buckets long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "part"), F.col("buckets"))
    cut_up = rows.join(F.broadcast(cut), "length").withColumn("bucket", bucket)
    parts = cut_up.where("buckets > 1").groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(parts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut_up.join(offsets, ["length", "bucket"], "left").withColumn("rank", F.coalesce("before", F.lit(0)) + F.row_number().over(within) - 1)
    here = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first"), F.col("end") - 1))
    sequence = F.col("bin") + F.floor(here / F.col("each"))
    offset = F.col("at") + F.pmod(here, F.col("each")) * F.col("length")
    return placed.select(*own.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), doc_ids: packed() with keep_ids, pieces joined in their order."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    out = rows.groupBy("sequence_id").agg(inside.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return out.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """packed() with the capacities of the query and the public byte-level vocabulary."""
    import public_tokenizers

    return packed(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
