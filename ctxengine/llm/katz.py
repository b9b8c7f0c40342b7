"""LM scoring: a Katz back-off model of words, trained and applied over all documents.

Documents are read once, into blocks of tokens. Level by level, a block sends its distinct
n-grams to the buckets of the model, with their counts in training documents and what the
level below says of them; a bucket adds up what all blocks sent, keeps it as a part of the
model's table, and answers each block's n-grams in the order in which they came. A block then
evaluates the recursion for each of its tokens.

A history's n-grams go to one bucket, a frequent history's to as many as its count asks for,
each of which answers its part of the history's sums. So neither a frequent word nor a
frequent pair makes a bucket large, and sums over whole histories, which exactly normalised
back-off weights need, reach every block that has the history.

Words are known by 64 bits of hash, longer n-grams by the number that a bucket gives them:
two words of n would share a hash with chance n^2 / 2^65.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxengine.llm.shared import written

#: Counts up to K are discounted; every FOLDS-th remainder HELD is held out.
K, FOLDS, HELD = 5, 7, 2
#: Tokens of a block, about; tokens for each bucket of the model, about.
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: The history of a document's first token.
START = 2**62
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TYPES = ("<u1", "<u2", "<u4", "<u8", "<f8")


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, all first bytes of the values, then all second ones, and so
    on; whole numbers in the fewest bytes that hold them."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        if a.dtype.kind != "f":
            top = int(a.max()) if len(a) else 0
            a = a.astype(next(t for t in _TYPES if top < 256 ** int(t[2])))
        kind = _TYPES.index(a.dtype.str if a.dtype.itemsize > 1 else "<u1")
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        out += [bytes([kind]), len(a).to_bytes(8, "little"), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    out, at = [], 2
    for _ in range(int.from_bytes(raw[:2], "little")):
        kind, n = np.dtype(_TYPES[raw[at]]), int.from_bytes(raw[at + 1 : at + 9], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 9).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 9 + n * kind.itemsize
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) as blocks: doc_ids, held_out, tokens of each document; the
    hashes of the block's distinct words; each token's place among them. The end of a document
    is a token; its word is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, sizes, tokens, numbers, made = [], [], [], [], _Numbers(), 0

        def block():
            nonlocal made
            words = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
            order = np.argsort(words)
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            name = f"{TaskContext.get().partitionId()}-{made}"
            made += 1
            row = [[name], [ids], [held], [sizes], [_pack(words[order])], [_pack(place[np.concatenate(tokens)])]]
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["block", "ids", "held", "sizes", "words", "tokens"])

        count = 0
        for batch in batches:
            for doc, text, out in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                own = (text.as_py() or "").encode().translate(_LOWER).split()
                own.append(b"")
                tokens.append(np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own)))
                ids.append(doc.as_py())
                held.append(out.as_py())
                sizes.append(len(own))
                count += len(own)
                if count >= BLOCK_TOKENS:
                    yield block()
                    ids, held, sizes, tokens, numbers, count = [], [], [], [], _Numbers(), 0
        if ids:
            yield block()

    return docs.mapInArrow(run, "block string, ids array<long>, held array<boolean>, sizes array<long>, words binary, tokens binary")


class Level:
    """What all blocks know of a level: how much was counted, and its discounts."""

    def __init__(self, tokens: int, types: int, counts: list[int]):
        self.tokens, self.types = tokens, types
        self.discount = discounts(counts)


def discounts(counts: list[int]) -> np.ndarray:
    """Of counts 0..K+1 (the last for all above K), from the numbers of n-grams with counts
    1..K+1. Where Good-Turing does not give a value between 0 and 1 (too few n-grams), a count
    r loses half an occurrence."""
    out = np.ones(K + 2)
    n = [0, *counts]
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def weights(sums: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrences, back-off weight, factor of discounted counts) of histories.

    sums: how many followers have counts 1..K, occurrences of the others, and the probability
    at the level below of all followers; a column for each history. A history whose followers
    all have higher counts leaves nothing to back off with: one occurrence is added for it.
    One whose followers are all words there are leaves nothing to back off to."""
    r = np.arange(1, K + 1)[:, None]
    occurrences = (r * sums[:K]).sum(0) + sums[K]
    kept = (r * discount[1 : K + 1, None] * sums[:K]).sum(0) + sums[K]
    rest = 1 - sums[K + 1]
    scale = np.where(kept >= occurrences - 1e-9, occurrences / (occurrences + 1), 1.0)
    scale = np.where((rest <= 1e-12) & (kept > 0), occurrences / np.maximum(kept, 1e-300), scale)
    left = (1 - kept * scale / np.maximum(1, occurrences)) / np.where(rest > 1e-12, rest, 1)
    return occurrences, np.where(occurrences > 0, np.where(rest > 1e-12, left, 0.0), 1.0), scale


class Block:
    """A block's tokens, and what the levels so far say of them."""

    def __init__(self, sizes, held, words: bytes | None, tokens: bytes, buckets: int):
        self.buckets = buckets
        self.token = _unpack(tokens)[0].astype(np.int32)
        self.words = None if words is None else _unpack(words)[0]
        sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.place = (np.arange(len(self.token)) - np.repeat(self.starts, sizes)).astype(np.int32)
        self.train = np.repeat(~np.asarray(held, bool), sizes)
        self.p = np.zeros(len(self.token))
        self.level = 0

    def ask(self, total: int) -> list[tuple[int, bytes]]:
        """(bucket, message) of the next level's n-grams; total: all training tokens."""
        self.level = k = self.level + 1
        if k == 1:
            self.valid = np.arange(len(self.token))
            history, many = np.zeros(len(self.token), np.uint64), None
            word = self.words
        else:
            self.valid = np.flatnonzero(self.place >= k - 2).astype(np.int32)
            before = self.valid - 1
            first = self.place[self.valid] == 0
            history = np.where(first, np.uint64(START), self.gram[before]).astype(np.uint64)
            many = np.where(first, total, self.count[before].astype(np.int64))
            word = self.word_id
        self.heads, at, head = np.unique(history, return_index=True, return_inverse=True)
        del history
        head *= len(word)
        head += self.token[self.valid]
        pair, first_at, inverse = np.unique(head, return_index=True, return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        del head, inverse
        head, own = pair // len(word), pair % len(word)
        self.entry_head = head
        counted = np.bincount(self.inverse, self.train[self.valid], len(pair)).astype(np.int64)
        key = word[own].astype(np.uint64)
        # A frequent history has parts, a part for each share of the tokens that a bucket gets.
        self.parts = np.full(1, self.buckets) if many is None else np.clip(-(-many[at] * 2 * self.buckets // max(1, total)), 1, self.buckets)
        offset = np.cumsum(self.parts) - self.parts
        if k == 1:
            share = (key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        else:
            share = _mix(key) % self.parts[head].astype(np.uint64)
        group = offset[head] + share.astype(np.int64)
        self.group_head = np.repeat(np.arange(len(self.heads)), self.parts)
        part = np.arange(len(self.group_head)) - offset[self.group_head]
        bucket = part if k == 1 else (_mix(self.heads)[self.group_head].astype(np.int64) + part) % self.buckets
        self.group_order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(self.group_order)
        rank[self.group_order] = np.arange(len(rank))
        self.order = np.lexsort((key, rank[group]))
        self.low = self.p[self.valid][first_at]
        size = np.bincount(rank[group], minlength=len(rank))
        group_cut = np.searchsorted(bucket[self.group_order], np.arange(self.buckets + 1))
        cut = np.concatenate([[0], np.cumsum(size)])[group_cut]
        out = []
        for b in range(self.buckets):
            g, e = slice(group_cut[b], group_cut[b + 1]), self.order[cut[b] : cut[b + 1]]
            if g.start < g.stop:
                values, code = np.unique(self.low[e], return_inverse=True)
                out.append((b, _pack(self.heads[self.group_head[self.group_order[g]]], size[g], key[e], counted[e], values, code)))
        self.cuts = {b: (slice(group_cut[b], group_cut[b + 1]), slice(cut[b], cut[b + 1])) for b, _ in out}
        return out

    def _first(self, answers: list[tuple[int, bytes]]):
        """Counts, numbers and sums of the first level, without the question."""
        self.level, self.valid, self.inverse = 1, np.arange(len(self.token)), self.token
        heard = [_unpack(raw) for _, raw in sorted(answers)]
        count = np.concatenate([a[0] for a in heard]).astype(np.int64)
        if len(answers) != self.buckets or len(count) <= self.token.max():
            raise RuntimeError("a block's answers are not those to its questions")
        self.entry_head, self.low = np.zeros(len(count), np.int64), np.zeros(len(count))
        sums = np.array([[np.concatenate([a[2 + i] for a in heard]).sum()] for i in range(K + 2)], float)
        return count, np.concatenate([a[1] for a in heard]).astype(np.uint64), sums

    def _next(self, answers: list[tuple[int, bytes]]):
        count = np.zeros(len(self.order), np.int64)
        number = np.zeros(len(self.order), np.uint64)
        sums = np.zeros((K + 2, len(self.heads)))
        if sorted(b for b, _ in answers) != sorted(self.cuts):
            raise RuntimeError("a block's answers are not those to its questions")
        for b, raw in answers:
            g, e = self.cuts[b]
            counts, numbers, *stats = _unpack(raw)
            count[self.order[e]] = counts
            if len(numbers):
                number[self.order[e]] = numbers
            head = self.group_head[self.group_order[g]]
            for i, s in enumerate(stats):
                sums[i] += np.bincount(head, s, len(self.heads))
        return count, number, sums

    def hear(self, answers: list[tuple[int, bytes]], level: Level) -> None:
        """Takes the buckets' answers; p is then the probability of each token at this level."""
        count, number, sums = self._next(answers) if self.level else self._first(answers)
        occurrences, left, scale = weights(sums, level.discount)
        entry_head = self.entry_head
        seen = count > 0
        own = level.discount[np.minimum(count, K + 1)] * count * scale[entry_head] / np.maximum(1, occurrences[entry_head])
        p = np.where(seen, own, left[entry_head] * (self.low if self.level > 1 else 1.0))
        self.p[self.valid] = p[self.inverse]
        gram, many = np.zeros(len(self.token), np.uint64), np.zeros(len(self.token), np.int32)
        gram[self.valid], many[self.valid] = number[self.inverse], count[self.inverse]
        self.gram, self.count = gram, many
        del p, own
        if self.level == 1:
            self.word_id, self.known = number, many

    def scores(self, log: np.ndarray) -> np.ndarray:
        return np.add.reduceat(log, self.starts)


def answer(bucket: int, buckets: int, blocks: list[str], messages: list[bytes], last: bool):
    """Of what all blocks sent to a bucket: ((block, answer) for each, its table, its sums).

    The last level's n-grams need no numbers."""
    asked = [_unpack(m) for m in messages]
    heads = np.concatenate([np.repeat(a[0], a[1].astype(np.int64)) for a in asked]).astype(np.uint64)
    words = np.concatenate([a[2] for a in asked]).astype(np.uint64)
    counts = np.concatenate([a[3] for a in asked]).astype(np.int64)
    low = np.concatenate([a[4][a[5]] for a in asked])
    head, head_at = np.unique(heads, return_inverse=True)
    word, word_at = np.unique(words, return_inverse=True)
    pair, first, at = np.unique(head_at * max(1, len(word)) + word_at, return_index=True, return_inverse=True)
    total = np.bincount(at, counts, len(pair)).astype(np.int64)
    of = pair // max(1, len(word))
    stats = np.zeros((K + 2, len(head)))
    for r in range(1, K + 1):
        stats[r - 1] = np.bincount(of[total == r], minlength=len(head))
    stats[K] = np.bincount(of, np.where(total > K, total, 0), len(head))
    stats[K + 1] = np.bincount(of, np.where(total > 0, low[first], 0), len(head))
    cut, out = 0, []
    for name, a in zip(blocks, asked, strict=True):
        own = at[cut : cut + len(a[2])]
        cut += len(a[2])
        asks = np.searchsorted(head, a[0])
        there = np.zeros(len(a[0]), bool) if not len(head) else head[np.minimum(asks, len(head) - 1)] == a[0]
        sums = stats[:, np.minimum(asks, max(0, len(head) - 1))] * there if len(head) else np.zeros((K + 2, len(a[0])))
        numbers = np.zeros(0, np.uint64) if last else bucket + buckets * own.astype(np.uint64)
        out.append((name, _pack(total[own], numbers, *sums[: K + 1].astype(np.int64), sums[K + 1])))
    seen = total > 0
    table = _pack(head[of[seen]], word[(pair % max(1, len(word)))[seen]], total[seen])
    summed = [int(total.sum()), int(seen.sum()), *[int((total == r).sum()) for r in range(1, K + 2)]]
    return out, table, summed


_ANSWERS = "kind string, level int, bucket int, block string, message binary, sums array<long>"


def _answered(asked: DataFrame, level: int, buckets: int, last: bool) -> tuple[DataFrame, Level]:
    """The level's answers, and what was counted; tables and answers are parts of one table."""

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        bucket = int(pdf["bucket"].iloc[0])
        out, table, summed = answer(bucket, buckets, pdf["block"].tolist(), pdf["message"].tolist(), last)
        rows = [("answer", level, bucket, name, m, None) for name, m in out] + [("table", level, bucket, None, table, summed)]
        return pd.DataFrame(rows, columns=["kind", "level", "bucket", "block", "message", "sums"])

    done = written(asked.groupBy("bucket").applyInPandas(run, _ANSWERS), f"katz-{level}", "kind")
    sums = done.where("kind = 'table'").select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = {r["i"]: r["n"] for r in sums}
    return done, Level(n.get(0, 0), n.get(1, 0), [n.get(2 + i, 0) for i in range(K + 1)])


def _released(spark) -> None:
    """Shuffle files go when the plans that wrote them are garbage; each level's are large."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scored(docs: DataFrame, order: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """(scores, model): a row of scores for every row of docs (doc_id, text, held_out), and for
    each level its table (bucket, message), a part for each bucket: histories, words, counts.

    Trained on documents that are not held out. Scores: n_tokens, n_known, train_tokens,
    base_score, score. Null text is the empty text, which is its end alone. An empty table
    gives an empty one. Unknown words are one word; with nothing to train on, it is certain.
    """
    spark = docs.sparkSession
    blocks = written(blocks_of(docs), "blocks")
    tokens = blocks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = int(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / BUCKET_TOKENS)))
    levels: list[Level] = []
    answers: DataFrame | None = None
    tables = []

    def state(block, heard) -> Block:
        own = Block(block["sizes"], block["held"], block.get("words"), block["tokens"], buckets)
        for k, level in enumerate(levels):
            if k:
                own.ask(levels[0].tokens)
            own.hear([(b, m) for lv, b, m in heard if lv == k + 1], level)
        return own

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sent = state(row, []).ask(0)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array([row["block"]] * len(sent), pa.string()), pa.array([m for _, m in sent], pa.binary())], ["bucket", "block", "message"])

    def following(left, right):
        import pandas as pd

        heard = list(zip(right["level"].tolist(), right["bucket"].tolist(), right["message"].tolist(), strict=True))
        sent = [(b, row["block"], m) for _, row in left.iterrows() for b, m in state(row, heard).ask(levels[0].tokens)]
        return pd.DataFrame(sent, columns=["bucket", "block", "message"])

    def last(left, right):
        import pandas as pd

        heard = list(zip(right["level"].tolist(), right["bucket"].tolist(), right["message"].tolist(), strict=True))
        out = []
        for _, row in left.iterrows():
            own = state(row, heard)
            n, v = levels[0].tokens, levels[0].types
            ids = pd.array([None if x is None or x != x else int(x) for x in row["ids"]], dtype="Int64")
            base = own.scores(np.log10((own.known + 1) / (n + v + 1)))
            known = own.scores((own.known > 0).astype(np.int64))
            out.append(pd.DataFrame({"doc_id": ids, "held_out": row["held"], "n_tokens": row["sizes"], "n_known": known, "train_tokens": n, "base_score": base, "score": own.scores(np.log10(own.p))}))
        return pd.concat(out)

    for k in range(1, order + 1):
        if k == 1:
            asked = blocks.mapInArrow(first, "bucket int, block string, message binary")
        else:
            asked = blocks.drop("words").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(following, "bucket int, block string, message binary")
        done, level = _answered(asked, k, buckets, 1 < k == order)
        del asked
        _released(spark)
        levels = [*levels, level]
        own = done.where("kind = 'answer'").select("level", "bucket", "block", "message")
        answers = own if answers is None else answers.unionByName(own)
        tables.append(done.where("kind = 'table'").select("level", "bucket", "message"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.drop("words").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(last, schema), tables


def report(docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per document; those are held out whose doc_id, as text, has that remainder."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    return scored(rows, order)[0]
