"""The pipeline's near-dedup against brute force, and the stages one after the other."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ctxengine.llm import simhash
from tests.llm.common import SCHEMA, SF, docs, lower, odd, words


def shingle_set(text, k=5):
    w = words(lower(text))
    return frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([" ".join(w)] if w else [])


def plain_kept(rows, similarity=0.8):
    """doc_ids that stay: the least of each group."""
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= similarity * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {find(d) for d in keys}


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(4000)}" for _ in range(260)]
    extra = []
    for i in range(60):
        own = list(base)
        for _ in range(i % 8):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        extra.append((7000 + i, " ".join(own), "en", "s", 0))
    df = docs(spark, 200).where("doc_id is not null and doc_id <> 9006").unionByName(spark.createDataFrame(extra, SCHEMA))
    got = [r["doc_id"] for r in simhash.deduplicated(df).collect()]
    want = plain_kept([(r["doc_id"], r["text"]) for r in df.collect()])
    assert Counter(got) == Counter(want)
    assert len(want) < df.count() - 40


def test_near_dedup_odd_rows(spark):
    df = odd(spark).withColumn("fp", F.lit(1)).withColumn("same", F.lit(2)).withColumn("mark", F.lit(3)).withColumn("key", F.lit(4))
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    # Three texts without words are one group, three equal ones another.
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([9001, 9004, 9005, 9007, 9008, 9009, None])
    assert not simhash.deduplicated(odd(spark).limit(0)).count()
    mark = simhash.fingerprints(odd(spark), 5, 128).join(odd(spark).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")), "doc_id")
    assert all(r["mark"] == r["m"] for r in mark.collect())


def test_near_dedup_of_repeated_passages(spark):
    rng = random.Random(6)
    rows, want = [], []
    for i in range(30):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(304))
        passage = " ".join(text.split()[:14])
        rows += [(2 * i, text, "en", "s", 0), (2 * i + 1, text + (" " + passage) * 20, "en", "s", 0)]
        want.append(2 * i)
    assert plain_kept([r[:2] for r in rows]) == set(want)
    got = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == want


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (None, texts[1].upper())]
    rows += [(7, texts[5]), (7, texts[6]), (7, texts[7]), (8, texts[7]), (9, texts[8]), (9, texts[8])]
    rows += [(3, texts[9]), (3, texts[9] + " "), (None, texts[9]), (2, texts[10]), (1, texts[10]), (4, texts[11])]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"].lower().strip()) for r in simhash.deduplicated(df).collect()]
    want = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:8]] + [(9, texts[8]), (3, texts[9]), (1, texts[10]), (4, texts[11])]
    assert Counter(got) == Counter(want)


CLASHES = ("__id", "__mark", "__blob", "__hits", "id", "mark", "hits", "blob", "key", "size", "k_0")


def test_stages_keep_clashing_columns(spark):
    df = docs(spark, 40)
    with_more = df.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, with_more, SF)
        assert out.columns == with_more.columns, name
        got, want = out.collect(), stage(spark, df, SF).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in want), name
        assert all(r["__id"] == "-".join(["__id"] + [str(r["doc_id"])] * (r["doc_id"] is not None)) for r in got), name
        assert all(r["__hits"].startswith("__hits") and r["__blob"].startswith("__blob") for r in got), name


def test_recall_of_planted_pairs(spark):
    """Pairs at 0.8 to 0.9, the least similar that count, found among unrelated texts."""
    rng = random.Random(11)
    rows, pairs = [], []
    for i in range(300):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
        other = list(text)
        while True:
            changed = list(other)
            changed[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            x, y = shingle_set(" ".join(text)), shingle_set(" ".join(changed))
            if len(x & y) < 0.8 * len(x | y):
                break
            other = changed
        x, y = shingle_set(" ".join(text)), shingle_set(" ".join(other))
        assert 0.8 <= len(x & y) / len(x | y) < 0.9
        rows += [(2 * i, " ".join(text), "en", "s", 0), (2 * i + 1, " ".join(other), "en", "s", 0)]
        pairs.append(2 * i + 1)
    got = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {2 * i for i in range(300)} <= got
    assert sum(p not in got for p in pairs) >= 0.95 * len(pairs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=12), st.integers(0, 12), st.sampled_from([0.5, 0.8, 1.0]))
def test_similar(sets, cut, similarity):
    a, b = sets[:cut], sets[cut:]
    if not a or not b:
        return
    i, j = simhash.similar([np.array(sorted(s), np.uint64) for s in a], [np.array(sorted(s), np.uint64) for s in b], similarity)
    assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(len(a)) for y in range(len(b)) if len(a[x] & b[y]) >= similarity * len(a[x] | b[y]) - 1e-9]


def test_stages(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = df.columns, df.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF).cache()
        assert df.columns == columns, name
        if name in ("language_id", "simhash_dedup", "secret_scan"):
            assert 0.8 * before < df.count() <= before, name
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and set(out["doc_id"]) <= set(range(before))
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.cumsum([0, *own["length"]])[:-1].tolist() and own["length"].sum() <= 2048
    assert set(corpus_pipeline.run(spark, SF).toPandas()["doc_id"]) == set(out["doc_id"])
