"""SimHash: fingerprints, bit-sliced comparison and groups against plain Python."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxengine.llm import simhash
from tests.llm.common import SCHEMA, docs, lower, odd, words


def plain_fingerprint(text, k=3):
    w = words(lower(text))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, radius):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_groups_equal_brute_force(spark):
    near = [(8000 + i, "alpha beta gamma delta " * 50 + " ".join(f"w{j}" for j in range(60)) + f" tail{i % 9}", "en", "s", 0) for i in range(40)]
    df = docs(spark).where("doc_id is not null").unionByName(spark.createDataFrame(near, SCHEMA))
    got = {r["doc_id"]: r for r in simhash.report(df).collect()}
    data = {r["doc_id"]: r["text"] for r in df.collect()}
    fps = {d: plain_fingerprint(t) for d, t in data.items()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == fps
    want = plain_groups(fps, 3)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert len(set(want.values())) < len(want) - 10
    assert got[9001]["fingerprint"] == "0" * 16


def test_null_ids_and_empty(spark):
    out = simhash.report(odd(spark)).collect()
    assert len(out) == 11 and sum(r["doc_id"] == 9006 for r in out) == 2
    assert {r["component_id"] for r in out if r["doc_id"] in (9005, 9006)} == {9005}
    assert not simhash.report(odd(spark).limit(0)).count()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 150), st.integers(0, 12), st.integers(0, 2**32), st.sampled_from([1, 2, 4]))
def test_bit_sliced_comparison(n, m, radius, seed, width):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (3, width), dtype=np.uint64)
    flips = (rng.random((n + m, width, 64)) < rng.choice([0.01, 0.08])) @ (1 << np.arange(64, dtype=np.uint64))
    x = base[rng.integers(0, 3, n + m)] ^ flips.astype(np.uint64)
    i, j = simhash.near_pairs(x[:n], x[n:], radius)
    distance = np.bitwise_count(x[:n][:, None] ^ x[n:][None]).sum(2)
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(p) for p in np.argwhere(distance <= radius).tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)).filter(lambda x: x[0] != x[1]), min_size=1))
def test_forest_keeps_components(edges):
    i, j = (np.array(x) for x in zip(*edges))
    a, b = simhash.forest(i, j)
    def groups(pairs):
        root = {}
        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x
        for x, y in pairs:
            root[find(x)] = find(y)
        out = {}
        for x in root:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))
    assert groups(edges) == groups(zip(a.tolist(), b.tolist())) and (a > b).all()
    assert max(np.unique(a, return_counts=True)[1]) == 1


@pytest.mark.parametrize("block", [8, 1024])
def test_hot_keys_are_cut_into_pairs_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = {int(i): int(v) for i, v in enumerate(np.unique(np.concatenate([rng.integers(0, 2**63, 80, dtype=np.uint64), np.uint64(77 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))])))}
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in x.items()], "id long, fp binary")
    keyed = df.select("id", "fp", simhash.shown("fp", 64).alias("shown")).select("id", "fp", simhash.block_keys(len(x), 64, 3).alias("keys"))
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.linked(keyed, 3, every=True).collect()}
    assert got == {(a, b) for a in x for b in x if a < b and (x[a] ^ x[b]).bit_count() <= 3}
