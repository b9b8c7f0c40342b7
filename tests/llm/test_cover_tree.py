"""Cover trees against all pairs."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxengine.llm import cover_tree
from tests.llm.common import SF


def cloud(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, dim))
    x = heads[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 90), st.integers(1, 90), st.integers(2, 12), st.sampled_from([0.0, 1e-3, 0.1, 0.3, 2.0]), st.integers(0, 2**32), st.sampled_from([0.8, 0.95, 0.999]))
def test_walk_finds_exactly_the_pairs(n, m, dim, spread, seed, cosine):
    z = cloud(seed, n + m, dim, spread)
    x, y = z[:n], z[n:]
    a, b = cover_tree.Tree(x), cover_tree.Tree(y)
    for t, own in ((a, x), (b, y)):
        assert sorted(t.order.tolist()) == list(range(len(own)))
        for k in range(len(t.centre)):
            below = own[t.order[t.low[k] : t.high[k]]]
            assert (np.linalg.norm(below - own[t.centre[k]], axis=1) <= t.radius[k] + 1e-8).all()
    near = x @ y.T
    if (np.abs(near - cosine) < 1e-9).any():
        return
    found = cover_tree.Found(np.ones(n, int), np.full(m, 2), False)
    cover_tree.walk(a, x, b, y, cosine, found)
    assert found.cx.tolist() == (2 * (near >= cosine).sum(1)).tolist() and found.cy.tolist() == (near >= cosine).sum(0).tolist()
    own = x @ x.T
    if (np.abs(own - cosine) < 1e-9).any():
        return
    found = cover_tree.Found(np.ones(n, int), np.ones(n, int), True)
    cover_tree.walk(a, x, a, x, cosine, found)
    assert found.cx.tolist() == ((own >= cosine).sum(1) - 1).tolist()


def plain(rows, cosine):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    dim = max((len(v) for _, v in good), default=1)
    x = np.array([np.pad(v, (0, dim - len(v))) / np.linalg.norm(v) for _, v in good])
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    group = np.arange(len(good))
    for _ in good:
        group = np.array([min(group[k], *group[link[k]], group[k]) for k in range(len(good))])
    out = [(i, int(link[k].sum()), min(good[j][0] for j in range(len(good)) if group[j] == group[k])) for k, (i, _) in enumerate(good)]
    used = {i for i, _ in good}
    return sorted(out + [(i, 0, i) for i, _ in rows if i not in used])


@pytest.mark.parametrize("block", [16, 4096])
def test_report(spark, block):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).collect()]
    x = cloud(3, 80, 64, 0.02)
    rows += [(1000 + k, v.tolist()) for k, v in enumerate(x)] + [(2000 + k, x[0].tolist()) for k in range(9)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] * 64), (3004, [None] + [1.0] * 63), (3005, [float("inf")] * 64), (3006, [1.0, 0.0]), (3007, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = cover_tree.report(df, block=block).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and sum(r["n_links"] > 0 for r in got) > 80


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.report(df).collect())
    assert got == [("5", 2, 5, True), ("5", 2, 5, True), ("7", 0, 7, True), ("None", 2, 5, False)]
    assert not cover_tree.report(df.limit(0)).count()


def planted(kind, seed, n, dim):
    """Unit vectors of a kind, a few of them again at cosines around 0.95, and a crowd of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if kind == "mean":
        x += 1.5 * rng.normal(size=dim)
    elif kind == "flat":
        x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, dim)) + 0.05 * x
    elif kind == "two":
        x[: n // 2] += 3 * rng.normal(size=dim)
    x[: n // 20] = x[0] + 0.1 * rng.normal(size=(n // 20, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k, c in enumerate(np.tile([0.9499999, 0.9500001, 0.96, 0.94], n // 40)):
        away = rng.normal(size=dim)
        away -= away @ x[-1 - k] * x[-1 - k]
        x[n // 2 + k] = c * x[-1 - k] + np.sqrt(1 - c * c) * away / np.linalg.norm(away)
    return x[rng.permutation(n)]


@pytest.mark.parametrize("kind", ["noise", "mean", "flat", "two"])
@pytest.mark.parametrize("dim", [3, 64, 200])
def test_directions_lose_no_pair(kind, dim):
    z = planted(kind, dim, 5000, dim)
    x, y = z[:2600], z[2600:]
    near = x @ y.T
    a, b = (cover_tree.Tree(own) for own in (x, y))
    for t, own in ((a, x), (b, y)):
        assert sorted(t.order.tolist()) == list(range(len(own)))
        for k in np.flatnonzero(t.high - t.low > 1):
            below = own[t.order[t.low[k] : t.high[k]]]
            assert (np.linalg.norm(below - own[t.centre[k]], axis=1) <= t.radius[k] + 1e-8).all()
    found = cover_tree.Found(np.full(len(x), 3), np.full(len(y), 2), False)
    cover_tree.walk(a, x, b, y, 0.95, found)
    assert found.cx.tolist() == (2 * (near >= 0.95).sum(1)).tolist() and found.cy.tolist() == (3 * (near >= 0.95).sum(0)).tolist()
    found = cover_tree.Found(np.ones(len(y), int), np.ones(len(y), int), True)
    cover_tree.walk(b, y, b, y, 0.95, found)
    assert found.cx.tolist() == ((y @ y.T >= 0.95).sum(1) - 1).tolist() and found.cx.any()
    reach, basis = np.sqrt(0.1), cover_tree._basis(z, np.sqrt(0.1), 4.5)
    (c, r, n, home), (d, q, _, other) = cover_tree.balls(x), cover_tree.balls(y)
    assert (np.linalg.norm(x - x[c][home], axis=1) <= r[home]).all() and (n == np.bincount(home)).all()
    i, j = np.nonzero(near >= 0.95)
    ours, theirs = cover_tree.sift(x[c] @ basis, r, y[d] @ basis, q, reach, 3)
    assert ours[home[i]].all() and theirs[other[j]].all()
    i, j = np.nonzero((x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool))
    ours, theirs = cover_tree.sift(x[c] @ basis, r, x[c] @ basis, r, reach, 3, n == 1)
    assert ours[home[i]].all() and theirs[home[j]].all()
    if kind == "noise" and dim == 64:
        assert ours.sum() < len(ours) / 4  # vectors without a near one stay where they are


NOISE = """
import time
import numpy as np
from ctxengine.llm import cover_tree
from tests.llm.test_cover_tree import planted

z = planted("noise", 1, 10000, 64)
x, y = z[:5000], z[5000:]
a, b = cover_tree.Tree(x), cover_tree.Tree(y)
found = cover_tree.Found(np.ones(len(x), int), np.ones(len(y), int), False)
at = time.process_time()
cover_tree.walk(a, x, b, y, 0.95, found)
walked = time.process_time() - at
at = time.process_time()
near = x @ y.T >= 0.95
plain = time.process_time() - at
assert found.cx.tolist() == near.sum(1).tolist()
print(walked, plain)
"""


def test_noise_costs_less_than_its_products():
    """In noise no ball leaves anything out; still a walk must cost less than all products. One thread, as in a task."""
    done = subprocess.run([sys.executable, "-c", NOISE], cwd=Path(__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}, capture_output=True, text=True, check=True)
    walked, plain = map(float, done.stdout.split())
    assert walked < plain


def test_large_ids(spark):
    ids = [2**60 + k for k in range(40)]
    x = planted("noise", 2, 40, 8)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, n long, v array<double>")
    counts, edges = cover_tree.linked(df, 0.5, block=8)
    near = x @ x.T >= 0.5
    np.fill_diagonal(near, False)
    assert {r["id"]: r["links"] for r in counts.collect()} == {i: int(n) for i, n in zip(ids, near.sum(1), strict=True) if n}
    assert all(r["a"] in ids and r["b"] in ids for r in edges.collect()) and edges.count()
