"""Embedding near-dedup by dual traversal of cover trees.

A tree has nested levels of balls with halving radii; each node knows the covering radius of
all that is below it. Two nodes are walked together: the pair is dropped when the centres are
further apart than both radii and the threshold, linked as a whole when they are so near that
every pair below is, and split otherwise, the larger ball first. The pairs found are exactly
those of the threshold; a last look at each single pair takes the cosine in double precision.

Balls are first compared by a few directions that tell most about their own vectors: what the rest
of two unit vectors can add to their cosine is at most the product of its lengths, and the radii
are columns beside it, so a matrix product of short rows drops nearly all pairs and no link.

Trees are built over bounded blocks of vectors; the top level is the blocks themselves, whose
balls are tested in the same way before two blocks meet. Of two blocks that meet, the balls of one
level are compared first, and only the vectors of balls that may hold a link are sent and walked.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxengine.llm.shared import components, written
from ctxengine.llm.simhash import forest

#: Rows of a block at least and at most, and how many blocks there are between the two.
BLOCK, MOST, PARTS = 4096, 65536, 8
#: Balls that the top level has at most; what a bound gives away to rounding, in double and single precision.
PIVOTS, SLACK, ROUGH = 64, 1e-9, 5e-5
#: A ball with this radius or fewer vectors is not split further: its vectors are leaves.
SMALL, LEAF = 2.0**-7, 16
#: Levels above this radius are left out where they would hold most vectors anyway. Rows that show that, and
#: the directions. Directions at least, and products from which they are worth while.
FLAT, SOME, LEAST, MANY = 0.25, 1024, 16, 1 << 18
#: Directions that a block sends at most.
SHOWN = 128


class Tree:
    """Balls over the rows of x (unit vectors); each level halves the radius at least.

    centre, radius, low, high: for each node its centre's row, its covering radius and its
    rows in `order`; first, last: its children, none for a leaf."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        centre, radius, low, high, first, last = [0], [_reach(x, 0)], [0], [len(x)], [0], [0]
        todo = [(0, 1.0)]
        while todo:
            node, r = todo.pop()
            own = self.order[low[node] : high[node]].copy()
            if len(own) <= LEAF or radius[node] <= SMALL:
                continue
            some = x[own[:: -(-len(own) // SOME)]]
            while r > SMALL and (r >= radius[node] or (r > FLAT and len(own) > 2 * SOME and 2 * len(_net(some, r)[0]) > len(some))):
                r /= 2
            heads, home = _net(x[own], r)
            by = np.argsort(home, kind="stable")
            self.order[low[node] : high[node]] = own[by]
            edges = np.searchsorted(home[by], np.arange(len(heads) + 1)) + low[node]
            first[node], last[node] = len(centre), len(centre) + len(heads)
            far = np.zeros(len(heads))
            np.maximum.at(far, home, np.linalg.norm(x[own] - x[own[heads]][home], axis=1))
            for k, h in enumerate(heads):
                if edges[k + 1] - edges[k] > LEAF and far[k] > SMALL:
                    todo.append((len(centre), r / 2))
                centre.append(int(own[h]))
                radius.append(float(far[k]))
                low.append(int(edges[k]))
                high.append(int(edges[k + 1]))
                first.append(0)
                last.append(0)
        self.centre, self.radius = np.array(centre), np.array(radius) + SLACK
        self.low, self.high, self.first, self.last = np.array(low), np.array(high), np.array(first), np.array(last)
        self.inner = self.last > self.first


def _basis(x: np.ndarray, reach: float, times: float = 3) -> np.ndarray:
    """Orthonormal directions (columns) in which rows of x mostly differ by far more than reach, the best first."""
    some = x[:: -(-len(x) // SOME)]
    off = some - some.mean(0)
    value, axis = np.linalg.eigh(off.T @ off / len(some))
    n = int(np.searchsorted(np.cumsum(value[::-1]), times * reach * reach)) + 1
    return axis[:, ::-1][:, : max(n, LEAST)]


def _short(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Each row along the basis, and the length of what is left of it."""
    return _rest(x @ basis)


def _rest(head: np.ndarray) -> np.ndarray:
    return np.column_stack([head, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", head, head)))])


def _bounded(short: np.ndarray, r: np.ndarray, reach: float, left: bool) -> np.ndarray:
    """Rows whose product with the other side's is at least 1 - reach^2 / 2 where balls may hold a link.

    The centres' cosine is 1 - (r + q + reach)^2 / 2 at least there, and that is a sum of products."""
    own, one = r * r / 2 + reach * r, np.ones(len(r))
    return np.column_stack([short, r, *((own, one) if left else (one, own))]).astype(np.float32)


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = 1 << 16
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) for k in range(0, len(i), step)])


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the true ones, few as they are: eight are looked at together."""
    flat = flags.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64) != 0)
    which, place = np.nonzero(flat.reshape(-1, 8)[some])
    return 8 * some[which] + place


def _close(x, p, f, y, q, g, limit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in p, places in q, cosines) of rows p of x and q of y, all those for which f @ g.T reaches limit."""
    for at in range(0, len(p), 512):
        for to in range(0, len(q), 512):
            near = f[at : at + 512] @ g[to : to + 512].T >= limit
            hit = _true(near)
            if len(hit):
                i, j = at + hit // near.shape[1], to + hit % near.shape[1]
                if 16 * len(hit) > near.size:
                    yield i, j, (x[p[at : at + 512]] @ y[q[to : to + 512]].T).ravel()[hit]
                else:
                    yield i, j, _dots(x, p[i], y, q[j])


def _reach(x: np.ndarray, i: int) -> float:
    return float(np.linalg.norm(x - x[i], axis=1).max()) if len(x) else 0.0


def _net(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are further than r from each other, and for each row one of them within r."""
    heads, n = np.zeros(len(x), np.int64), 0
    home = np.full(len(x), -1)
    limit = 1 - r * r / 2  # of the cosine
    short = _short(x, _basis(x, r)).astype(np.float32) if len(x) > 2 * SOME else None
    tops = np.zeros_like(short) if short is not None else None
    for at in range(0, len(x), 512):
        part = np.arange(at, min(at + 512, len(x)))
        if n and short is None:
            dots = x[part] @ x[heads[:n]].T
            best = dots.argmax(1)
            near = dots[np.arange(len(part)), best] >= limit
            home[part[near]] = best[near]
        elif n:
            best = np.full(len(part), limit)
            for i, j, dot in _close(x, part, short[part], x, heads[:n], tops[:n], limit - ROUGH):
                by = np.argsort(dot, kind="stable")  # of several, the nearest is assigned last
                i, j, dot = i[by], j[by], dot[by]
                near = dot >= best[i]
                best[i[near]], home[part[i[near]]] = dot[near], j[near]
        part = part[home[part] < 0]
        dots = x[part] @ x[part].T >= limit
        free, lone = np.ones(len(part), bool), dots.sum(1) <= 1
        first = n
        for k in np.flatnonzero(~lone).tolist():
            if free[k]:
                covered = free & dots[k]
                covered[k] = True
                home[part[covered]], heads[n] = n, part[k]
                n += 1
                free &= ~covered
        alone = part[lone]
        home[alone], heads[n : n + len(alone)] = np.arange(n, n + len(alone)), alone
        n += len(alone)
        if short is not None:
            tops[first:n] = short[heads[first:n]]
    return heads[:n], home


def _grown(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all values low..high-1 of each range."""
    n = highs - lows
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lows, n)


class Found:
    """Links so far: for each row of either side the weight of its partners, and edges that join
    what links join. In edges, rows of the other side come after those of this one."""

    def __init__(self, wx: np.ndarray, wy: np.ndarray, same: bool):
        self.wx, self.wy, self.same = wx, wy, same
        self.cx, self.cy = np.zeros(len(wx), np.int64), np.zeros(len(wy), np.int64)
        self.base = 0 if same else len(wx)
        self.new, self.held, self.kept = [], 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.same:
            i, j = i[i != j], j[i != j]
        if len(i):
            self.new.append((i, j))
            self.held += len(i)
            if self.held > 1 << 20:
                self.flush()

    def whole(self, i: np.ndarray, j: np.ndarray) -> None:
        """All pairs of two disjoint sets, joined by a few edges."""
        self.cx[i] += self.wy[j].sum()
        self.cy[j] += self.wx[i].sum()
        self.kept += [(i, np.full(len(i), j[0] + self.base)), (np.full(len(j), i[0]), j + self.base)]

    def flush(self) -> None:
        """Counts the pairs and keeps a forest of them."""
        if self.new:
            i, j = (np.concatenate(z) for z in zip(*self.new, strict=True))
            np.add.at(self.cx, i, self.wy[j])
            np.add.at(self.cy, j, self.wx[i])
            self.kept.append((i, j + self.base))
            self.new, self.held = [], 0
        self.kept = [forest(*(np.concatenate(z) for z in zip(*self.kept, strict=True)))]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        return self.kept[0]


def walk(a: Tree, x: np.ndarray, b: Tree, y: np.ndarray, cosine: float, found: Found) -> None:
    """Walks two trees together and gives `found` every pair of rows of x and y with that cosine.

    If both are the same tree, every pair comes from either side, so cx alone counts links."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    stack, basis = [(0, 0)], None
    while stack:
        s, t = stack.pop()
        u = np.arange(a.first[s], a.last[s]) if a.inner[s] else np.array([s])
        v = np.arange(b.first[t], b.last[t]) if b.inner[t] else np.array([t])
        if len(u) * len(v) >= MANY:
            if basis is None:
                basis = _basis(np.concatenate([z[:: -(-len(z) // SOME)] for z in (x, y)]), reach)
            f = _bounded(_short(x[a.centre[u]], basis), a.radius[u], reach, True)
            g = _bounded(_short(y[b.centre[v]], basis), b.radius[v], reach, False)
            for i, j, dot in _close(x, a.centre[u], f, y, b.centre[v], g, 1 - reach * reach / 2 - ROUGH):
                _decide(a, x, u[i], b, y, v[j], dot, cosine, reach, found, stack)
            continue
        for va in range(0, len(v), 8192):
            q = v[va : va + 8192]
            dots = x[a.centre[u]] @ y[b.centre[q]].T
            bound = a.radius[u][:, None] + b.radius[q][None, :]
            bound += reach
            i, j = np.nonzero(dots >= 1 - bound * bound / 2)
            _decide(a, x, u[i], b, y, q[j], dots[i, j], cosine, reach, found, stack)
    found.flush()


def _decide(a, x, i, b, y, j, dot, cosine, reach, found, stack) -> None:
    """Drops, links as a whole, puts on the stack or looks into each pair of nodes."""
    r = a.radius[i] + b.radius[j]
    may = dot >= 1 - (r + reach) ** 2 / 2
    i, j, dot, r = i[may], j[may], dot[may], r[may]
    single = (a.high[i] - a.low[i] == 1) & (b.high[j] - b.low[j] == 1)
    hit = single & (dot >= cosine)
    found.pairs(a.order[a.low[i[hit]]], b.order[b.low[j[hit]]])
    i, j, dot, r = i[~single], j[~single], dot[~single], r[~single]
    far = np.sqrt(np.maximum(0, 2 - 2 * dot)) + r + SLACK
    whole = (far < reach) & ((i != j) if found.same else True) & ((a.high[i] - a.low[i]) * (b.high[j] - b.low[j]) > LEAF * LEAF)
    for m, n in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
        found.whole(a.order[a.low[m] : a.high[m]], b.order[b.low[n] : b.high[n]])
    i, j = i[~whole], j[~whole]
    leaves = ~a.inner[i] & ~b.inner[j]
    stack += zip(i[~leaves].tolist(), j[~leaves].tolist(), strict=True)
    _leaves(a, x, b, y, i[leaves], j[leaves], cosine, found)


def _leaves(a, x, b, y, u, v, cosine, found) -> None:
    """Single pairs below pairs of leaves, a bounded number at once."""
    size = (a.high[u] - a.low[u]) * (b.high[v] - b.low[v])
    at = 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 1 << 16)) + at)
        w, i = _grown(a.low[u[at:to]], a.high[u[at:to]])
        t = v[at:to][w]
        w, j = _grown(b.low[t], b.high[t])
        i, j = a.order[i[w]], b.order[j]
        for part in range(0, len(i), 1 << 16):
            m, n = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            hit = _dots(x, m, y, n) >= cosine
            found.pairs(m[hit], n[hit])
        at = to


def balls(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centres (rows of x), radii and sizes of balls of radius FLAT at most, and the ball of each row."""
    heads, home = _net(x, FLAT)
    far, size = np.zeros(len(heads)), np.bincount(home, minlength=len(heads))
    np.maximum.at(far, home, np.linalg.norm(x - x[heads][home], axis=1))
    return heads, np.where(size > 1, far + SLACK, 0), size, home


def sift(heads: np.ndarray, radii: np.ndarray, tops: np.ndarray, radii2: np.ndarray, reach: float, first: int, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which balls of either side may hold a link with one of the other; heads, tops: their centres along the directions.

    The first directions are compared for all, the others for those that these leave. alone: both
    sides are the same, and these balls hold one vector, which is no link with itself."""
    limit = 1 - reach * reach / 2 - ROUGH
    whole = [_bounded(_rest(z), r, reach, left) for z, r, left in ((heads, radii, True), (tops, radii2, False))]
    short = [_bounded(_rest(z[:, :first]), r, reach, left) for z, r, left in ((heads, radii, True), (tops, radii2, False))]
    a, b = np.zeros(len(heads), bool), np.zeros(len(tops), bool)
    for i, j, dot in _close(whole[0], np.arange(len(a)), short[0], whole[1], np.arange(len(b)), short[1], limit):
        may = dot >= limit
        if alone is not None:
            may &= (i != j) | ~alone[i]
        a[i[may]] = b[j[may]] = True
    return a, b


def usable(v: str):
    """A condition: not null, no null or non-finite component, not zero."""
    wrong = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~wrong & F.exists(v, lambda c: c != 0), F.lit(False))


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.zeros((len(raw), dim))
    for k, b in enumerate(raw):
        own = np.frombuffer(b, "<f8")
        x[k, : len(own)] = own
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def linked(vectors: DataFrame, cosine: float, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(counts, edges): counts (id, links) of the vectors that have a link; edges (a, b) join
    what links join. vectors: id (long, unique), n (weight in counts), v (array of double).

    Blocks are of bounded size, cut by a hash. Where the balls around a bounded number of pivots
    leave out half of all pairs or more, every vector is in the cell of the nearest pivot, blocks
    are parts of cells, and two meet only if the balls of their cells allow it; elsewhere, as in
    noise of many dimensions, all pairs of blocks meet. For these a block sends its balls' radii
    and their centres along a few directions; vectors follow for balls that may hold a link.
    vectors are read several times, so they should be a table."""
    spark = vectors.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
            raw = [values[s:e].astype("<f8").tobytes() for s, e in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())], ["id", "n", "dim", "raw"])

    vectors = vectors.select("id", "n", F.col("v").cast("array<double>"))
    rows = vectors.mapInArrow(pack, "id long, n long, dim int, raw binary")
    whole = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim, size = whole["dim"] or 1, max(block, min(MOST, -(-whole["n"] // PARTS)))
    some = rows.orderBy(F.xxhash64("id")).limit(max(64, min(SOME, (1 << 19) // dim))).select("raw").collect()
    some = _units([r["raw"] for r in some], dim) if some else np.eye(1, dim)
    heads = some[: max(1, min(pivots, whole["n"] // block))]
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    basis, first = _basis(some, reach, 4.5)[:, :SHOWN], _basis(some, reach).shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = _units(batch.column(3).to_pylist(), dim) @ heads.T
            cell = dots.argmax(1)
            far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(cell, pa.int32()), pa.array(far)], ["id", "n", "raw", "cell", "far"])

    placed = rows.mapInArrow(place, "id long, n long, raw binary, cell int, far double")
    cells = {r["cell"]: (r["far"], r["n"]) for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()} if len(heads) > 1 else {}
    meet = [(a, b) for a in sorted(cells) for b in sorted(cells) if a <= b and np.linalg.norm(heads[a] - heads[b]) <= cells[a][0] + cells[b][0] + reach + SLACK]
    if not cells or 2 * sum(cells[a][1] * cells[b][1] * (1 if a < b else 0.5) for a, b in meet) > 0.5 * whole["n"] ** 2:
        cells, meet, placed = {0: (2.0, whole["n"])}, [(0, 0)], rows.withColumn("cell", F.lit(0))
    parts = {c: max(1, -(-n // size)) for c, (_, n) in sorted(cells.items())}
    pairs = spark.createDataFrame([(a, b, parts[a], parts[b]) for a, b in meet], "a int, b int, na int, nb int")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("nb") - 1)))
    ends = F.array(F.struct(F.col("a").alias("cell"), F.col("i").alias("part"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cell"), F.col("j").alias("part"), F.lit(1).alias("side")))
    pairs = pairs.withColumn("pair", F.concat_ws("-", "a", "i", "b", "j")).select("pair", F.inline(ends))
    pairs = pairs.dropDuplicates(["pair", "cell", "part"])  # a block that meets itself comes once
    number = F.create_map(*[F.lit(z) for c, n in parts.items() for z in (c, n)])

    def build(key, pdf):
        import pandas as pd

        x = _units(pdf["raw"].tolist(), dim)
        centre, radius, count, home = balls(x)
        np.savez(out := io.BytesIO(), radius=radius, alone=count == 1, heads=(x[centre] @ basis).astype(np.float32))
        pdf = pdf.assign(node=home.astype(np.int32), balls=None)
        return pd.concat([pdf, pd.DataFrame({"cell": [key[0]], "part": [key[1]], "id": [0], "n": [0], "raw": [b""], "node": [-1], "balls": [out.getvalue()]})])  # no column with gaps, which pandas would turn to double

    blocks = placed.withColumn("part", F.pmod(F.xxhash64("id"), number[F.col("cell")].cast("long")).cast("int")).select("cell", "part", "id", "n", "raw")
    blocks = written(blocks.groupBy("cell", "part").applyInPandas(build, "cell int, part int, id long, n long, raw binary, node int, balls binary"), "blocks")

    def sieve(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("side")
        sides = []
        for z in pdf["balls"]:
            with np.load(io.BytesIO(z)) as own:
                sides.append((own["heads"].astype(float), own["radius"], own["alone"]))
        same = len(sides) == 1
        a, b = sift(*sides[0][:2], *sides[-1][:2], reach, first, sides[0][2] if same else None)
        out = [np.flatnonzero(z).astype(np.int32) for z in ([a | b] if same else [a, b])]
        return pd.concat([pd.DataFrame({"pair": key[0], "cell": r.cell, "part": r.part, "side": r.side, "node": z}) for r, z in zip(pdf.itertuples(), out, strict=True)])

    near = pairs.join(blocks.where("balls is not null").select("cell", "part", "balls"), ["cell", "part"])
    near = near.groupBy("pair").applyInPandas(sieve, "pair string, cell int, part int, side int, node int")
    near = written(near, "near").join(blocks.where("balls is null").drop("balls"), ["cell", "part", "node"])

    def meeting(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["side", "id"])
        sides = [(own["id"].to_numpy(np.int64), own["n"].to_numpy(np.int64), _units(own["raw"].tolist(), dim)) for _, own in pdf.groupby("side")]
        same = len(sides) == 1
        (ids, ns, x), (jds, ms, y) = sides[0], sides[-1]
        a = Tree(x)
        b = a if same else Tree(y)
        found = Found(ns, ms, same)
        walk(a, x, b, y, cosine, found)
        both = ids if same else np.concatenate([ids, jds])
        e, f = found.edges()
        has = found.cx > 0
        out = [pd.DataFrame({"id": ids[has], "links": found.cx[has], "other": -1})]
        if not same:
            has = found.cy > 0
            out.append(pd.DataFrame({"id": jds[has], "links": found.cy[has], "other": -1}))
        return pd.concat([*out, pd.DataFrame({"id": both[e], "links": -1, "other": both[f]})])

    out = near.select("pair", "side", "id", "n", "raw").groupBy("pair").applyInPandas(meeting, "id long, links long, other long")
    out = written(out, "links")
    counts = out.where("links >= 0").groupBy("id").agg(F.sum("links").alias("links"))
    return counts, out.where("links < 0").select(F.col("id").alias("a"), F.col("other").alias("b"))


def report(embeddings: DataFrame, cosine: float = 0.95, **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold a null or non-finite component link with nothing.
    Shorter vectors count as filled up with zeros. Equal vectors are one from here on, with
    their number as weight. A null vec_id takes part and is larger than all others; it is not
    kept. component_id of a row without links is its own vec_id. Repeated rows link like any
    other equal vectors. An empty table gives an empty one."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), usable("embedding").alias("ok"))
    classes = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    counts, edges = linked(classes.select("id", "n", "v"), cosine, **options)
    groups = components(edges)
    member = classes.join(groups, F.col("id") == F.col("node"), "left").join(counts, "id", "left")
    member = written(member.select("v", "least", F.coalesce("component", "id").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "members")
    least = member.groupBy("group").agg(F.min("least").alias("component_id"))
    member = written(member.join(least, "group").select("v", "n_links", "component_id"), "members")
    good = rows.where("ok").join(member, "v").select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
