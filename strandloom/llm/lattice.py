"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors to eight random directions, or several times eight, and decodes each projection to its nearest point
of the E8 lattice: the points together are the vector's cell. A vector stands in its own cell and probes the neighbouring cells whose
centres come next. How many directions, how wide the cells and how many tables there are follows from the number of vectors, so that as few
unlike vectors meet in a large table as in a small one. In a cell, short sketches are compared bit-sliced first, and only vectors that
have another near by are brought there. Those that meet, one of them at home, are verified by cosine in double precision.

Projections are exact sums of whole numbers, so that a vector's cells are the same wherever they are computed;
a pair that meets more than once is counted where its first meeting is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches
from .components import connected_components
from .simhash import Forest, bit_sliced_pairs, boundaries, slices, whole_cells

#: Least cosine of a link, and neighbouring cells that a vector probes in each table.
COSINE, PROBES = 0.95, 2
#: Lattice blocks to a table, size of a cell, tables, and the share of all unlike pairs that meet in one table. Measured on random pairs: each finds 99 of 100 at
#: a cosine of just 0.95 and nearly all at 0.97, in whatever dimension. A plan is taken while unlike vectors that a vector meets in a table are MEET at most.
PLANS = ((1, 2.0, 3, 1.8e-2), (1, 1.7, 4, 5.9e-3), (1, 1.4, 5, 1.6e-3), (1, 1.2, 7, 5.3e-4), (2, 2.0, 8, 9.3e-5), (2, 1.7, 11, 8.3e-6), (2, 1.4, 19, 5.6e-7), (3, 1.7, 30, 1.6e-8), (4, 1.7, 80, 1e-10))
MEET = 16
#: Bits by which sketches of vectors at the least cosine differ at most, but for a few pairs in a hundred thousand.
SKETCH = 20
#: Rows of a cell that meet in one piece; larger cells are cut into chunks that meet pairwise.
CHUNK = 512
_FINE, _COARSE = 1 << 20, 1 << 10


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_ROOTS = roots()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points of whole numbers with an even sum: round, and where the sum is odd round the worst place the other way."""
    p = np.rint(y)
    odd = np.flatnonzero(p.sum(axis=1) % 2)
    off = y[odd] - p[odd]
    worst = np.abs(off).argmax(axis=1)
    p[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return p


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 moved by one half in each place."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _hash(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64 bits of lattice points."""
    h = np.full(len(points), (table * 1_000_003 + dim) & 0xFFFFFFFF, np.uint64)
    doubled = (points * 2).astype(np.int64).view(np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ doubled[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@cache
def _directions(seed: int, table: int, dim: int, width: int = 8) -> np.ndarray:
    """Random directions, in whole numbers."""
    return np.rint(np.random.Generator(np.random.PCG64([seed, table, dim])).normal(size=(dim, width)) * _COARSE)


def plan(n: int) -> tuple[int, float, int]:
    """Blocks, scale and tables for n vectors."""
    return next((p[:3] for p in PLANS if p[3] * n <= MEET), PLANS[-1][:3])


def cells(unit: np.ndarray, blocks: int = 1, scale: float = 1.4, tables: int = 5, probes: int = PROBES, seed: int = 8) -> np.ndarray:
    """Of each unit vector (a row): for each table its own cell, then the cells that it probes. Shape (rows, tables, 1 + probes)."""
    n, dim = unit.shape
    whole = np.rint(unit * _FINE)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        y = (whole @ _directions(seed, t, dim, 8 * blocks)) / (scale * _FINE * _COARSE)  # the product is exact: its terms stay far below 2^53
        home = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        out[:, t, 0] = _hash(home, t, dim)
        # the nearer a neighbour's centre, the larger the offset's product with the step to it; steps are added in a fixed order
        off, gain = y - home, np.zeros((n, blocks * len(_ROOTS)))
        for b in range(blocks):
            for k in range(8):
                gain[:, b * len(_ROOTS) : (b + 1) * len(_ROOTS)] += off[:, 8 * b + k : 8 * b + k + 1] * _ROOTS[:, k]
        rows = np.arange(n)
        for p in range(probes):
            best = gain.argmax(axis=1)  # of neighbours as near the first
            gain[rows, best] = -np.inf
            there = home.copy().reshape(n, blocks, 8)
            there[rows, best // len(_ROOTS)] += _ROOTS[best % len(_ROOTS)]
            out[:, t, 1 + p] = _hash(there.reshape(n, -1), t, dim)
    return out


def sketches(unit: np.ndarray, seed: int = 8) -> np.ndarray:
    """64 signs of random projections of each unit vector, as an unsigned number."""
    sign = np.rint(unit * _FINE) @ _directions(seed, 1 << 20, unit.shape[1], 64) > 0
    return np.packbits(sign, axis=1, bitorder="little").view("<u8")[:, 0]


def _vectors(column) -> np.ndarray:
    """A list column of vectors of one length, as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small numbers would be lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and cell where pairs first meet; a, b: their cells, the smaller node's first."""
    table, cell = np.full(len(a), -1), np.zeros(len(a), np.int64)
    for t in range(a.shape[1]):
        home_a, home_b = a[:, t, 0], b[:, t, 0]
        for met, where in ((home_a == home_b, home_a), ((b[:, t, 1:] == home_a[:, None]).any(axis=1), home_a), ((a[:, t, 1:] == home_b[:, None]).any(axis=1), home_b)):
            new = met & (table < 0)
            table[new], cell[new] = t, where[new]
    return table, cell


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell the rows whose sketch is near that of another, one of the two at home."""
    keys = ["cell", "dim", "lo", "hi", "tab"]
    for t in whole_cells(batches, keys, 1 << 14):
        starts, home, node = boundaries(t, keys), t.column("home").to_numpy(zero_copy_only=False), t.column("node").to_numpy()
        ends, alive, sketch = np.append(starts, t.num_rows), np.zeros(t.num_rows, bool), t.column("sketch").to_numpy().view(np.uint64)
        for c, d in slices(starts, t.num_rows):
            s, e = ends[c], ends[d]
            for i, j in bit_sliced_pairs(starts[c:d] - s, sketch[s:e], SKETCH):
                met = (home[s + i] | home[s + j]) & (node[s + i] != node[s + j])
                alive[s + i[met]] = alive[s + j[met]] = True
        yield from t.drop_columns("sketch").filter(pa.array(alive)).combine_chunks().to_batches()


def _meet(cosine: float, blocks: int, scale: float, tables: int, probes: int):
    def of_cells(t: pa.Table, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """For cells of vectors of one length: (node, links, null), links weighed by copies, and a spanning forest as (node, null, other)."""
        n = t.num_rows
        cuts = np.append(boundaries(t, keys), n)
        home, node, copies, own = (t.column(c).to_numpy() for c in ("home", "node", "copies", "own"))
        across, cell, table = t.column("lo").to_numpy() != t.column("hi").to_numpy(), t.column("cell").to_numpy(), t.column("tab").to_numpy()
        unit, links, forest = _vectors(t.column("embedding")), np.zeros(n, np.int64), Forest(n)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            """Count the pairs that meet first where they have been found; cells are made anew, of all rows in them at once."""
            if not held:
                return
            a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            forest.link(a, b)
            rows = np.unique(np.concatenate((a, b)))
            known = cells(unit[rows], blocks, scale, tables, probes)
            swap = node[a] > node[b]
            first, second = np.where(swap, b, a), np.where(swap, a, b)
            at, where = _first_meeting(known[np.searchsorted(rows, first)], known[np.searchsorted(rows, second)])
            mine = (at == table[a]) & (where == cell[a])
            for p, q in ((first[mine], second[mine]), (second[mine], first[mine])):
                np.add.at(links, p, copies[q])

        pairs = 0
        for s, e in zip(cuts, cuts[1:]):
            at_home = np.flatnonzero(home[s:e])
            for k in range(0, len(at_home) if e - s > 1 else 0, 256):
                i = at_home[k : k + 256]
                near = unit[s + i] @ unit[s:e].T >= cosine
                # two at home meet once; across chunks only rows of different chunks do
                near &= ~home[None, s:e] | (np.arange(e - s)[None, :] > i[:, None])
                near &= node[s + i][:, None] != node[None, s:e]
                if across[s]:
                    near &= own[s + i][:, None] != own[None, s:e]
                a, b = np.nonzero(near)
                if len(a):
                    held.append((s + i[a], s + b))
                    pairs += len(a)
                if pairs >= 1 << 16:
                    count()
                    pairs = 0
        count()
        got = np.flatnonzero(links)
        if len(got):
            yield node[got], links[got], None
        root = forest.roots()
        child = np.flatnonzero(root != np.arange(n))
        if len(child):
            yield node[child], None, node[root[child]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cell", "dim", "lo", "hi", "tab"]
        for whole in whole_cells(batches, keys, 1 << 13):
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = whole if (dims == dim).all() else whole.filter(pa.array(dims == dim))
                for a, n, b in of_cells(t, keys):
                    none = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a), none if n is None else pa.array(n), none if b is None else pa.array(b)], ["a", "links", "b"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, probes: int = PROBES, of: tuple[int, float, int] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings(vec_id, embedding, ...).

    n_links counts the other rows at `cosine` or more that the tables find; component_id is the smallest vec_id that
    links reach; kept: vec_id is component_id. Equal vectors are one node with its number of copies, and all linked
    with one another. Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do vectors of
    different lengths. A null vec_id is never kept unless nothing else can be, and counts as a row. An empty table gives an
    empty result; other columns are ignored, whatever their names. Blocks, scale and tables follow from the number of distinct vectors unless `of` has them.
    """
    e = F.col("embedding")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    nodes = rows.filter("good").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    blocks, scale, tables = of or plan(nodes.count())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                unit = _vectors(part.column("embedding"))
                found = cells(unit, blocks, scale, tables, probes).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("dim"), pa.array(sketches(unit).view(np.int64)), pa.array(found.tolist(), pa.list_(pa.int64()))], ["node", "dim", "sketch", "cells"])

    coded = materialize(nodes.select("node", "dim", "embedding").transform(small_batches).mapInArrow(code, "node long, dim int, sketch long, cells array<long>"), "coded")
    stands = coded.select("node", "dim", "sketch", F.posexplode("cells").alias("at", "cell")).withColumn("tab", F.expr(f"at div {1 + probes}").cast("int")).withColumn("home", F.col("at") % (1 + probes) == 0)
    sizes = coded.select("dim", F.explode("cells").alias("cell")).groupBy("cell", "dim").count()
    hot = materialize(sizes.filter(F.col("count") > CHUNK).select("cell", "dim", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "hot-cells")
    cut = stands.join(hot, ["cell", "dim"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    keys, order = ["cell", "dim", "lo", "hi"], ["cell", "dim", "lo", "hi", "tab", "node"]
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("cell", "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "tab", "own", "home", "node", "sketch")
    spread = spread.repartition(*keys).sortWithinPartitions(*order).transform(small_batches)
    alive = materialize(spread.mapInArrow(_alive, "cell long, dim int, lo int, hi int, tab int, own int, home boolean, node long"), "alive")
    # vectors go only where a near one is
    brought = alive.join(nodes.select("node", "copies", "embedding"), "node").repartition(*keys).sortWithinPartitions(*order)
    met = materialize(brought.transform(small_batches).mapInArrow(_meet(cosine, blocks, scale, tables, probes), "a long, links long, b long"), "met")
    links = met.filter("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    of_node = connected_components(met.filter("b is not null").select("a", "b").distinct())
    linked = materialize(nodes.select("node", "least_id").join(of_node, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = linked.join(least, "root").select("node", "component_id")
    result = materialize(
        nodes.join(component, "node", "left").join(links, "node", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id")), "by-vector"
    )
    release(coded, alive, met, linked)
    found = rows.filter("good").join(result, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
