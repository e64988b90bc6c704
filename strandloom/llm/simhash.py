"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Two fingerprints within three bits
differ in at most three of five bit blocks, so they agree on one of the ten pairs of blocks: each pair
is a table, keyed by about 26 bits; for very many fingerprints there are more blocks and longer keys, which find the same. Inside a key, 64 fingerprints stand side by side as 64 vertical bit
planes; a query meets all 64 at once, one word operation a plane, and counts their distances in two
carry-save bit planes plus an overflow plane. Blocks whose lanes have all overflowed are dropped early.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches
from .components import connected_components

BITS = 64
RADIUS = 3
#: Bit blocks for up to so many fingerprints: a table's key is all of them but RADIUS, so that a few unlike fingerprints share one.
BLOCKS = ((5, 1 << 29), (6, 1 << 35), (7, 1 << 62))
#: Rows of a key that one cell compares at most (twice that across two chunks); larger keys are cut into chunks that meet pairwise.
CHUNK = 1024
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHINGLES_AT_ONCE = 1 << 16


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of UTF-8 text, as an unsigned integer: see near_duplicates."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest, counts = len(words) - width + 1, xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    for k in range(0, n, _SHINGLES_AT_ONCE):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(first[k : k + _SHINGLES_AT_ONCE], last[k : k + _SHINGLES_AT_ONCE])], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, version, fp long) for every document; version is a hash of the text that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fp = np.fromiter((simhash(t.as_py(), width, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array(fp.view(np.int64))], ["doc_id", "version", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version(F.col("text")).alias("version"), F.col("text").cast("string").alias("text"))
    return rows.transform(small_batches).mapInArrow(run, "doc_id long, version long, fp long")


def version(text):
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(text.cast("string"))


def bit_sliced_pairs(starts: np.ndarray, fps: np.ndarray, radius: int = RADIUS, at_once: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within `radius` bits, both in one cell; cells begin at `starts` in fps, sorted by cell: uint64, or a matrix of several to a row."""
    fps = fps.reshape(len(fps), -1)
    n, bits = len(fps), BITS * fps.shape[1]
    sizes = np.diff(np.append(starts, n))
    words = -(-sizes // BITS)  # words of 64 lanes to a cell
    base = np.concatenate(([0], np.cumsum(words)[:-1]))
    cell = np.repeat(np.arange(len(starts)), sizes)
    rank = np.arange(n) - starts[cell]
    word, lane = base[cell] + rank // BITS, (rank % BITS).astype(np.uint64)
    at = np.flatnonzero(np.diff(word, prepend=-1))
    planes = np.stack([np.bitwise_or.reduceat((fps[:, k // BITS] >> np.uint64(k % BITS) & np.uint64(1)) << lane, at) for k in range(bits)])
    width = np.diff(np.append(at, n)).astype(np.uint64)
    unused = np.where(width >= BITS, np.uint64(0), _ONES << np.minimum(width, np.uint64(BITS - 1)))
    # counters of so many planes that begin where `radius` more fill them, and one more makes them overflow
    depth = radius.bit_length()
    ahead = (1 << depth) - 1 - radius
    # a row meets its own word and the later ones of its cell
    meets = words[cell] - rank // BITS
    upto = np.cumsum(meets)
    done = 0
    while done < n:
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + at_once, "right")))
        rows = np.repeat(np.arange(done, stop), meets[done:stop])
        offset = np.arange(len(rows)) - np.repeat(upto[done:stop] - meets[done:stop] - (upto[done - 1] if done else 0), meets[done:stop])
        done = stop
        block = word[rows] + offset
        own = offset == 0
        over = unused[block]
        # lanes up to the row's own are met by the rows before it
        over[own] |= _ONES >> (np.uint64(BITS - 1) - lane[rows[own]])
        count = [np.full_like(over, _ONES if ahead >> p & 1 else 0) for p in range(depth)]
        for k in range(0, bits, 2):
            if k % 8 == 0:  # blocks whose lanes have all overflowed are abandoned
                alive = over != _ONES
                if not alive.all():
                    rows, block, over = rows[alive], block[alive], over[alive]
                    count = [c[alive] for c in count]
                    if not len(rows):
                        break
            query = fps[rows, k // BITS]
            x = planes[k, block] ^ (np.uint64(0) - (query >> np.uint64(k % BITS) & np.uint64(1)))
            y = planes[k + 1, block] ^ (np.uint64(0) - (query >> np.uint64(k % BITS + 1) & np.uint64(1)))
            if not depth:
                over |= x | y
                continue
            # carry-save: ones + x + y = sum + 2 * carry, and the carry goes up through the other planes
            carry = (count[0] & (x | y)) | (x & y)
            count[0] ^= x ^ y
            for p in range(1, depth):
                carry, count[p] = count[p] & carry, count[p] ^ carry
            over |= carry
        lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, at_lane = np.nonzero(lanes)
        if len(hit):
            yield rows[hit], at[block[hit]] + at_lane


class Forest:
    """Union-find over indices 0..n-1, fed with arrays of pairs; keeps the smallest index as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            p = self.roots()
            a, b = p[i], p[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def whole_cells(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole cells, from batches sorted by the columns `keys`; a cell is held whole, so callers bound its size."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= at_least:
            t = pa.Table.from_batches(held)
            new = boundaries(t, keys)
            cut = int(new[-1])
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            rows = t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def boundaries(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Indices where a row's keys differ from those of the row before; 0 is one."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def slices(starts: np.ndarray, rows: int, pairs: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of cells that have about so many pairs together, or are one cell."""
    upto = np.cumsum(np.diff(np.append(starts, rows)).astype(np.int64) ** 2) // pairs
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(starts)]
    return zip(cuts, cuts[1:])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each cell's links, as (a, b) fingerprints: no more rows than it has read."""
    for t in whole_cells(batches, ["key", "lo", "hi"]):
        starts, fps = boundaries(t, ["key", "lo", "hi"]), t.column("fp").to_numpy()
        forest, bits = Forest(len(fps)), fps.view(np.uint64)
        for i, j in bit_sliced_pairs(starts, bits):
            forest.link(i, j)
        root = forest.roots()
        child = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(fps[child]), pa.array(fps[root[child]])], ["a", "b"])


def blocks_for(n: int) -> int:
    return next(blocks for blocks, upto in BLOCKS if n <= upto)


def _table_keys(fp, blocks: int):
    """A key for each table: its number and the bits of all blocks but RADIUS."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    part = [(F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << e - s) - 1)), e - s) for s, e in zip(cuts, cuts[1:])]
    keys = []
    for t, chosen in enumerate(combinations(part, blocks - RADIUS)):
        key = F.lit(t).cast("long")
        for bits, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def fingerprint_links(distinct: DataFrame, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all links within three bits; distinct: one row per fp."""
    keyed = distinct.select("fp", F.explode(_table_keys(F.col("fp"), blocks or blocks_for(distinct.count()))).alias("key"))
    hot = materialize(keyed.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "hot-keys")
    cut = keyed.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    cells = cut.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return cells.transform(small_batches).mapInArrow(_links, "a long, b long").distinct()


def _components(fps: DataFrame, links: Callable[[DataFrame], DataFrame] = fingerprint_links) -> DataFrame:
    """(fp, component_id, root) for every fingerprint: the smallest doc_id that links reach, and the component's smallest fingerprint."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    edges = materialize(links(distinct), "links")
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    linked = materialize(distinct.join(roots, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = linked.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    joined = distinct.join(of_fp, "fp", "left")
    # a component of null ids has none of its own; a fingerprint without links is its own component
    out = materialize(joined.select("fp", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root")), "fp-components")
    release(edges, linked)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...).

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, shingles are `width` words joined by blanks
    (fewer words: the whole sequence) and count as often as they occur. A bit is 1 if it is set in over
    half of the shingles' XXH64. Fingerprints within three bits link; component_id is the smallest
    doc_id that links reach.

    Null, empty and blank texts have fingerprint zero, which links like any other. Repeated rows and
    ties come back row by row. A null doc_id stays null and is never a component_id unless all of its
    component are null. An empty table gives an empty result; other columns of docs are ignored.
    """
    fps = materialize(fingerprints(docs, width, seed).select("doc_id", "fp"), "fps")
    return fps.join(_components(fps).select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs with one document of each group of near-duplicates, the one with the smallest doc_id; all columns as they are.

    Where several rows of a group share that doc_id, one of them stays; so does one of a group without any doc_id.
    """
    return one_of_each(docs, materialize(fingerprints(docs, width, seed), "fps"))


def one_of_each(docs: DataFrame, fps: DataFrame, links: Callable[[DataFrame], DataFrame] = fingerprint_links) -> DataFrame:
    """The rows of docs that `representatives` keeps, given each row's (doc_id, version, fp) and the links of distinct fps."""
    first = fps.join(_components(fps, links), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = first.groupBy("root", "doc_id", "version").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("root").agg(F.min(F.struct("version", "doc_id", "n")).alias("c"))
    kept = materialize(chosen.select("c.*"), "kept")
    # rows travel as one struct, so that no name of docs can clash
    rows = docs.select(F.struct("*").alias("row")).withColumn("id", F.col("row.doc_id").cast("long")).withColumn("v", version(F.col("row.text")))

    def matching(which: str) -> DataFrame:
        ids = kept.filter(which)
        return rows.join(ids, rows["id"].eqNullSafe(ids["doc_id"]) & (rows["v"] == ids["version"]), "left_semi")

    out = matching("n = 1").select("row")
    if not kept.filter("n > 1").isEmpty():
        out = out.union(matching("n > 1").dropDuplicates(["id", "v"]).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
