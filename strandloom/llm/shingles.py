"""Near-duplicates by SimHash, verified by exact Jaccard similarity of word shingles.

A document is the set of the XXH64 of its shingles of five words, and a fingerprint of 128 bits, their majorities. Sets at a similarity of
0.8 lie some 19 bits apart, so no few blocks of bits agree for sure: tables are keyed by drawn bits, as many tables as let nearly all pairs at 0.8 meet.
In a table's cell fingerprints are compared bit-sliced, with wide carry-save counters, and those within the radius are candidates, verified on the whole
sets. A cell first gives the candidates of a least spanning forest by distance. Where more are near, the sets of those that the verified ones leave
apart are brought to the cell, and all pairs across are verified there: components are those of all candidates that hold, while rows stay in proportion to the cells'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches
from .components import connected_components
from .simhash import BITS, Forest, bit_sliced_pairs, boundaries, one_of_each, slices, version, whole_cells

WIDTH = 5
#: A link's similarity, at least: NEAR[0] / NEAR[1].
NEAR = (4, 5)
#: Bits in a fingerprint, in words of 64; candidates differ in so many at most. At a similarity of just 0.8 a bit differs with probability FLIP, and 97.5 in 100 pairs are within.
WORDS, RADIUS, FLIP = 2, 27, 0.1515
#: How many of the pairs at a similarity of just 0.8 meet in a table.
MEET = 0.97
#: Rows of a key, and shingles in their sets, that one cell compares at most (twice that across two chunks); larger keys are cut into chunks that meet pairwise.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 21
_AT_ONCE = 1 << 14


def shingles(text: bytes | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct shingles of UTF-8 text, sorted: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; fewer words than width, or none: one shingle."""
    words = (text or b"").lower().split()
    joined, width = b" ".join(words), min(width, len(words))
    if not words:
        return np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Words of the fingerprint of a set: a bit is 1 if it is set in over half of the hashes, or of what a mixing step makes of them."""
    counts = np.zeros(WORDS * BITS, np.int64)
    for k in range(0, len(hashes), _AT_ONCE):
        h = hashes[k : k + _AT_ONCE]
        words = [h]
        for w in range(1, WORDS):  # the finalizer of SplitMix64, with a step for each word
            x = h + np.uint64(0x9E3779B97F4A7C15 * w & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            words.append(x ^ x >> np.uint64(31))
        bits = np.unpackbits(np.stack(words, axis=1).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def plan(n: int) -> tuple[int, int]:
    """Drawn bits to a key, and tables, for n fingerprints: about six rows to a key of unlike ones, whatever n, and as many tables as let MEET of the pairs at 0.8 meet.

    Tables grow with n to the power of 0.24: some 40 for 200,000, 110 for 15 million.
    """
    bits = max(6, int(math.log2(max(n, 1))) - 2)
    return bits, math.ceil(math.log(1 - MEET) / math.log(1 - (1 - FLIP) ** bits))


def keys(fps: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys (signed) of fingerprints (rows of words) in each table: the table's number over its drawn bits."""
    rng = np.random.default_rng(42)
    out = np.empty((len(fps), tables), np.int64)
    for t in range(tables):
        key = np.full(len(fps), t, np.uint64)
        for b in rng.permutation(WORDS * BITS)[:bits].tolist():
            key = key << np.uint64(1) | (fps[:, b // BITS] >> np.uint64(b % BITS) & np.uint64(1))
        out[:, t] = key.view(np.int64)
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp, size, w0, w1) for every document; fp is a hash of its set, size that of the set, the rest its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column("text").cast(pa.binary())]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            words = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [b.column("doc_id"), b.column("version"), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(words[:, w]) for w in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "fp", "size", *_WORDS])

    return _texts(docs).transform(small_batches).mapInArrow(run, "doc_id long, version long, fp long, size long, " + ", ".join(f"{w} long" for w in _WORDS))


_WORDS = [f"w{k}" for k in range(WORDS)]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a Jaccard similarity of NEAR at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(a) + len(b) - both)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), version(F.col("text")).alias("version"), F.col("text").cast("string").alias("text"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, None
    for b in batches:
        keep = []
        for a, x, y in zip(b.column("a").to_pylist(), b.column("x").cast(pa.binary()), b.column("y").cast(pa.binary())):
            if a != last:
                last, held = a, shingles(x.as_py())
            keep.append(near(held, shingles(y.as_py())))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, text) of a document of each node, one of those that share its place."""
    need = materialize(nodes.select("fp", F.col("at.doc_id").alias("id"), F.col("at.version").alias("v")), "need")
    rows = _texts(docs)
    out = materialize(rows.join(need, rows["doc_id"].eqNullSafe(need["id"]) & (rows["version"] == need["v"])).select("fp", "text").dropDuplicates(["fp"]), "texts")
    release(need)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are near, from the texts of one document each."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    texts = _texts_of(nodes.join(ends, "fp"), docs)
    x, y = (texts.select(F.col("fp").alias(n), F.col("text").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    out = materialize(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").transform(small_batches).mapInArrow(_near, "a long, b long"), "near")
    release(texts)
    return out


def _keyed(nodes: DataFrame, bits: int, tables: int, columns: tuple[str, ...] = ("fp", "root", *_WORDS)) -> DataFrame:
    """(key, ...) of every node in every table, with columns of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(w).to_numpy().view(np.uint64) for w in _WORDS], axis=1)
            at = pa.array(np.repeat(np.arange(b.num_rows), tables))
            yield pa.RecordBatch.from_arrays([pa.array(keys(words, bits, tables).reshape(-1)), *(b.column(c).take(at) for c in columns)], ["key", *columns])

    rows = nodes.select(*dict.fromkeys((*_WORDS, *columns))).transform(small_batches)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *columns)))


def _forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) make a least spanning forest over groups of indices, by Boruvka's rounds; ties by the pairs' order."""
    rank = np.empty(len(weight), np.int64)
    rank[np.lexsort((np.arange(len(weight)), weight))] = np.arange(len(weight))
    chosen, forest, alive = np.zeros(len(i), bool), Forest(len(group)), np.arange(len(i))
    forest.link(np.arange(len(group)), group)
    while True:
        p = forest.roots()
        a, b = p[i[alive]], p[j[alive]]
        apart = a != b
        alive, a, b = alive[apart], a[apart], b[apart]
        if not len(alive):
            return chosen
        best = np.full(len(group), len(weight))
        np.minimum.at(best, a, rank[alive])
        np.minimum.at(best, b, rank[alive])
        now = alive[(rank[alive] == best[a]) | (rank[alive] == best[b])]
        chosen[now] = True
        forest.link(i[now], j[now])


_CELL = ["key", "lo", "hi"]


def _near_in(t: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within the radius and of different roots in cells that begin at starts, and a number for each row's root."""
    words = np.stack([t.column(w).to_numpy().view(np.uint64) for w in _WORDS], axis=1)
    _, root = np.unique(t.column("root").to_numpy(), return_inverse=True)
    found = [(i[ok], j[ok]) for i, j in bit_sliced_pairs(starts, words, RADIUS) if (ok := root[i] != root[j]).any()]
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return i, j, root


def _parts(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of a few whole cells, and where these begin."""
    for t in whole_cells(batches, _CELL, at_least):
        starts = boundaries(t, _CELL)
        ends = np.append(starts, t.num_rows)
        for c, d in slices(starts, t.num_rows):
            yield t.slice(ends[c], ends[d] - ends[c]), starts[c:d] - ends[c]


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b, null) of a least spanning forest, by distance, of each cell's candidates, and (null, null, key) for cells that have more of them."""
    for t, starts in _parts(batches, _AT_ONCE):
        i, j, root = _near_in(t, starts)
        if not len(i):
            continue
        words = np.stack([t.column(w).to_numpy().view(np.uint64) for w in _WORDS], axis=1)
        take = _forest(i, j, np.bitwise_count(words[i] ^ words[j]).sum(axis=1), np.arange(t.num_rows))
        fp, cell = t.column("fp").to_numpy(), np.searchsorted(starts, i, "right") - 1
        a, b = fp[i[take]], fp[j[take]]
        more = np.unique(t.column("key").to_numpy()[starts[np.unique(cell[~take])]])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64())] * 2 + [pa.array(more)], ["a", "b", "key"])


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) of a cell's rows that have a candidate of another root."""
    for t, starts in _parts(batches, _AT_ONCE):
        i, j, _ = _near_in(t, starts)
        rows = np.unique(np.concatenate((i, j)))
        yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[rows]) for c in ("key", "fp")], ["key", "fp"])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest, as (a, b), of each cell's candidates of different roots that hold, by the cell's sets."""
    for t, starts in _parts(batches, 1):
        i, j, root = _near_in(t, starts)
        if not len(i):
            continue
        sets = t.column("hashes").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
        _, at = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        size, mark = np.diff(ends), np.zeros(len(at) and at.max() + 1, bool)
        alike = np.minimum(size[i], size[j]) * NEAR[1] >= np.maximum(size[i], size[j]) * NEAR[0]
        i, j = i[alike], j[alike]
        # one tree for each root of a cell, from the start
        cell = np.searchsorted(starts, np.arange(t.num_rows), "right")
        _, first, of = np.unique(cell * (root.max() + 1) + root, return_index=True, return_inverse=True)
        tree, out = first[of], []
        for k in np.unique(i).tolist():
            others = j[i == k] if len(i) < 64 else j[np.searchsorted(i, k) : np.searchsorted(i, k, "right")]
            others = others[tree[others] != tree[k]]
            if not len(others):
                continue
            mark[at[ends[k] : ends[k + 1]]] = True
            spans = [at[ends[x] : ends[x + 1]] for x in others.tolist()]
            both = np.add.reduceat(mark[np.concatenate(spans)], np.concatenate(([0], np.cumsum([len(x) for x in spans])[:-1])), dtype=np.int64)
            mark[at[ends[k] : ends[k + 1]]] = False
            for x in others[NEAR[1] * both >= NEAR[0] * (size[k] + size[others] - both)].tolist():
                if tree[x] != tree[k]:
                    out.append((k, x))
                    tree[tree == tree[x]] = tree[k]
        if out:
            fp = t.column("fp").to_numpy()
            a, b = fp[[x for x, _ in out]], fp[[y for _, y in out]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _celled(keyed: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """keyed's rows dealt out by key, and where `chunks` has more than one for a key, to each pair of them; sorted."""
    hot = materialize(chunks.filter("chunks > 1"), "hot-keys")
    cut = keyed.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "root", *_WORDS, *columns)
    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "fp").transform(small_batches)


def links(nodes: DataFrame, docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect the same sets as all candidates that hold; nodes: one row per fp, with size, fingerprint and the place `at` of a document."""
    bits, tables = plan(nodes.count())
    rows = F.ceil(F.count("*") / chunk).cast("int")
    keyed, by_key = _keyed(nodes.withColumn("root", F.col("fp")), bits, tables), _keyed(nodes, bits, tables, ()).groupBy("key")
    met = materialize(_celled(keyed, by_key.agg(rows.alias("chunks"))).mapInArrow(_first, "a long, b long, key long"), "met")
    sizes = nodes.select("fp", "size")
    pairs = met.filter("a is not null").select("a", "b").distinct()
    pairs = pairs.join(sizes.select(F.col("fp").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("fp").alias("b"), F.col("size").alias("size_b")), "b")
    # a similarity of two sets is at most the ratio of their sizes
    pairs = materialize(pairs.filter(F.least("size_a", "size_b") * NEAR[1] >= F.greatest("size_a", "size_b") * NEAR[0]).select("a", "b"), "pairs")
    edges = _verified(pairs, nodes, docs)
    more = materialize(met.filter("key is not null").select("key").distinct(), "more")
    if more.isEmpty():
        return edges
    # what has more candidates is an end of one of the forest's
    ends = met.filter("a is not null").select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    rooted = materialize(nodes.join(ends, "fp", "left_semi").join(connected_components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    again = materialize(_keyed(rooted, bits, tables).join(more, "key", "left_semi"), "again")
    alive = materialize(_celled(again, again.groupBy("key").agg(rows.alias("chunks"))).mapInArrow(_alive, "key long, fp long").distinct(), "alive")
    sets = materialize(_texts_of(rooted.join(alive.select("fp").distinct(), "fp", "left_semi"), docs).transform(small_batches).mapInArrow(_hashes, "fp long, hashes array<long>"), "node-sets")
    apart = alive.join(rooted.select("fp", "root", "size", *_WORDS), "fp")
    chunks = apart.groupBy("key").agg(F.greatest(rows, F.ceil(F.sum("size") / CHUNK_SHINGLES).cast("int")).alias("chunks"))
    proved = materialize(_celled(apart.join(sets, "fp"), chunks, "hashes").mapInArrow(_proved, "a long, b long").distinct(), "proved")
    release(met, pairs, more, rooted, again, alive, sets)
    return edges.union(proved)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array([shingles(x.as_py()).view(np.int64) for x in b.column("text").cast(pa.binary())], pa.list_(pa.int64()))], ["fp", "hashes"])


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each group that links of a similarity of 0.8 or more connect, the one with the smallest doc_id; all columns as they are.

    Similarity is the Jaccard similarity of the sets of five-word shingles; links are those of candidates, which MEET and RADIUS make nearly all. Null, empty and
    blank texts have one set in common, equal texts of course too. Of repeated rows one stays. Where several rows of a group share that doc_id, one of them stays; so does one of a group
    without any doc_id. Very long texts are read whole; other columns may have any names. An empty table gives an empty result.
    """
    rows = materialize(_sets(docs), "sets")
    nodes = materialize(rows.groupBy("fp").agg(F.first("size").alias("size"), *[F.first(w).alias(w) for w in _WORDS], F.min(F.struct("doc_id", "version")).alias("at")), "nodes")
    out = one_of_each(docs, rows.select("doc_id", "version", "fp"), lambda _: links(nodes, docs))
    release(rows, nodes)
    return out
