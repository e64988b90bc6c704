"""K-mer counts, spectra and de Bruijn graphs on frames (ord, seq[, qual])."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches as bt
from ..functions import sequence as sq


#: Characters of a sequence that windows are taken of at once: the work of a window grows with its place.
PIECE = 512


def _windows(df: DataFrame, k: int, **columns) -> DataFrame:
    """df's sequences (or other columns of their length) cut into pieces that overlap by k - 1: ord, piece (its place in PIECEs), and the pieces by name."""
    size = max(PIECE, k)
    names = list(columns)
    cut = df.select("ord", *[sq.pieces(c, size, k - 1).alias(n) for n, c in columns.items()])
    # outer, as the filter on sizes that goes before an inner one would make the arrays twice
    if len(names) == 1:
        return cut.select("ord", F.posexplode_outer(names[0]).alias("piece", names[0])).filter("piece is not null")
    return cut.select("ord", F.posexplode_outer(F.arrays_zip(*names)).alias("piece", "x")).filter("piece is not null").select("ord", "piece", *[F.col("x").getField(n).alias(n) for n in names])


def kmers(df: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(ord, pos, kmer) for every window of A, C, G, T (either case, upper case in the result)."""
    pos = F.col("piece").cast("long") * max(PIECE, k) + F.col("x.pos")
    out = _windows(df, k, seq=F.upper("seq")).select("ord", "piece", F.explode_outer(sq.kmers("seq", k)).alias("x")).select("ord", pos.alias("pos"), "x.kmer").filter(F.col("kmer").rlike("^[ACGT]+$"))
    return out.withColumn("kmer", sq.canonical("kmer")) if canonical else out


#: The longest k-mers whose codes fit a long, and whose counts a task keeps in one array.
CODED, DENSE = 31, 11


def _partial(df: DataFrame, k: int, canonical: bool, least: int | None = None) -> DataFrame:
    """(code, n, good, ord): how often a k-mer occurs in a part of the reads, how often with all qualities (characters) from `least` on, and one read that has it.

    k is CODED at most. A k-mer has a row a task up to DENSE, else one for each stretch of windows that has it.
    """

    def rows(code: np.ndarray, n: np.ndarray, good: np.ndarray, ord_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (code, n, good, ord_)], names=["code", "n", "good", "ord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = 4**k if k <= DENSE else 0
        total, fine = np.zeros(dense, np.int64), np.zeros(dense if least is not None else 0, np.int64)
        some = np.zeros(dense, np.int64)
        for b in batches:
            ords = b.column("ord").to_numpy(zero_copy_only=False).astype(np.int64)
            low = None
            if least is not None:
                quals, _, starts = bt.joined(b.column("qual").to_pylist())
                low = np.concatenate(([0], np.cumsum(quals < least, dtype=np.int32)))
            for text, place, code, ok in bt.window_codes(b.column("seq").to_pylist(), k, canonical):
                text, place, code = text[ok], place[ok], code[ok]
                clean = code[:0]
                if low is not None:
                    at = starts[text] + place
                    clean = code[low[at + k] == low[at]]
                if dense:
                    total += np.bincount(code, minlength=dense)
                    some[code] = ords[text]
                    if low is not None:
                        fine += np.bincount(clean, minlength=dense)
                elif len(code):
                    values, first, n = np.unique(code, return_index=True, return_counts=True)
                    good = np.zeros(len(values), np.int64)
                    if len(clean):
                        c, m = np.unique(clean, return_counts=True)
                        good[np.searchsorted(values, c)] = m
                    yield rows(values, n, good, ords[text][first])
        found = np.flatnonzero(total)
        for s in range(0, len(found), 1 << 17):
            x = found[s : s + (1 << 17)]
            yield rows(x, total[x], fine[x] if least is not None else np.zeros(len(x), np.int64), some[x])

    return df.select("ord", "seq", *(["qual"] if least is not None else [])).mapInArrow(run, "code long, n long, good long, ord long")


def count(df: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """How often each k-mer occurs; with its strand's other reading if canonical."""
    if k <= CODED:
        return _partial(df, k, canonical).groupBy("code").agg(F.sum("n").alias("n")).select(sq.decode("code", k).alias("kmer"), "n")
    return kmers(df, k, canonical).groupBy("kmer").agg(F.count("*").alias("n"))


def spectrum(df: DataFrame, k: int, quality: int = 20, offset: int = 33) -> DataFrame:
    """Per canonical k-mer its coverage (up to 255) and how often all its bases have the quality (up to 63)."""
    if k <= CODED:
        sums = _partial(df, k, True, quality + offset).groupBy("code").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        return sums.select(sq.decode("code", k).alias("kmer"), F.least("n", F.lit(255)).alias("coverage"), F.least("good", F.lit(63)).alias("good"))
    reads = df.withColumn("low", F.translate("qual", "".join(chr(c) for c in range(33, 127)), "".join("l" if c - offset < quality else "h" for c in range(33, 127))))
    windows = _windows(reads, k, seq=F.upper("seq"), low=F.col("low")).select(F.explode_outer(sq.kmers("seq", k)).alias("x"), "low").select("x.kmer", F.substr(F.col("low"), F.col("x.pos") + 1, F.lit(k)).alias("low")).filter(F.col("kmer").rlike("^[ACGT]+$"))
    return windows.groupBy(sq.canonical("kmer").alias("kmer")).agg(F.least(F.count("*"), F.lit(255)).alias("coverage"), F.least(F.count_if(~F.col("low").contains("l")), F.lit(63)).alias("good"))


def coverage_mode(spectrum: DataFrame, least: int = 3) -> DataFrame:
    """One row: the coverage, from `least` on, that most k-mers have (the lowest of several) and how many have it."""
    counts = spectrum.filter(F.col("coverage") >= least).groupBy("coverage").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("coverage", F.struct("n", -F.col("coverage"))).alias("mode"), F.max("n").alias("n"))


def without_unique(df: DataFrame, k: int) -> DataFrame:
    """Reads none of whose k-mers occurs only once. Such a k-mer's read is known where it is counted: reads aren't asked for their k-mers again."""
    if k <= CODED:
        counts = _partial(df, k, True).groupBy("code").agg(F.sum("n").alias("n"), F.max("ord").alias("ord"))
    else:
        counts = kmers(df, k, canonical=True).groupBy("kmer").agg(F.count("*").alias("n"), F.max("ord").alias("ord"))
    return df.join(counts.filter("n <= 1").select("ord").distinct(), "ord", "left_anti")


def graph_edges(df: DataFrame, k: int) -> DataFrame:
    """Distinct edges of the de Bruijn graph: (source, target), the canonical k-1-mers at either end of a k-mer."""
    # a k-mer and its other strand have different edges: (a, b) and (b, a)
    windows = _partial(df, k, False).select("code").distinct().select(sq.decode("code", k).alias("kmer")) if k <= CODED else kmers(df, k)
    ends = windows.select(sq.canonical(F.substring("kmer", 1, k - 1)).alias("source"), sq.canonical(F.substring("kmer", 2, k - 1)).alias("target"))
    return ends.distinct()


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node, indegree, outdegree)."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("o"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("i"))
    return out.join(into, "node", "full").select("node", F.coalesce("i", F.lit(0).cast("long")).alias("indegree"), F.coalesce("o", F.lit(0).cast("long")).alias("outdegree"))


def unitigs(edges: DataFrame, store) -> DataFrame:
    """Maximal paths without branches: (unitig, node, place), named by their first node; a cycle starts at its smallest node.

    A node with one way out points to its target if that has one way in. Pointers are doubled until every node of an open path
    knows its head and its distance; nodes that never meet a head lie on cycles, which are cut before their smallest node and
    go through the same again. `store` writes a frame and reads it back, which keeps the plans of the rounds apart.
    """
    edges = store(edges)  # nodes and links read them, each of which would take the reads again
    nodes = store(graph_nodes(edges))
    one_out = nodes.filter("outdegree = 1").select(F.col("node").alias("source"))
    one_in = nodes.filter("indegree = 1").select(F.col("node").alias("target"))
    links = store(edges.filter("source <> target").join(one_out, "source", "left_semi").join(one_in, "target", "left_semi").select(F.col("target").alias("node"), F.col("source").alias("before")))
    return _paths(nodes.select("node"), links, store, True)


def _paths(nodes: DataFrame, links: DataFrame, store, cycles: bool) -> DataFrame:
    # head is null while a node doesn't know its head; `at` is `steps` nodes back; `least` is the smallest node on the way
    jump = store(nodes.join(links, "node", "left").select("node", F.coalesce("before", "node").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("before").isNull().alias("done"), F.least("node", F.coalesce("before", "node")).alias("least")))
    total, open_, turn = jump.count(), -1, 0
    while True:
        left = jump.filter("not done").count()
        # a path of n nodes is done after log2(n) rounds: if more rounds finish no node, the rest are cycles
        if left == 0 or left == open_ and 2**turn > total:
            break
        turn += 1
        open_ = left
        far = jump.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("more"), F.col("done").alias("ends"), F.col("least").alias("least2"))
        jump = store(jump.join(far, "at").select("node", F.when(F.col("done"), F.col("at")).otherwise(F.col("at2")).alias("at"), F.when(F.col("done"), F.col("steps")).otherwise(F.col("steps") + F.col("more")).alias("steps"), (F.col("done") | F.col("ends")).alias("done"), F.least("least", "least2").alias("least")))
    out = jump.filter("done").select(F.col("at").alias("unitig"), "node", F.col("steps").alias("place"))
    if not cycles or jump.filter("not done").isEmpty():
        return out
    round_ = store(jump.filter("not done").select("node", "least"))
    # the smallest node of a cycle loses its way back
    cut = links.join(round_, "node").filter("node <> least").select("node", "before")
    return out.union(_paths(round_.select("node"), store(cut), store, False))


def locate(df: DataFrame, pattern: str) -> DataFrame:
    """(ord, pos) of all places of a pattern, overlapping ones too, from 0; an empty pattern is everywhere. Sequences are cut into pieces that overlap, so that the work follows their length."""
    m = len(pattern)
    if not m:
        return df.select("ord", F.explode(F.sequence(F.lit(0), F.length("seq"))).alias("pos")).withColumn("pos", F.col("pos").cast("long"))
    found = _windows(df, m, seq=F.col("seq")).filter(F.col("seq").contains(pattern))
    at = F.filter(F.sequence(F.lit(0), F.length("seq") - m), lambda i: F.substr(F.col("seq"), i + 1, F.lit(m)) == pattern)
    return found.select("ord", "piece", F.explode(at).alias("at")).select("ord", (F.col("piece").cast("long") * max(PIECE, m) + F.col("at")).alias("pos"))


def rolling(df: DataFrame, k: int) -> DataFrame:
    """(ord, pos, code) of every window, in order: two bits a base, up to 31, null where a base is ambiguous. pos is the window's last base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ords = b.column("ord").to_numpy(zero_copy_only=False).astype(np.int64)
            for text, place, code, ok in bt.window_codes(b.column("seq").to_pylist(), k):
                yield pa.RecordBatch.from_arrays([pa.array(ords[text], pa.int64()), pa.array(place + (k - 1), pa.int64()), pa.array(code, pa.int64(), mask=~ok)], names=["ord", "pos", "code"])

    return df.select(F.col("ord").cast("long").alias("ord"), "seq").mapInArrow(run, "ord long, pos long, code long")
