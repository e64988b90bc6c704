"""Read quality reports: twelve modules, each an aggregate and a rule that passes, warns or fails it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..functions import sequence as sq
from ..functions import special
from .sequences import numbered

# Adapters that are looked for by their first twelve bases, and common contaminants.
ADAPTERS = (
    ("Illumina Universal Adapter", "AGATCGGAAGAG"), ("Illumina Small RNA 3' Adapter", "TGGAATTCTCGG"), ("Illumina Small RNA 5' Adapter", "GATCGTCGGACT"),
    ("Nextera Transposase Sequence", "CTGTCTCTTATA"), ("PolyA", "A" * 12), ("PolyG", "G" * 12),
)
CONTAMINANTS = (("TruSeq Adapter, Read 1", kn.TRUSEQ_R1), ("TruSeq Adapter, Read 2", kn.TRUSEQ_R2))
#: Reads among which sequences are found that are then counted in all reads; every how manieth read gives k-mers.
TRACKED, EVERY = 100_000, 50
KMER, KMER_BASES = 7, 500


#: Characters that are counted at once.
_AT_ONCE = 1 << 20


def _groups(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns of whole numbers from 0 on, and how often each is there."""
    sizes = [int(k.max(initial=0)) + 1 for k in keys]
    code = np.zeros(len(keys[0]), np.int64)
    for k, size in zip(keys, sizes):
        code = code * size + k
    if np.prod(sizes, dtype=float) <= 4 * _AT_ONCE:
        n = np.bincount(code)
        code = np.flatnonzero(n)
        n = n[code]
    else:
        code, n = np.unique(code, return_counts=True)
    out = []
    for size in reversed(sizes):
        out.insert(0, code % size)
        code = code // size
    return out, n


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of some texts, their places from 1, and the texts' lengths."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    joined = "".join(t or "" for t in texts)
    flat = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    return flat, np.arange(1, len(flat) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the numbers of each text."""
    upto = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


def _first_places(texts: list[str], pattern: str) -> np.ndarray:
    """Where a pattern, in upper case, first is in each text that has it, from 1."""
    joined = "\0".join(texts)
    if not joined.isascii():
        at = np.array([t.upper().find(pattern) + 1 for t in texts], np.int64)
        return at[at > 0]
    joined, found, at = joined.upper(), [], 0
    while (at := joined.find(pattern, at)) >= 0:
        begin = joined.rfind("\0", 0, at) + 1
        found.append(at - begin + 1)
        at = joined.find("\0", at)
        if at < 0:
            break
    return np.array(found, np.int64)


def _counted(b: pa.RecordBatch, what: str, offset: int) -> Iterator[pa.RecordBatch]:
    def rows(kind: str, n, pos=None, value=None, tile=None) -> pa.RecordBatch:
        column = lambda x: pa.nulls(len(n), pa.int64()) if x is None else pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), column(tile), column(pos), column(value), column(n)], names=["what", "tile", "pos", "value", "n"])

    if set(what) & set("qm"):
        flat, place, lengths = _characters(b.column("qual").to_pylist())
        if "q" in what:
            tiles = pc.dictionary_encode(b.column("tile"), null_encoding="encode")
            (tile, pos, c), n = _groups(tiles.indices.to_numpy(zero_copy_only=False).astype(np.int64).repeat(lengths), place, flat)
            yield rows("q", n, pos, c - offset, tiles.dictionary.take(pa.array(tile)))
        if "m" in what:
            size = lengths[lengths > 0]
            total = _sums(flat, lengths)[lengths > 0] - offset * size
            mean, n = np.unique(np.sign(total) * ((2 * np.abs(total) + size) // (2 * size)), return_counts=True)
            yield rows("m", n, value=mean)
    if set(what) & set("clp"):
        seqs = b.column("seq").to_pylist()
        flat, place, lengths = _characters(seqs)
        flat = kn.upper(flat) if flat.dtype == np.uint8 else np.where((flat >= ord("a")) & (flat <= ord("z")), flat - 32, flat)
        if "c" in what:
            (pos, c), n = _groups(place, flat)
            yield rows("c", n, pos, c)
        if "l" in what:
            none = np.array([t is None for t in seqs], bool)
            (size, gc), n = _groups(lengths[~none], _sums((flat == ord("G")) | (flat == ord("C")), lengths)[~none])
            yield rows("l", n, size, gc)
            if none.any():
                yield rows("l", [int(none.sum())])
        if "p" in what:
            for k, (_, text) in enumerate(ADAPTERS):
                at, n = np.unique(_first_places([t for t in seqs if t], text), return_counts=True)
                yield rows("p", n, at, np.full(len(n), k))


def _tally(df: DataFrame, what: str = "qmclp", offset: int = 33) -> DataFrame:
    """(what, tile, pos, value, n): what modules count, in one pass over the reads; a batch is counted as a whole, so that characters never are rows.

    q: qualities by tile and place (value), m: reads by mean quality, rounded (value), c: characters in upper case by place (value: code point),
    l: reads by length (pos; null for no sequence) and G and C (value), p: reads by the first place of an adapter (value: its number).
    """
    parts = F.split(F.col("id"), ":")
    tile = F.when(F.size(parts) >= 7, F.get(parts, F.lit(4))).when(F.size(parts) == 5, F.get(parts, F.lit(2))).try_cast("long")
    columns = ([tile.alias("tile")] if "q" in what else []) + (["qual"] if set(what) & set("qm") else []) + (["seq"] if set(what) & set("clp") else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.schema.names if c != "tile"]
            upto, k = np.cumsum(np.maximum.reduce(sizes)), 0
            while k < len(upto):
                end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + _AT_ONCE, "right")))
                yield from _counted(b.slice(k, end - k), what, offset)
                k = end

    counts = df.select(*columns).mapInArrow(run, "what string, tile long, pos long, value long, n long")
    return counts.groupBy("what", "tile", "pos", "value").agg(F.sum("n").alias("n"))


def _status(warn: Column, fail: Column) -> Column:
    return F.when(fail, "fail").when(warn, "warn").otherwise("pass").alias("status")


def basic(df: DataFrame) -> DataFrame:
    """One row: reads, shortest and longest, GC in whole percent, encoding by the lowest quality character (under 64: Sanger)."""
    lowest = F.min(F.ascii(F.array_min(F.filter(F.split("qual", ""), lambda c: c != ""))))
    return df.agg(
        F.count("*").alias("reads"), F.min(sq.length("seq")).alias("shortest"), F.max(sq.length("seq")).alias("longest"), F.round(100.0 * F.sum(sq.count_any("seq", "GCgc")) / F.sum(F.length("seq"))).cast("long").alias("gc"),
        F.when(lowest < 64, "Sanger / Illumina 1.9").otherwise("Illumina 1.5").alias("encoding"),
    )


def base_quality(df: DataFrame, offset: int = 33) -> DataFrame:
    """Per position: mean, and the lowest qualities that 10, 25, 50, 75 and 90 percent of the reads reach down to."""
    return _base_quality(_tally(df, "q", offset))


def _base_quality(tally: DataFrame) -> DataFrame:
    counts = tally.filter("what = 'q'").groupBy("pos", F.col("value").alias("q")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy("pos").orderBy("q")
    cum = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", F.sum("n").over(Window.partitionBy("pos")))
    at = lambda share, name: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("q"))).cast("long").alias(name)
    return cum.groupBy("pos").agg(F.round(F.sum(F.col("q") * F.col("n")) / F.first("total"), 6).alias("mean"), at(0.5, "median"), at(0.25, "q25"), at(0.75, "q75"), at(0.1, "p10"), at(0.9, "p90"))


def tile_quality(df: DataFrame, offset: int = 33) -> DataFrame:
    """Per tile and position: mean quality less that of all tiles. The tile is the fifth of seven or more fields of a header, or the third of five."""
    return _tile_quality(_tally(df, "q", offset))


def _tile_quality(tally: DataFrame) -> DataFrame:
    sums = tally.filter("what = 'q' and tile is not null").groupBy("tile", "pos").agg(F.sum(F.col("value") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    every = Window.partitionBy("pos")
    return sums.select("tile", "pos", F.round(F.col("s") / F.col("n") - F.sum("s").over(every) / F.sum("n").over(every), 6).alias("deviation"))


def sequence_quality(df: DataFrame, offset: int = 33) -> DataFrame:
    """Reads by mean quality, rounded."""
    return _sequence_quality(_tally(df, "m", offset))


def _sequence_quality(tally: DataFrame) -> DataFrame:
    return tally.filter("what = 'm'").select(F.col("value").alias("quality"), "n")


def _base_counts(tally: DataFrame) -> DataFrame:
    """(pos, c, n): characters in upper case by position, other than ASCII as ?."""
    return tally.filter("what = 'c'").select("pos", F.when(F.col("value") < 128, F.char("value")).otherwise("?").alias("c"), "n")


def base_content(df: DataFrame) -> DataFrame:
    """Per position: percent of G, A, T and C."""
    return _base_content(_tally(df, "c"))


def _base_content(tally: DataFrame) -> DataFrame:
    share = lambda b: F.round(100.0 * F.coalesce(F.sum(F.when(F.col("c") == b, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias(b.lower())
    return _base_counts(tally).groupBy("pos").agg(share("G"), share("A"), share("T"), share("C"))


def sequence_gc(df: DataFrame) -> DataFrame:
    """Reads by GC percent, each split over the two whole percents next to it, and what a normal distribution of the same mean and variance has."""
    return _sequence_gc(_tally(df, "l"))


def _sequence_gc(tally: DataFrame) -> DataFrame:
    gc = tally.filter("what = 'l' and pos > 0").select((F.col("value") / F.col("pos") * 100).alias("p"), "n")
    low = F.floor("p")
    bins = F.array(F.struct(low.alias("gc"), (1 - (F.col("p") - low)).alias("w")), F.struct((low + 1).alias("gc"), (F.col("p") - low).alias("w")))
    seen = gc.select(F.explode(bins).alias("b"), "n").filter("b.w > 0").groupBy("b.gc").agg(F.sum(F.col("b.w") * F.col("n")).alias("n"))
    all_ = tally.sparkSession.range(101).select(F.col("id").alias("gc")).join(F.broadcast(seen), "gc", "left").select("gc", F.coalesce("n", F.lit(0.0)).alias("n"))
    every = Window.partitionBy()  # 101 rows
    total = F.sum("n").over(every)
    mean = F.sum(F.col("gc") * F.col("n")).over(every) / total
    with_mean = all_.withColumn("total", total).withColumn("mean", mean)
    d = F.col("gc") - F.col("mean")
    with_var = with_mean.withColumn("var", F.sum(d * d * F.col("n")).over(every) / F.col("total"))
    raw = with_var.withColumn("raw", F.when(F.col("var") > 0, F.exp(-0.5 * d * d / F.col("var"))).otherwise((F.col("gc") == F.round("mean")).cast("double")))
    return raw.select("gc", F.round("n", 6).alias("n"), F.round(F.coalesce(F.col("raw") * F.col("total") / F.sum("raw").over(every), F.lit(0.0)), 6).alias("expected"))


def n_content(df: DataFrame) -> DataFrame:
    """Per position: percent of N."""
    return _n_content(_tally(df, "c"))


def _n_content(tally: DataFrame) -> DataFrame:
    return _base_counts(tally).groupBy("pos").agg(F.round(100.0 * F.coalesce(F.sum(F.when(F.col("c") == "N", F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("n"))


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy(sq.length("seq").alias("length")).agg(F.count("*").alias("n"))


def _tracked(df: DataFrame) -> DataFrame:
    """(key, n): sequences (their first 50 bases if they have over 75) that occur among the first reads, counted in all."""
    key = F.when(F.length("seq") > 75, F.substring("seq", 1, 50)).otherwise(F.col("seq"))
    keyed = numbered(df).select("number", key.alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("number").alias("first")).filter(F.col("first") < TRACKED).drop("first")


_LEVELS = ((10, ">10"), (50, ">50"), (100, ">100"), (500, ">500"), (1000, ">1k"), (5000, ">5k"), (10000, ">10k"))


def duplication(df: DataFrame) -> DataFrame:
    """Per level of duplication: percent of distinct sequences and of reads."""
    level = F.col("n").cast("string")
    for least, name in _LEVELS:
        level = F.when(F.col("n") >= least, name).otherwise(level)
    every = Window.partitionBy()  # a row a level
    levels = _tracked(df).groupBy(level.alias("level")).agg(F.count("*").alias("d"), F.sum("n").alias("r"))
    return levels.select("level", F.round(100.0 * F.col("d") / F.sum("d").over(every), 6).alias("distinct_share"), F.round(100.0 * F.col("r") / F.sum("r").over(every), 6).alias("read_share"))


def contaminant(seq: str, contaminants=CONTAMINANTS) -> str:
    """The first contaminant that agrees with a sequence up to one mismatch, the shorter of both somewhere in the longer and at least 20 bases long (or as long as the contaminant)."""
    a = kn.array(seq)
    for name, text in contaminants:
        b = kn.array(text)
        short, long_ = (a, b) if len(a) <= len(b) else (b, a)
        if len(short) and len(short) >= min(len(b), 20):
            if ((np.lib.stride_tricks.sliding_window_view(long_, len(short)) != short).sum(axis=1) <= 1).any():
                return name
    return "No Hit"


def overrepresented(df: DataFrame, contaminants=CONTAMINANTS) -> DataFrame:
    """Tracked sequences with over 0.1 percent of all reads: count, percent and possible source."""
    total = df.agg(F.count("*").alias("total"))
    rows = _tracked(df).crossJoin(F.broadcast(total)).filter(F.col("n") > 0.001 * F.col("total"))  # by one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["source"] = [contaminant(s, contaminants) for s in b["key"]]
            yield b

    return rows.select("key", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share")).mapInPandas(run, "key string, n long, share double, source string")


def adapter_content(df: DataFrame) -> DataFrame:
    """Per adapter and position: percent of reads in which the adapter has begun by then."""
    up = F.upper("seq")
    firsts = F.array(*[F.struct(F.lit(name).alias("adapter"), F.instr(up, text).cast("long").alias("pos")) for name, text in ADAPTERS])
    hits = df.select(F.explode(firsts).alias("h")).filter("h.pos > 0").groupBy("h.adapter", "h.pos").agg(F.count("*").alias("n"))
    return _adapter_content(hits, df.agg(F.max(F.length("seq")).alias("longest"), F.count("*").alias("total")))


def _adapter_content(hits: DataFrame, size: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(name) for name, _ in ADAPTERS])
    grid = size.filter("longest > 0").select("total", F.explode(names).alias("adapter"), "longest").select("total", "adapter", F.explode(F.expr("sequence(1L, cast(longest as long))")).alias("pos"))
    run = Window.partitionBy("adapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(hits, ["adapter", "pos"], "left").select("adapter", "pos", F.round(100.0 * F.coalesce(F.sum("n").over(run), F.lit(0)) / F.col("total"), 6).alias("share"))


def _kmers(df: DataFrame) -> DataFrame:
    """Each 7-mer of every 50th read: count, best position, its count over what is expected, and the chance of that."""
    few = numbered(df).filter(F.col("number") % EVERY == 0).select(F.upper(F.substring("seq", 1, KMER_BASES)).alias("seq"))
    places = few.agg(F.max(F.greatest(F.length("seq") - KMER + 1, F.lit(0))).alias("places"))
    windows = few.select(F.explode(sq.kmers("seq", KMER)).alias("x")).select("x.kmer", (F.col("x.pos") + 1).alias("pos")).filter(F.col("kmer").rlike("^[ACGT]+$"))
    by = windows.groupBy("kmer", "pos").agg(F.count("*").alias("n")).groupBy("kmer").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("pos", F.struct("n", -F.col("pos"))).cast("long").alias("pos"))
    rows = by.crossJoin(F.broadcast(places)).withColumn("ratio", F.col("most") * F.col("places") / F.col("n"))  # by one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["p_value"] = [special.binomial_sf(int(m), int(n), 1 / p) for m, n, p in zip(b["most"], b["n"], b["places"])]
            yield b[["kmer", "n", "p_value", "ratio", "pos"]]

    return rows.mapInPandas(run, "kmer string, n long, p_value double, ratio double, pos long")


def kmer_content(df: DataFrame, top: int = 6) -> DataFrame:
    """The six 7-mers that are most frequent at one position against all."""
    return _kmers(df).orderBy(F.desc("ratio"), "kmer").limit(top)


def summary(df: DataFrame, store) -> DataFrame:
    """(module, status): pass, warn or fail by each module's rule. `store` writes a frame and reads it back, so that the reads are counted once for all modules that go by counts."""
    one = lambda name, frame, warn, fail: frame.agg(F.lit(name).alias("module"), _status(warn, fail))
    worst = lambda c: F.coalesce(F.max(c), F.lit(0.0))
    tally = store(_tally(df))
    sizes = tally.filter("what = 'l'")
    size = sizes.agg(F.max("pos").alias("longest"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    adapter = F.element_at(F.array(*[F.lit(name) for name, _ in ADAPTERS]), (F.col("value") + 1).cast("int"))
    adapters = _adapter_content(tally.filter("what = 'p'").select(adapter.alias("adapter"), "pos", "n"), size)
    quality, gc, tracked = _base_quality(tally), _sequence_gc(tally), store(_tracked(df))
    odd = F.coalesce(F.sum(F.abs(F.col("n") - F.col("expected"))) / 2 / F.sum("n"), F.lit(0.0))
    copies = F.coalesce(1 - F.count("*") / F.sum("n"), F.lit(0.0))
    gap = worst(F.greatest(F.abs(F.col("a") - F.col("t")), F.abs(F.col("g") - F.col("c"))))
    mode = F.max_by("quality", F.struct("n", -F.col("quality")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    parts = [
        tally.agg(F.lit("basic").alias("module"), F.lit("pass").alias("status")),
        one("base_quality", quality, any_((F.col("q25") < 10) | (F.col("median") < 25)), any_((F.col("q25") < 5) | (F.col("median") < 20))),
        one("tile_quality", _tile_quality(tally), F.coalesce(F.min("deviation"), F.lit(0.0)) < -2, F.coalesce(F.min("deviation"), F.lit(0.0)) < -5),
        one("sequence_quality", _sequence_quality(tally), mode < 27, mode < 20),
        one("base_content", _base_content(tally), gap > 10, gap > 20),
        one("sequence_gc", gc, odd > 0.15, odd > 0.30),
        one("n_content", _n_content(tally), worst("n") > 5, worst("n") > 20),
        one("lengths", sizes.groupBy(F.col("pos").alias("length")).agg(F.sum("n").alias("n")), F.count("*") > 1, any_(F.col("length") == 0)),
        one("duplication", tracked, copies > 0.2, copies > 0.5),
        one("overrepresented", tracked.crossJoin(F.broadcast(size)), worst(F.col("n") / F.col("total")) > 0.001, worst(F.col("n") / F.col("total")) > 0.01),
        one("adapter_content", adapters, worst("share") > 5, worst("share") > 10),
        one("kmer_content", _kmers(df), F.coalesce(F.min("p_value"), F.lit(1.0)) < 0.01, F.coalesce(F.min("p_value"), F.lit(1.0)) < 1e-5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
