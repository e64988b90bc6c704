"""Read trimming, merging and k-mer filtering: numpy kernels on Arrow batches, one narrow stage each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches as bt
from ..functions import kernels as kn
from .sequences import pairs


@dataclass(frozen=True)
class Trim:
    """Settings of trimming; empty adapters and False switch a layer off."""

    adapter1: str = kn.TRUSEQ_R1
    adapter2: str = kn.TRUSEQ_R2
    adapter_least: int = 5
    adapter_rate: float = 0.2
    poly_g: bool = False
    poly_g_base: str = "G"
    poly_g_least: int = 10
    poly_x: bool = False
    poly_x_least: int = 10
    poly_x_mismatches: int = 5
    poly_x_per: int = 8
    front1: int = 0
    tail1: int = 0
    front2: int = 0
    tail2: int = 0
    overlap: bool = False
    overlap_require: int = 30
    overlap_limit: int = 5
    overlap_share: float = 0.2
    least: int = 15

    def __post_init__(self):
        if self.poly_g_base.upper() not in "ACGT" or self.poly_x_per <= 0:
            raise ValueError("poly_g_base is one of ACGT, poly_x_per is positive")


_COUNTERS = ("adapter_reads", "adapter_bases", "poly_g_reads", "poly_g_bases", "poly_x_reads", "poly_x_bases", "fixed_bases", "overlap_pairs", "overlap_bases")


class _Reads:
    """Reads as rows of a matrix, their windows, cut from the end, and counters of what was cut by which layer."""

    def __init__(self, seqs: list[str], front: int, tail: int):
        self.bases, self.length = bt.matrix(seqs)
        self.whole = front + tail < self.length
        self.start = np.where(self.whole, front, 0)
        self.size = np.where(self.whole, self.length - front - tail, 0)
        self.done = {c: np.zeros(len(seqs), np.int64) for c in _COUNTERS}
        self.done["fixed_bases"] += np.where(self.whole, front + tail, 0)

    def windows(self, reverse: bool = False) -> np.ndarray:
        return bt.moved(self.bases, self.start, self.size, reverse)

    def cut(self, at: np.ndarray, layer: str, rows=True) -> None:
        now = rows & self.whole & (at >= 0) & (at < self.size)
        self.done[f"{layer}_reads"] += now
        self.done[f"{layer}_bases"] += np.where(now, self.size - at, 0)
        self.size = np.where(now, at, self.size)

    def adapter(self, t: Trim, adapter: str, rows=True) -> None:
        if adapter:
            self.cut(bt.adapter_starts(self.windows(), self.size, kn.array(adapter), t.adapter_least, t.adapter_rate), "adapter", rows)

    def poly_g(self, t: Trim) -> None:
        if t.poly_g:
            self.cut(bt.poly_tails(self.windows(reverse=True), self.size, t.poly_g_base, t.poly_g_least), "poly_g")

    def poly_x(self, t: Trim) -> None:
        if t.poly_x:
            self.cut(bt.dominant_tails(self.windows(reverse=True), self.size, t.poly_x_least, t.poly_x_mismatches, t.poly_x_per), "poly_x")


def _single(seqs: list[str], t: Trim) -> pd.DataFrame:
    """Window, whether it is kept, and counters of each read."""
    r = _Reads(seqs, t.front1, t.tail1)
    r.adapter(t, t.adapter1)
    r.poly_g(t)
    r.poly_x(t)
    return pd.DataFrame({"s": r.start, "e": r.start + r.size, "kept": r.whole & (r.size >= t.least), **r.done})


def _pair(seqs1: list[str], seqs2: list[str], t: Trim) -> pd.DataFrame:
    """Windows, whether they are kept, and counters of each pair."""
    a, b = _Reads(seqs1, t.front1, t.tail1), _Reads(seqs2, t.front2, t.tail2)
    whole = a.whole & b.whole
    for r in (a, b):
        r.start, r.size, r.whole = np.where(whole, r.start, 0), np.where(whole, r.size, 0), whole
        r.done["fixed_bases"] = np.where(whole, r.done["fixed_bases"], 0)
        r.poly_g(t)
    short = np.zeros(len(seqs1), bool)
    if t.overlap:
        found, offset, size = bt.trim_overlaps(a.windows(), a.size, bt.complements(b.windows(), b.size), b.size, t.overlap_require, t.overlap_limit, t.overlap_share)
        short = whole & found & (offset < 0)  # the insert is shorter than the reads: what is behind it is adapter
        for r, far in ((a, b.start), (b, a.start)):
            left = np.where(short, np.minimum(r.size, size + far), r.size)
            a.done["overlap_bases"] += r.size - left
            r.size = left
        a.done["overlap_pairs"] += short
    a.adapter(t, t.adapter1, ~short)
    b.adapter(t, t.adapter2, ~short)
    for r in (a, b):
        r.poly_x(t)
    kept = whole & (np.minimum(a.size, b.size) >= t.least)
    return pd.DataFrame({"s1": a.start, "e1": a.start + a.size, "s2": b.start, "e2": b.start + b.size, "kept": kept, **{c: a.done[c] + b.done[c] for c in _COUNTERS}})


_COUNTED = ", ".join(f"{c} long" for c in _COUNTERS)


def _by_parts(b: pd.DataFrame, columns: list[str], f, t: Trim) -> Iterator[pd.DataFrame]:
    """b with what f gives for its columns of sequences, in parts whose matrices are small enough."""
    for rows in bt.parts(np.maximum.reduce([b[c].str.len().to_numpy(np.int64) for c in columns])):
        part = b.iloc[rows].reset_index(drop=True)
        yield pd.concat([part, f(*(part[c].tolist() for c in columns), t)], axis=1)


def _windows(df: DataFrame, t: Trim) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _by_parts(b, ["seq"], _single, t)

    return df.select("ord", "id", "seq", "qual").mapInPandas(run, f"ord long, id string, seq string, qual string, s long, e long, kept boolean, {_COUNTED}")


def _pair_windows(both: DataFrame, t: Trim) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _by_parts(b, ["seq1", "seq2"], _pair, t)

    columns = "ord id1 seq1 qual1 id2 seq2 qual2".split()
    return both.select(*columns).mapInPandas(run, f"ord long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string, s1 long, e1 long, s2 long, e2 long, kept boolean, {_COUNTED}")


def _cut(c: str, s: str, e: str):
    return F.expr(f"substr({c}, cast({s} + 1 as int), cast({e} - {s} as int))")


def trim(df: DataFrame, t: Trim = Trim()) -> DataFrame:
    """Single reads cut at both ends by fixed lengths, then at the adapter, the poly-G and the poly-X tail; short ones go."""
    return _windows(df, t).filter("kept").select("ord", "id", _cut("seq", "s", "e").alias("seq"), _cut("qual", "s", "e").alias("qual"))


def trim_pairs(r1: DataFrame, r2: DataFrame, t: Trim = Trim()) -> DataFrame:
    """Pairs cut by fixed lengths, poly-G, the mates' overlap or else the adapters, and poly-X; pairs with a short mate go."""
    return trim_paired(pairs(r1, r2), t)


def trim_paired(both: DataFrame, t: Trim = Trim()) -> DataFrame:
    """trim_pairs, given the pairs."""
    w = _pair_windows(both, t).filter("kept")
    return w.select("ord", *(x for m in "12" for x in (F.col(f"id{m}"), _cut(f"seq{m}", f"s{m}", f"e{m}").alias(f"seq{m}"), _cut(f"qual{m}", f"s{m}", f"e{m}").alias(f"qual{m}"))))


def trim_report(df: DataFrame, t: Trim = Trim()) -> DataFrame:
    """One row of counters for single reads: reads and bases in and out, and cut by each layer."""
    w = _windows(df, t).withColumn("out", F.when(F.col("kept"), F.col("e") - F.col("s")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return w.agg(F.count("*").alias("reads_in"), F.count_if("kept").alias("reads_out"), zero(F.length("seq")).alias("bases_in"), zero("out").alias("bases_out"), F.count_if(~F.col("kept")).alias("too_short"), *(zero(c).alias(c) for c in _COUNTERS))


def merge(r1: DataFrame, r2: DataFrame, require: int = 30, limit: int = 5, percent: float = 20, correct: bool = False, include_unmerged: bool = False) -> DataFrame:
    """Overlapping mates made one read, named by the bases from either; include_unmerged adds the mates of the others."""
    return merge_paired(pairs(r1, r2), require, limit, percent, correct, include_unmerged)


def merge_paired(both: DataFrame, require: int = 30, limit: int = 5, percent: float = 20, correct: bool = False, include_unmerged: bool = False) -> DataFrame:
    """merge, given the pairs."""

    def part(b: pd.DataFrame) -> pd.DataFrame:
        (one, n), (two, m) = bt.matrix(b["seq1"].tolist()), bt.matrix(b["seq2"].tolist())
        found, offset, size, wrong = bt.merge_overlaps(one, n, bt.complements(two, m, merging=True), m, require, limit, percent)
        rows = []
        # what overlaps is put together one by one, the search is over
        at = np.flatnonzero(found)
        for ord_, id_, *texts, o, n_, w in zip(*(b[c].to_numpy()[at].tolist() for c in ("ord", "id1", "seq1", "qual1", "seq2", "qual2")), offset[at].tolist(), size[at].tolist(), wrong[at].tolist()):
            seq, qual, len1, len2, changed = kn.join_pair(*texts, (o, n_, w), correct)
            rows.append((ord_, 0, f"{id_} merged_{len1}_{len2}", seq, qual, True, changed))
        out = [pd.DataFrame(rows, columns=columns)]
        if include_unmerged:
            rest = b[~found]
            out += [pd.DataFrame({"ord": rest["ord"], "mate": k, "id": rest[f"id{k}"], "seq": rest[f"seq{k}"], "qual": rest[f"qual{k}"], "merged": False, "corrected": 0}) for k in (1, 2)]
        return pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)

    columns = "ord mate id seq qual merged corrected".split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows in bt.parts(np.maximum(b["seq1"].str.len().to_numpy(np.int64), b["seq2"].str.len().to_numpy(np.int64))):
                yield part(b.iloc[rows].reset_index(drop=True))

    return both.select(*"ord id1 seq1 qual1 id2 seq2 qual2".split()).mapInPandas(run, "ord long, mate int, id string, seq string, qual string, merged boolean, corrected long")


@dataclass(frozen=True)
class Duk:
    """Settings of k-mer filtering (ktrim f) and trimming (r, l), and of quality trimming (qtrim f, r, l, rl)."""

    k: int = 27
    mink: int = 0
    hdist: int = 0
    hdist2: int = 0
    rcomp: bool = True
    maskmiddle: bool = True
    min_hits: int = 1
    min_share: float = 0.0
    ktrim: str = "f"
    qtrim: str = "f"
    trimq: int = 6
    minlength: int = 10


def duk(df: DataFrame, references: list[str], d: Duk = Duk()) -> DataFrame:
    """Reads with what is left of them, and whether they match: (ord, id, seq, qual, matched). Reads that go are kept with matched true.

    The references (adapters, contaminants) are a parameter; their k-mers go to the executors once.
    """
    judge = _duk(df, references, d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["matched"] = ~judge(b, "seq", "qual")
            yield b

    return df.select("ord", "id", "seq", "qual").mapInPandas(run, "ord long, id string, seq string, qual string, matched boolean")


def _duk(df: DataFrame, references: list[str], d: Duk):
    """A function of a batch and its columns of sequences and qualities, which cuts these and gives the reads that stay."""
    if d.ktrim != "f" and not references:
        raise ValueError("k-mer trimming needs references")
    s = asdict(d)
    refs = df.sparkSession.sparkContext.broadcast(kn.References(references, **{n: s[n] for n in ("k", "mink", "hdist", "hdist2", "rcomp", "maskmiddle")}))
    rest = {n: s[n] for n in ("ktrim", "qtrim", "trimq", "minlength", "min_hits", "min_share")}

    def judge(b: pd.DataFrame, seq: str, qual: str) -> np.ndarray:
        start, end, kept = bt.kept_windows(b[seq].tolist(), b[qual].tolist(), refs.value, **rest)
        whole = ~kept | (start == 0) & (end == b[seq].str.len().to_numpy(np.int64))
        if not whole.all():
            for c in (seq, qual):
                b[c] = [t if w else t[x:y] for t, w, x, y in zip(b[c].tolist(), whole.tolist(), start.tolist(), end.tolist())]
        return kept

    return judge


def duk_paired(both: DataFrame, references: list[str], d: Duk = Duk()) -> DataFrame:
    """duk_pairs, given the pairs."""
    judge = _duk(both, references, d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = judge(b, "seq1", "qual1") & judge(b, "seq2", "qual2")
            yield b[kept]

    columns = "id1 seq1 qual1 id2 seq2 qual2".split()
    return both.select("ord", *columns).mapInPandas(run, f"ord long, {', '.join(f'{c} string' for c in columns)}")


def duk_pairs(r1: DataFrame, r2: DataFrame, references: list[str], d: Duk = Duk()) -> DataFrame:
    """Pairs of which neither mate goes."""
    one, two = (duk(r, references, d).filter("not matched").drop("matched") for r in (r1, r2))
    return one.select("ord", *(F.col(c).alias(f"{c}1") for c in ("id", "seq", "qual"))).join(two.select("ord", *(F.col(c).alias(f"{c}2") for c in ("id", "seq", "qual"))), "ord")
