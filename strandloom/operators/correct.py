"""K-mer error correction of reads, by rounds of joins with the table of solid k-mers.

The table of k-mers grows with the genome, so it is never sent to the executors: each round asks it only for the k-mers that
decide the next base to either side of each read's longest solid stretch. A round settles at most one base a side and read; rounds go on until none does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from . import kmers as km


def _solid_positions(reads: DataFrame, solid: DataFrame, k: int) -> DataFrame:
    """(ord, pos) of the windows that are solid k-mers."""
    return km.kmers(reads, k, canonical=True).join(solid.select("kmer"), "kmer", "left_semi").select("ord", "pos")


def _islands(positions: DataFrame) -> DataFrame:
    """(ord, a, b): first and last window of each read's longest run of solid ones, the first of several."""
    run = F.col("pos") - F.row_number().over(Window.partitionBy("ord").orderBy("pos"))
    runs = positions.withColumn("run", run).groupBy("ord", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return runs.groupBy("ord").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("i")).select("ord", "i.a", "i.b")


def _put(seq, place, base):
    """seq with one base at a place from 0; places under 0 change nothing."""
    return F.when(place >= 0, F.overlay(seq, base, (place + 1).cast("int"), F.lit(1))).otherwise(seq)


def _first_stretch(state: DataFrame, counts: DataFrame, positions: DataFrame, k: int, mode: int) -> DataFrame:
    """(ord, place, base) for reads without a solid window: the one change of the first window of ACGT that makes it frequent.

    It must be more frequent than a third of the usual coverage, and no other change may be found three times.
    """
    none = state.join(positions.select("ord").distinct(), "ord", "left_anti")
    windows = km.kmers(none, k)
    first = windows.groupBy("ord").agg(F.min_by(F.struct("pos", "kmer"), "pos").alias("w")).select("ord", "w.pos", "w.kmer")
    at = first.select("ord", "pos", "kmer", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), F.array(*map(F.lit, "ACGT")).alias("bases")).select("ord", "pos", "kmer", "i", F.explode("bases").alias("base"))
    changed = at.filter(F.substr(F.col("kmer"), F.col("i") + 1, F.lit(1)) != F.col("base")).withColumn("kmer", sq.canonical(_put(F.col("kmer"), F.col("i"), F.col("base"))))
    ranked = changed.join(counts, "kmer").withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("n"), "i", "base"))).withColumn("next", F.lead("n").over(Window.partitionBy("ord").orderBy(F.desc("n"), "i", "base")))
    best = ranked.filter((F.col("rank") == 1) & (F.col("n") * 3 > mode) & (F.coalesce("next", F.lit(0)) < 3))
    return best.select("ord", (F.col("pos") + F.col("i")).alias("place"), "base")


def _next_bases(state: DataFrame, islands: DataFrame, solid: DataFrame, k: int, look: int) -> DataFrame:
    """(ord, left, left_base, right, right_base): the bases next to each stretch that make the windows from there on solid; -1 for no place.

    Of the other bases, the one with most solid windows in a row wins, if it is the only one.
    """
    last = F.length("seq") - k
    sides = F.filter(F.array(F.when(F.col("b") < last, F.struct(F.lit(1).alias("side"), (F.col("b") + k).alias("place"))), F.when(F.col("a") > 0, F.struct(F.lit(-1).alias("side"), (F.col("a") - 1).alias("place")))), lambda s: s.isNotNull())
    open_ = state.select("ord", "seq").join(islands, "ord").select("ord", "seq", "a", "b", F.explode(sides).alias("s")).select("ord", "seq", "a", "b", "s.side", "s.place")
    bases = open_.withColumn("base", F.explode(F.array(*map(F.lit, "ACGT")))).filter(F.substr(F.col("seq"), F.col("place") + 1, F.lit(1)) != F.col("base"))
    edited = bases.withColumn("seq", _put(F.col("seq"), F.col("place"), F.col("base")))
    starts = F.when(F.col("side") > 0, F.sequence(F.col("b") + 1, F.least(F.col("b") + look, last))).otherwise(F.sequence(F.col("a") - 1, F.greatest(F.col("a") - look, F.lit(0))))
    tested = edited.select("ord", "side", "place", "base", "seq", F.posexplode(starts).alias("j", "start")).select("ord", "side", "place", "base", "j", sq.canonical(F.substr(F.col("seq"), F.col("start") + 1, F.lit(k))).alias("kmer"))
    known = tested.join(solid.select("kmer", F.lit(True).alias("solid")), "kmer", "left")
    runs = known.groupBy("ord", "side", "place", "base").agg(F.coalesce(F.min(F.when(F.col("solid").isNull(), F.col("j"))), F.count("*")).cast("int").alias("run")).filter("run > 0")
    best = runs.withColumn("most", F.max("run").over(Window.partitionBy("ord", "side"))).filter("run = most").groupBy("ord", "side").agg(F.count("*").alias("n"), F.first("place").alias("place"), F.first("base").alias("base")).filter("n = 1")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return best.groupBy("ord").agg(F.coalesce(pick(-1, "place"), F.lit(-1)).alias("left"), pick(-1, "base").alias("left_base"), F.coalesce(pick(1, "place"), F.lit(-1)).alias("right"), pick(1, "base").alias("right_base"))


def correct(reads: DataFrame, store, k: int = 33, min_cov: int = 3, quality: int = 20, look: int = 5, no_correct: bool = False, discard: bool = False, drop_unique: bool = False, with_quality: bool = True) -> DataFrame:
    """(ord, id, seq, qual, n_corrected, correctable) of reads (ord, id, seq, qual).

    Corrected bases are lower case. Qualities of correctable reads say what was done: the base that stood there (from `\"` for A to `&` for N) where it was changed,
    else ? from the given quality on and + below it. Reads shorter than k, with over 5 percent N, or without a solid stretch stay as they are, or go
    if `discard`. drop_unique: reads with a k-mer that occurs once go. `store` writes a frame and reads it back.
    """
    if k % 2 == 0 or not 11 <= k <= 63:
        raise ValueError("k is odd, from 11 to 63")
    counts = store(km.count(reads, k))
    solid = store(counts.filter(F.col("n") >= min_cov))
    mode = counts.filter(F.col("n") >= min_cov).groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    upper = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    fit = (F.length("seq") >= k) & (sq.count_any(upper, "N") * 20 <= F.length("seq"))
    base = store(reads.select("ord", "id", F.col("seq").alias("given"), upper.alias("was"), "qual", fit.alias("fit")))
    state = store(base.filter("fit").select("ord", F.col("was").alias("seq")))
    if not no_correct and mode:
        first = store(_first_stretch(state, counts, _solid_positions(state, solid, k), k, int(mode[0]["n"])))
        state = store(state.join(first, "ord", "left").select("ord", F.coalesce(_put(F.col("seq"), F.col("place"), F.col("base")), "seq").alias("seq")))
        # every edit makes a read's longest stretch longer; a read that a round leaves as it is stays so, and isn't asked again
        active, rounds = state, []
        while True:
            edits = store(_next_bases(active, _islands(_solid_positions(active, solid, k)), solid, k, look))
            if edits.isEmpty():
                break
            changed = _put(_put(F.col("seq"), F.col("left"), F.col("left_base")), F.col("right"), F.col("right_base"))
            active = store(active.join(edits, "ord").select("ord", changed.alias("seq")))
            rounds.append(active.select("ord", "seq", F.lit(len(rounds)).alias("round")))
        if rounds:
            last = reduce(DataFrame.union, rounds).groupBy("ord").agg(F.max_by("seq", "round").alias("last"))
            state = store(state.join(last, "ord", "left").select("ord", F.coalesce("last", "seq").alias("seq")))
    found = _solid_positions(state, solid, k).select("ord").distinct().withColumn("found", F.lit(True))
    rows = base.join(state, "ord", "left").join(found, "ord", "left").withColumn("ok", F.coalesce("found", F.lit(False)))
    places = F.sequence(F.lit(1), F.length("was"))
    at = lambda c, i: F.substr(F.col(c), i, F.lit(1))
    is_changed = lambda i: at("seq", i) != at("was", i)
    seq = F.array_join(F.transform(places, lambda i: F.when(is_changed(i), F.lower(at("seq", i))).otherwise(at("seq", i))), "")
    fine = lambda i: (F.ascii(at("qual", i)) - 33 >= quality) & (at("was", i) != "N")
    qual = F.array_join(F.transform(places, lambda i: F.when(is_changed(i), F.translate(at("was", i), "ACGTN", "\"#$%&")).when(fine(i), "?").otherwise("+")), "")
    out = rows.select(
        "ord", "id", F.when(F.col("ok"), seq).otherwise(F.col("given")).alias("seq"), (F.when(F.col("ok"), qual).otherwise(F.col("qual")) if with_quality else F.lit("")).alias("qual"),
        F.when(F.col("ok"), F.size(F.filter(places, is_changed))).otherwise(0).cast("long").alias("n_corrected"), F.col("ok").alias("correctable"),
    )
    if discard:
        out = out.filter("correctable")
    if drop_unique:
        once = counts.filter("n <= 1").select("kmer")
        bad = km.kmers(out, k, canonical=True).join(once, "kmer", "left_semi").select("ord").distinct()
        out = out.join(bad, "ord", "left_anti")
    return out


def report(corrected: DataFrame) -> DataFrame:
    """One row of counters of correct()."""
    return corrected.agg(F.count("*").alias("reads"), F.count_if(F.col("n_corrected") > 0).alias("reads_corrected"), F.coalesce(F.sum("n_corrected"), F.lit(0)).alias("bases_corrected"), F.count_if(~F.col("correctable")).alias("uncorrectable"))
