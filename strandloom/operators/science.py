"""Statistics, population genetics, alignment, hidden Markov models, taxonomy and trees on DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align as al
from ..functions import phylo, special
from ..functions.hmm import Hmm
from ..storage import materialize, release
from .intervals import running

METHODS = {"bh": "bh", "fdr": "bh", "by": "by", "bonferroni": "bonferroni", "holm": "holm", "hochberg": "hochberg", "hommel": "hommel", "none": "none"}


def adjust(df: DataFrame, method: str = "bh", p: str = "p") -> DataFrame:
    """df with `adjusted`, the p-values adjusted for their number.

    Ranks and running extremes are taken over distinct values, by ranges of p, so that neither ties nor many values meet in one task.
    A p that is null, no number or outside 0 to 1 is an error, an unknown method a ValueError.
    """
    how = METHODS.get(method.lower())
    if how is None:
        raise ValueError(f"unknown method: {method}")
    bad = F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)
    df = df.withColumn(p, F.when(bad, F.raise_error(F.concat(F.lit("not a p-value: "), F.coalesce(F.col(p).cast("string"), F.lit("null")))).cast("double")).otherwise(F.col(p)))
    if how == "none":
        return df.withColumn("adjusted", F.col(p))
    if how == "hommel":
        return _hommel(df, p)
    n = df.agg(F.count("*").alias("total"))
    if how == "bonferroni":
        return df.crossJoin(F.broadcast(n)).withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.col("total"))).drop("total")  # by one row
    values = df.groupBy(F.col(p).alias("at")).agg(F.count("*").alias("ties")).withColumn("chrom", F.lit(""))
    width = 1 / 4096
    ranked = running(values, F.col("ties"), F.sum, tile=width).select("chrom", "at", "ties", (F.col("own") + F.coalesce("before", F.lit(0))).alias("upto")).crossJoin(F.broadcast(n))
    harmonic = F.lit(df.sparkSession.range(1, df.count() + 1).agg(F.coalesce(F.sum(1 / F.col("id")), F.lit(0.0))).first()[0]) if how == "by" else F.lit(1.0)
    first = F.col("upto") - F.col("ties") + 1
    value = {"bh": F.col("total") / F.col("upto") * F.col("at"), "by": harmonic * F.col("total") / F.col("upto") * F.col("at"), "holm": (F.col("total") - first + 1) * F.col("at"), "hochberg": (F.col("total") - F.col("upto") + 1) * F.col("at")}[how]
    up = how == "holm"
    steps = ranked.select("chrom", (F.col("at") if up else -F.col("at")).alias("at"), F.least(F.lit(1.0), value).alias("v"))
    best = running(steps, F.col("v"), F.max if up else F.min, tile=width)
    extreme = (F.greatest if up else F.least)("own", F.coalesce("before", "own"))
    found = best.select((F.col("at") if up else -F.col("at")).alias(p), extreme.alias("adjusted"))
    return df.join(found, p)


def _hommel(df: DataFrame, p: str) -> DataFrame:
    """Distinct values, 16 bytes each with their counts, are sorted and adjusted in one task, by n log n steps."""
    values = df.groupBy(F.col(p).alias("at")).agg(F.count("*").alias("ties"))

    def run(all_: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({p: all_["at"], "adjusted": special.hommel_ties(all_["at"].to_numpy(float), all_["ties"].to_numpy())})

    return df.join(values.groupBy().applyInPandas(run, f"{p} double, adjusted double"), p).select(*df.columns, "adjusted")


def _one_row(df: DataFrame, f, name: str = "p_value") -> DataFrame:
    """df (a row of aggregates, or a few) with f of each row, a number, as a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[name] = [f(r) for r in b.itertuples(index=False)]
            yield b

    return df.mapInPandas(run, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, {name} double")


def fisher_combine(df: DataFrame, p: str = "p") -> DataFrame:
    """One row: number of p-values, Fisher's statistic, combined p (0 if any p is 0)."""
    sums = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col(p) > 0, -2 * F.log(p))), F.lit(0.0)).alias("statistic"), F.count_if(F.col(p) == 0).alias("zeros"))
    return _one_row(sums, lambda r: 0.0 if r.zeros else special.chi2_sf_even(r.statistic, r.n) if r.n else math.nan).drop("zeros")


def stouffer_combine(df: DataFrame, p: str = "p", weight: Column | None = None) -> DataFrame:
    """One row: number of p-values and their combined p by weighted normal scores."""
    w = F.lit(1.0) if weight is None else weight

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return x.clip(1e-300, 1 - 1e-15).map(lambda v: -special.normal_quantile(v))

    sums = df.select(score(p).alias("z"), w.alias("w")).agg(F.count("*").alias("n"), (F.sum(F.col("z") * F.col("w")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("z"))
    return _one_row(sums, lambda r: special.normal_cdf(-r.z) if r.n else math.nan)


def _sided(alternative: str, both: float, greater: float, less: float) -> float:
    return min(1.0, max(0.0, {"two-sided": both, "greater": greater, "less": less}[alternative]))


def welch_t(df: DataFrame, value: str, group: Column, alternative: str = "two-sided") -> DataFrame:
    """One row: statistic, degrees of freedom and p of Welch's t-test; group is true for the first sample. Null p for samples under two or without variance."""
    rows = df.select(F.col(value).cast("double").alias("x"), group.alias("g"))
    part = lambda f, g: f(F.when(F.col("g") if g else ~F.col("g"), F.col("x")))
    sums = rows.agg(part(F.count, True).alias("n1"), part(F.count, False).alias("n2"), part(F.avg, True).alias("m1"), part(F.avg, False).alias("m2"), part(F.var_samp, True).alias("v1"), part(F.var_samp, False).alias("v2"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    out = sums.select(((F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).alias("statistic"), ((e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))).alias("df"))
    sf = special.student_sf

    def p(r) -> float | None:
        if r.statistic is None or r.df is None or math.isnan(r.statistic):
            return None
        return _sided(alternative, 2 * sf(abs(r.statistic), r.df), sf(r.statistic, r.df), 1 - sf(r.statistic, r.df))

    return _one_row(out, p)


def mann_whitney(df: DataFrame, value: str, group: Column, alternative: str = "two-sided") -> DataFrame:
    """One row: U of the first sample and p by the normal approximation with ties and continuity; ranks come from counts of distinct values."""
    values = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("at")).agg(F.count_if(group).alias("a"), F.count("*").alias("t")).withColumn("chrom", F.lit(""))
    spread = values.agg(F.max(F.abs("at"))).first()[0] or 1.0
    ranks = running(values, F.col("t"), F.sum, tile=max(spread, 1e-300) / 4096).withColumn("upto", F.col("own") + F.coalesce("before", F.lit(0)))
    middle = F.col("upto") - (F.col("t") - 1) / 2
    t = F.col("t").cast("double")
    sums = ranks.agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("a") * middle).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    out = sums.select("n1", "n2", "ties", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("statistic"))

    def p(r) -> float | None:
        n, middle = r.n1 + r.n2, r.n1 * r.n2 / 2
        sigma = math.sqrt(r.n1 * r.n2 / 12 * (n + 1 - r.ties / (n * (n - 1)))) if n > 1 else 0
        if not r.n1 or not r.n2 or not sigma:
            return None
        z = (min(r.statistic, 2 * middle - r.statistic) - middle + 0.5) / sigma
        return _sided(alternative, 2 * special.normal_cdf(min(z, -abs(z))), special.normal_cdf(-(r.statistic - middle - 0.5) / sigma), special.normal_cdf((r.statistic - middle + 0.5) / sigma))

    return _one_row(out, p).select("statistic", "p_value")


def fisher_exact(df: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """df(a, b, c, d, ...) with odds_ratio and p_value of each row's 2x2 table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [special.fisher_exact(int(a), int(b), int(c), int(d), alternative) for a, b, c, d in zip(x["a"], x["b"], x["c"], x["d"])]
            x["odds_ratio"], x["p_value"] = [f[0] for f in found], [f[1] for f in found]
            yield x

    return df.mapInPandas(run, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, odds_ratio double, p_value double")


def hwe(df: DataFrame) -> DataFrame:
    """df(hets, hom1, hom2, ...) with the exact Hardy-Weinberg p of each row."""
    return _one_row(df, lambda r: special.hwe_exact(int(r.hets), int(r.hom1), int(r.hom2)))


def _pairs(n: int) -> float:
    if n < 2:
        raise ValueError("at least two samples")
    return n * (n - 1) / 2


def theta_pi(df: DataFrame, n: int, k: str = "k") -> DataFrame:
    """Mean share of differing pairs per site, from minor-allele counts among n."""
    ok = F.when(F.col(k) > n, F.raise_error(F.lit("a count above the sample size")).cast("double")).otherwise(F.col(k) * (n - F.col(k)) / _pairs(n))
    return df.agg(F.avg(ok).alias("theta_pi"))


def watterson(df: DataFrame, n: int, k: str = "k") -> DataFrame:
    """Segregating sites over the harmonic number of n - 1, per site."""
    _pairs(n)
    a1 = math.fsum(1 / i for i in range(1, n))
    return df.agg((F.count_if((F.col(k) != 0) & (F.col(k) != n)) / (a1 * F.count("*"))).alias("theta_w"))


def tajimas_d(df: DataFrame, n: int, k: str = "k") -> DataFrame:
    """Tajima's D; null without segregating sites."""
    if n < 4:
        raise ValueError("at least four samples")
    a1, a2 = math.fsum(1 / i for i in range(1, n)), math.fsum(1 / i**2 for i in range(1, n))
    c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2
    e1, e2 = c1 / a1, c2 / (a1**2 + a2)
    sums = df.agg(F.sum(F.col(k) * (n - F.col(k)) / _pairs(n)).alias("pi"), F.count_if((F.col(k) != 0) & (F.col(k) != n)).alias("s"))
    variance = e1 * F.col("s") + e2 * F.col("s") * (F.col("s") - 1)
    return sums.select(F.when(variance > 0, (F.col("pi") - F.col("s") / a1) / F.sqrt(variance)).alias("tajimas_d"))


def ld_r2(df: DataFrame, by: str = "locus") -> DataFrame:
    """Squared correlation of two loci's alleles (0 or 1), by group; 0 where one never varies."""
    m = df.groupBy(by).agg(F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"), F.avg((F.col("a") * F.col("b")).cast("double")).alias("pab"))
    d, spread = F.col("pab") - F.col("pa") * F.col("pb"), F.col("pa") * (1 - F.col("pa")) * F.col("pb") * (1 - F.col("pb"))
    return m.select(by, F.when(spread > 0, F.least(F.lit(1.0), d * d / spread)).otherwise(0.0).alias("r2"))


def align_pairs(df: DataFrame, local: bool = False, **scores) -> DataFrame:
    """df(ord, a, b) with score, operations (as text, see functions.align) and starts of the best alignment of each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = al.align(list(zip(x["a"], x["b"])), local, **scores)
            for k, c in enumerate(("score", "ops", "a_start", "b_start")):
                x[c] = [f[k] for f in found]
            yield x

    return df.select("ord", "a", "b").mapInPandas(run, "ord long, a string, b string, score int, ops string, a_start int, b_start int")


def hmm_paths(df: DataFrame, model: Hmm) -> DataFrame:
    """df(key, symbols array<int>) with the most likely states and the log-likelihood."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["states"] = [model.viterbi(s) for s in x["symbols"]]
            x["loglik"] = [model.log_likelihood(s) for s in x["symbols"]]
            yield x

    return df.mapInPandas(run, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, states array<int>, loglik double")


def lineages(nodes: DataFrame) -> DataFrame:
    """(tax_id, ancestor, distance) for each node and all above it, itself at 0; the root is its own parent. A cycle is a ValueError.

    Steps double from round to round, so that a tree of any depth takes its logarithm of rounds, each a join of written tables.
    """
    up = nodes.select("tax_id", "parent")
    ids = up.select("tax_id").union(up.select("parent")).distinct()
    # all pairs that are fewer than `steps` apart, and where each node is after as many
    pairs = materialize(ids.select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("distance")), "lineages")
    jumps = materialize(up.filter("tax_id <> parent").select("tax_id", F.col("parent").alias("at")), "jumps")
    most, steps = pairs.count(), 1
    while not jumps.isEmpty():
        if steps > most:
            raise ValueError("the nodes' parents go in a circle")
        above = pairs.select(F.col("tax_id").alias("at"), "ancestor", (F.col("distance") + steps).alias("distance"))
        before = pairs
        pairs = materialize(pairs.union(jumps.join(above, "at").select("tax_id", "ancestor", "distance")), "lineages")
        jumps = materialize(jumps.join(jumps.select(F.col("tax_id").alias("at"), F.col("at").alias("further")), "at").select("tax_id", F.col("further").alias("at")), "jumps")
        release(before)
        steps *= 2
    return pairs.join(up.select("tax_id").distinct(), "tax_id", "left_semi")


def lowest_common_ancestor(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, lca) for members(grp, tax_id): the deepest node above all of a group."""
    up = lineages(nodes)
    depth = up.groupBy("tax_id").agg(F.max("distance").alias("depth")).withColumnRenamed("tax_id", "ancestor")
    distinct = members.select("grp", "tax_id").distinct()
    size = distinct.groupBy("grp").agg(F.count("*").alias("size"))
    shared = distinct.join(up, "tax_id").groupBy("grp", "ancestor").agg(F.count("*").alias("n")).join(size, "grp").filter("n = size").join(depth, "ancestor")
    return shared.groupBy("grp").agg(F.max_by("ancestor", "depth").alias("lca"))


def resolve(ids: DataFrame, merged: DataFrame, hops: int = 16) -> DataFrame:
    """ids(tax_id) with `current`: the id that merged(old_id, new_id) leads to, in up to `hops` steps.

    The steps are taken on the table of merged ids, by itself; ids are joined with it once.
    """
    leads = materialize(merged.select("old_id", F.col("new_id").alias("to")), "merged")
    step = merged.select(F.col("old_id").alias("to"), F.col("new_id").alias("further"))
    for _ in range(hops - 1):
        if leads.join(step, "to", "left_semi").isEmpty():
            break
        leads = materialize(leads.join(step, "to", "left").select("old_id", F.coalesce("further", "to").alias("to")), "merged")
    return ids.join(leads, ids["tax_id"] == leads["old_id"], "left").select(*[ids[c] for c in ids.columns], F.coalesce("to", ids["tax_id"]).alias("current"))


def newick_nodes(df: DataFrame, text: str = "newick") -> DataFrame:
    """df(tree_id, newick) as one row per node: (tree_id, node, parent, name, length, leaf)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(t, *n) for t, s in zip(x["tree_id"], x[text]) for n in phylo.parse(s)]
            yield pd.DataFrame(rows, columns=["tree_id", "node", "parent", "name", "length", "leaf"]).astype({"parent": "Int64", "length": "Float64"})

    return df.select("tree_id", text).mapInPandas(run, "tree_id long, node long, parent long, name string, length double, leaf boolean")


def newick_text(nodes: DataFrame) -> DataFrame:
    """(tree_id, newick) from nodes (tree_id, node, parent, name, length)."""
    rows = nodes.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("node", "parent", "name", "length"))).alias("nodes"))

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        clean = lambda v: None if v is None or v != v else v
        return x.map(lambda ns: phylo.write([(n["node"], None if clean(n["parent"]) is None else int(n["parent"]), n["name"], clean(n["length"])) for n in ns]))

    return rows.select("tree_id", text("nodes").alias("newick"))


def plink_genotypes(packed: bytes, n_samples: int) -> np.ndarray:
    """Genotype codes of one variant's bytes, four samples a byte from the lowest bits: copies of the first allele (2, 1, 0), -1 where missing."""
    two = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").reshape(-1, 2)[:n_samples]
    return np.array([2, -1, 1, 0], np.int8)[two[:, 0] + 2 * two[:, 1]]


def genotypes(df: DataFrame, packed: str = "packed", samples: str = "samples") -> DataFrame:
    """(ord, sample, code) of df(ord, packed binary, samples): a row for each sample of each variant, from 0."""

    @F.pandas_udf("array<int>")
    def codes(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([plink_genotypes(b, k).astype(np.int32) for b, k in zip(x, n)])

    return df.select("ord", F.posexplode(codes(packed, samples)).alias("sample", "code"))
