"""Queries of the k-mer, statistics, population, alignment, model, taxonomy and tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions.hmm import Hmm
from ..operators import correct as ec
from ..operators import kmers as km
from ..operators import science as op
from ..storage import materialize
from .registry import query

_N = "(SELECT count(*) FROM pvals)"
_RANKED = "r AS (SELECT ord, p, row_number() OVER (ORDER BY p, ord) AS i, count(*) OVER () AS n FROM pvals)"


def _padj(name: str, value: str, direction: str | None) -> None:
    order = {"up": "ORDER BY i DESC", "down": "ORDER BY i"}.get(direction)
    fold = "min" if direction == "up" else "max"
    adjusted = f"{fold}(least(1.0, {value})) OVER ({order} ROWS UNBOUNDED PRECEDING)" if order else f"least(1.0, {value})"
    query(f"padj_{name}", "pvals", f"WITH {_RANKED} SELECT ord, p, round({adjusted}, 9) AS adjusted FROM r")(lambda df: op.adjust(df, name).withColumn("adjusted", F.round("adjusted", 9)))


_padj("bonferroni", "p * n", None)
_padj("bh", "n / i * p", "up")
_padj("by", "(SELECT sum(1 / k) FROM (SELECT unnest(range(1, n + 1)) AS k)) * n / i * p".replace("range(1, n + 1)", f"range(1, {_N} + 1)"), "up")
_padj("holm", "(n - i + 1) * p", "down")
_padj("hochberg", "(n - i + 1) * p", "up")
query("padj_hommel", "pvals")(lambda df: op.adjust(df, "hommel"))
query("padj_none", "pvals", "SELECT *, p AS adjusted FROM pvals")(lambda df: op.adjust(df, "none"))

# with any p of 0 the combined p is 0, whatever the others
query("fisher_combine", "pvals", """WITH s AS (SELECT count(*) AS n, sum(CASE WHEN p > 0 THEN -2 * ln(p) END) AS x, count(*) FILTER (p = 0) AS zeros FROM pvals), t AS (SELECT n, x, zeros, unnest(range(0, n)) AS i FROM s)
  SELECT any_value(n) AS n, round(any_value(x), 6) AS statistic, CASE WHEN any_value(zeros) > 0 THEN 0.0 ELSE round(sum(exp(i * ln(x / 2) - x / 2 - lgamma(i + 1))), 6) END AS p_value FROM t""")(
    lambda df: op.fisher_combine(df).select("n", F.round("statistic", 6).alias("statistic"), F.round("p_value", 6).alias("p_value"))
)
query("stouffer", "pvals")(op.stouffer_combine)
# half the tail beyond |t| of Student's distribution, by Simpson's rule, and the normal tail below z <= 0, by its series
_T_PDF = "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + u * u / v))"
_LOWER = "(0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * k + 1) * ln(greatest(-z, 1e-300)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))) FROM (SELECT unnest(range(0, 300)) AS k)))"
query("welch_t", "orders", f"""WITH x AS (SELECT CAST(o_totalprice AS DOUBLE) AS x, o_orderkey % 2 = 0 AS g FROM orders),
  s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, avg(x) FILTER (g) - avg(x) FILTER (NOT g) AS d, var_samp(x) FILTER (g) AS v1, var_samp(x) FILTER (NOT g) AS v2 FROM x),
  t AS (SELECT d / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)) AS v FROM s),
  i AS (SELECT t, v, unnest(range(0, 4001)) AS i FROM t), f AS (SELECT t, v, i, abs(t) * i / 4000 AS u FROM i)
  SELECT round(any_value(t), 9) AS statistic, round(any_value(v), 6) AS df, round(least(1.0, 1 - 2 * any_value(abs(t)) / 12000 * sum({_T_PDF} * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)), 9) AS p_value FROM f""")(
    lambda df: op.welch_t(df, "o_totalprice", F.col("o_orderkey") % 2 == 0).select(F.round("statistic", 9).alias("statistic"), F.round("df", 6).alias("df"), F.round("p_value", 9).alias("p_value"))
)
query("mann_whitney", "orders", f"""WITH x AS (SELECT CAST(o_totalprice AS DOUBLE) AS x, o_orderkey % 2 = 0 AS g FROM orders), c AS (SELECT x, CAST(count(*) AS DOUBLE) AS t, CAST(count(*) FILTER (g) AS DOUBLE) AS a FROM x GROUP BY x),
  r AS (SELECT *, sum(t) OVER (ORDER BY x) - (t - 1) / 2 AS middle FROM c), s AS (SELECT sum(a) AS n1, sum(t - a) AS n2, sum(a * middle) AS r1, sum(t * t * t - t) AS ties FROM r),
  u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sigma FROM s), z AS (SELECT u, (least(u, n1 * n2 - u) - n1 * n2 / 2 + 0.5) / sigma AS z0 FROM u), w AS (SELECT u, least(z0, -abs(z0)) AS z FROM z)
  SELECT u AS statistic, round(least(1.0, 2 * {_LOWER}), 9) AS p_value FROM w""")(
    lambda df: op.mann_whitney(df, "o_totalprice", F.col("o_orderkey") % 2 == 0).withColumn("p_value", F.round("p_value", 9))
)


_FISHER = """WITH t AS (SELECT c_mktsegment, count(*) FILTER (c_acctbal > 0 AND c_custkey % 2 = 0) AS a, count(*) FILTER (c_acctbal > 0 AND c_custkey % 2 <> 0) AS b, count(*) FILTER (c_acctbal <= 0 AND c_custkey % 2 = 0) AS c,
    count(*) FILTER (c_acctbal <= 0 AND c_custkey % 2 <> 0) AS d FROM customer GROUP BY c_mktsegment),
  k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM t),
  p AS (SELECT *, exp(lgamma(a + c + 1) - lgamma(k + 1) - lgamma(a + c - k + 1) + lgamma(b + d + 1) - lgamma(a + b - k + 1) - lgamma(d - a + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)) AS p FROM k),
  o AS (SELECT c_mktsegment, p AS seen FROM p WHERE k = a)
  SELECT p.c_mktsegment, a, b, c, d, CASE WHEN b = 0 OR c = 0 THEN CAST('inf' AS DOUBLE) ELSE round(a * d / (b * c), 6) END AS odds_ratio, round(least(1.0, sum(p) FILTER (p <= seen + 1e-12)), 6) AS p_value
  FROM p JOIN o ON o.c_mktsegment = p.c_mktsegment GROUP BY p.c_mktsegment, a, b, c, d"""
_HWE = """WITH t AS (SELECT p_brand, count(*) FILTER (p_size % 4 = 1) AS hets, count(*) FILTER (p_size % 4 > 1) AS hom1, count(*) FILTER (p_size % 4 = 0) AS hom2, count(*) AS n FROM part GROUP BY p_brand),
  r AS (SELECT *, 2 * least(hom1, hom2) + hets AS rare FROM t), k AS (SELECT *, unnest(range(rare % 2, least(rare, 2 * n - rare) + 1, 2)) AS k FROM r),
  p AS (SELECT *, exp(k * ln(2) - lgamma(k + 1) - lgamma((rare - k) // 2 + 1) - lgamma(n - k - (rare - k) // 2 + 1) + lgamma(n + 1)) AS w FROM k), s AS (SELECT p_brand, sum(w) AS total, max(CASE WHEN k = hets THEN w END) AS seen FROM p GROUP BY p_brand)
  SELECT p.p_brand, hets, hom1, hom2, CASE WHEN any_value(rare) IN (0, 2 * any_value(n)) THEN 1.0 ELSE round(least(1.0, sum(w / total) FILTER (w / total <= seen / total + 1e-12)), 6) END AS p_value FROM p JOIN s ON s.p_brand = p.p_brand GROUP BY p.p_brand, hets, hom1, hom2"""


@query("fisher_exact", "customer", _FISHER)
def fisher_exact(df):
    rich, even = F.col("c_acctbal") > 0, F.col("c_custkey") % 2 == 0
    table = df.groupBy("c_mktsegment").agg(F.count_if(rich & even).alias("a"), F.count_if(rich & ~even).alias("b"), F.count_if(~rich & even).alias("c"), F.count_if(~rich & ~even).alias("d"))
    return op.fisher_exact(table).withColumns({"odds_ratio": F.round("odds_ratio", 6), "p_value": F.round("p_value", 6)})


@query("hwe_exact", "part", _HWE)
def hwe_exact(df):
    table = df.groupBy("p_brand").agg(F.count_if(F.col("p_size") % 4 == 1).alias("hets"), F.count_if(F.col("p_size") % 4 > 1).alias("hom1"), F.count_if(F.col("p_size") % 4 == 0).alias("hom2"))
    return op.hwe(table).withColumn("p_value", F.round("p_value", 6))


query("theta_pi", "sites", "SELECT round(avg(k * (20 - k) / 190.0), 9) AS theta_pi FROM sites")(lambda df: op.theta_pi(df, 20).select(F.round("theta_pi", 9).alias("theta_pi")))
query("watterson", "sites", "SELECT round(count(*) FILTER (k NOT IN (0, 20)) / ((SELECT sum(1 / i) FROM (SELECT unnest(range(1, 20)) AS i)) * count(*)), 9) AS theta_w FROM sites")(lambda df: op.watterson(df, 20).select(F.round("theta_w", 9).alias("theta_w")))
query("tajimas_d", "sites", """WITH h AS (SELECT sum(1 / i) AS a1, sum(1 / (i * i)) AS a2 FROM (SELECT unnest(range(1, 20)) AS i)), s AS (SELECT sum(k * (20 - k) / 190.0) AS pi, count(*) FILTER (k NOT IN (0, 20)) AS s FROM sites),
  c AS (SELECT *, (21 / 57.0 - 1 / a1) / a1 AS e1, (2 * 423 / 3420.0 - 22 / (a1 * 20) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM h, s)
  SELECT round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 6) AS tajimas_d FROM c""")(lambda df: op.tajimas_d(df, 20).select(F.round("tajimas_d", 6).alias("tajimas_d")))
query("ld_r2", "haplotypes", """WITH m AS (SELECT locus, avg(a) AS pa, avg(b) AS pb, avg(a * b) AS pab FROM haplotypes GROUP BY locus), d AS (SELECT *, pa * (1 - pa) * pb * (1 - pb) AS v FROM m)
  SELECT locus, round(CASE WHEN v > 0 THEN least(1.0, (pab - pa * pb) * (pab - pa * pb) / v) ELSE 0.0 END, 6) AS r2 FROM d""")(lambda df: op.ld_r2(df).withColumn("r2", F.round("r2", 6)))

_WINDOWS = "SELECT ord, unnest(range(1, greatest(length(seq) - {k} + 2, 1))) AS i, seq{more} FROM reads"
_KMERS = f"""x AS ({_WINDOWS}), k AS (SELECT ord, i - 1 AS pos, substr(seq, i, {{k}}) AS kmer{{kept}} FROM x WHERE regexp_full_match(substr(seq, i, {{k}}), '[ACGT]+'))"""
_CANONICAL = "least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA'))"

query("kmer_count", "reads", f"WITH {_KMERS.format(k=11, more='', kept='')} SELECT {_CANONICAL} AS kmer, count(*) AS n FROM k GROUP BY 1")(lambda df: km.count(df, 11))
query("kmer_spectrum", "reads", f"""WITH {_KMERS.format(k=9, more=', qual', kept=', substr(qual, i, 9) AS q')}
  SELECT {_CANONICAL} AS kmer, least(count(*), 255) AS coverage, least(count(*) FILTER (NOT regexp_matches(q, '[!-4]')), 63) AS good FROM k GROUP BY 1""")(lambda df: km.spectrum(df, 9))
query("kmer_mode", "reads", f"""WITH {_KMERS.format(k=9, more='', kept='')}, s AS (SELECT {_CANONICAL} AS kmer, least(count(*), 255) AS coverage FROM k GROUP BY 1), h AS (SELECT coverage, count(*) AS n FROM s WHERE coverage >= 3 GROUP BY coverage)
  SELECT coverage AS mode, n FROM h ORDER BY n DESC, coverage LIMIT 1""")(lambda df: km.coverage_mode(km.spectrum(df, 9)))
query("kmer_unique_reads", "reads", f"""WITH {_KMERS.format(k=8, more='', kept='')}, c AS (SELECT ord, {_CANONICAL} AS c FROM k), u AS (SELECT c FROM c GROUP BY c HAVING count(*) = 1)
  SELECT r.* FROM reads r WHERE NOT EXISTS (SELECT 1 FROM c JOIN u ON c.c = u.c WHERE c.ord = r.ord)""")(lambda df: km.without_unique(df, 8))
_EDGES = f"""{_KMERS.format(k=8, more='', kept='')}, p AS (SELECT substr(kmer, 1, 7) AS a, substr(kmer, 2, 7) AS b FROM k),
  e AS (SELECT DISTINCT least(a, translate(reverse(a), 'ACGT', 'TGCA')) AS source, least(b, translate(reverse(b), 'ACGT', 'TGCA')) AS target FROM p)"""
query("debruijn_edges", "reads", f"WITH {_EDGES} SELECT * FROM e")(lambda df: km.graph_edges(df, 8))
query("debruijn_nodes", "reads", f"""WITH {_EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e)
  SELECT node, (SELECT count(*) FROM e WHERE target = node) AS indegree, (SELECT count(*) FROM e WHERE source = node) AS outdegree FROM n""")(lambda df: km.graph_nodes(km.graph_edges(df, 8)))
query("unitigs", "reads")(lambda df: km.unitigs(km.graph_edges(df, 16), materialize))
query("substring_locate", "fasta", "SELECT ord, i - 1 AS pos FROM (SELECT ord, seq, unnest(range(1, greatest(length(seq) - 1, 1))) AS i FROM fasta) WHERE substr(seq, i, 3) = 'TAT'")(lambda df: km.locate(df, "TAT"))
query("kmer_codes", "reads", """WITH x AS (SELECT ord, unnest(range(1, greatest(length(seq) - 2, 1))) AS i, seq FROM reads), k AS (SELECT ord, i, substr(seq, i, 4) AS w FROM x)
  SELECT ord, i + 2 AS pos, CASE WHEN regexp_full_match(w, '[ACGT]+') THEN (instr('CGT', w[1]) * 64 + instr('CGT', w[2]) * 16 + instr('CGT', w[3]) * 4 + instr('CGT', w[4])) END AS code FROM k""")(lambda df: km.rolling(df, 4))


query("fastq_correct", "reads")(lambda df: ec.correct(df, materialize, k=11, min_cov=3))
query("fastq_correct_report", "reads")(lambda df: ec.report(ec.correct(df, materialize, k=11, min_cov=3)))


def _mates(both):
    return both.select("ord", F.col("seq1").alias("a"), sq.reverse_complement("seq2").alias("b")).filter("a <> '' and b <> ''")


query("nw_align", "pairs")(lambda both: op.align_pairs(_mates(both)))
query("sw_align", "pairs")(lambda both: op.align_pairs(_mates(both), local=True))

_MODEL = Hmm([0.6, 0.4], [[0.8, 0.2], [0.3, 0.7]], [[0.4, 0.3, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])


def _observed(events):
    """Each user's event types in order, as numbers of their names' order (up to 4)."""
    kinds = events.select("event_type").distinct().groupBy().agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    rows = events.crossJoin(F.broadcast(kinds)).select("user_id", F.struct("ts", "event_id", F.least(F.array_position("kinds", F.col("event_type")) - 1, F.lit(4)).cast("int").alias("s")).alias("x"))
    return rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("symbols"))


# one step of a user's events at a time: the best path and its probability, or the summed one, for either state
_EVENTS = """kinds AS (SELECT event_type, least(row_number() OVER (ORDER BY event_type) - 1, 4) AS s FROM (SELECT DISTINCT event_type FROM events)),
  seen AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events JOIN kinds USING (event_type)),
  e AS (SELECT user_id, i, [0.4, 0.3, 0.1, 0.1, 0.1][s + 1] AS e0, [0.1, 0.1, 0.2, 0.3, 0.3][s + 1] AS e1 FROM seen), last AS (SELECT user_id, max(i) AS n FROM seen GROUP BY user_id)"""
query("hmm_viterbi", "events", f"""WITH RECURSIVE {_EVENTS},
  v AS (SELECT user_id, i, ln(0.6) + ln(e0) AS a, ln(0.4) + ln(e1) AS b, [CAST(0 AS INTEGER)] AS pa, [CAST(1 AS INTEGER)] AS pb FROM e WHERE i = 1 UNION ALL
    SELECT v.user_id, e.i, greatest(a + ln(0.8), b + ln(0.3)) + ln(e0), greatest(a + ln(0.2), b + ln(0.7)) + ln(e1),
      list_append(CASE WHEN a + ln(0.8) >= b + ln(0.3) THEN pa ELSE pb END, 0), list_append(CASE WHEN a + ln(0.2) >= b + ln(0.7) THEN pa ELSE pb END, 1) FROM v JOIN e ON e.user_id = v.user_id AND e.i = v.i + 1)
  SELECT v.user_id, CASE WHEN a >= b THEN pa ELSE pb END AS states FROM v JOIN last ON last.user_id = v.user_id AND v.i = last.n""")(lambda df: op.hmm_paths(_observed(df), _MODEL).select("user_id", "states"))
query("hmm_loglik", "events", f"""WITH RECURSIVE {_EVENTS},
  f AS (SELECT user_id, i, 0.6 * e0 / (0.6 * e0 + 0.4 * e1) AS a, ln(0.6 * e0 + 0.4 * e1) AS total FROM e WHERE i = 1 UNION ALL
    SELECT f.user_id, e.i, (a * 0.8 + (1 - a) * 0.3) * e0 / ((a * 0.8 + (1 - a) * 0.3) * e0 + (a * 0.2 + (1 - a) * 0.7) * e1), total + ln((a * 0.8 + (1 - a) * 0.3) * e0 + (a * 0.2 + (1 - a) * 0.7) * e1) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
  SELECT f.user_id, round(total, 6) AS loglik FROM f JOIN last ON last.user_id = f.user_id AND f.i = last.n""")(lambda df: op.hmm_paths(_observed(df), _MODEL).select("user_id", F.round("loglik", 6).alias("loglik")))

_UP = "WITH RECURSIVE up AS (SELECT tax_id, tax_id AS ancestor, 0 AS distance FROM tax_nodes UNION ALL SELECT u.tax_id, n.parent, u.distance + 1 FROM up u JOIN tax_nodes n ON n.tax_id = u.ancestor WHERE n.parent <> n.tax_id)"
query("tax_lineage", "tax_nodes", f"{_UP} SELECT * FROM up")(op.lineages)
query("tax_lca", "tax_nodes nation", f"""{_UP}, m AS (SELECT n_nationkey % 9 AS grp, 100 + n_nationkey AS tax_id FROM nation), d AS (SELECT tax_id AS ancestor, max(distance) AS depth FROM up GROUP BY tax_id),
  s AS (SELECT m.grp, up.ancestor FROM m JOIN up ON up.tax_id = m.tax_id GROUP BY m.grp, up.ancestor HAVING count(*) = (SELECT count(*) FROM m m2 WHERE m2.grp = m.grp))
  SELECT CAST(s.grp AS INTEGER) AS grp, arg_max(s.ancestor, d.depth) AS lca FROM s JOIN d ON d.ancestor = s.ancestor GROUP BY s.grp""")(
    lambda nodes, nation: op.lowest_common_ancestor(nodes, nation.select((F.col("n_nationkey") % 9).alias("grp"), (100 + F.col("n_nationkey")).cast("int").alias("tax_id")))
)


def _trees(region, nation):
    """One tree a region, its nations as leaves."""
    leaf = F.concat("n_name", F.lit(":"), (F.col("n_nationkey") + 1).cast("string"))
    n = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(leaf)), ",").alias("leaves"))
    return region.join(n, region["r_regionkey"] == n["n_regionkey"]).select(F.col("r_regionkey").cast("long").alias("tree_id"), F.concat(F.lit("("), F.translate("leaves", " ", "_"), F.lit(")"), F.translate("r_name", " ", "_"), F.lit(";")).alias("newick"))


query("newick_nodes", "region nation", """WITH l AS (SELECT CAST(n_regionkey AS BIGINT) AS tree_id, replace(n_name, ' ', '_') AS name, n_nationkey + 1.0 AS length, row_number() OVER (PARTITION BY n_regionkey ORDER BY concat(n_name, ':', n_nationkey + 1)) AS node FROM nation)
  SELECT tree_id, node, CAST(0 AS BIGINT) AS parent, name, CAST(length AS DOUBLE) AS length, true AS leaf FROM l UNION ALL SELECT CAST(r_regionkey AS BIGINT), 0, NULL, replace(r_name, ' ', '_'), NULL, false FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")(lambda r, n: op.newick_nodes(_trees(r, n)))
query("newick_round_trip", "region nation", """SELECT CAST(r_regionkey AS BIGINT) AS tree_id, concat('(', (SELECT string_agg(replace(concat(n_name, ':', n_nationkey + 1), ' ', '_'), ',' ORDER BY concat(n_name, ':', n_nationkey + 1)) FROM nation WHERE n_regionkey = r_regionkey), ')', replace(r_name, ' ', '_'), ';') AS newick FROM region""")(
    lambda r, n: op.newick_text(op.newick_nodes(_trees(r, n)))
)


@query("plink_genotypes", "part", """WITH v AS (SELECT p_partkey AS ord, (p_partkey * 40503) % 65536 AS v, unnest(range(0, 7)) AS sample FROM part), t AS (SELECT ord, sample, ((CASE WHEN sample < 4 THEN v // 256 ELSE v % 256 END) >> (2 * (sample % 4))) & 3 AS two FROM v)
  SELECT ord, CAST(sample AS INTEGER) AS sample, CAST([2, -1, 1, 0][two + 1] AS INTEGER) AS code FROM t""")
def plink_genotypes(part):
    """Seven samples in two bytes a variant."""
    packed = F.unhex(F.lpad(F.hex(F.col("p_partkey") * 40503 % 65536), 4, "0"))
    return op.genotypes(part.select(F.col("p_partkey").alias("ord"), packed.alias("packed"), F.lit(7).alias("samples")))
