"""Queries of the read quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import qc as op
from ..storage import materialize
from .registry import query

_SQL: dict[str, str] = {}


def _query(name: str, view: str, sql: str):
    """Register a module, and keep its SQL for the summary."""
    _SQL[name] = sql
    return query(name, view, sql)


_SEQ = "s AS (SELECT ord, unnest(range(1, length(seq) + 1)) AS pos, seq FROM reads), c AS (SELECT ord, pos, substr(seq, pos, 1) AS c FROM s)"
_QUAL = "s AS (SELECT id, ord, unnest(range(1, length(qual) + 1)) AS pos, qual FROM reads), c AS (SELECT id, ord, pos, ascii(substr(qual, pos, 1)) - 33 AS q FROM s)"

_query("fastqc_basic", "reads", f"""WITH {_QUAL} SELECT (SELECT count(*) FROM reads) AS reads, (SELECT min(length(seq)) FROM reads) AS shortest, (SELECT max(length(seq)) FROM reads) AS longest,
  (SELECT CAST(round(100.0 * sum(length(seq) - length(regexp_replace(seq, '[GC]', '', 'g'))) / sum(length(seq))) AS BIGINT) FROM reads) AS gc, CASE WHEN min(q) + 33 < 64 THEN 'Sanger / Illumina 1.9' ELSE 'Illumina 1.5' END AS encoding FROM c""")(op.basic)
_query("fastqc_base_quality", "reads", f"""WITH {_QUAL}, p AS (SELECT pos, q, row_number() OVER (PARTITION BY pos ORDER BY q) AS i, count(*) OVER (PARTITION BY pos) AS n FROM c)
  SELECT pos, round(avg(q), 6) AS mean, CAST(min(q) FILTER (i >= 0.5 * n) AS BIGINT) AS median, CAST(min(q) FILTER (i >= 0.25 * n) AS BIGINT) AS q25, CAST(min(q) FILTER (i >= 0.75 * n) AS BIGINT) AS q75,
  CAST(min(q) FILTER (i >= 0.1 * n) AS BIGINT) AS p10, CAST(min(q) FILTER (i >= 0.9 * n) AS BIGINT) AS p90 FROM p GROUP BY pos""")(op.base_quality)
_query("fastqc_tile", "reads", f"""WITH {_QUAL}, t AS (SELECT CAST(split_part(id, ':', 5) AS BIGINT) AS tile, pos, q FROM c), o AS (SELECT pos, avg(q) AS a FROM t GROUP BY pos)
  SELECT tile, t.pos, round(avg(q) - any_value(o.a), 6) AS deviation FROM t JOIN o ON o.pos = t.pos GROUP BY tile, t.pos""")(op.tile_quality)
_query("fastqc_seq_quality", "reads", f"WITH {_QUAL}, m AS (SELECT ord, CAST(round(avg(q)) AS BIGINT) AS quality FROM c GROUP BY ord) SELECT quality, count(*) AS n FROM m GROUP BY quality")(op.sequence_quality)
_query("fastqc_base_content", "reads", f"WITH {_SEQ} SELECT pos, {', '.join(f'''round(100.0 * count(*) FILTER (c = '{b}') / count(*), 6) AS {b.lower()}''' for b in 'GATC')} FROM c GROUP BY pos")(op.base_content)
_query("fastqc_seq_gc", "reads", """WITH p AS (SELECT (length(seq) - length(regexp_replace(seq, '[GC]', '', 'g'))) / length(seq) * 100 AS p FROM reads WHERE length(seq) > 0),
  b AS (SELECT floor(p) AS gc, 1 - (p - floor(p)) AS w FROM p UNION ALL SELECT floor(p) + 1, p - floor(p) FROM p), n AS (SELECT i AS gc, coalesce((SELECT sum(w) FROM b WHERE b.gc = i), 0) AS n FROM (SELECT unnest(range(0, 101)) AS i)),
  m AS (SELECT sum(gc * n) / sum(n) AS mean, sum(n) AS total FROM n), v AS (SELECT any_value(mean) AS mean, any_value(total) AS total, sum((gc - mean) * (gc - mean) * n) / any_value(total) AS var FROM n, m),
  r AS (SELECT gc, n, exp(-0.5 * (gc - mean) * (gc - mean) / var) AS raw, total FROM n, v)
  SELECT gc, round(n, 6) AS n, round(raw * total / (SELECT sum(raw) FROM r), 6) AS expected FROM r""")(op.sequence_gc)
_query("fastqc_n", "reads", f"WITH {_SEQ} SELECT pos, round(100.0 * count(*) FILTER (c = 'N') / count(*), 6) AS n FROM c GROUP BY pos")(op.n_content)
_query("fastqc_lengths", "reads", "SELECT length(seq) AS length, count(*) AS n FROM reads GROUP BY 1")(op.lengths)
_query("fastqc_dup", "reads", """WITH k AS (SELECT CASE WHEN length(seq) > 75 THEN substr(seq, 1, 50) ELSE seq END AS key, row_number() OVER (ORDER BY ord) AS i FROM reads), t AS (SELECT key, count(*) AS n FROM k GROUP BY key HAVING min(i) <= 100000),
  l AS (SELECT CASE WHEN n < 10 THEN CAST(n AS VARCHAR) WHEN n < 50 THEN '>10' WHEN n < 100 THEN '>50' WHEN n < 500 THEN '>100' WHEN n < 1000 THEN '>500' WHEN n < 5000 THEN '>1k' WHEN n < 10000 THEN '>5k' ELSE '>10k' END AS level, n FROM t)
  SELECT level, round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS distinct_share, round(100.0 * sum(n) / (SELECT sum(n) FROM t), 6) AS read_share FROM l GROUP BY level""")(op.duplication)
_KEYS = "k AS (SELECT CASE WHEN length(seq) > 75 THEN substr(seq, 1, 50) ELSE seq END AS key, row_number() OVER (ORDER BY ord) AS i FROM reads), t AS (SELECT key, count(*) AS n FROM k GROUP BY key HAVING min(i) <= 100000)"
_SOURCES = ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(op.CONTAMINANTS))
# the shorter of a sequence and a contaminant somewhere in the longer, with one mismatch at most
_query("fastqc_overrep", "reads", f"""WITH {_KEYS}, o AS (SELECT key, n, round(100.0 * n / (SELECT count(*) FROM reads), 6) AS share FROM t WHERE n > 0.001 * (SELECT count(*) FROM reads)), c(place, name, text) AS (VALUES {_SOURCES}),
  p AS (SELECT key, place, name, CASE WHEN length(key) <= length(text) THEN key ELSE text END AS short, CASE WHEN length(key) <= length(text) THEN text ELSE key END AS long FROM o, c WHERE length(key) > 0 AND least(length(key), length(text)) >= least(length(text), 20)),
  w AS (SELECT *, unnest(range(1, length(long) - length(short) + 2)) AS i FROM p), h AS (SELECT key, arg_min(name, place) AS source FROM w WHERE hamming(short, substr(long, CAST(i AS INT), CAST(length(short) AS INT))) <= 1 GROUP BY key)
  SELECT o.key, n, share, coalesce(h.source, 'No Hit') AS source FROM o LEFT JOIN h ON h.key = o.key""")(op.overrepresented)
_query("fastqc_adapter", "adapted", f"""WITH a(adapter, text) AS (VALUES {', '.join(f"('{n.replace(chr(39), chr(39) * 2)}', '{t}')" for n, t in op.ADAPTERS)}),
  h AS (SELECT a.adapter, instr(r.seq, a.text) AS pos FROM adapted r, a), g AS (SELECT adapter, unnest(range(1, (SELECT max(length(seq)) FROM adapted) + 1)) AS pos FROM a)
  SELECT adapter, pos, round(100.0 * (SELECT count(*) FROM h WHERE h.adapter = g.adapter AND h.pos BETWEEN 1 AND g.pos) / (SELECT count(*) FROM adapted), 6) AS share FROM g""")(op.adapter_content)
_query("fastqc_kmer", "reads", f"""WITH f AS (SELECT substr(seq, 1, {op.KMER_BASES}) AS seq FROM (SELECT seq, row_number() OVER (ORDER BY ord) - 1 AS i FROM reads) WHERE i % {op.EVERY} = 0), x AS (SELECT seq, unnest(range(1, greatest(length(seq) - {op.KMER - 2}, 1))) AS pos FROM f),
  k AS (SELECT substr(seq, CAST(pos AS INT), {op.KMER}) AS kmer, pos FROM x), c AS (SELECT kmer, pos, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer, pos),
  m AS (SELECT kmer, CAST(sum(n) AS BIGINT) AS n, max(n) AS most, arg_min(pos, -n * 100000 + pos) AS pos FROM c GROUP BY kmer), p AS (SELECT *, (SELECT max(greatest(length(seq) - {op.KMER - 1}, 0)) FROM f) AS places FROM m),
  t AS (SELECT *, most * places / n AS ratio FROM p ORDER BY ratio DESC, kmer LIMIT 6), b AS (SELECT *, unnest(range(most, n + 1)) AS j FROM t)
  SELECT kmer, any_value(n) AS n, round(sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - j * ln(places) + (n - j) * ln(1 - 1 / places))), 9) AS p_value, any_value(ratio) AS ratio, any_value(pos) AS pos FROM b GROUP BY kmer""")(
    lambda df: op.kmer_content(df).withColumn("p_value", F.round("p_value", 9))
)


def _status(module: str, of: str, warn: str, fail: str) -> str:
    return f"SELECT '{module}' AS module, CASE WHEN {fail} THEN 'fail' WHEN {warn} THEN 'warn' ELSE 'pass' END AS status FROM ({of})"


_LIMITS = [
    ("base_quality", _SQL["fastqc_base_quality"], "bool_or(q25 < 10 OR median < 25)", "bool_or(q25 < 5 OR median < 20)"),
    ("tile_quality", _SQL["fastqc_tile"], "min(deviation) < -2", "min(deviation) < -5"),
    ("sequence_quality", _SQL["fastqc_seq_quality"], "arg_min(quality, -n * 1000 + quality) < 27", "arg_min(quality, -n * 1000 + quality) < 20"),
    ("base_content", _SQL["fastqc_base_content"], "max(greatest(abs(a - t), abs(g - c))) > 10", "max(greatest(abs(a - t), abs(g - c))) > 20"),
    ("sequence_gc", _SQL["fastqc_seq_gc"], "sum(abs(n - expected)) / 2 / sum(n) > 0.15", "sum(abs(n - expected)) / 2 / sum(n) > 0.30"),
    ("n_content", _SQL["fastqc_n"], "max(n) > 5", "max(n) > 20"),
    ("lengths", _SQL["fastqc_lengths"], "count(*) > 1", "bool_or(length = 0)"),
    ("duplication", f"WITH {_KEYS} SELECT * FROM t", "1 - count(*) / sum(n) > 0.2", "1 - count(*) / sum(n) > 0.5"),
    ("overrepresented", f"WITH {_KEYS} SELECT n / (SELECT count(*) FROM reads) AS share FROM t", "max(share) > 0.001", "max(share) > 0.01"),
    ("adapter_content", _SQL["fastqc_adapter"].replace("adapted", "reads"), "max(share) > 5", "max(share) > 10"),
    # of all k-mers, not of the first six
    ("kmer_content", _SQL["fastqc_kmer"].replace("ORDER BY ratio DESC, kmer LIMIT 6", ""), "min(p_value) < 0.01", "min(p_value) < 1e-5"),
]
query("fastqc_summary", "reads", "SELECT 'basic' AS module, 'pass' AS status UNION ALL " + " UNION ALL ".join(_status(*limits) for limits in _LIMITS))(lambda df: op.summary(df, materialize))
