"""Queries of the FASTA and FASTQ operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..functions import sequence as sq
from ..operators import reads as rd
from ..operators import sequences as op
from .registry import query

_RC = "translate(reverse(seq), 'ACGTacgt', 'TGCATGCA')"
_LOW = "length(qual) - length(regexp_replace(qual, '[!-/]', '', 'g'))"
_N = "length(seq) - length(regexp_replace(seq, '[Nn]', '', 'g'))"
_OUTCOME = f"CASE WHEN ({_LOW}) * 100 > 40 * length(seq) THEN 'quality' WHEN ({_N}) > 25 THEN 'n' WHEN length(seq) < 15 THEN 'length' ELSE 'pass' END"
_COUNT = "length({0}) - length(regexp_replace({0}, '[{1}]', '', 'g'))"


def _simple(prefix: str, view: str) -> None:
    query(f"{prefix}_count", view, f"SELECT count(*) AS n FROM {view}")(op.count)
    query(f"{prefix}_len", view, f"SELECT id, length(seq) AS length FROM {view}")(op.lengths)
    query(f"{prefix}_grep", view, f"SELECT * FROM {view} WHERE regexp_matches(id, '[37]')")(lambda df: op.grep(df, "[37]"))
    query(f"{prefix}_grep_invert", view, f"SELECT * FROM {view} WHERE NOT regexp_matches(id, '[37]')")(lambda df: op.grep(df, "[37]", invert=True))
    query(f"{prefix}_head", view, f"SELECT * FROM {view} ORDER BY ord LIMIT 10")(op.head)
    query(f"{prefix}_rename", view, f"SELECT * REPLACE (concat('{prefix}_', row_number() OVER (ORDER BY ord) - 1) AS id) FROM {view}")(lambda df: op.rename(df, f"{prefix}_"))
    query(f"{prefix}_sample", view, f"SELECT * FROM {view} WHERE CAST(concat('0x', substr(md5(concat('11|', ord)), 1, 15)) AS BIGINT) % 1000000000 < 250000000")(lambda df: op.sample(df, 0.25, 11))


_simple("fasta", "fasta")
_simple("fastq", "reads")

query("fasta_gc", "fasta", f"SELECT id, CASE WHEN length(seq) > 0 THEN round(100.0 * ({_COUNT.format('seq', 'GCgc')}) / length(seq), 2) ELSE 0.0 END AS gc FROM fasta")(op.gc)
query("fasta_filter", "fasta", "SELECT * FROM fasta WHERE length(seq) BETWEEN 200 AND 900")(lambda df: op.filter_length(df, 200, 900))
query("fasta_upper", "fasta", "SELECT ord, id, upper(seq) AS seq FROM fasta")(op.upper)
query("fasta_revcomp", "fasta", f"SELECT ord, id, {_RC} AS seq FROM fasta")(op.reverse_complement)
query("fastq_revcomp", "reads", "SELECT ord, id, translate(reverse(seq), 'ACGTNacgtn', 'TGCANTGCAN') AS seq, reverse(qual) AS qual FROM reads")(lambda df: op.reverse_complement(df, sq.COMPLEMENT_FASTQ))
query("fasta_sort_name", "fasta", "SELECT * FROM fasta")(lambda df: op.sort_by(df, "name"))
query("fasta_sort_len", "fasta", "SELECT * FROM fasta")(lambda df: op.sort_by(df, "length"))
query("fasta_sort_len_desc", "fasta", "SELECT * FROM fasta")(lambda df: op.sort_by(df, "length_desc"))
query("fastq_sort", "reads", "SELECT * FROM reads")(lambda df: op.sort_by(df, "name"))
query("fasta_split", "fasta", "SELECT *, (row_number() OVER (ORDER BY ord) - 1) // 64 AS part FROM fasta")(lambda df: op.split_parts(df, per_part=64))
query("fastq_split", "reads", "SELECT *, (row_number() OVER (ORDER BY ord) - 1) // CAST(ceil((SELECT count(*) FROM reads) / 7.0) AS BIGINT) AS part FROM reads")(lambda df: op.split_parts(df, parts=7))
query("fasta_to_fastq", "fasta", "SELECT ord, id, seq, repeat('I', length(seq)) AS qual FROM fasta")(op.to_fastq)
query("fastq_to_fasta", "reads", "SELECT ord, id, seq FROM reads")(op.to_fasta)
query("fasta_mask", "fasta", "SELECT * FROM fasta")(lambda df: df)
query("fasta_subseq", "fasta", "SELECT * FROM fasta")(lambda df: df)


@query("fasta_index_fetch", "fasta", "SELECT concat('doc', ord) AS name, 5 + ord % 30 AS first, 60 + ord % 50 AS last, substr(seq, CAST(5 + ord % 30 AS INT), CAST(56 + ord % 50 - ord % 30 AS INT)) AS seq FROM fasta")
def fasta_index_fetch(df):
    return op.fetch(df, df.select(F.concat(F.lit("doc"), "ord").alias("name"), (5 + F.col("ord") % 30).alias("first"), (60 + F.col("ord") % 50).alias("last")))


_LENGTHS = """h AS (SELECT length(seq) AS len FROM {view}), s AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS i, count(*) OVER () AS n FROM h),
  g AS (SELECT len, sum(len * c) OVER (ORDER BY len DESC) AS from_top, sum(len * c) OVER () AS total, row_number() OVER (ORDER BY len DESC) AS bucket FROM (SELECT len, count(*) AS c FROM h GROUP BY len)),
  q AS (SELECT
    avg(len) FILTER (i IN ((n + 1) // 2 // 2, ((n + 1) // 2 - 1) // 2)) AS q1, avg(len) FILTER (i IN (n // 2, (n - 1) // 2)) AS q2,
    avg(len) FILTER (i IN (n // 2 + (n + 1) // 2 // 2, n // 2 + ((n + 1) // 2 - 1) // 2)) AS q3 FROM s),
  t AS (SELECT len AS n50, bucket AS l50 FROM g WHERE from_top >= total / 2 ORDER BY bucket LIMIT 1)"""
_STATS = f"""count(*) AS num_seqs, 'DNA' AS type, CAST(sum(length(seq)) AS BIGINT) AS sum_len, min(length(seq)) AS min_len, round(avg(length(seq)), 6) AS avg_len, max(length(seq)) AS max_len,
  any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, CAST(sum({_COUNT.format('seq', ' .-')}) AS BIGINT) AS sum_gap, any_value(n50) AS n50, any_value(l50) AS l50,
  round(100.0 * sum({_COUNT.format('seq', 'GCgc')}) / sum(length(seq)), 6) AS gc, CAST(sum({_COUNT.format('seq', 'Nn')}) AS BIGINT) AS sum_n"""

query("fasta_stats", "fasta", f"WITH {_LENGTHS.format(view='fasta')} SELECT {_STATS} FROM fasta, q, t")(op.fasta_stats)
query(
    "fastq_stats", "reads",
    f"""WITH {_LENGTHS.format(view='reads')}, c AS (SELECT unnest(string_split(qual, '')) AS c FROM reads), e AS (SELECT ascii(c) - 33 AS q FROM c WHERE c <> ''),
    v AS (SELECT round(100.0 * count(*) FILTER (q >= 20) / count(*), 2) AS q20_share, round(100.0 * count(*) FILTER (q >= 30) / count(*), 2) AS q30_share, round(-10 * log10(sum(pow(10, -q / 10)) / count(*)), 6) AS avg_qual FROM e)
    SELECT {_STATS}, any_value(q20_share) AS q20_share, any_value(q30_share) AS q30_share, any_value(avg_qual) AS avg_qual FROM reads, q, t, v""",
)(op.fastq_stats)

query("fastq_interleave", "reads mates", "SELECT id, seq, qual, ord * 2 AS place FROM reads UNION ALL SELECT id, seq, qual, ord * 2 + 1 FROM mates")(op.interleave)
query("fastq_filter_se", "reads", f"SELECT * FROM reads WHERE {_OUTCOME} = 'pass'")(lambda df: op.filter_reads(df, n_limit=25))
query("fastq_filter_pe", "pairs", f"""WITH a AS (SELECT *, {_OUTCOME} AS o FROM reads), b AS (SELECT *, {_OUTCOME} AS o FROM mates)
  SELECT a.ord, a.id AS id1, a.seq AS seq1, a.qual AS qual1, b.id AS id2, b.seq AS seq2, b.qual AS qual2 FROM a JOIN b ON a.ord = b.ord WHERE a.o = 'pass' AND b.o = 'pass'""")(lambda both: op.filter_paired(both, n_limit=25))
query("fastq_filter_report", "reads", f"""SELECT count(*) AS reads_in, count(*) FILTER (o = 'pass') AS reads_out, CAST(sum(n) AS BIGINT) AS bases_in, CAST(sum(n) FILTER (o = 'pass') AS BIGINT) AS bases_out,
  count(*) FILTER (o = 'quality') AS failed_quality, count(*) FILTER (o = 'length') AS failed_length, count(*) FILTER (o = 'n') AS failed_n FROM (SELECT length(seq) AS n, {_OUTCOME} AS o FROM reads)""")(lambda df: op.filter_report(df, n_limit=25))
query("fastq_dedup_full", "reads", "SELECT ord, id, seq, qual FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord) AS n FROM reads) WHERE n = 1")(lambda df: op.dedup(df, mode="full"))
query("fastq_dedup_bin", "reads", """WITH w AS (SELECT *, substr(seq, CAST(greatest(length(seq) - 12, 0) + 1 AS INT), 12) AS w FROM reads),
  k AS (SELECT *, CASE WHEN length(seq) >= 12 AND regexp_full_match(w, '[ACGT]+') THEN concat('k:', least(w, translate(reverse(w), 'ACGT', 'TGCA'))) ELSE concat('s:', seq) END AS k FROM w)
  SELECT ord, id, seq, qual FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM k) WHERE n = 1""")(op.dedup)

query("fastq_dedup_report", "reads", "SELECT count(*) AS reads_in, CAST(sum(length(seq)) AS BIGINT) AS bases_in, count(DISTINCT seq) AS reads_out, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM (SELECT DISTINCT seq FROM reads)) AS bases_out, count(*) - count(DISTINCT seq) AS reads_removed FROM reads")(
    lambda df: op.change_report(df, op.dedup(df, mode="full"))
)

_TAGGED = "concat(split_part(id, ' ', 1), ':', {umi}, substr(id, length(split_part(id, ' ', 1)) + 1))"
query("fastq_umi_read1", "reads", f"SELECT ord, {_TAGGED.format(umi='substr(seq, 1, 8)')} AS id, substr(seq, least(least(length(seq), 8) + 2, length(seq) - 1) + 1) AS seq, substr(qual, least(least(length(seq), 8) + 2, length(seq) - 1) + 1) AS qual FROM reads WHERE length(seq) > 0")(
    lambda df: op.umi(df.filter("length(seq) > 0"), "read1", 8, 2)
)
query("fastq_umi_report", "reads", "SELECT count(*) AS reads_in, CAST(sum(length(seq)) AS BIGINT) AS bases_in, count(*) AS reads_out, CAST(sum(length(seq) - least(least(length(seq), 8) + 2, length(seq) - 1)) AS BIGINT) AS bases_out, CAST(0 AS BIGINT) AS reads_removed FROM reads WHERE length(seq) > 0")(
    lambda df: op.change_report(df.filter("length(seq) > 0"), op.umi(df.filter("length(seq) > 0"), "read1", 8, 2))
)
query("fastq_umi_index1", "reads", f"SELECT ord, {_TAGGED.format(umi=chr(39) + 'ACGT' + chr(39))} AS id, seq, qual FROM reads")(lambda df: op.umi(df, "index1"))
_PER_READ = (f"""WITH p AS (SELECT a.ord, a.id, a.seq AS s1, a.qual AS q1, b.id AS id2, b.seq AS s2, b.qual AS q2, concat(substr(a.seq, 1, 4), '_', substr(b.seq, 1, 4)) AS u FROM reads a JOIN mates b ON a.ord = b.ord WHERE length(a.seq) > 0 AND length(b.seq) > 0)
  SELECT ord, {_TAGGED.format(umi='u')} AS id1, concat(split_part(id2, ' ', 1), ':', u, substr(id2, length(split_part(id2, ' ', 1)) + 1)) AS id2,
  substr(s1, least(4, length(s1) - 1) + 1) AS seq1, substr(q1, least(4, length(s1) - 1) + 1) AS qual1, substr(s2, least(4, length(s2) - 1) + 1) AS seq2, substr(q2, least(4, length(s2) - 1) + 1) AS qual2 FROM p""")


def _whole_pairs(both):
    return both.filter("length(seq1) > 0 AND length(seq2) > 0")


query("fastq_umi_per_read", "pairs", _PER_READ)(lambda both: op.umi_paired(_whole_pairs(both), "per_read", 4))


def _umi_pairs(location: str, umi: str, cut: str = "0", **sizes) -> None:
    """Mates with a tag in both headers, `cut` bases of mate 2 gone."""
    sql = f"""WITH p AS (SELECT a.ord, a.id, a.seq AS seq1, a.qual AS qual1, b.id AS id2, b.seq AS s2, b.qual AS q2 FROM reads a JOIN mates b ON a.ord = b.ord WHERE length(a.seq) > 0 AND length(b.seq) > 0), t AS (SELECT *, {umi} AS u FROM p)
      SELECT ord, {_TAGGED.format(umi='u')} AS id1, concat(split_part(id2, ' ', 1), ':', u, substr(id2, length(split_part(id2, ' ', 1)) + 1)) AS id2, seq1, qual1, substr(s2, CAST({cut} + 1 AS INT)) AS seq2, substr(q2, CAST({cut} + 1 AS INT)) AS qual2 FROM t"""
    query(f"fastq_umi_{location}", "pairs", sql)(lambda both: op.umi_paired(_whole_pairs(both), location, **sizes))


_umi_pairs("read2", "substr(s2, 1, 6)", "least(least(length(s2), 6) + 1, length(s2) - 1)", length=6, skip=1)
_umi_pairs("index2", "split_part(id2, '+', 2)")
_umi_pairs("per_index", "concat(split_part(split_part(id, '+', 1), ':', -1), '_', split_part(id2, '+', 2))")

# layers of trimming as common table expressions: each takes (ord, w), the windows so far, and gives (ord, w)
_REVERSED = "SELECT ord, w, reverse(w) AS r, length(w) AS n, unnest(range(1, length(w) + 1)) AS k FROM {of}"
_HAS = "(length(substr(r, 1, k)) - length(regexp_replace(substr(r, 1, k), '[{0}]', '', 'g')))"
_CUT = "SELECT f.ord, substr(f.w, 1, CAST(coalesce(c.at, length(f.w)) AS INT)) AS w FROM {of} f LEFT JOIN {cut} c ON c.ord = f.ord"


def _adapter_sql(of: str, to: str, adapter: str) -> str:
    """Cut at the first place from which a window agrees with the adapter's front, up to a fifth of mismatches, five bases at least."""
    return f"""{to}_o AS (SELECT ord, w, unnest(range(0, greatest(length(w) - 4, 0))) AS i FROM {of}),
      {to}_h AS (SELECT ord, i, least(length(w) - i, {len(adapter)}) AS n, substr(w, CAST(i + 1 AS INT), {len(adapter)}) AS x FROM {to}_o),
      {to}_c AS (SELECT ord, min(i) AS at FROM {to}_h WHERE CAST(hamming(x, substr('{adapter}', 1, CAST(n AS INT))) AS FLOAT) / CAST(n AS FLOAT) <= CAST(0.2 AS FLOAT) GROUP BY ord),
      {to} AS ({_CUT.format(of=of, cut=f'{to}_c')})"""


def _poly_g_sql(of: str, to: str) -> str:
    """Cut the tail of G: from the end on while mismatches are five at most and, from ten bases on, one in eight."""
    return f"""{to}_s AS ({_REVERSED.format(of=of)}), {to}_w AS (SELECT ord, n, k, substr(r, CAST(k AS INT), 1) = 'G' AS hit, k - {_HAS.format('G')} AS wrong FROM {to}_s),
      {to}_r AS (SELECT ord, coalesce(min(k - 1) FILTER (wrong > 5 OR wrong > k // 8 AND k >= 10), any_value(n)) AS reach FROM {to}_w GROUP BY ord),
      {to}_c AS (SELECT x.ord, any_value(n) - max(k) AS at FROM {to}_w x JOIN {to}_r y ON x.ord = y.ord WHERE hit AND k - 1 <= reach AND reach >= 10 GROUP BY x.ord),
      {to} AS ({_CUT.format(of=of, cut=f'{to}_c')})"""


def _poly_x_sql(of: str, to: str) -> str:
    """Cut the tail of its most frequent base: from the end on until every base has too many others beside it."""
    counts = ", ".join(f"{_HAS.format(b + 'N')} AS {b.lower()}" for b in "ACGT")
    return f"""{to}_s AS ({_REVERSED.format(of=of)}), {to}_w AS (SELECT ord, n, k, substr(r, CAST(k AS INT), 1) AS base, {counts} FROM {to}_s),
      {to}_r AS (SELECT ord, least(coalesce(min(k - 1) FILTER (k - greatest(a, c, g, t) > least(5, k // 8) AND k >= 9), any_value(n)) + 1, any_value(n)) AS upto,
        coalesce(min(k - 1) FILTER (k - greatest(a, c, g, t) > least(5, k // 8) AND k >= 9), any_value(n)) AS reach FROM {to}_w GROUP BY ord),
      {to}_b AS (SELECT x.ord, upto, CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END AS best FROM {to}_w x JOIN {to}_r y ON x.ord = y.ord AND k = upto WHERE reach + 1 >= 10),
      {to}_c AS (SELECT x.ord, any_value(n) - max(k) AS at FROM {to}_w x JOIN {to}_b y ON x.ord = y.ord WHERE base = best AND k <= upto GROUP BY x.ord),
      {to} AS ({_CUT.format(of=of, cut=f'{to}_c')})"""


_TRIM_SE = f"""WITH w0 AS (SELECT ord, substr(seq, 3) AS w FROM adapted WHERE length(seq) > 2), {_adapter_sql('w0', 'w1', kn.TRUSEQ_R1)}, {_poly_g_sql('w1', 'w2')}, {_poly_x_sql('w2', 'w3')}"""
query("fastq_trim_se", "adapted", f"{_TRIM_SE} SELECT a.ord, a.id, w AS seq, substr(qual, 3, CAST(length(w) AS INT)) AS qual FROM adapted a JOIN w3 ON a.ord = w3.ord WHERE length(w) >= 15")(
    lambda df: rd.trim(df, rd.Trim(front1=2, poly_g=True, poly_x=True))
)
query("fastq_trim_report", "adapted", f"""{_TRIM_SE}, n AS (SELECT a.ord, length(a.seq) AS n, w0.ord IS NOT NULL AS whole, length(w0.w) AS n0, length(w1.w) AS n1, length(w2.w) AS n2, length(w3.w) AS n3
    FROM adapted a LEFT JOIN w0 ON w0.ord = a.ord LEFT JOIN w1 ON w1.ord = a.ord LEFT JOIN w2 ON w2.ord = a.ord LEFT JOIN w3 ON w3.ord = a.ord)
  SELECT count(*) AS reads_in, count(*) FILTER (n3 >= 15) AS reads_out, CAST(sum(n) AS BIGINT) AS bases_in, CAST(coalesce(sum(n3) FILTER (n3 >= 15), 0) AS BIGINT) AS bases_out, count(*) FILTER (coalesce(n3, 0) < 15) AS too_short,
    count(*) FILTER (n1 < n0) AS adapter_reads, CAST(coalesce(sum(n0 - n1), 0) AS BIGINT) AS adapter_bases, count(*) FILTER (n2 < n1) AS poly_g_reads, CAST(coalesce(sum(n1 - n2), 0) AS BIGINT) AS poly_g_bases,
    count(*) FILTER (n3 < n2) AS poly_x_reads, CAST(coalesce(sum(n2 - n3), 0) AS BIGINT) AS poly_x_bases, CAST(2 * count(*) FILTER (whole) AS BIGINT) AS fixed_bases, CAST(0 AS BIGINT) AS overlap_pairs, CAST(0 AS BIGINT) AS overlap_bases FROM n""")(
    lambda df: rd.trim_report(df, rd.Trim(front1=2, poly_g=True, poly_x=True))
)
# the first offset of mate 2 into mate 1, upwards from 0 and then downwards from -1, at which mismatches stay within a fifth and five
_OVERLAP = """x AS (SELECT a.ord, a.w AS s1, translate(reverse(b.w), 'ACGT', 'TGCA') AS s2 FROM a1 a JOIN b1 b ON a.ord = b.ord WHERE length(a.w) >= 30 AND length(b.w) >= 30),
  o AS (SELECT ord, s1, s2, unnest(list_concat(range(0, length(s1) - 29), range(-1, 29 - length(s2), -1))) AS o FROM x),
  z AS (SELECT *, CASE WHEN o >= 0 THEN least(length(s1) - o, length(s2)) ELSE least(length(s1), length(s2) + o) END AS size FROM o),
  m AS (SELECT ord, o, size, hamming(substr(s1, CAST(1 + greatest(o, 0) AS INT), CAST(size AS INT)), substr(s2, CAST(1 + greatest(-o, 0) AS INT), CAST(size AS INT))) AS wrong FROM z),
  met AS (SELECT ord, arg_min(o, CASE WHEN o >= 0 THEN o ELSE 1000000 - o END) AS o, arg_min(size, CASE WHEN o >= 0 THEN o ELSE 1000000 - o END) AS size FROM m
    WHERE wrong <= least(5, floor(CAST(size AS FLOAT) * CAST(0.2 AS FLOAT))) GROUP BY ord)"""
query("fastq_trim_pe", "adapted_pairs", f"""WITH p AS (SELECT a.ord, a.seq AS s1, b.seq AS s2 FROM adapted a JOIN mates b ON a.ord = b.ord WHERE length(a.seq) > 0 AND length(b.seq) > 0),
  a0 AS (SELECT ord, s1 AS w FROM p), b0 AS (SELECT ord, s2 AS w FROM p), {_poly_g_sql('a0', 'a1')}, {_poly_g_sql('b0', 'b1')}, {_OVERLAP},
  a2 AS (SELECT * FROM a1 WHERE ord NOT IN (SELECT ord FROM met WHERE o < 0)), b2 AS (SELECT * FROM b1 WHERE ord NOT IN (SELECT ord FROM met WHERE o < 0)), {_adapter_sql('a2', 'a3', kn.TRUSEQ_R1)}, {_adapter_sql('b2', 'b3', kn.TRUSEQ_R2)},
  a4 AS (SELECT * FROM a3 UNION ALL SELECT a.ord, substr(w, 1, CAST(size AS INT)) FROM a1 a JOIN met ON met.ord = a.ord WHERE o < 0), b4 AS (SELECT * FROM b3 UNION ALL SELECT b.ord, substr(w, 1, CAST(size AS INT)) FROM b1 b JOIN met ON met.ord = b.ord WHERE o < 0)
  SELECT a.ord, a.id AS id1, a4.w AS seq1, substr(a.qual, 1, CAST(length(a4.w) AS INT)) AS qual1, b.id AS id2, b4.w AS seq2, substr(b.qual, 1, CAST(length(b4.w) AS INT)) AS qual2
  FROM adapted a JOIN mates b ON a.ord = b.ord JOIN a4 ON a4.ord = a.ord JOIN b4 ON b4.ord = a.ord WHERE least(length(a4.w), length(b4.w)) >= 15""")(
    lambda both: rd.trim_paired(both, rd.Trim(overlap=True, poly_g=True))
)
# the first offset, upwards from 0 and then downwards, at which all mismatches, or those of the first 50 bases of more, stay within a fifth and five; where mates disagree, Q30 overrules Q14
query("fastq_merge", "pairs", """WITH p AS (SELECT a.ord, a.id AS id1, b.id AS id2, a.seq AS s1, a.qual AS q1, b.seq AS seq2, b.qual AS qual2, translate(reverse(b.seq), 'ACGT', 'TGCA') AS s2, reverse(b.qual) AS q2 FROM reads a JOIN mates b ON a.ord = b.ord),
  o AS (SELECT ord, s1, s2, unnest(list_concat(range(0, greatest(0, length(s1) - 30)), range(0, -greatest(0, length(s2) - 30), -1))) AS o FROM p),
  z AS (SELECT *, CASE WHEN o >= 0 THEN least(length(s1) - o, length(s2)) ELSE least(length(s1), length(s2) + o) END AS size FROM o),
  y AS (SELECT ord, o, size, substr(s1, CAST(1 + greatest(o, 0) AS INT), CAST(size AS INT)) AS x, substr(s2, CAST(1 + greatest(-o, 0) AS INT), CAST(size AS INT)) AS y, least(5, floor(size * 0.2)) AS budget FROM z),
  met AS (SELECT ord, arg_min(o, CASE WHEN o >= 0 THEN o ELSE 1000000 - o END) AS o, arg_min(size, CASE WHEN o >= 0 THEN o ELSE 1000000 - o END) AS size FROM y
    WHERE CASE WHEN x = y THEN 0 ELSE hamming(x, y) END <= budget OR CASE WHEN size <= 50 THEN false ELSE hamming(substr(x, 1, 50), substr(y, 1, 50)) <= budget END GROUP BY ord),
  m AS (SELECT p.*, size, greatest(o, 0) AS g, greatest(-o, 0) AS l, CASE WHEN o > 0 THEN length(s2) - size ELSE 0 END AS len2 FROM p JOIN met ON met.ord = p.ord),
  k AS (SELECT *, unnest(range(1, size + 1)) AS k FROM m), c AS (SELECT ord, k, substr(s1, CAST(g + k AS INT), 1) AS x, substr(s2, CAST(l + k AS INT), 1) AS y, substr(q1, CAST(g + k AS INT), 1) AS p, substr(q2, CAST(l + k AS INT), 1) AS q FROM k),
  f AS (SELECT *, x <> y AND ascii(p) >= 63 AND ascii(q) <= 47 AS one, x <> y AND ascii(q) >= 63 AND ascii(p) <= 47 AS two FROM c),
  j AS (SELECT ord, string_agg(CASE WHEN two THEN y ELSE x END, '' ORDER BY k) AS seq, string_agg(CASE WHEN two THEN q ELSE p END, '' ORDER BY k) AS qual, count(*) FILTER (one OR two) AS corrected FROM f GROUP BY ord)
  SELECT m.ord, CAST(0 AS INTEGER) AS mate, concat(id1, ' merged_', g + size, '_', len2) AS id, concat(substr(s1, 1, CAST(g AS INT)), j.seq, substr(s2, CAST(size + 1 AS INT), CAST(len2 AS INT))) AS seq,
    concat(substr(q1, 1, CAST(g AS INT)), j.qual, substr(q2, CAST(size + 1 AS INT), CAST(len2 AS INT))) AS qual, true AS merged, coalesce(j.corrected, 0) AS corrected FROM m LEFT JOIN j ON j.ord = m.ord
  UNION ALL SELECT ord, 1, id1, s1, q1, false, 0 FROM p WHERE ord NOT IN (SELECT ord FROM met) UNION ALL SELECT ord, 2, id2, seq2, qual2, false, 0 FROM p WHERE ord NOT IN (SELECT ord FROM met)""")(
    lambda both: rd.merge_paired(both, correct=True, include_unmerged=True)
)

_DUK_REFERENCE = kn.TRUSEQ_R1
_K = 15
# every window of the adapter and of its other strand, its middle base a wildcard; and the first of them in each read of a view
_DUK_REFS = f"""r AS (SELECT '{_DUK_REFERENCE}' AS s UNION ALL SELECT translate(reverse('{_DUK_REFERENCE}'), 'ACGT', 'TGCA')),
  w AS (SELECT s, unnest(range(1, length(s) - {_K} + 2)) AS i FROM r), m AS (SELECT DISTINCT concat(substr(s, i, {_K // 2}), '.', substr(s, i + {_K // 2 + 1}, {_K // 2})) AS k FROM w)"""


def _duk_hits(view: str, name: str) -> str:
    return f"""x_{name} AS (SELECT ord, unnest(range(1, greatest(length(seq) - {_K} + 2, 1))) AS i, seq FROM {view}), {name} AS (SELECT x.ord, min(x.i) AS first FROM x_{name} x
    JOIN m ON concat(substr(seq, i, {_K // 2}), '.', substr(seq, i + {_K // 2 + 1}, {_K // 2})) = m.k AND regexp_full_match(substr(seq, i, {_K}), '[ACGT]+') GROUP BY x.ord)"""


_DUK_KMERS = f"{_DUK_REFS}, {_duk_hits('adapted', 'h')}"
query("bbduk_filter", "adapted", f"WITH {_DUK_KMERS} SELECT a.* FROM adapted a LEFT JOIN h ON a.ord = h.ord WHERE h.ord IS NULL AND length(a.seq) >= 10")(lambda df: rd.duk(df, [_DUK_REFERENCE], rd.Duk(k=_K)).filter("not matched").drop("matched"))
query("bbduk_ktrim_r", "adapted", f"""WITH {_DUK_KMERS}, c AS (SELECT a.ord, a.id, a.seq, a.qual, coalesce(h.first - 1, length(a.seq)) AS n FROM adapted a LEFT JOIN h ON a.ord = h.ord)
  SELECT ord, id, substr(seq, 1, CAST(n AS INT)) AS seq, substr(qual, 1, CAST(n AS INT)) AS qual FROM c WHERE n >= 10""")(lambda df: rd.duk(df, [_DUK_REFERENCE], rd.Duk(k=_K, ktrim="r")).filter("not matched").drop("matched"))
query("bbduk_qtrim", "reads", """WITH t AS (SELECT ord, id, seq, qual, length(regexp_extract(qual, '^[!-+]*')) AS s, length(regexp_replace(qual, '[!-+]+$', '')) AS e FROM reads)
  SELECT ord, id, substr(seq, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS seq, substr(qual, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS qual FROM t WHERE e - s >= 10""")(lambda df: rd.duk(df, [], rd.Duk(qtrim="rl", trimq=11)).filter("not matched").drop("matched"))
query("bbduk_pairs", "adapted_pairs", f"""WITH {_DUK_REFS}, {_duk_hits('adapted', 'h')}, {_duk_hits('mates', 'g')}
  SELECT a.ord, a.id AS id1, a.seq AS seq1, a.qual AS qual1, b.id AS id2, b.seq AS seq2, b.qual AS qual2 FROM adapted a JOIN mates b ON a.ord = b.ord LEFT JOIN h ON h.ord = a.ord LEFT JOIN g ON g.ord = a.ord
  WHERE h.ord IS NULL AND g.ord IS NULL AND length(a.seq) >= 10 AND length(b.seq) >= 10""")(lambda both: rd.duk_paired(both, [_DUK_REFERENCE], rd.Duk(k=_K)))
