"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .registry import query

_MERGED = """
m0 AS (SELECT chrom, chrom_start, chrom_end, max(chrom_end) OVER (PARTITION BY chrom ORDER BY chrom_start, chrom_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {of}),
m1 AS (SELECT *, sum(CASE WHEN reached IS NULL OR chrom_start > reached THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY chrom_start, chrom_end ROWS UNBOUNDED PRECEDING) AS island FROM m0),
merged AS (SELECT chrom, min(chrom_start) AS chrom_start, max(chrom_end) AS chrom_end FROM m1 GROUP BY chrom, island)"""
_MERGED_A, _MERGED_B = _MERGED.format(of="iv_a"), _MERGED.format(of="iv_b")
_OVERLAP = "a.chrom = b.chrom AND a.chrom_start < b.chrom_end AND b.chrom_start < a.chrom_end"


@query("bed_sort", "iv_a", "SELECT chrom, chrom_start, chrom_end FROM iv_a")
def bed_sort(a):
    return iv.sort(a)


@query("bed_merge", "iv_a", f"WITH {_MERGED_A} SELECT * FROM merged")
def bed_merge(a):
    return iv.merge(a)


@query("bed_intersect", "iv_a iv_b", f"SELECT a.chrom, greatest(a.chrom_start, b.chrom_start) AS chrom_start, least(a.chrom_end, b.chrom_end) AS chrom_end FROM iv_a a JOIN iv_b b ON {_OVERLAP}")
def bed_intersect(a, b):
    return iv.intersect(a, b)


@query("bed_overlap_count", "iv_b iv_a", f"SELECT a.iv_id, count(b.iv_id) AS n_overlaps FROM iv_b a LEFT JOIN iv_a b ON {_OVERLAP} GROUP BY a.iv_id")
def bed_overlap_count(b, a):
    return iv.overlap_count(b, a)


@query(
    "bed_subtract", "iv_a iv_b",
    f"""WITH {_MERGED_B}, holes AS (
        SELECT a.iv_id, a.chrom, a.chrom_start AS s, a.chrom_end AS e, b.chrom_start AS hs, b.chrom_end AS he FROM iv_a a JOIN merged b ON {_OVERLAP}),
      starts AS (SELECT iv_id, chrom, s AS at, e FROM (SELECT iv_id, chrom, chrom_start AS s, chrom_end AS e FROM iv_a) UNION ALL SELECT iv_id, chrom, he, e FROM holes WHERE he < e)
      SELECT x.iv_id, x.chrom, x.at AS chrom_start, coalesce((SELECT min(h.hs) FROM holes h WHERE h.iv_id = x.iv_id AND h.hs >= x.at), x.e) AS chrom_end
      FROM starts x WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE h.iv_id = x.iv_id AND h.hs <= x.at AND h.he > x.at)""",
)
def bed_subtract(a, b):
    return iv.subtract(a, b)


@query(
    "bed_complement", "iv_b genome",
    f"""WITH {_MERGED_B}, edges AS (SELECT m.chrom, m.chrom_start, m.chrom_end FROM merged m JOIN genome g ON g.chrom = m.chrom AND m.chrom_start < g.size UNION ALL SELECT chrom, size, size FROM genome),
      gaps AS (SELECT chrom, coalesce(max(chrom_end) OVER (PARTITION BY chrom ORDER BY chrom_start, chrom_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chrom_start, chrom_start AS chrom_end FROM edges)
      SELECT * FROM gaps WHERE chrom_start < chrom_end""",
)
def bed_complement(b, genome):
    return iv.complement(b, genome)


@query(
    "bed_closest", "iv_b iv_a",
    """WITH d AS (
        SELECT a.iv_id, b.iv_id AS other, b.chrom_start AS bs, b.chrom_end AS be, greatest(0, b.chrom_start - a.chrom_end, a.chrom_start - b.chrom_end) AS distance
        FROM iv_b a JOIN iv_a b ON a.chrom = b.chrom), r AS (SELECT *, row_number() OVER (PARTITION BY iv_id ORDER BY distance, other) AS n FROM d)
      SELECT a.iv_id, a.chrom, a.chrom_start, a.chrom_end, coalesce(r.bs, -1) AS b_start, coalesce(r.be, -1) AS b_end, coalesce(r.distance, -1) AS distance
      FROM iv_b a LEFT JOIN r ON r.iv_id = a.iv_id AND r.n = 1""",
)
def bed_closest(b, a):
    return iv.closest(b, a)


@query("bed_jaccard", "iv_a iv_b", f"""WITH o AS (SELECT coalesce(sum(least(a.chrom_end, b.chrom_end) - greatest(a.chrom_start, b.chrom_start)), 0) AS i, count(*) AS n FROM iv_a a JOIN iv_b b ON {_OVERLAP}),
      t AS (SELECT (SELECT sum(chrom_end - chrom_start) FROM iv_a) + (SELECT sum(chrom_end - chrom_start) FROM iv_b) AS total)
      SELECT CAST(i AS BIGINT) AS intersection, CAST(total - i AS BIGINT) AS union_bases, round(i / (total - i), 6) AS jaccard, n AS n_intersections FROM o, t""")
def bed_jaccard(a, b):
    return iv.jaccard(a, b)


@query("bed_coverage", "iv_a", f"WITH {_MERGED_A} SELECT chrom, CAST(sum(chrom_end - chrom_start) AS BIGINT) AS bases FROM merged GROUP BY chrom")
def bed_coverage(a):
    return iv.coverage(a)


@query("bed_genomecov", "iv_b genome", """WITH s AS (SELECT chrom, CAST(sum(chrom_end - chrom_start) AS BIGINT) AS covered FROM iv_b GROUP BY chrom),
      x AS (SELECT g.chrom, g.size, coalesce(s.covered, 0) AS covered FROM genome g LEFT JOIN s ON s.chrom = g.chrom),
      d AS (SELECT chrom, CAST(0 AS BIGINT) AS depth, greatest(size - covered, 0) AS bases, size FROM x UNION ALL SELECT chrom, 1, covered, size FROM x)
      SELECT chrom, depth, bases, size, round(bases / size, 6) AS fraction FROM d WHERE bases > 0""")
def bed_genomecov(b, genome):
    return iv.genomecov(b, genome)


@query("bed_genomecov_depth", "iv_b genome", """WITH p AS (SELECT DISTINCT chrom, pos FROM (
        SELECT i.chrom, least(i.chrom_start, g.size) AS pos FROM iv_b i JOIN genome g ON g.chrom = i.chrom UNION ALL SELECT i.chrom, least(i.chrom_end, g.size) FROM iv_b i JOIN genome g ON g.chrom = i.chrom
        UNION ALL SELECT chrom, 0 FROM genome UNION ALL SELECT chrom, size FROM genome)),
      s AS (SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS upto FROM p),
      d AS (SELECT s.chrom, s.pos, s.upto, count(i.iv_id) AS depth FROM s LEFT JOIN iv_b i ON i.chrom = s.chrom AND i.chrom_start <= s.pos AND i.chrom_end > s.pos WHERE s.upto IS NOT NULL GROUP BY 1, 2, 3)
      SELECT d.chrom, d.depth, CAST(sum(upto - pos) AS BIGINT) AS bases, g.size, round(sum(upto - pos) / g.size, 6) AS fraction FROM d JOIN genome g ON g.chrom = d.chrom GROUP BY d.chrom, d.depth, g.size""")
def bed_genomecov_depth(b, genome):
    return iv.genomecov_depth(b, genome)


@query("bed_slop", "iv_b genome", """SELECT b.iv_id, b.chrom, greatest(0, b.chrom_start - 500) AS chrom_start, least(b.chrom_end + 800, coalesce(g.size, b.chrom_end + 800)) AS chrom_end FROM iv_b b LEFT JOIN genome g ON g.chrom = b.chrom""")
def bed_slop(b, genome):
    return iv.slop(b, genome, 500, 800)


@query("bed_flank", "iv_b genome", """WITH x AS (SELECT b.*, g.size FROM iv_b b LEFT JOIN genome g ON g.chrom = b.chrom),
      f AS (SELECT iv_id, chrom, greatest(0, chrom_start - 300) AS chrom_start, chrom_start AS chrom_end FROM x UNION ALL SELECT iv_id, chrom, chrom_end, least(chrom_end + 200, coalesce(size, chrom_end + 200)) FROM x)
      SELECT * FROM f WHERE chrom_start < chrom_end""")
def bed_flank(b, genome):
    return iv.flank(b, genome, 300, 200)


@query("bed_shift", "iv_b genome", """WITH x AS (SELECT b.iv_id, b.chrom, greatest(0, least(b.chrom_start - 4000, coalesce(g.size, b.chrom_start - 4000))) AS chrom_start, greatest(0, least(b.chrom_end - 4000, coalesce(g.size, b.chrom_end - 4000))) AS chrom_end
      FROM iv_b b LEFT JOIN genome g ON g.chrom = b.chrom) SELECT * FROM x WHERE chrom_start < chrom_end""")
def bed_shift(b, genome):
    return iv.shift(b, genome, -4000)


@query("bed_makewindows", "genome", "SELECT g.chrom, w.s AS chrom_start, least(w.s + 100000, g.size) AS chrom_end FROM genome g, LATERAL (SELECT unnest(range(0, g.size, 75000)) AS s) w")
def bed_makewindows(genome):
    return iv.make_windows(genome, 100000, 75000)


@query("bed_len", "iv_a", "SELECT *, greatest(chrom_end - chrom_start, 0) AS length FROM iv_a")
def bed_len(a):
    return iv.lengths(a)


@query("bed_stats", "iv_a", """SELECT count(*) AS n, CAST(sum(chrom_end - chrom_start) AS BIGINT) AS total, min(chrom_end - chrom_start) AS least, max(chrom_end - chrom_start) AS largest,
      round(avg(chrom_end - chrom_start), 6) AS mean, CAST(median(chrom_end - chrom_start) AS DOUBLE) AS median FROM iv_a""")
def bed_stats(a):
    return iv.stats(a)


@query("bed_count", "iv_a iv_b", "SELECT 'a' AS file, count(*) AS n FROM iv_a UNION ALL SELECT 'b', count(*) FROM iv_b UNION ALL SELECT 'total', (SELECT count(*) FROM iv_a) + (SELECT count(*) FROM iv_b)")
def bed_count(a, b):
    files = a.select(F.lit("a").alias("file")).unionAll(b.select(F.lit("b").alias("file")))
    return files.rollup("file").agg(F.count("*").alias("n")).select(F.coalesce("file", F.lit("total")).alias("file"), "n")


@query("bed_to_gff", "iv_b", "SELECT chrom AS seqid, 'bed' AS source, 'region' AS type, chrom_start + 1 AS start_pos, chrom_end AS end_pos, '.' AS score, '.' AS strand, '.' AS phase, 'Name=.' AS attributes FROM iv_b")
def bed_to_gff(b):
    return iv.to_gff(b)


@query("bed_random", "genome", """WITH l AS (SELECT chrom, size - 499 AS room, sum(size - 499) OVER (ORDER BY chrom) AS upto FROM genome), p AS (SELECT i, CAST(concat('0x', substr(md5(concat('7|', i)), 1, 15)) AS BIGINT) % (SELECT sum(room) FROM l) AS pick FROM (SELECT unnest(range(0, 1000)) AS i))
  SELECT p.i AS iv_id, l.chrom, CAST(p.pick - l.upto + l.room AS BIGINT) AS chrom_start, CAST(p.pick - l.upto + l.room + 500 AS BIGINT) AS chrom_end FROM p JOIN l ON p.pick < l.upto AND p.pick >= l.upto - l.room""")
def bed_random(genome):
    return iv.random_intervals(genome, 1000, 500, 7)


@query("bed_getfasta", "fasta", """SELECT iv_id, concat('doc', iv_id) AS chrom, chrom_start, chrom_end, substr(f.seq, CAST(chrom_start + 1 AS INT), CAST(chrom_end - chrom_start AS INT)) AS seq
      FROM (SELECT ord AS iv_id, ord % 60 AS chrom_start, ord % 60 + 40 AS chrom_end FROM fasta) r JOIN fasta f ON f.ord = r.iv_id""")
def bed_getfasta(fasta):
    start = F.col("ord") % 60
    return iv.get_fasta(fasta.select(F.col("ord").alias("iv_id"), F.concat(F.lit("doc"), "ord").alias("chrom"), start.alias("chrom_start"), (start + 40).alias("chrom_end")), fasta)


@query("bed_cluster", "iv_b", "SELECT * FROM iv_b")
def bed_cluster(b):
    return b


@query("bed_unsorted", "iv_b", """WITH n AS (SELECT iv_id AS ord, chrom, chrom_start, row_number() OVER (ORDER BY iv_id) AS i FROM iv_b), l AS (SELECT *, max(chrom_start) OVER (PARTITION BY chrom ORDER BY i) AS most, lag(chrom) OVER (ORDER BY i) AS prev,
      row_number() OVER (PARTITION BY chrom ORDER BY i) AS k FROM n)
      SELECT chrom, ord, 'start' AS problem FROM l WHERE most > chrom_start UNION ALL SELECT chrom, ord, 'chromosome' FROM l WHERE k > 1 AND prev <> chrom""")
def bed_unsorted(b):
    return iv.unsorted(b, "iv_id")


@query("bed_cluster_ids", "iv_a", f"WITH {_MERGED_A} SELECT a.iv_id, a.chrom, a.chrom_start, a.chrom_end, m.chrom_start AS cluster_start FROM iv_a a JOIN merged m ON a.chrom = m.chrom AND a.chrom_start >= m.chrom_start AND a.chrom_end <= m.chrom_end")
def bed_cluster_ids(a):
    return iv.cluster_ids(a)


@query("bed_expand", "iv_b", "SELECT * FROM iv_b")
def bed_expand(b):
    return b
