"""Queries of the annotation, variant and alignment operators."""

from __future__ import annotations

from ..operators import records as op
from ..operators import sequences as sq
from .registry import query

_GFF_LINE = "concat_ws('\\t', seqid, source, type, start_pos, end_pos, score, strand, phase, attributes)".replace("'\\t'", "chr(9)")
_VCF_LINE = "concat_ws(chr(9), chrom, pos, ref, alt, coalesce(CAST(qual AS VARCHAR), '.'), filter)"

query("gff_count", "gff", "SELECT count(*) AS n FROM gff")(op.count)
query("gff_filter", "gff", f"SELECT * FROM gff WHERE type = 'click' AND regexp_matches({_GFF_LINE}, 'srcB.*U=1')")(lambda df: op.gff_filter(df, "click", "srcB.*U=1"))
query("gff_grep", "gff", "SELECT * FROM gff WHERE regexp_matches(attributes, 'U=1?5')")(lambda df: op.gff_grep(df, "U=1?5", attributes_only=True))
query("gff_grep_invert", "gff", f"SELECT * FROM gff WHERE NOT regexp_matches({_GFF_LINE}, 'chr1.*srcA')")(lambda df: op.gff_grep(df, "chr1.*srcA", invert=True))
query("gff_head", "gff", "SELECT * FROM gff ORDER BY ord LIMIT 10")(op.head)
query("gff_sort", "gff", "SELECT * FROM gff")(op.gff_sort)
query("gff_stats", "gff", "SELECT 'total' AS what, NULL AS value, count(*) AS n FROM gff UNION ALL SELECT 'type', type, count(*) FROM gff GROUP BY type UNION ALL SELECT 'source', source, count(*) FROM gff GROUP BY source UNION ALL SELECT 'seqid', seqid, count(*) FROM gff GROUP BY seqid")(op.gff_stats)
query("gff_to_bed", "gff", "SELECT seqid AS chrom, greatest(start_pos - 1, 0) AS chrom_start, end_pos AS chrom_end, type AS name, score, strand FROM gff")(op.gff_to_bed)
query("gff_merge", "gff", "SELECT * FROM gff")(lambda df: df)
query("vcf_count", "vcf", "SELECT count(*) AS n FROM vcf")(op.count)
query("vcf_filter", "vcf", "SELECT * FROM vcf WHERE qual IS NULL OR qual >= 20")(lambda df: op.vcf_filter(df, 20))
query("vcf_filter_pass", "vcf", "SELECT * FROM vcf WHERE filter = 'PASS'")(lambda df: op.vcf_filter(df, passing=True))
query("vcf_grep", "vcf", "SELECT * FROM vcf WHERE regexp_matches(concat_ws(chr(9), chrom, pos, ref, alt), 'chr2.*,T')")(lambda df: op.vcf_grep(df, "chr2.*,T"))
query("vcf_head", "vcf", "SELECT * FROM vcf ORDER BY ord LIMIT 10")(op.head)
query("vcf_sort", "vcf", "SELECT * FROM vcf")(op.vcf_sort)
query("vcf_concat", "vcf vcf_b", "SELECT *, 0 AS file FROM vcf UNION ALL SELECT *, 1 FROM vcf_b")(op.concat)
query("vcf_merge", "vcf_b vcf", """WITH u AS (SELECT *, 0 AS file FROM vcf_b UNION ALL SELECT *, 1 FROM vcf), r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY file, ord) AS n FROM u)
  SELECT * EXCLUDE (n) FROM r WHERE n = 1""")(op.vcf_merge)
query("vcf_isec", "vcf vcf_b", "SELECT * FROM vcf a WHERE EXISTS (SELECT 1 FROM vcf_b b WHERE a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt)")(op.vcf_intersect)
query("vcf_stats", "vcf", """WITH a AS (SELECT ref AS r, unnest(string_split(alt, ',')) AS a FROM vcf), k AS (SELECT length(r) = 1 AND length(a) = 1 AS snp, concat(r, a) IN ('AG', 'GA', 'CT', 'TC') AS ti, length(a) - length(r) AS d, length(r) AS n FROM a)
  SELECT count(*) AS total, count(*) FILTER (snp) AS snps, count(*) FILTER (d > 0) AS insertions, count(*) FILTER (d < 0) AS deletions, count(*) FILTER (d = 0 AND n > 1) AS mnps, count(*) FILTER (snp AND ti) AS transitions,
  count(*) FILTER (snp AND NOT ti) AS transversions, round(count(*) FILTER (snp AND ti) / count(*) FILTER (snp AND NOT ti), 6) AS ti_tv FROM k""")(op.vcf_stats)
query("vcf_sample", "vcf", "SELECT * FROM vcf WHERE CAST(concat('0x', substr(md5(concat('5|', ord)), 1, 15)) AS BIGINT) % 1000000000 < 300000000")(lambda df: sq.sample(df, 0.3, 5))
query("vcf_rename", "vcf", "SELECT * FROM vcf")(lambda df: df)
_BITS = {"total": "true", "primary_reads": "p", "secondary": "flag & 256 <> 0", "supplementary": "flag & 2048 <> 0", "duplicates": "flag & 1024 <> 0", "primary_duplicates": "flag & 1024 <> 0 AND p", "mapped": "m", "primary_mapped": "m AND p", "paired": "flag & 1 <> 0",
         "read1": "flag & 65 = 65", "read2": "flag & 129 = 129", "properly_paired": "flag & 3 = 3", "both_mapped": "flag & 13 = 1", "singletons": "flag & 13 = 9 AND p", "mate_elsewhere": "flag & 13 = 1 AND p AND rname <> rnext", "mate_elsewhere_q5": "flag & 13 = 1 AND p AND rname <> rnext AND mapq >= 5"}
query("bam_flagstat", "sam", f"""WITH s AS (SELECT *, flag & 512 <> 0 AS failed, flag & 2304 = 0 AS p, flag & 4 = 0 AS m FROM sam), c AS (SELECT failed, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _BITS.items())} FROM s GROUP BY failed)
  SELECT *, round(100.0 * mapped / total, 2) AS mapped_share, round(100.0 * primary_mapped / primary_reads, 2) AS primary_mapped_share, round(100.0 * properly_paired / paired, 2) AS properly_paired_share, round(100.0 * singletons / paired, 2) AS singletons_share FROM c""")(op.flagstat)
query("bam_idxstats", "sam genome", """WITH n AS (SELECT rname, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped FROM sam GROUP BY rname), g AS (SELECT * FROM genome UNION ALL SELECT '*', 0)
  SELECT g.chrom, g.size, coalesce(n.mapped, 0) AS mapped, coalesce(n.unmapped, 0) AS unmapped FROM g LEFT JOIN n ON n.rname = g.chrom""")(op.idxstats)
query("bam_sort_coord", "sam", "SELECT * FROM sam")(op.sort_alignments)
query("bam_sort_name", "sam", "SELECT * FROM sam")(lambda df: op.sort_alignments(df, "name"))
