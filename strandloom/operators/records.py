"""Operators on annotation (GFF), variant (VCF) and alignment (SAM) frames; ord is the place in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GFF_COLUMNS = ("seqid", "source", "type", "start_pos", "end_pos", "score", "strand", "phase", "attributes")
VARIANT = ("chrom", "pos", "ref", "alt")


def line(df: DataFrame, columns):
    """A row as its line of text: columns by tabs, nulls as dots."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns])


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def gff_filter(df: DataFrame, kind: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of a type whose line matches a pattern; either may be left out."""
    if kind is not None:
        df = df.filter(F.col("type") == kind)
    return df if pattern is None else df.filter(line(df, GFF_COLUMNS).rlike(pattern))


def gff_grep(df: DataFrame, pattern: str, attributes_only: bool = False, invert: bool = False) -> DataFrame:
    text = F.coalesce("attributes", F.lit("")) if attributes_only else line(df, GFF_COLUMNS)
    return df.filter(~text.rlike(pattern) if invert else text.rlike(pattern))


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy("ord").limit(n)


def gff_sort(df: DataFrame) -> DataFrame:
    """By sequence and start; starts that are no number count as 0."""
    return df.orderBy("seqid", F.coalesce(F.col("start_pos").try_cast("long"), F.lit(0)), "ord")


def gff_stats(df: DataFrame) -> DataFrame:
    """(what, value, n): rows in all, by type, by source and by sequence."""
    sets = df.groupingSets([["type"], ["source"], ["seqid"], []], "type", "source", "seqid").agg(F.count("*").alias("n"), F.grouping_id("type", "source", "seqid").alias("g"))
    what = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "source").when(F.col("g") == 6, "seqid").otherwise("total")
    return sets.select(what.alias("what"), F.coalesce("type", "source", "seqid").alias("value"), "n")


def gff_to_bed(df: DataFrame) -> DataFrame:
    """BED6, 0-based; the name is the feature's type."""
    return df.select(F.col("seqid").alias("chrom"), F.greatest(F.col("start_pos") - 1, F.lit(0)).alias("chrom_start"), F.col("end_pos").alias("chrom_end"), F.col("type").alias("name"), "score", "strand")


def vcf_filter(df: DataFrame, least: float | None = None, passing: bool = False) -> DataFrame:
    """Records of at least a quality (missing qualities pass), and only those whose FILTER is PASS or missing if `passing`."""
    if least is not None:
        df = df.filter(F.col("qual").isNull() | (F.col("qual") >= least))
    return df.filter(F.col("filter").isNull() | F.col("filter").isin("PASS", ".")) if passing else df


def vcf_grep(df: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    hit = line(df, [c for c in df.columns if c != "ord"]).rlike(pattern)
    return df.filter(~hit if invert else hit)


def vcf_sort(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom", "pos", "ord")


def concat(*frames: DataFrame) -> DataFrame:
    """One body after another, numbered by file."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("file", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out


def vcf_merge(*frames: DataFrame) -> DataFrame:
    """The union by (chrom, pos, ref, alt), the first record of each key in order of files and lines."""
    both = concat(*frames)
    rest = [c for c in both.columns if c not in VARIANT]
    first = F.min_by(F.struct(*rest), F.struct("file", "ord"))
    return both.groupBy(*VARIANT).agg(first.alias("r")).select(*VARIANT, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*both.columns)


def vcf_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of a whose (chrom, pos, ref, alt) stand in b, too."""
    return a.join(b.select(*VARIANT), list(VARIANT), "left_semi").select(*a.columns)


def vcf_stats(df: DataFrame) -> DataFrame:
    """One row of counts over alternative alleles: by kind, and transitions against transversions. `.` and `*` aren't alleles."""
    alleles = df.select(F.upper("ref").alias("r"), F.explode(F.split("alt", ",")).alias("a")).filter(~F.col("a").isin(".", "*")).withColumn("a", F.upper("a"))
    n, m = F.length("r"), F.length("a")
    snp = (n == 1) & (m == 1)
    pair = F.concat("r", "a")
    transition = snp & pair.isin("AG", "GA", "CT", "TC")
    ratio = F.when(F.count_if(snp & ~transition) > 0, F.round(F.count_if(transition) / F.count_if(snp & ~transition), 6)).otherwise(0.0)
    return alleles.agg(
        F.count("*").alias("total"), F.count_if(snp).alias("snps"), F.count_if(m > n).alias("insertions"), F.count_if(m < n).alias("deletions"), F.count_if((n == m) & (n > 1)).alias("mnps"),
        F.count_if(transition).alias("transitions"), F.count_if(snp & ~transition).alias("transversions"), ratio.alias("ti_tv"),
    )


def flagstat(df: DataFrame) -> DataFrame:
    """One row for reads that pass quality control and one for those that fail: counts by flag. Only the paired ones ask for the pairing bit."""
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    primary, mapped, paired, mate = ~bit(256) & ~bit(2048), ~bit(4), bit(1), ~bit(8)
    # "=" stands for the read's own reference; null and * are no reference
    reference = lambda c: F.when(F.col(c) == "*", None).otherwise(F.col(c))
    other = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    apart = paired & mapped & mate & primary & ~reference("rname").eqNullSafe(F.when(other == "*", None).otherwise(other))
    counters = {
        "total": F.lit(True), "primary_reads": primary, "secondary": bit(256), "supplementary": bit(2048), "duplicates": bit(1024), "primary_duplicates": bit(1024) & primary, "mapped": mapped, "primary_mapped": mapped & primary,
        "paired": paired, "read1": paired & bit(64), "read2": paired & bit(128), "properly_paired": paired & bit(2), "both_mapped": paired & mapped & mate, "singletons": paired & mapped & ~mate & primary,
        "mate_elsewhere": apart, "mate_elsewhere_q5": apart & (F.col("mapq") >= 5) & (F.col("mapq") != 255),
    }
    found = df.groupBy(bit(512).alias("failed")).agg(*(F.count_if(c).alias(n) for n, c in counters.items()))
    both = df.sparkSession.createDataFrame([(False,), (True,)], "failed boolean")
    filled = F.broadcast(both).join(found, "failed", "left").select("failed", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counters))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 2)).alias(f"{a}_share")
    return filled.select("*", share("mapped", "total"), share("primary_mapped", "primary_reads"), share("properly_paired", "paired"), share("singletons", "paired"))


def idxstats(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Mapped and unmapped reads by reference, all references and one row * for reads without one."""
    unmapped = F.col("flag").bitwiseAND(F.lit(4)) != 0
    n = df.groupBy(F.coalesce("rname", F.lit("*")).alias("chrom")).agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))
    star = genome.sparkSession.createDataFrame([("*", 0)], "chrom string, size long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return genome.select("chrom", "size").union(star).join(n, "chrom", "left").select("chrom", "size", zero("mapped"), zero("unmapped"))


def sort_alignments(df: DataFrame, by: str = "coordinate", genome: DataFrame | None = None) -> DataFrame:
    """By reference (in the header's order, if a genome is given with `place`, else by name) and position, reads without one last; or by name. Equal ones stay in file order."""
    if by == "name":
        return df.orderBy("qname", "ord")
    if genome is None:
        return df.orderBy(F.asc_nulls_last("rname"), "pos", "ord")
    placed = df.join(genome.select(F.col("chrom").alias("rname"), "place"), "rname", "left")
    return placed.orderBy(F.asc_nulls_last("place"), "pos", "ord").select(*df.columns)
