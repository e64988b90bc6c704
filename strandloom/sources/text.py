"""Genomic text formats as DataFrames. Every row knows its place (ord, from 0), as DataFrames have no order: in its file, or
where several are read, in all of them in order of their paths, so that ord tells rows of several files apart.

Files are read by Spark's text source, split over tasks where their compression allows. A line's number comes from the lines
before it in its block of the file, and from the counts of the blocks before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import GFF_COLUMNS


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, at, fours, start, value): the lines of text files, without line ends, with their number in the file, and in all files, how many groups of four
    lines the files before have, and their first byte in the file."""
    raw = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    sized = raw.withColumn("size", F.octet_length("value") + 1)
    blocks = sized.groupBy("file", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before, files = Window.partitionBy("file").orderBy("block"), Window.orderBy("file")
    # one row a file, and one a block
    of_file = blocks.groupBy("file").agg(F.sum("n").alias("lines")).select("file", (F.sum("lines").over(files) - F.col("lines")).alias("l0"), (F.sum(F.ceil(F.col("lines") / 4)).over(files) - F.ceil(F.col("lines") / 4)).cast("long").alias("fours"))
    base = blocks.select("file", "block", (F.sum("n").over(before) - F.col("n")).alias("n0"), (F.sum("bytes").over(before) - F.col("bytes")).alias("b0")).join(of_file, "file")
    own = Window.partitionBy("file", "block").orderBy("m")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = sized.withColumn("i", F.row_number().over(own) - 1).withColumn("upto", F.sum("size").over(upto)).join(base, ["file", "block"])
    line_no = (F.col("n0") + F.col("i")).cast("long")
    return numbered.select("file", line_no.alias("line_no"), (F.col("l0") + line_no).alias("at"), "fours", (F.col("b0") + F.col("upto") - F.col("size")).cast("long").alias("start"), F.regexp_replace("value", "\r$", "").alias("value"))


def _fail(what: str, row: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(row.cast("string"), F.lit("null"))))


def _checked(ok: Column, value: Column, what: str, row: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(_fail(what, row).cast("string"))


def bed(spark: SparkSession, paths, mode: str = "failfast") -> DataFrame:
    """(file, ord, chrom, chrom_start, chrom_end, name, score, strand). Blank, # , track and browser lines are skipped.

    failfast: short rows, bad numbers and empty intervals are errors; permissive: rows of under three fields or with bad numbers are skipped.
    A strand that is neither + nor - is null.
    """
    body = lines(spark, paths).filter((F.trim("value") != "") & ~F.col("value").rlike(r"^(#|track(\s|$)|browser(\s|$))"))
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    row = body.withColumn("s", field(1).try_cast("long")).withColumn("e", field(2).try_cast("long"))
    whole = (F.size(f) >= 3) & F.col("s").isNotNull() & F.col("e").isNotNull()
    if mode == "permissive":
        row, chrom = row.filter(whole), field(0)
    else:
        chrom = _checked(whole & (F.col("s") >= 0) & (F.col("s") < F.col("e")), field(0), "not an interval", F.col("value"))
    strand = F.when(field(5).isin("+", "-"), field(5))
    return row.select("file", F.col("at").alias("ord"), chrom.alias("chrom"), F.col("s").alias("chrom_start"), F.col("e").alias("chrom_end"), field(3).alias("name"), field(4).alias("score"), strand.alias("strand"))


def genome_sizes(spark: SparkSession, paths) -> DataFrame:
    """(chrom, size, place) of a two-column file."""
    body = lines(spark, paths).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    size = F.get(f, F.lit(1)).try_cast("long")
    return body.select(_checked(size.isNotNull(), F.get(f, F.lit(0)), "not a size", F.col("value")).alias("chrom"), size.alias("size"), F.col("at").alias("place"))


def fastq(spark: SparkSession, paths) -> DataFrame:
    """(file, ord, id, seq, qual) of four-line records; a missing line, a wrong mark, or qualities of another length than the bases are errors."""
    four = lines(spark, paths).groupBy("file", F.expr("fours + line_no div 4").alias("ord")).agg(*(F.max(F.when(F.col("line_no") % 4 == k, F.col("value"))).alias(n) for k, n in enumerate(("head", "seq", "plus", "qual"))))
    ok = F.col("head").startswith("@") & F.col("plus").startswith("+") & F.col("qual").isNotNull() & (F.length("seq") == F.length("qual"))
    return four.select("file", "ord", _checked(ok, F.substr(F.col("head"), F.lit(2)), "not a FASTQ record", F.col("head")).alias("id"), "seq", "qual")


def _records(text: DataFrame) -> DataFrame:
    """Lines with the number of the FASTA record that they belong to, in all files (ord) and in their own (place, -1 before the first header)."""
    head = F.col("value").startswith(">").cast("long")
    run = text.withColumn("run", F.expr(f"line_no div {1 << 16}")).withColumn("head", head)
    sums = run.groupBy("file", "run").agg(F.sum("head").alias("n"))
    of_file = sums.groupBy("file").agg(F.sum("n").alias("heads")).select("file", (F.sum("heads").over(Window.orderBy("file")) - F.col("heads")).alias("h0"))
    base = sums.select("file", "run", (F.sum("n").over(Window.partitionBy("file").orderBy("run")) - F.col("n")).alias("before")).join(of_file, "file")
    own = Window.partitionBy("file", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return run.withColumn("own", F.sum("head").over(own)).join(base, ["file", "run"]).withColumn("place", F.col("before") + F.col("own") - 1).withColumn("ord", F.col("h0") + F.col("place"))


def fasta(spark: SparkSession, paths) -> DataFrame:
    """(file, ord, id, seq): headers whole, wrapped lines joined. Text before the first header is an error."""
    body = _records(lines(spark, paths).filter(F.trim("value") != ""))
    part = F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("line_no", "value"))))
    rows = body.groupBy("file", "ord", "place").agg(F.max(F.when(F.col("head") == 1, F.substr(F.col("value"), F.lit(2)))).alias("id"), F.array_join(F.transform(part, lambda x: F.regexp_replace(x["value"], r"\s", "")), "").alias("seq"))
    return rows.select("file", "ord", _checked(F.col("place") >= 0, F.col("id"), "text before the first header of", F.col("file")).alias("id"), "seq")


def fastx(spark: SparkSession, paths) -> DataFrame:
    """FASTA or FASTQ, by the first character; FASTA has null qualities."""
    first = spark.read.text(paths).filter("value <> ''").first()
    if first is None or first[0][0] not in ">@":
        raise ValueError("neither FASTA nor FASTQ")
    return fastq(spark, paths) if first[0][0] == "@" else fasta(spark, paths).withColumn("qual", F.lit(None).cast("string"))


def fasta_index(spark: SparkSession, paths) -> DataFrame:
    """(name, length, offset, line_bases, line_width) of each record; lines of different length inside a record are an error."""
    body = _records(lines(spark, paths))
    n = F.length("value")
    seq = body.filter("head = 0")
    last = F.max(F.when(n > 0, F.col("line_no"))).over(Window.partitionBy("file", "ord"))
    seq = seq.withColumn("last", last).withColumn("n", n)
    sums = seq.groupBy("file", "ord").agg(F.sum("n").alias("length"), F.min("start").alias("offset"), F.max(F.when(F.col("line_no") < F.col("last"), F.col("n"))).alias("most"), F.min(F.when(F.col("line_no") < F.col("last"), F.col("n"))).alias("least"), F.max(F.when(F.col("line_no") == F.col("last"), F.col("n"))).alias("tail"))
    names = body.filter("head = 1").select("file", "ord", F.regexp_extract("value", r"^>(\S*)", 1).alias("name"))
    bases = F.coalesce("most", "tail", F.lit(0))
    ok = F.col("most").isNull() | ((F.col("most") == F.col("least")) & (F.coalesce("tail", F.lit(0)) <= F.col("most")))
    return names.join(sums, ["file", "ord"], "left").select("ord", _checked(ok, F.col("name"), "lines of different length in", F.col("name")).alias("name"), F.coalesce("length", F.lit(0)).alias("length"), "offset", bases.alias("line_bases"), (bases + 1).alias("line_width"))


def gff(spark: SparkSession, paths) -> DataFrame:
    """(file, ord, nine columns); rows of under nine fields are skipped, and so are # and blank lines. Coordinates are 1-based."""
    body = lines(spark, paths).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    columns = [F.get(f, F.lit(k)).try_cast("long").alias(c) if c.endswith("_pos") else F.get(f, F.lit(k)).alias(c) for k, c in enumerate(GFF_COLUMNS)]
    return body.filter(F.size(f) >= 9).select("file", F.col("at").alias("ord"), *columns)


def gff_attributes(df: DataFrame) -> DataFrame:
    """df with its ninth column as attribute_map: key=value of GFF3, key "value" of GTF (the first where a key comes again)."""
    pair = F.lit(r'([^\s;]+)\s+(?:"([^"]*)"|([^\s;"]+))')
    names = F.regexp_extract_all("attributes", pair, 1)
    values = F.zip_with(F.regexp_extract_all("attributes", pair, 2), F.regexp_extract_all("attributes", pair, 3), lambda quoted, bare: F.concat(quoted, bare))
    once = F.array_distinct(names)
    gtf = F.map_from_arrays(once, F.transform(once, lambda k: F.element_at(values, F.array_position(names, k).cast("int"))))
    # outside of quotes GTF has no equals sign
    is_gtf = F.col("attributes").rlike(r'^\s*[^\s;="]+\s+("|[^\s;="]+\s*(;|$))')
    return df.withColumn("attribute_map", F.when(is_gtf, gtf).otherwise(F.expr("str_to_map(attributes, ';', '=')")))


def header(spark: SparkSession, paths, mark: str = "#") -> list[str]:
    """A file's header lines, in order; they are few and go to the driver."""
    return [r["value"] for r in lines(spark, paths).filter(F.col("value").startswith(mark)).orderBy("file", "line_no").collect()]


def vcf(spark: SparkSession, paths) -> DataFrame:
    """(file, ord, chrom, pos, id, ref, alt, qual, filter, info, format, samples); a dot is no quality."""
    body = lines(spark, paths).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    text = lambda k, c: F.get(f, F.lit(k)).alias(c)
    samples = F.when(F.size(f) > 9, F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(1))))
    return body.filter(F.size(f) >= 5).select(
        "file", F.col("at").alias("ord"), text(0, "chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), text(2, "id"), text(3, "ref"), text(4, "alt"), F.get(f, F.lit(5)).try_cast("double").alias("qual"), text(6, "filter"), text(7, "info"), text(8, "format"), samples.alias("samples")
    )


def vcf_info(df: DataFrame) -> DataFrame:
    """df with its INFO column as info_map, flags with an empty value; a dot is an empty map, and of a key that comes again the first counts."""
    entries = F.filter(F.split("info", ";"), lambda e: (e != "") & (e != "."))
    names = F.transform(entries, lambda e: F.substring_index(e, "=", 1))
    once = F.array_distinct(names)
    value = lambda k: F.element_at(entries, F.array_position(names, k).cast("int"))
    return df.withColumn("info_map", F.map_from_arrays(once, F.transform(once, lambda k: F.substr(value(k), F.length(k) + 2))))


def vcf_calls(df: DataFrame) -> DataFrame:
    """(file, ord, sample, call): a row for each sample of each variant, from 0, with its FORMAT keys and values as a map; keys without a value are missing."""
    keys = F.split("format", ":")
    calls = df.filter("samples is not null").select("file", "ord", keys.alias("keys"), F.posexplode("samples").alias("sample", "value")).withColumn("value", F.split("value", ":"))
    n = F.least(F.size("keys"), F.size("value"))
    return calls.select("file", "ord", "sample", F.map_from_arrays(F.slice("keys", F.lit(1), n), F.slice("value", F.lit(1), n)).alias("call"))


SAM_COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def sam(spark: SparkSession, paths) -> DataFrame:
    """(file, ord, eleven columns, tags); * is no reference."""
    body = lines(spark, paths).filter((F.col("value") != "") & ~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    number = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    columns = [F.get(f, F.lit(k)).cast(number.get(c, "string")) for k, c in enumerate(SAM_COLUMNS)]
    columns = [F.when(x != "*", x).alias(c) if c in ("rname", "rnext") else x.alias(c) for x, c in zip(columns, SAM_COLUMNS)]
    tags = F.when(F.size(f) > 11, F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(1))), lambda t: F.struct(F.substring(t, 1, 2), F.substr(t, F.lit(6))))))
    return body.select("file", F.col("at").alias("ord"), *columns, tags.alias("tags"))


def sam_references(spark: SparkSession, paths) -> DataFrame:
    """(chrom, size, place) of a SAM file's header."""
    sq = lines(spark, paths).filter(F.col("value").startswith("@SQ\t"))
    return sq.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("size"), F.col("at").alias("place"))


def p_values(spark: SparkSession, paths, column: int = 1) -> DataFrame:
    """(ord, line, p): a column (from 1) of a table by tabs; what is no number is an error."""
    body = lines(spark, paths).filter(F.trim("value") != "")
    p = F.get(F.split("value", "\t"), F.lit(column - 1)).try_cast("double")
    return body.select(F.col("at").alias("ord"), F.col("value").alias("line"), _checked(p.isNotNull(), p.cast("string"), "no p-value", F.col("value")).cast("double").alias("p"))


def _dump(spark: SparkSession, path: str, *columns: tuple[int, str, str]) -> DataFrame:
    f = F.split(F.regexp_replace("value", r"\t?\|\s*$", ""), r"\t\|\t")
    return spark.read.text(path).filter("value <> ''").select(*(F.get(f, F.lit(k)).cast(t).alias(c) for k, c, t in columns))


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """(tax_id, parent, node_rank, name) of nodes.dmp and the scientific names of names.dmp."""
    nodes = _dump(spark, f"{folder}/nodes.dmp", (0, "tax_id", "int"), (1, "parent", "int"), (2, "node_rank", "string"))
    names = _dump(spark, f"{folder}/names.dmp", (0, "tax_id", "int"), (1, "name", "string"), (3, "kind", "string")).filter("kind = 'scientific name'").drop("kind")
    return nodes.join(names, "tax_id", "left")


def merged_taxa(spark: SparkSession, folder: str) -> DataFrame:
    """(old_id, new_id) of merged.dmp."""
    return _dump(spark, f"{folder}/merged.dmp", (0, "old_id", "int"), (1, "new_id", "int"))


def newick(spark: SparkSession, paths) -> DataFrame:
    """(tree_id, newick): one tree a line."""
    return lines(spark, paths).filter(F.trim("value") != "").select(F.col("at").alias("tree_id"), F.col("value").alias("newick"))


def kmer_references(spark: SparkSession, paths=(), literals: str = "") -> list[str]:
    """Reference sequences for k-mer filters: of FASTA files and of a comma list. They are parameters, and go to the driver."""
    found = [s for s in literals.upper().split(",") if s]
    return found + ([r["seq"].upper() for r in fasta(spark, list(paths)).select("seq").collect()] if paths else [])
