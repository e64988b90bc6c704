"""Operators on FASTA and FASTQ frames: (ord, id, seq) or (ord, id, seq, qual); ord is the place in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def lengths(df: DataFrame) -> DataFrame:
    return df.select("id", sq.length("seq").alias("length"))


def gc(df: DataFrame) -> DataFrame:
    return df.select("id", sq.gc_percent("seq").alias("gc"))


def filter_length(df: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """Sequences of least to most characters; most 0 is no limit."""
    n = F.length("seq")
    return df.filter(n >= least) if most == 0 else df.filter((n >= least) & (n <= most))


def grep(df: DataFrame, pattern: str, invert: bool = False, on: str = "id") -> DataFrame:
    """Rows whose header matches a regular expression anywhere, or doesn't."""
    hit = F.col(on).rlike(pattern)
    return df.filter(~hit if invert else hit)


def head(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows of the file."""
    return df.orderBy("ord").limit(n)


def numbered(df: DataFrame, order: str = "ord", run: int = 1 << 16) -> DataFrame:
    """df with `number`, gapless from 0 in file order.

    Runs of neighbouring ords are numbered by themselves, and the runs' counts are summed, so that no task holds the file.
    """
    cut = df.withColumn("run", F.floor(F.col(order) / run))
    base = cut.groupBy("run").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("run")) - F.col("n")).select("run", "base")
    own = F.row_number().over(Window.partitionBy("run").orderBy(order)) - 1
    return cut.withColumn("own", own).join(base, "run").withColumn("number", F.col("base") + F.col("own")).drop("run", "own", "base")


def rename(df: DataFrame, prefix: str) -> DataFrame:
    """Headers made prefix and place in the file, from 0."""
    return numbered(df).withColumn("id", F.concat(F.lit(prefix), F.col("number").cast("string"))).select(*df.columns)


def upper(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.upper("seq"))


def reverse_complement(df: DataFrame, table: tuple[str, str] = sq.COMPLEMENT_FASTA) -> DataFrame:
    """The other strand; qualities, if there are any, are turned round with it."""
    out = df.withColumn("seq", sq.reverse_complement("seq", table))
    return out.withColumn("qual", F.reverse("qual")) if "qual" in df.columns else out


def sort_by(df: DataFrame, key: str = "name") -> DataFrame:
    """By header, by length, or by length descending; rows of equal keys stay in file order."""
    keys = {"name": F.col("id").asc(), "length": F.length("seq").asc(), "length_desc": F.length("seq").desc()}
    return df.orderBy(keys[key], "ord")


def draw(seed: int, *keys: str) -> Column:
    """60 pseudorandom bits for each row, from an MD5 of the seed and the row's keys, so that any SQL engine draws the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sample(df: DataFrame, share: float, seed: int = 0, key: str = "ord") -> DataFrame:
    """About `share` of the rows, the same for the same seed, however partitioned."""
    return df.filter(draw(seed, key) % 1_000_000_000 < int(share * 1_000_000_000))


def split_parts(df: DataFrame, per_part: int | None = None, parts: int | None = None) -> DataFrame:
    """df with `part`, from 0: so many records to a part, or so many parts of (rounded up) equal size."""
    if (per_part is None) == (parts is None):
        raise ValueError("give per_part or parts")
    if per_part is None:
        per_part = max(1, -(-df.count() // parts))
    return numbered(df).withColumn("part", F.expr(f"number div {per_part}")).drop("number")


def to_fasta(df: DataFrame) -> DataFrame:
    return df.select("ord", "id", "seq")


def to_fastq(df: DataFrame, quality: int = 40) -> DataFrame:
    """Constant qualities."""
    return df.select("ord", "id", "seq", F.repeat(F.lit(chr(quality + 33)), F.length("seq")).alias("qual"))


#: Characters of a sequence that regions are joined with.
CHUNK = 1 << 14


def slices(regions: DataFrame, fasta: DataFrame, name: str, first: Column, length: Column) -> DataFrame:
    """regions with `seq`: `length` characters from `first` (from 0) of the sequence whose header's first word is the region's name, as far as it goes.

    Sequences are cut into chunks, so that a region meets those that it covers and not the whole. Regions without a sequence are gone; where more
    sequences have a name, there is a row of each.
    """
    columns = regions.columns
    # rows that are equal travel as one, with their number
    wanted = regions.groupBy(*columns).agg(F.count("*").alias("times_")).withColumn("from_", F.greatest(first.cast("long"), F.lit(0))).withColumn("upto_", first.cast("long") + F.greatest(length.cast("long"), F.lit(0)))
    named = fasta.select(F.substring_index("id", " ", 1).alias("name_"), F.col("ord").alias("ord_"), F.length("seq").alias("size_"))
    met = wanted.join(named, F.col(name) == F.col("name_")).withColumn("upto_", F.least("upto_", "size_")).drop("name_", "size_")
    chunks = fasta.select(F.col("ord").alias("ord_"), F.posexplode(sq.pieces("seq", CHUNK)).alias("chunk_", "piece_"))
    covers = F.when(F.col("from_") < F.col("upto_"), F.expr(f"sequence(from_ div {CHUNK}, (upto_ - 1) div {CHUNK})")).otherwise(F.array(F.lit(-1).cast("long")))
    spread = met.withColumn("chunk_", F.explode(covers.cast("array<int>"))).join(chunks, ["ord_", "chunk_"], "left")
    low = F.greatest(F.col("from_") - F.col("chunk_").cast("long") * CHUNK, F.lit(0))
    high = F.col("upto_") - F.col("chunk_").cast("long") * CHUNK
    part = F.coalesce(F.substr(F.col("piece_"), (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), F.lit(""))
    joined = spread.withColumn("part_", F.struct("chunk_", part.alias("text"))).groupBy(*columns, "times_", "ord_").agg(F.array_sort(F.collect_list("part_")).alias("parts_"))
    text = F.array_join(F.transform("parts_", lambda p: p["text"]), "")
    return joined.withColumn("seq", text).withColumn("times_", F.explode(F.array_repeat(F.lit(1), F.col("times_").cast("int")))).select(*columns, "seq")


def fetch(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Sequences of regions (name, first, last), 1-based and inclusive, by the first word of the header."""
    return slices(regions.select("name", "first", "last"), df, "name", F.col("first") - 1, F.col("last") - F.col("first") + 1)


def interleave(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Mates one after another, in the order of their files."""
    both = r1.withColumn("place", F.col("ord") * 2).unionByName(r2.withColumn("place", F.col("ord") * 2 + 1))
    return both.drop("ord").orderBy("place")


def pairs(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """One row per pair: ord, then r1's and r2's columns with suffix 1 and 2. Files of different length are an error."""
    one = r1.select("ord", F.col("id").alias("id1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"), F.lit(True).alias("in1"))
    two = r2.select("ord", F.col("id").alias("id2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"), F.lit(True).alias("in2"))
    joined = one.join(two, "ord", "full")
    whole = F.assert_true(F.col("in1").isNotNull() & F.col("in2").isNotNull(), "mates' files differ in length")
    return joined.filter(whole.isNull()).drop("in1", "in2")


def _histogram(df: DataFrame) -> DataFrame:
    """Lengths with their counts, running counts, and bases from the longest on; one row per distinct length."""
    counts = df.groupBy(sq.length("seq").alias("len")).agg(F.count("*").alias("cnt"))
    up, down = Window.orderBy("len"), Window.orderBy(F.desc("len"))
    every = Window.partitionBy()
    return counts.select("len", "cnt", F.sum("cnt").over(up).alias("upto"), F.sum(F.col("len") * F.col("cnt")).over(down).alias("bases_from"), F.sum("cnt").over(every).alias("n"), F.sum(F.col("len") * F.col("cnt")).over(every).alias("bases"))


def length_statistics(df: DataFrame) -> DataFrame:
    """One row: quartiles (medians of halves, the middle in both for odd counts), N50, and how many distinct lengths it takes (l50)."""
    h = _histogram(df)
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("len")))  # noqa: E731  the value at a place, from 0

    def middle(first: Column, n: Column) -> Column:
        return (at(first + F.floor((n - 1) / 2)) + at(first + F.floor(n / 2))) / 2

    n = F.col("n")
    half = F.ceil(n / 2)
    reaches = F.col("bases_from") >= F.col("bases") / 2
    out = h.agg(middle(F.lit(0), half).alias("q1"), middle(F.lit(0), n).alias("q2"), middle(n - half, half).alias("q3"), F.max(F.when(reaches, F.col("len"))).alias("n50"), (F.count("*") - F.count(F.when(reaches, 1)) + 1).alias("l50"))
    return out


def fasta_stats(df: DataFrame, gaps: str = "- .") -> DataFrame:
    """One row: counts, lengths, type (by the first record), quartiles, gaps, N50, GC and N. A frame without rows gives nulls and count 0."""
    basic = df.agg(
        F.count("*").alias("num_seqs"), F.sum(sq.length("seq")).alias("sum_len"), F.min(sq.length("seq")).alias("min_len"), F.round(F.avg(F.length("seq")), 6).alias("avg_len"), F.max(sq.length("seq")).alias("max_len"),
        F.min_by(sq.classify("seq"), "ord").alias("type"), F.sum(sq.count_any("seq", gaps)).alias("sum_gap"), F.sum(sq.count_any("seq", "GCgc")).alias("gc_bases"), F.sum(sq.count_any("seq", "Nn")).alias("n_bases"), F.sum(sq.count_any("seq", "Xx")).alias("x_bases"),
    )
    protein = F.col("type") == "Protein"
    out = basic.crossJoin(length_statistics(df))  # one row by one row
    return out.select(
        "num_seqs", "type", "sum_len", "min_len", "avg_len", "max_len", "q1", "q2", "q3", "sum_gap", "n50", "l50",
        F.when(protein, 0.0).otherwise(F.round(100.0 * F.col("gc_bases") / F.col("sum_len"), 6)).alias("gc"), F.when(protein, F.col("x_bases")).otherwise(F.col("n_bases")).alias("sum_n"),
    )


def fastq_stats(df: DataFrame, offset: int = 33) -> DataFrame:
    """fasta_stats with the shares of Q20 and Q30 bases and the mean quality by mean error. A quality below the offset is an error."""
    chars = df.select(F.explode(F.split("qual", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    q = sq.phred(F.col("c"), offset)
    ok = F.when(q < 0, F.raise_error(F.lit("quality below the offset"))).otherwise(q)
    quality = chars.withColumn("q", ok.cast("int")).agg(F.coalesce(F.sum(F.when(F.col("q") >= 20, F.col("n"))), F.lit(0)).alias("q20"), F.coalesce(F.sum(F.when(F.col("q") >= 30, F.col("n"))), F.lit(0)).alias("q30"), F.sum(F.col("n") * F.pow(F.lit(10.0), -F.col("q") / 10)).alias("errors"))
    out = fasta_stats(df).crossJoin(quality)  # one row by one row
    share = lambda c: F.round(100.0 * F.col(c) / F.col("sum_len"), 2)
    mean = F.when(F.coalesce(F.col("errors"), F.lit(0.0)) == 0, 0.0).otherwise(F.round(-10 * F.log10(F.col("errors") / F.col("sum_len")), 6))
    return out.select("*", share("q20").alias("q20_share"), share("q30").alias("q30_share"), mean.alias("avg_qual")).drop("q20", "q30", "errors")


def filter_outcome(seq: str = "seq", qual: str = "qual", quality: int = 15, percent: int = 40, n_limit: int = 5, least: int = 15, most: int = 0, by_quality: bool = True, by_length: bool = True) -> Column:
    """pass, quality, n or length: the first rule that a read fails. Without by_quality Ns aren't counted either."""
    n = F.length(seq)
    out = F.lit("pass")
    if by_length:
        out = F.when((n < least) | ((n > most) if most > 0 else F.lit(False)), "length").otherwise(out)
    if by_quality:
        out = F.when(sq.count_any(seq, "Nn") > n_limit, "n").otherwise(out)
        out = F.when(sq.count_below(qual, quality) * 100 > percent * n, "quality").otherwise(out)
    return out


def filter_reads(df: DataFrame, **limits) -> DataFrame:
    return df.filter(filter_outcome(**limits) == "pass")


def filter_pairs(r1: DataFrame, r2: DataFrame, **limits) -> DataFrame:
    """Pairs of which both mates pass."""
    return filter_paired(pairs(r1, r2), **limits)


def filter_paired(both: DataFrame, **limits) -> DataFrame:
    """filter_pairs, given the pairs."""
    return both.filter((filter_outcome("seq1", "qual1", **limits) == "pass") & (filter_outcome("seq2", "qual2", **limits) == "pass"))


def filter_report(df: DataFrame, **limits) -> DataFrame:
    """One row of counters: reads and bases in and out, and reads failed by each rule."""
    judged = df.select(filter_outcome(**limits).alias("outcome"), sq.length("seq").alias("len"))
    failed = lambda what: F.count_if(F.col("outcome") == what)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return judged.agg(F.count("*").alias("reads_in"), failed("pass").alias("reads_out"), zero(F.sum("len")).alias("bases_in"), zero(F.sum(F.when(F.col("outcome") == "pass", F.col("len")))).alias("bases_out"), failed("quality").alias("failed_quality"), failed("length").alias("failed_length"), failed("n").alias("failed_n"))


def change_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counters for operators that drop or cut reads: reads and bases in and out."""
    total = lambda df, tag: df.agg(F.count("*").alias(f"reads_{tag}"), F.coalesce(F.sum(sq.length("seq")), F.lit(0).cast("long")).alias(f"bases_{tag}"))
    return total(before, "in").crossJoin(total(after, "out")).withColumn("reads_removed", F.col("reads_in") - F.col("reads_out"))  # one row by one row


def dedup_key(mode: str = "bin", k: int = 12, tail_offset: int = 0) -> Column:
    """What makes reads duplicates: the whole sequence, or the canonical k-mer that ends tail_offset before its end (from the start of shorter ones; the sequence if that isn't all ACGT)."""
    if mode == "full":
        return F.col("seq")
    n = F.length("seq")
    window = F.substr(F.col("seq"), F.greatest(n - k - tail_offset, F.lit(0)) + 1, F.lit(k))
    return F.when((n >= k) & window.rlike("^[ACGTacgt]+$"), F.concat(F.lit("k:"), sq.canonical(window))).otherwise(F.concat(F.lit("s:"), F.col("seq")))


def dedup(df: DataFrame, **key) -> DataFrame:
    """The first read of each key in file order."""
    keyed = df.withColumn("key", dedup_key(**key))
    first = keyed.groupBy("key").agg(F.min("ord").alias("ord"))
    return df.join(first.select("ord"), "ord", "left_semi")


def first_index(name: Column) -> Column:
    """The field behind a header's last colon, up to a plus; empty where there is none."""
    tail = F.regexp_extract(name, r"(?s)^.*:(.{2,})$", 1)
    return F.when(F.length(name) < 5, F.lit("")).otherwise(F.regexp_extract(tail, r"(?s)^(.*?)(\+.{2,})?$", 1))


def last_index(name: Column) -> Column:
    """What is behind a header's last colon or plus."""
    return F.when(F.length(name) < 5, F.lit("")).otherwise(F.regexp_extract(name, r"(?s)^.*[:+](.{2,})$", 1))


def stamp(name: Column, umi: Column, delimiter: str = ":", prefix: str = "") -> Column:
    """A header with the UMI put before its first blank, or behind it; an empty UMI leaves it."""
    word = F.substring_index(name, " ", 1)
    tag = F.concat(F.lit(delimiter + (f"{prefix}_" if prefix else "")), umi)
    return F.when(umi == "", name).otherwise(F.concat(word, tag, F.substr(name, F.length(word) + 1)))


def _cut_umi(length: int, skip: int, seq: str, qual: str) -> tuple[Column, Column, Column]:
    n = F.length(seq)
    taken = F.least(n, F.lit(length))
    gone = F.least(taken + skip, n - 1)
    full = F.when(n == 0, F.raise_error(F.lit("a read of length 0 has no UMI")).cast("string")).otherwise(F.substr(F.col(seq), F.lit(1), taken))
    return full, F.substr(F.col(seq), gone + 1), F.substr(F.col(qual), gone + 1)


def umi(df: DataFrame, location: str = "read1", length: int = 0, skip: int = 0, delimiter: str = ":", prefix: str = "") -> DataFrame:
    """Single reads with their UMI in the header: from the read's start (cut off then), or its index field."""
    if location == "index1":
        return df.withColumn("id", stamp(F.col("id"), first_index(F.col("id")), delimiter, prefix))
    if location != "read1" or length <= 0:
        raise ValueError("single reads have read1 (with a length) and index1")
    tag, seq, qual = _cut_umi(length, skip, "seq", "qual")
    return df.select("ord", stamp(F.col("id"), tag, delimiter, prefix).alias("id"), seq.alias("seq"), qual.alias("qual"))


def umi_pairs(r1: DataFrame, r2: DataFrame, location: str, length: int = 0, skip: int = 0, delimiter: str = ":", prefix: str = "") -> DataFrame:
    """Pairs with a common UMI in both headers: read1, read2, index1, index2, per_index or per_read."""
    return umi_paired(pairs(r1, r2), location, length, skip, delimiter, prefix)


def umi_paired(both: DataFrame, location: str, length: int = 0, skip: int = 0, delimiter: str = ":", prefix: str = "") -> DataFrame:
    """umi_pairs, given the pairs."""
    if location in ("read1", "read2", "per_read") and length <= 0:
        raise ValueError("a UMI from sequence needs a length")
    parts, columns = [], {c: F.col(c) for c in ("seq1", "qual1", "seq2", "qual2")}
    for mate in ("1", "2"):
        if location in (f"read{mate}", "per_read"):
            tag, columns[f"seq{mate}"], columns[f"qual{mate}"] = _cut_umi(length, skip, f"seq{mate}", f"qual{mate}")
            parts.append(tag)
    if location in ("index1", "per_index"):
        parts.append(first_index(F.col("id1")))
    if location in ("index2", "per_index"):
        parts.append(last_index(F.col("id2")))
    if not parts:
        raise ValueError(f"no such location: {location}")
    tag = parts[0] if len(parts) == 1 else F.concat(parts[0], F.lit("_"), parts[1])
    return both.select("ord", *(stamp(F.col(f"id{m}"), tag, delimiter, prefix).alias(f"id{m}") for m in "12"), *(c.alias(n) for n, c in columns.items()))
