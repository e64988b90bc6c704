"""Column functions on sequences and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Four different complement tables, as (from, to) pairs for translate.
COMPLEMENT_FASTA = ("ACGTacgt", "TGCATGCA")
COMPLEMENT_FASTQ = ("ACGTNacgtn", "TGCANTGCAN")
COMPLEMENT_CASE = ("ACGTacgt", "TGCAtgca")
COMPLEMENT_MERGE = ("ACGTU", "TGCAA")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def length(c: Column | str) -> Column:
    return F.length(col(c)).cast("long")


def reverse_complement(c: Column | str, table: tuple[str, str] = COMPLEMENT_FASTA) -> Column:
    """The other strand; characters outside the table stay."""
    return F.translate(F.reverse(col(c)), *table)


def count_any(c: Column | str, characters: str) -> Column:
    """How many characters of a text are among `characters`."""
    return (F.length(col(c)) - F.length(F.translate(col(c), "".join(sorted(set(characters))), ""))).cast("long")


def gc_percent(c: Column | str) -> Column:
    """Share of G and C in percent, either case, 2 decimals; 0 for an empty sequence."""
    n = F.length(col(c))
    return F.when(n > 0, F.round(F.lit(100.0) * count_any(c, "GCgc") / n, 2)).otherwise(F.lit(0.0))


def phred(character: Column, offset: int = 33) -> Column:
    return F.ascii(character) - F.lit(offset)


def count_below(qual: Column | str, least: int, offset: int = 33) -> Column:
    """Qualities under `least`."""
    return count_any(qual, "".join(chr(q) for q in range(33, min(126, offset + least - 1) + 1))) if least > 0 else F.lit(0).cast("long")


def classify(c: Column | str) -> Column:
    """DNA, RNA, Protein or Unlimit by a sequence's first 10,000 characters: IUPAC nucleotides, gaps and line ends are neutral."""
    head = F.upper(F.substring(col(c), 1, 10000))
    return (
        F.when((head == "") | head.rlike(r"[^ACGTUNRYSWKMBDHVEFILPQZX* .\n\r-]"), "Unlimit")
        .when(head.rlike(r"[EFILPQZX*]"), "Protein")
        .when(head.contains("U") & ~head.contains("T"), "RNA")
        .otherwise("DNA")
    )


def pieces(c: Column | str, size: int, more: int = 0) -> Column:
    """A text cut into pieces of `size` characters, each with the first `more` (up to size) of the next, as an array; an empty text may have none.

    One pass over the text, however long: substr from a place far into a text walks there from its start.
    """
    parts = F.regexp_extract_all(col(c), F.lit(f"(?s).{{1,{size}}}"), 0)
    if more:
        behind = F.concat(F.slice(parts, 2, F.length(col(c))), F.array(F.lit("")))
        parts = F.zip_with(parts, behind, lambda p, q: F.concat(p, F.substring(q, 1, more)))
    return F.when(F.length(col(c)) <= size, F.array(col(c))).otherwise(parts)


def kmers(c: Column | str, k: int) -> Column:
    """Array of (pos from 0, kmer) over all windows; empty for short sequences."""
    c = col(c)
    return F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.struct((i - 1).alias("pos"), F.substr(c, i, F.lit(k)).alias("kmer")))).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def canonical(kmer: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement, in upper case."""
    up = F.upper(col(kmer))
    return F.least(up, reverse_complement(up))


def encode(kmer: Column | str) -> Column:
    """A k-mer of A, C, G, T as a number, two bits a base; up to 31 bases fit a long."""
    return F.conv(F.translate(F.upper(col(kmer)), "ACGT", "0123"), 4, 10).cast("long")


def decode(number: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(col(number).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def hamming(a: Column, b: Column) -> Column:
    """Places in which two texts of equal length differ."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)), 1).otherwise(0))
