"""Binary formats: BAM alignments and PLINK genotypes, decoded file by file (variants in runs) in Python workers."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.science import plink_genotypes

_BASES = "=ACMGRSVTWYHKDBN"
_CIGAR = "MIDNSHP=X"
_BAM = "file string, ord long, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"


# Struct codes of a tag's types.
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags(raw: bytes, at: int, end: int) -> dict[str, str] | None:
    """A record's tags as SAM writes their values, without types; None without any. Arrays have their numbers' type before them."""
    said = lambda v: f"{v:g}" if isinstance(v, float) else str(v)
    out = {}
    while at < end:
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in _NUMBERS:
            (v,) = struct.unpack_from(f"<{_NUMBERS[kind]}", raw, at)
            at += struct.calcsize(_NUMBERS[kind])
            out[tag] = said(v)
        elif kind == "A":
            out[tag] = chr(raw[at])
            at += 1
        elif kind in "ZH":
            stop = raw.index(b"\0", at)
            out[tag] = raw[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            code, (n,) = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)
            values = struct.unpack_from(f"<{n}{_NUMBERS[code]}", raw, at + 5)
            at += 5 + n * struct.calcsize(_NUMBERS[code])
            out[tag] = ",".join([code, *map(said, values)])
        else:
            raise ValueError(f"no such type of a tag: {kind}")
    return out or None


def decode_bam(data: bytes) -> tuple[list[tuple[str, int]], Iterator[tuple]]:
    """References and records of a BAM file's bytes: BGZF is a series of gzip members."""
    raw = gzip.decompress(data)
    if raw[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    (count,) = struct.unpack_from("<i", raw, at)
    at += 4
    refs = []
    for _ in range(count):
        (n,) = struct.unpack_from("<i", raw, at)
        refs.append((raw[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", raw, at + 4 + n)[0]))
        at += 8 + n

    def records(at: int) -> Iterator[tuple]:
        name = lambda k: refs[k][0] if 0 <= k < len(refs) else None
        while at < len(raw):
            (size,) = struct.unpack_from("<i", raw, at)
            at += 4
            ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw, at)
            p = at + 32
            qname = raw[p : p + n_name - 1].decode()
            p += n_name
            cigar = "".join(f"{c >> 4}{_CIGAR[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", raw, p)) or "*"
            p += 4 * n_cigar
            seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in raw[p : p + (n_seq + 1) // 2])[:n_seq] or "*"
            p += (n_seq + 1) // 2
            q = raw[p : p + n_seq]
            qual = "*" if not q or q[0] == 255 else bytes(b + 33 for b in q).decode()
            yield qname, flag, name(ref), pos + 1, mapq, cigar, name(mate), mate_pos + 1, tlen, seq, qual, _tags(raw, p + n_seq, at + size)
            at += size

    return refs, records(at)


def bam(spark: SparkSession, paths) -> DataFrame:
    """SAM's columns of BAM files, tags too. A file is one task and held whole there; ord is its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _BAM.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows, ord_ = [], 0
                for r in decode_bam(content)[1]:
                    rows.append((path, ord_, *r))
                    ord_ += 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, _BAM)


def bam_references(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, size, place) of a BAM file's header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame([(n, s, k) for k, (n, s) in enumerate(decode_bam(content)[0])], columns=["chrom", "size", "place"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "chrom string, size long, place long")


def plink(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, samples, genotypes) of prefix.bim, .fam and .bed.

    genotypes: (variant_idx, sample_idx, gt), gt the copies of the first allele, null where missing. A wrong magic number or size is an error.
    """
    from .text import lines

    def table(suffix: str, columns: str) -> DataFrame:
        f = F.split(F.trim("value"), r"\s+")
        names = [c.split(":") for c in columns.split()]
        body = lines(spark, f"{prefix}.{suffix}").filter("trim(value) <> ''")
        return body.select(F.col("line_no").alias("idx"), *(F.get(f, F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(names)))

    variants = table("bim", "chrom:string id:string cm:double pos:long a1:string a2:string").withColumnRenamed("idx", "variant_idx")
    samples = table("fam", "family:string sample:string father:string mother:string sex:int phenotype:string").withColumnRenamed("idx", "sample_idx")
    n, m = samples.count(), variants.count()
    each = (n + 3) // 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                if content[:3] != b"\x6c\x1b\x01" or len(content) != 3 + each * m:
                    raise ValueError("not a variant-major PLINK file of this size")
                for v in range(m):
                    gt = plink_genotypes(content[3 + v * each : 3 + (v + 1) * each], n)
                    yield pd.DataFrame({"variant_idx": np.full(n, v), "sample_idx": np.arange(n), "gt": pd.array(np.where(gt < 0, 0, gt), dtype="Int8").copy()}).assign(gt=lambda d: d["gt"].mask(gt < 0))

    genotypes = spark.read.format("binaryFile").load(f"{prefix}.bed").select("content").mapInPandas(run, "variant_idx long, sample_idx long, gt byte")
    return variants, samples, genotypes
