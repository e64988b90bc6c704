"""Writers of the text formats, and the envelope of reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import GFF_COLUMNS, line


def _write(df: DataFrame, text: Column, path: str, order, single: bool, gz: bool) -> None:
    """Lines in order. single: one part file (a task writes it all); else as many as there are ranges of the order."""
    rows = df.orderBy(*order) if order else df
    rows = rows.select(text.alias("value"))
    writer = (rows.coalesce(1) if single else rows).write
    (writer.option("compression", "gzip") if gz else writer).text(path)


def write_bed(df: DataFrame, path: str, columns: int = 3, order=("chrom", "chrom_start", "chrom_end"), single: bool = False, gz: bool = False) -> None:
    """BED3, or BED6 with a dot, 0 and a dot where name, score and strand are missing."""
    out = [F.col(c).cast("string") for c in ("chrom", "chrom_start", "chrom_end")]
    if columns == 6:
        out += [F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in df.columns else F.lit(d) for c, d in (("name", "."), ("score", "0"), ("strand", "."))]
    _write(df, F.concat_ws("\t", *out), path, order, single, gz)


def fasta_text(wrap: int = 0) -> Column:
    seq = F.col("seq") if wrap <= 0 else F.regexp_replace("seq", f"(.{{{wrap}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), "id", F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str, wrap: int = 0, order=("ord",), single: bool = False, gz: bool = False) -> None:
    _write(df, fasta_text(wrap), path, order, single, gz)


def fastq_text() -> Column:
    return F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")


def write_fastq(df: DataFrame, path: str, order=("ord",), single: bool = False, gz: bool = False) -> None:
    _write(df, fastq_text(), path, order, single, gz)


def write_split(df: DataFrame, folder: str, pattern: str = "{:04d}.fq", first: int = 1, fastq: bool = True) -> list[str]:
    """One file per value of `part`, named by its number counted from `first`: 0001.fq, or with another pattern piece_0000.fa."""
    spark = df.sparkSession
    rows = df.repartition("part").sortWithinPartitions("part", "ord").select("part", (fastq_text() if fastq else fasta_text()).alias("value"))
    rows.write.partitionBy("part").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs, out = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for status in fs.listStatus(root):
        where = status.getPath()
        if not where.getName().startswith("part="):
            continue
        to = pattern.format(int(where.getName()[5:]) + first)
        (file,) = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]
        fs.rename(file, path(root, to))
        fs.delete(where, True)
        out.append(to)
    return sorted(out)


def write_with_header(df: DataFrame, header: list[str], text: Column, path: str, order=("ord",)) -> None:
    """Header lines, then the rows' lines: one file."""
    spark = df.sparkSession
    body = df.select(F.struct(F.lit(1), *order).alias("k"), F.struct(*order).alias("o"), text.alias("value")).select(F.lit(1).alias("after"), "o", "value")
    empty = df.select(F.struct(*order).alias("o")).schema["o"].dataType
    top = spark.createDataFrame([(0, k, h) for k, h in enumerate(header)], "after int, line int, value string")
    rows = top.select("after", "line", F.lit(None).cast(empty).alias("o"), "value").unionByName(body.withColumn("line", F.lit(0)))
    rows.orderBy("after", "line", "o").coalesce(1).select("value").write.text(path)


def gff_text() -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in GFF_COLUMNS])


def vcf_text(df: DataFrame) -> Column:
    fixed = line(df, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"])
    return F.when(F.col("samples").isNotNull(), F.concat_ws("\t", fixed, "format", F.array_join("samples", "\t"))).otherwise(fixed)


def write_fasta_index(df: DataFrame, path: str) -> None:
    """The five columns of an index, in the order of the file."""
    _write(df, F.concat_ws("\t", *[F.col(c).cast("string") for c in ("name", "length", "offset", "line_bases", "line_width")]), path, ("ord",), True, False)


def sam_text(df: DataFrame) -> Column:
    from .text import SAM_COLUMNS

    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in SAM_COLUMNS])


def envelope(tool: str, version: str, result: DataFrame | None = None, error: Exception | None = None) -> str:
    """A report's rows, or an error with its exit code, as JSON. Reports are a few rows."""
    head = {"schema_version": "1.0", "tool": tool, "tool_version": version}
    if error is not None:
        return json.dumps(head | {"status": "error", "error": {"kind": type(error).__name__, "message": str(error), "exit_code": getattr(error, "exit_code", 1)}})
    rows = [json.loads(r[0]) for r in result.select(F.to_json(F.struct("*"))).collect()]
    return json.dumps(head | {"status": "ok", "result": rows[0] if len(rows) == 1 else rows})


def report_text(spark: SparkSession, modules: dict[str, DataFrame], summary: DataFrame) -> tuple[str, str]:
    """The texts of a quality report, data and summary; modules are small aggregates."""
    status = {r["module"]: r["status"] for r in summary.collect()}
    data = []
    for name, df in modules.items():
        rows = df.orderBy(*df.columns).collect()
        data += [f">>{name}\t{status.get(name, 'pass')}", "#" + "\t".join(df.columns), *("\t".join(str(v) for v in r) for r in rows), ">>END_MODULE"]
    return "\n".join(data) + "\n", "".join(f"{s.upper()}\t{m}\n" for m, s in status.items())


def tabular(report: DataFrame, decimals: int = 2) -> str:
    """A report (a few rows) as a table by tabs, numbers as they are."""
    show = lambda v: f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    return "".join("\t".join(r) + "\n" for r in [report.columns, *([show(v) for v in row] for row in report.collect())])


def pretty(report: DataFrame, decimals: int = 1) -> str:
    """A report (a few rows) in aligned columns, text to the left, numbers to the right with thousands apart."""
    rows = report.collect()
    number = [any(isinstance(r[c], (int, float)) for r in rows) for c in report.columns]
    show = lambda v: f"{v:,.{decimals}f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    cells = [report.columns, *([show(v) for v in r] for r in rows)]
    width = [max(len(r[k]) for r in cells) for k in range(len(report.columns))]
    return "".join("  ".join(t.rjust(w) if n else t.ljust(w) for t, w, n in zip(r, width, number)).rstrip() + "\n" for r in cells)
