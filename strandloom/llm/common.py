"""Small helpers that the operators have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release, remove, shared_dir  # noqa: F401

#: What separates words: the blank and the control characters from tab to carriage return; and a word with the gap before it.
_GAP = r"\x20\x09-\x0D"
WORD_GAP, GAP_AND_WORD = f"[{_GAP}]+", f"[{_GAP}]*[^{_GAP}]+"

#: Bytes of an Arrow batch, in the JVM and again in a worker.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to small Arrow batches; goes before a mapInArrow.

    Texts are long and uneven: without a bound in bytes ten thousand of them come at once, and a worker holds what
    it makes of them several times over. The setting is the session's, as Spark has no other.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def word_count(text: str = "text"):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column, null text: 0. JVM only."""
    parts = F.split(F.col(text), WORD_GAP, -1)
    # the split gives one part more than there are gaps; an empty one where a gap, or nothing, begins or ends the text
    ends = F.col(text).rlike(rf"\A[{_GAP}]").cast("int") + F.col(text).rlike(rf"[{_GAP}]\z").cast("int")
    return F.coalesce(F.when(F.col(text) == "", 0).otherwise(F.greatest(F.size(parts) - ends, F.lit(0))), F.lit(0)).cast("long")


def row_keys(docs: DataFrame) -> DataFrame:
    """(part, place, row): the rows of docs as structs, with what finds each of them again: its file and its place in it.

    Where docs isn't a selection from Parquet files alone, it is written to the shared folder first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    row = F.struct("*")
    if plan.nodeName() != "LogicalRelation" or not plan.relation().toString().lower().startswith("parquet"):
        docs, row = materialize(docs.select(F.struct("*").alias("row")), "rows"), F.col("row")
    return docs.select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("place"), row.alias("row"))
