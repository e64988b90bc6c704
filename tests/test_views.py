"""Views that are cut by other means than their SQL."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.operators.sequences import pairs
from strandloom.plans import catalog
from strandloom.plans.views import pair_view, read_view, spark_sql_view


@pytest.mark.parametrize("name", ["reads", "mates"])
def test_windows_are_those_of_the_sql(spark, tmp_path, name):
    odd = [None, "", "a", "Az é😀 0;&\n" * 41, "x" * 149, "y" * 150, "b" * 151, "Q" * 300, "w" * 330]
    rows = [(i, t) for i, t in enumerate(odd)] + [(39 + 40 * i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = spark_sql_view(spark, str(tmp_path), name)
    found = read_view(docs, name == "mates")
    assert found.dtypes == want.dtypes and sorted(map(tuple, found.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_work_follows_a_text_s_length(spark):
    """A text of six million characters has 40,000 windows; giving each a copy of the text would take 240 GB."""
    docs = spark.createDataFrame([(1, "word " * 1_200_000)], "doc_id long, text string")
    began = time.time()
    assert read_view(docs).filter("length(seq) = 150").count() == 40_000
    assert time.time() - began < 30


def test_reads_are_cut_by_many_tasks(spark):
    """However few tasks read the texts."""
    texts = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: F.md5((F.col("id") * 100 + i).cast("string")))).alias("text"))
    for view in (read_view(texts), read_view(texts, True), pair_view(texts)):
        assert view.select(F.spark_partition_id().alias("p")).distinct().count() > 2


@pytest.mark.parametrize("more", [[], [(3, "a doc_id once more " * 20)], [(5, "The windows of a long text run on " * 18100)]])
def test_pairs_are_reads_joined_with_mates(spark, more):
    rows = [(0, "ab"), (1, None), (2, ""), (3, "Zwölf Boxkämpfer 😀 " * 40), (4, "x" * 150), (6, "y" * 301), (39, "z" * 180), (79, "w" * 39)]
    docs = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    want = pairs(read_view(docs), read_view(docs, True))
    found = pair_view(docs)
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", "fastq_filter_pe fastq_umi_per_read fastq_umi_read2 fastq_umi_index2 fastq_umi_per_index fastq_trim_pe fastq_merge bbduk_pairs nw_align sw_align".split())
def test_pairs_are_not_joined(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapIn" in plan


def test_a_worker_gets_few_texts_at_once(spark):
    """A batch is bounded in bytes, not only by ten thousand rows, in what cuts texts and in what takes reads."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text"))
    try:
        assert read_view(texts).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 6 << 20
        assert int(spark.conf.get(key)) == 4 << 20
    finally:
        spark.conf.unset(key)
