"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash. Pass two runs a
seeded Fisher-Yates shuffle over each bucket and writes it. Bucket after bucket, the written order is the
shuffled order of the whole table; dealing it out in turn gives shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

#: Bytes of text and rows that a bucket holds on average; a task holds one bucket at a time.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 100_000
SEED = 20240229


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1 by Fisher-Yates: from the last place down, swap with a place drawn from those up to it."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).random(n)
    for k in range(n - 1, 0, -1):
        j = int(draws[k] * (k + 1))
        order[k], order[j] = order[j], order[k]
    return np.array(order, np.int64)


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """How many buckets hold the table at the sizes above."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()
    return max(1, math.ceil(size / BUCKET_BYTES), math.ceil(rows / BUCKET_ROWS))


def shuffled(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """The rows of docs with three more columns, written bucket by bucket to shared storage:
    struct `record` (all columns of docs), `bucket` int and `place` long (gapless in its bucket).

    A record's bucket follows from key, text and its position in the input, so that neither a hot key nor
    repeated rows fill one bucket. The position makes the input's own order count: give it a table or another
    plan that yields its rows in the same order when a task runs again. Before Fisher-Yates a bucket is put
    in the order of its hashes, so that the shuffle doesn't depend on the order in which blocks arrive.
    """
    buckets = buckets or bucket_count(docs, text)
    hashed = docs.select(
        F.struct("*").alias("record"), F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.monotonically_increasing_id()).alias("hash")
    ).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "hash"), F.lit(buckets)).cast("int"))
    schema = T.StructType([hashed.schema["bucket"], T.StructField("place", T.LongType(), False), hashed.schema["record"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(t.column("hash").to_numpy(), kind="stable")
            drawn = fisher_yates(len(order), seed + now)
            for k in range(0, len(order), 4096):
                part = t.take(pa.array(order[drawn[k : k + 4096]])).combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column("bucket").chunk(0), pa.array(np.arange(k, k + part.num_rows)), part.column("record").chunk(0)], ["bucket", "place", "record"])

        for b in batches:
            ids = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if now is not None and ids[s] != now:
                    yield from out()
                    held = []
                now = int(ids[s])
                held.append(b.slice(s, e - s))
        if held:
            yield from out()

    scattered = hashed.select("bucket", "hash", "record").repartition("bucket").sortWithinPartitions("bucket", "hash")
    return materialize(scattered.transform(small_batches).mapInArrow(run, schema), "shuffled")


def numbered(written: DataFrame) -> DataFrame:
    """The written buckets with `position`, a record's place in the whole order, from the buckets' counts alone (one small row a bucket)."""
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    # offsets in two levels, so that no task sums over all buckets but only over groups of them
    group = F.shiftright("bucket", 10)
    groups = counts.groupBy(group.alias("group")).agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("group")) - F.col("n")).select("group", "base")
    own = Window.partitionBy("group").orderBy("bucket")
    offsets = counts.withColumn("group", group).withColumn("before", F.sum("n").over(own) - F.col("n")).join(groups, "group").select("bucket", (F.col("base") + F.col("before")).alias("offset"))
    return written.join(materialize(offsets, "offsets"), "bucket").withColumn("position", F.col("offset") + F.col("place")).drop("offset")


def shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """struct `record`, `shard` int and `slot` long (gapless from 0 in its shard) for every row of docs.

    Shards' row counts are at most one apart. Null keys and texts, empty and very long texts, repeated rows
    and clashing column names are records like any other; an empty table gives an empty result.
    """
    return dealt(shuffled(docs, key, text, seed), n_shards)


def dealt(written: DataFrame, n_shards: int = 8) -> DataFrame:
    """Written buckets, or a projection of them that keeps bucket and place, with shard and slot instead of these two."""
    at = numbered(written)
    rest = [F.col(c) for c in written.columns if c not in ("bucket", "place")]
    return at.select(*rest, F.pmod("position", F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"position div {n_shards}").alias("slot"))
