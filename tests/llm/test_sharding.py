import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import sharding as sd
from strandloom.llm.queries import op2_sharding


def test_fisher_yates_is_a_fair_permutation():
    assert all(sorted(sd.fisher_yates(n, 5)) == list(range(n)) for n in range(20))
    seen = {}
    for seed in range(6000):
        seen[tuple(sd.fisher_yates(3, seed))] = seen.get(tuple(sd.fisher_yates(3, seed)), 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 850


@pytest.mark.parametrize("buckets", [1, 3, 17])
def test_shards(documents, buckets):
    rows = sd.dealt(sd.shuffled(documents, buckets=buckets), 8).collect()
    assert sorted(r["record"]["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.collect())
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_runs_agree_and_seeds_differ(documents):
    order = lambda seed: [(r["record"]["doc_id"]) for r in sorted(sd.shards(documents, 1, seed=seed).collect(), key=lambda r: r["slot"])]
    a = order(1)
    assert a == order(1) and a != order(2)
    # far from the order that came in
    assert abs(np.corrcoef(np.arange(len(a)), a)[0, 1]) < 0.3


def test_odd_rows(odd_documents, no_documents):
    rows = sd.shards(odd_documents, 3).collect()
    assert len(rows) == 11 and sorted((r["shard"], r["slot"]) for r in rows) == sorted((k % 3, k // 3) for k in range(11))
    assert rows[0]["record"].__fields__ == odd_documents.columns
    assert sd.shards(no_documents, 3).collect() == []


def test_query_against_the_texts(spark, tmp_path):
    """Every row's size and CRC-32 are its text's, and equal texts are sharded like any others."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(7001, None), (7002, ""), (7003, "é ß 日本語 \U0001f600"), (7003, "é ß 日本語 \U0001f600"), (None, "x" * 300_000), (7004, "\x00\n")]
    docs = docs.union(spark.createDataFrame([(k, t, None, None, None) for k, t in odd], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op2_sharding(spark, str(tmp_path)).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"rows"} and all(r["grown_shard"] is None for r in rows)
    slots = [sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(8)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_shuffle_against_brute_force(documents):
    """The written order is Fisher-Yates over each bucket's records in the order of their hashes."""
    keyed = documents.select("doc_id", F.xxhash64(F.lit(9), "doc_id", "text", F.monotonically_increasing_id()).alias("h"))
    rows = keyed.select("doc_id", "h", F.pmod(F.xxhash64(F.lit(9), "h"), F.lit(5)).alias("b")).collect()
    found = sorted((r["bucket"], r["place"], r["record"]["doc_id"]) for r in sd.shuffled(documents, seed=9, buckets=5).collect())
    want = []
    for b in range(5):
        own = [r["doc_id"] for r in sorted(rows, key=lambda r: r["h"]) if r["b"] == b]
        draws = np.random.Generator(np.random.PCG64(9 + b)).random(len(own))
        for k in range(len(own) - 1, 0, -1):
            j = int(draws[k] * (k + 1))
            own[k], own[j] = own[j], own[k]
        want += [(b, k, d) for k, d in enumerate(own)]
    assert found == want
