import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import simhash as sh
from strandloom.llm.components import connected_components


def plain_simhash(text, width=3):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "one Two", "a b c", "A\tB\nC d E f", "é É ß x y z", "the the the the the"])
def test_fingerprint(text):
    assert sh.simhash(None if text is None else text.encode()) == plain_simhash(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs_are_all_pairs(radius):
    rng = np.random.default_rng(radius)
    sizes = [1, 2, 63, 64, 65, 130, 700]
    starts = np.cumsum([0, *sizes[:-1]])
    fps = rng.integers(0, 2**63, 9, dtype=np.uint64)[rng.integers(0, 9, sum(sizes))]
    for _ in range(3):
        fps ^= (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)) * (rng.random(len(fps)) < 0.6).astype(np.uint64)
    found = [p for i, j in sh.bit_sliced_pairs(starts, fps, radius, at_once=97) for p in zip(i.tolist(), j.tolist())]
    want = {(s + i, s + j) for s, n in zip(starts, sizes) for i in range(n) for j in range(i + 1, n) if int(fps[s + i] ^ fps[s + j]).bit_count() <= radius}
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("radius", [5, 27, 31])
def test_wide_counters(radius):
    rng = np.random.default_rng(radius)
    sizes = [1, 3, 64, 130]
    starts = np.cumsum([0, *sizes[:-1]])
    fps = rng.integers(0, 2**63, (4, 2), dtype=np.uint64)[rng.integers(0, 4, sum(sizes))]
    fps ^= np.packbits(rng.random((len(fps), 128)) < 0.12, axis=1).view(np.uint64)
    found = [p for i, j in sh.bit_sliced_pairs(starts, fps, radius, at_once=97) for p in zip(i.tolist(), j.tolist())]
    want = {(s + i, s + j) for s, n in zip(starts, sizes) for i in range(n) for j in range(i + 1, n) if np.bitwise_count(fps[s + i] ^ fps[s + j]).sum() <= radius}
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_links_of_chunked_keys(spark, blocks):
    # all agree on 40 bits: every table's keys are hot
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 12, 900).astype(np.int64) << 20)
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    roots = dict(connected_components(sh.fingerprint_links(frame, chunk=64, blocks=blocks)).collect())
    forest = sh.Forest(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= 3)
    forest.link(i, j)
    want = forest.roots()
    assert {int(f): roots.get(int(f), int(f)) for f in fps} == {int(f): int(fps[r]) for f, r in zip(fps, want)}


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_pairs_within_three_bits_share_a_key(spark, blocks):
    rng = np.random.default_rng(blocks)
    a = rng.integers(-(2**63), 2**63 - 1, 300)
    b = a.copy()
    for _ in range(3):
        b ^= (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)).view(np.int64)
    frame = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    rows = frame.select(sh._table_keys(F.col("a"), blocks).alias("x"), sh._table_keys(F.col("b"), blocks).alias("y")).collect()
    assert all(set(r["x"]) & set(r["y"]) for r in rows)
    assert all(len(set(r["x"])) == len(r["x"]) for r in rows) and sh.blocks_for(10**6) == 5 and sh.blocks_for(10**10) == 6


def check(rows):
    fp = {}
    for r in rows:
        fp.setdefault(int(r["fingerprint"], 16), []).append(r)
    keys = list(fp)
    forest = sh.Forest(len(keys))
    a = np.array(keys, np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    forest.link(i, j)
    least = {}
    for k, root in zip(keys, forest.roots()):
        ids = [r["doc_id"] for r in fp[k] if r["doc_id"] is not None]
        least[root] = min([least.get(root), *ids], key=lambda v: (v is None, v)) if ids or root in least else None
    for k, root in zip(keys, forest.roots()):
        assert all(r["component_id"] == least[root] for r in fp[k])


def test_whole_table(documents):
    rows = sh.near_duplicates(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts) and all(int(r["fingerprint"], 16) == plain_simhash(texts[r["doc_id"]]) for r in rows)
    check(rows)


def test_odd_rows(odd_documents, no_documents):
    rows = sh.near_duplicates(odd_documents).collect()
    assert len(rows) == 11
    assert [r["component_id"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1, 1]
    # null, empty and blank texts have fingerprint zero, and so link
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {3}
    assert sh.near_duplicates(no_documents).collect() == []


def test_representatives(odd_documents):
    kept = sh.representatives(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7, 8] and ids.count(None) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (None, 3), (7000, 6000)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)} | {7000: 6000, 6000: 6000}
