import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strandloom.llm import shingles, simhash  # noqa: E402


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_the_stage_drops_near_copies_at_a_similarity_of_08(spark):
    rng = random.Random(3)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        words = own(200)
        for edits in (0, rng.choice([2, 3, 4, 5, 8, 12])):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = own(1)[0]
            texts.append(" ".join(copy))
    # a chain: neighbours are near, its ends are not
    chain = own(200)
    texts += [" ".join(chain[k * 15 : k * 15 + 140]) for k in range(4)]
    texts += ["same small text", "Same  SMALL text", "other small text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forest = simhash.Forest(len(texts))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) >= 0.8]
    far = [simhash.simhash(texts[i].encode()) ^ simhash.simhash(texts[j].encode()) for i, j in pairs]
    assert any(f.bit_count() > simhash.RADIUS for f in far)
    forest.link(*map(np.array, zip(*pairs)))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(forest.roots().tolist()))


@pytest.mark.parametrize("chunk", [16, 1024])
def test_a_large_group_of_near_copies(spark, monkeypatch, chunk):
    """Cells with far more candidates than rows, in one piece or in chunks: all that hold link, whatever the forest has tried first."""
    whole = shingles.links
    monkeypatch.setattr(shingles, "links", lambda nodes, docs: whole(nodes, docs, chunk))
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for _ in range(500):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(0, 7)):
            words[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [grams(t) for t in texts]
    forest = simhash.Forest(len(texts))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    forest.link(*map(np.array, zip(*pairs)))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    want = set(forest.roots().tolist())
    assert want <= kept and len(kept - want) <= 2


def test_forest_is_least():
    rng = np.random.default_rng(2)
    n = 40
    i, j = np.triu_indices(n, 1)
    some = rng.random(len(i)) < 0.3
    i, j, weight = i[some], j[some], rng.integers(0, 9, some.sum()).astype(float)
    group = np.arange(n)
    group[5] = 3
    chosen = shingles._forest(i, j, weight, group)
    forest, want = simhash.Forest(n), 0.0
    forest.link(np.array([5]), np.array([3]))
    for k in np.argsort(weight, kind="stable"):
        p = forest.roots()
        if p[i[k]] != p[j[k]]:
            forest.link(i[k : k + 1], j[k : k + 1])
            want += weight[k]
    assert weight[chosen].sum() == want and chosen.sum() <= n - 1


def test_keys_meet_as_planned():
    """Fingerprints of sets at a similarity of 0.8 share a key as often as planned, and are within the radius."""
    rng = np.random.default_rng(4)
    a, b = [], []
    for _ in range(300):
        both, own = rng.integers(0, 2**63, 320, dtype=np.uint64), rng.integers(0, 2**63, 80, dtype=np.uint64)
        a.append(shingles.fingerprint(np.concatenate((both, own[:40]))))
        b.append(shingles.fingerprint(np.concatenate((both, own[40:]))))
    a, b = np.array(a), np.array(b)
    bits, tables = shingles.plan(200_000)
    assert np.mean((shingles.keys(a, bits, tables) == shingles.keys(b, bits, tables)).any(axis=1)) > 0.92
    assert np.mean(np.bitwise_count(a ^ b).sum(axis=1) <= shingles.RADIUS) > 0.94


def test_odd_rows(odd_documents, no_documents, spark):
    kept = corpus_pipeline.near_duplicates(spark, odd_documents, "")
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 7, 8] and ids.count(None) == 1
    assert corpus_pipeline.near_duplicates(spark, no_documents, "").collect() == []
