import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import packing as pk


@pytest.fixture(scope="module")
def encoder():
    return pk.Encoder(pk.vocabulary_path())


def test_ids_are_the_tokenizers(encoder, monkeypatch):
    monkeypatch.setattr(pk, "_KEPT", 50)
    random.seed(1)
    texts = ["a's don't THE'LL x's, it's", "ÀÉ ß ẞ İstanbul ΣΑΣ ς", "é ́a ño", "12a34 5,6 1's '9 't !'s ''s s''", "\x1c\x1d a\x85b c　d", "", "   \n", "日本語 text。 한국어", "word'' 's 're", "x²½ ⅷ µ ª º × ÷", "<|endoftext|> a<|startoftext|>"]
    texts += ["".join(random.choice("aBé'stßÿ \n.,112-!") for _ in range(60)) for _ in range(800)]
    texts += ["".join(random.choice("aB'st \n.,é́ßΣ1² İſ<|endoftext|>") for _ in range(60)) for _ in range(300)]
    for k in range(0, len(texts), 100):
        some = texts[k : k + 100]
        want = [e.ids for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)] == want


def best_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
    return max(sums)


def test_fullest_is_the_closest_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 5)) for n in rng.choice(np.arange(1, 60), rng.integers(1, 7), replace=False)}
        room = int(rng.integers(0, 120))
        found = pk.fullest(sorted(counts, reverse=True), counts, room)
        assert all(0 < k <= counts[n] for n, k in found)
        assert sum(n * k for n, k in found) == best_sum(counts, room)


def test_fillings_use_each_piece_once():
    rng = np.random.default_rng(1)
    counts = {int(n): int(rng.integers(1, 50)) for n in rng.choice(np.arange(1, 400), 120, replace=False)}
    made = pk.fillings(dict(counts), 400)
    used = {}
    for times, filling in made:
        assert sum(n * k for n, k in filling) <= 400
        for n, k in filling:
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    # no more windows than by first fit, longest first
    windows = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((k for k, w in enumerate(windows) if w >= n), None)
        if at is None:
            windows.append(400 - n)
        else:
            windows[at] -= n
    assert sum(t for t, _ in made) <= len(windows)


def check(packed, texts, encoder):
    rows = packed.collect()
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, ids in texts.items():
        want = np.append(ids, pk.END).astype("<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= pk.CAPACITY
    assert sorted(by_window) == list(range(len(by_window)))
    return len(by_window), sum(r["length"] for r in rows)


def test_whole_table(documents, encoder):
    texts = {r["doc_id"]: encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in documents.collect()}
    windows, tokens = check(pk.pack(documents), texts, encoder)
    assert windows <= -(-tokens // pk.CAPACITY) + 2


def test_windows_hold_the_ids(documents, encoder):
    packed = pk.pack(documents.limit(50), with_ids=True).persist()
    seqs = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in pk.windows(packed).collect()}
    assert all(len(s) == pk.CAPACITY for s in seqs.values())
    for r in packed.collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].astype("<u4").tobytes() == r["ids"]


def test_odd_rows(odd_documents, no_documents):
    rows = pk.pack(odd_documents).collect()
    assert sum(r["start"] == 0 for r in rows) == 11
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (3, 4, 6)] == [1, 1, 1]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert pk.pack(no_documents).collect() == []


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(pk, "_RUN", 16)
    rows = pk.pack(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))).collect()
    n = rows[0]["length"]
    assert sorted((r["sequence_id"], r["offset"]) for r in rows) == [(k // (4096 // n), k % (4096 // n) * n) for k in range(500)]
