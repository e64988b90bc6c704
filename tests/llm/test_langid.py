import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import langid as li


def plain_ngrams(text):
    """N-grams by strings: letters in lower case, runs of anything else a blank."""
    folded = [c if c.isalpha() else " " for c in text.lower()]
    s = " " + "".join(folded) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    found = Counter(c for c in s if c != " ")
    found.update(s[k : k + 2] for k in range(len(s) - 1))
    found.update(s[k : k + 3] for k in range(len(s) - 2) if s[k + 1] != " ")
    return found


def test_counts(monkeypatch):
    for text in ["", " ", "a", "Ab c", "the cat, the é ñ!", "a1b2  c", "x" * 50, "ab" * 40 + " cd"]:
        want = sorted(plain_ngrams(text).values(), reverse=True) if any(c.isalpha() for c in text) else []
        got = li.ngrams(text)[1].tolist()
        assert got == want or not want, text
    whole = li.ngrams("some words of a text that is cut in parts " * 9)
    monkeypatch.setattr(li, "_AT_ONCE", 16)
    parts = li.ngrams("some words of a text that is cut in parts " * 9)
    assert [w.tolist() for w in whole] == [p.tolist() for p in parts]


def key(gram):
    """What orders n-grams that are as frequent: their length, then their letters, the blank first."""
    return len(gram), [0 if c == " " else ord(c) for c in gram]


def brute(rows, size):
    """lang_pred and score of each row (doc_id, text, lang): out-of-place distances, one n-gram at a time."""
    counts = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5:
            counts.setdefault(lang, Counter()).update(plain_ngrams(text) if any(c.isalpha() for c in text.lower()) else {})
    profiles = {lang: sorted(c, key=lambda g: (-c[g], key(g)))[:size] for lang, c in sorted(counts.items()) if c}
    for _, text, _ in rows:
        found = plain_ngrams(text) if text and any(c.isalpha() for c in text.lower()) else {}
        own = sorted(found, key=lambda g: (-found[g], key(g)))[:size]
        if not own or not profiles:
            yield "und", 0.0
            continue
        sums = {lang: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sums, key=lambda lang: (sums[lang], lang))
        yield best, 1 - sums[best] / (len(own) * size)


SCRIPTS = {
    "zh": "我们今天在城市里看到许多人，他们都在学习新的语言。老师说每个字都很重要。",
    "ja": "私たちは今日、町でたくさんの人を見ました。みんな新しい言葉を学んでいます。",
    "ko": "우리는 오늘 도시에서 많은 사람들을 보았습니다. 모두 새로운 언어를 배우고 있습니다.",
    "ru": "Сегодня мы видели в городе много людей, и все они учат новый язык вместе с учителем.",
    "got": "\U00010330\U00010332\U00010333 \U00010334\U00010335 \U0001f600 \U00010336\U00010337\U00010330",
}


@pytest.mark.parametrize("size", [5, 400])
def test_against_brute_force(spark, documents, size):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect() if len(r["text"]) < 2500]
    rows += [(5000 + 10 * k + j, text * (1 + j) + " x" * j, lang) for k, (lang, text) in enumerate(SCRIPTS.items()) for j in range(6)]
    rows += [(6000, None, "en"), (6001, "", "en"), (6002, "123 !", "en"), (None, "the cat", None), (6003, "ab cd", None), (6003, "ab cd", None)]
    found = Counter()
    for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size).collect():
        found[r["doc_id"], r["lang_pred"], round(r["score"], 9)] += 1
    want = Counter((r[0], lang, round(score, 9)) for r, (lang, score) in zip(rows, brute(rows, size)))
    assert found == want


def test_letters_of_all_scripts_stay_apart():
    for text in SCRIPTS.values():
        assert len(li.ngrams(text)[0]) == len(plain_ngrams(text))
    assert len(set(li.ngrams("".join(map(chr, range(0x4E00, 0x9FA0))))[0].tolist())) == 3 * (0x9FA0 - 0x4E00) + 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = li.identify(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97


def test_learns_from_the_others_alone(spark):
    docs = spark.createDataFrame([(k, "abc abd" if zlib.crc32(str(k).encode()) % 5 else "xyz", "l" if zlib.crc32(str(k).encode()) % 5 else "held") for k in range(60)], "doc_id long, text string, lang string")
    assert set(li.profiles(docs)) == {"l"}


def test_odd_rows(odd_documents, no_documents):
    rows = li.identify(odd_documents).collect()
    assert len(rows) == 11
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 6, 8))
    assert li.identify(no_documents).collect() == []
    nothing = li.identify(odd_documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
