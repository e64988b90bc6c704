import math

import numpy as np

from strandloom.llm import quality as q

GAP = " \t\n\x0b\x0c\r"


def plain(text):
    text = text or ""
    words = "".join(" " if c in GAP else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if x.strip(GAP)]
    return len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_counts():
    texts = [None, "", " \n ", "a b c", "a b c a b c", "a b a b a b a b", "x | y # z\nx | y # z\n\n \n", "é ü w\x1cx z", "a\x0bb\x0cc\rd", "日本 #", "a b c d a b c"]
    for t in texts:
        assert q.digest(t)[:5] == plain(t), t
    assert all(sum(q.digest(t)[5]) == len(t or "") for t in texts)


def test_repeated_words_at_random():
    rng = np.random.default_rng(0)
    for n in range(60):
        words = [f"w{k}" for k in rng.integers(0, 6, n)]
        assert q.repeated_words(words) == plain(" ".join(words))[4]


def test_jensen_shannon():
    p = np.array([[1.0, 0, 0], [2, 2, 0], [0, 0, 0]])
    d = q.jensen_shannon(p, np.array([0.5, 0.5, 0]))
    m = np.array([0.75, 0.25])
    want = np.sqrt((np.log2(1 / m[0]) + 0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1])) / 2)
    assert np.allclose(d, [want, 0, 0])
    assert q.jensen_shannon(np.array([[0.0, 1.0]]), np.array([1.0, 0.0]))[0] == 1


def kind(c):
    if c == "\n":
        return 3
    if c in GAP:
        return 2
    if c in "#*$%&|<>":
        return 5
    if c.isalpha():
        return 1 if c.isupper() else 0
    return 0 if c.isdigit() or c in "'\"()[]{}-–—’“”«»/@+_" else 4 if c in ".,;:?!" else 6


def distance(p, q):
    """Square root of the Jensen-Shannon divergence (base 2) of two distributions."""
    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b) if x > 0)

    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def brute(rows):
    """kept of every row, from texts and languages, one character and one word at a time."""
    vocabulary = sorted({w for words in q.COMMON_WORDS.values() for w in words})

    def histograms(text):
        words = [w for w in "".join(" " if c in GAP else c for c in text.lower()).split(" ") if w]
        common = [sum(w in (v, v + ",", v + ".") for w in words) for v in vocabulary]
        return [sum(kind(c) == k for c in text) for k in range(7)], [*common, plain(text)[0] - sum(common)]

    found = [(r["lang"], plain(r["text"]), *histograms(r["text"] or "")) for r in rows]

    def weights(lang):
        """Documents by class and binned share; counts of common words."""
        bins, words = [[0.0] * 512 for _ in range(7)], [0.0] * (len(vocabulary) + 1)
        for of, counts, classes, common in found:
            if counts[0] >= 50 and (lang is any or of == lang):
                for k, c in enumerate(classes):
                    bins[k][min(511, int(math.sqrt(c / sum(classes)) * 512))] += 1
                words = [x + y for x, y in zip(words, common)]
        return bins, words

    def reference(bins, words):
        median = []
        for b in bins:
            upto, at = 0.0, 0
            for at, n in enumerate(b):
                upto += n
                if upto >= sum(b) / 2 - 1e-9:
                    break
            median.append(1e-5 if at == 0 else ((at + 0.5) / 512) ** 2)
        return [m / sum(median) for m in median], [w / sum(words) for w in words]

    all_bins, all_words = weights(any)
    refs = {None: reference(all_bins, all_words)}
    for lang in {r["lang"] for r in rows if r["lang"] is not None}:
        bins, words = weights(lang)
        refs[lang] = reference([[x + 50 * y / sum(other) for x, y in zip(own, other)] for own, other in zip(bins, all_bins)], [x + 5000 * y / sum(all_words) for x, y in zip(words, all_words)])
    out = []
    for lang, (n, *_, repeated), classes, common in found:
        ref = refs[lang]
        by_class = distance([c / sum(classes) for c in classes], ref[0]) if sum(classes) else 0
        by_word = distance([c / n for c in common], ref[1]) if n else 0
        limit = distance([0] * len(vocabulary) + [1], ref[1]) * min(0.95, 0.5 + 60 / max(n, 1))
        failed = n < 50 or 100 * repeated > 50 * n
        out.append((by_class, by_word, not failed and not (n >= 50 and by_class > 0.14 or n >= 100 and by_word > limit)))
    return out


def test_against_brute_force(spark, documents):
    rows = [r.asDict() for r in documents.select("doc_id", "text", "lang").collect() if len(r["text"]) < 4000]
    # a language of one document, none, junk of plain words, and junk of marks
    rows += [{"doc_id": 9001, "text": rows[0]["text"], "lang": "xx"}, {"doc_id": 9002, "text": rows[0]["text"] * 2, "lang": None}]
    rows += [{"doc_id": 9003 + k, "text": " ".join(f"{a}{b}orlo" for a in "bcdfghjklmnpqrstvwxz" for b in "aeiouyrlmntsv"[: 9 + k]) + ".", "lang": lang} for k, lang in enumerate(("en", "de", "xx", None))]
    rows += [{"doc_id": 9010, "text": "|| ## == %% ~~ " * 40, "lang": "en"}, {"doc_id": 9011, "text": None, "lang": "en"}, {"doc_id": 9012, "text": "", "lang": None}]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in q.quality(frame).collect()}
    assert len(found) == len(rows)
    for r, (by_class, by_word, kept) in zip(rows, brute(rows)):
        got = found[r["doc_id"]]
        assert abs(got["class_distance"] - by_class) < 1e-7 and abs(got["word_distance"] - by_word) < 1e-7 and got["kept"] == kept, r["doc_id"]
    assert not any(found[k]["kept"] for k in (9003, 9004, 9005, 9006, 9010)) and not any(found[k]["base_failed"] for k in (9003, 9004))
    assert sum(r["kept"] for r in found.values()) > 100


def test_a_language_does_not_depend_on_how_many_there_are(spark, documents):
    """The same documents are judged alike beside a thousand other languages, each with a document or two."""
    rows = documents.select("doc_id", "text", "lang").collect()
    alone = {r["doc_id"]: r["class_distance"] for r in q.quality(documents).collect()}
    many = [(r["doc_id"], r["text"], r["lang"]) for r in rows] + [(10_000 + k, rows[k % 100]["text"][:400], f"l{k}") for k in range(1200)]
    found = q.quality(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert found.count() == len(many)
    assert max(abs(r["class_distance"] - alone[r["doc_id"]]) for r in found.collect() if r["doc_id"] < 10_000) < 0.03


def test_verdicts_follow_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = q.quality(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_odd_rows(odd_documents, no_documents):
    rows = q.quality(odd_documents).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["base_failed"] and not by[k]["kept"] for k in (1, 2, 3, 4, 6, 7, 8))
    assert by[4]["n_words"] == 0 and by[5]["n_words"] == 180_000
    assert q.quality(no_documents).collect() == []


def test_keep_good_is_quality(odd_documents, documents, no_documents):
    kept = q.keep_good(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in q.quality(documents).filter("kept").collect())
    assert q.keep_good(odd_documents).columns == odd_documents.columns
    assert q.keep_good(odd_documents).count() == q.quality(odd_documents).filter("kept").count()
    assert q.keep_good(no_documents).collect() == []
