import random
import re
from collections import defaultdict

import numpy as np
import pytest

from strandloom.llm import spans as sp


def test_sentences():
    text = "One two three four. Five six.\nSeven eight nine ten! Eleven"
    assert sp.sentences(text) == [(0, 4, "one two three four."), (20, 2, "five six."), (30, 4, "seven eight nine ten!"), (52, 1, "eleven")]
    assert sp.sentences("") == sp.sentences(" \n\t") == []
    long = " ".join(f"w{k}" for k in range(200))
    found = sp.sentences(long)
    assert " ".join(f for _, _, f in found) == long and max(n for _, n, _ in found) <= sp.MOST
    # cuts follow the words: the same after another start
    moved = {f for _, _, f in sp.sentences("other words here now " + long)}
    assert sum(f in moved for _, _, f in found) >= len(found) - 3


def test_runs_are_the_shortest():
    counts = [4, 2, 9, 1, 1, 1, 16, 3, 5, 5, 5, 5]
    n = len(counts)
    enough = lambda s, e: e - s >= sp.SENTENCES and sum(counts[s:e]) >= sp.WORDS
    want = set()
    for s in range(n):
        ends = [e for e in range(s + 1, n + 1) if enough(s, e)]
        want |= {(s, ends[0] - 1)} if ends else set()
    for e in range(1, n + 1):
        starts = [s for s in range(e) if enough(s, e)]
        want |= {(starts[-1], e - 1)} if starts else set()
    assert list(zip(*map(list, sp.runs(np.array(counts), np.array([n]))))) == sorted(want)
    # of several texts, each by itself
    both = sp.runs(np.array(counts * 2), np.array([n, 2 * n]))
    assert list(zip(*map(list, both))) == sorted(want | {(s + n, e + n) for s, e in want})


def test_a_passage_of_fifty_words_is_covered_whole():
    passage = " ".join(f"p{k}" + ("." if k % 7 == 6 else "") for k in range(56))
    a, b = f"{passage} Some tail of one.", f"A head of the other one. {passage}\nAnd a tail."
    first = set(sp.spans(a)[0])
    left, gone = sp.remove(b, [(s, e) for h, s, e in zip(*sp.spans(b)) if h in first])
    assert left == "A head of the other one. And a tail." and gone == 8


def test_a_passage_of_51_words_shares_a_span_in_any_running_context():
    rng = random.Random(7)
    for trial in range(1500):
        stops = 0.12 if trial % 2 else 0
        word = lambda: f"w{rng.randrange(3000)}" + ("." if rng.random() < stops else "")  # noqa: E731, B023
        passage = " ".join(word() for _ in range(51))
        a, b = (" ".join([*(word() for _ in range(rng.randrange(40))), passage, *(word() for _ in range(rng.randrange(40)))]) for _ in "ab")
        assert set(sp.spans(a)[0]) & set(sp.spans(b)[0]), (a, b)


def word_hash(word):
    """A polynomial in numbers for the word's bytes, and its length, mixed."""
    raw = word.encode()
    x = (sum(int(sp._BYTES[c]) * pow(sp._FACTORS[0], k, 1 << 64) for k, c in enumerate(raw)) + len(raw)) % (1 << 64)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def test_hashes_are_those_of_the_words():
    words = ["a", "the", "über", "日本", "x" * 300]
    first, h = sp._words(np.frombuffer(" the  a\nüber\t日本 x".encode() + b"x" * 299 + b" ", np.uint8))
    assert h.tolist() == [word_hash(w) for w in ["the", "a", "über", "日本", "x" * 300]] and len(first) == len(words)


def test_texts_do_not_depend_on_those_beside_them(documents, monkeypatch):
    texts = [None, "", *(r["text"] for r in documents.collect()), " \n"]
    alone = [sp.spans(t) for t in texts]
    for at_once in (1 << 8, 1 << 14, 1 << 30):
        monkeypatch.setattr(sp, "_AT_ONCE", at_once)
        h, rows, first, last = sp.spans_of(texts)
        for k, want in enumerate(alone):
            assert all((x[rows == k] == y).all() and (rows == k).sum() == len(y) for x, y in zip((h, first, last), want))


def plain_pieces(text):
    """(start, end, words) of pieces, word by word: sentences, long ones cut behind the word whose hash is the least of any eight in a row."""
    words = [(m.start(), m.group().lower()) for m in re.finditer(r"\S+", text)]
    sentence, of = 0, []
    for k, (at, w) in enumerate(words):
        of.append(sentence)
        upto = words[k + 1][0] if k + 1 < len(words) else len(text)
        gap = text[at + len(w) : upto]
        if "\n" in gap or w[-1] in ".!?" and gap.startswith(" "):
            sentence += 1
    ends = {k for k in range(len(words)) if k + 1 == len(words) or of[k + 1] != of[k]}
    for k in range(len(words) - 7):
        if of[k] == of[k + 7]:
            hashes = [word_hash(words[j][1]) for j in range(k, k + 8)]
            ends.add(max(j for j in range(k, k + 8) if hashes[j - k] == min(hashes)))
    out, start = [], 0
    for e in sorted(ends):
        out.append((words[start][0], words[e + 1][0] if e + 1 < len(words) else len(text), tuple(w for _, w in words[start : e + 1])))
        start = e + 1
    return out


def plain_brute(texts):
    """Texts without the sentences of every run of three or more, with 16 words or more, that stands earlier: from each sentence, the shortest and the eight next longer ones."""
    found = {k: plain_pieces(t) for k, t in texts.items() if t is not None}
    first, cut = {}, defaultdict(set)
    for k in sorted(found):
        p = found[k]
        for s in range(len(p)):
            enough = [e for e in range(s + 3, len(p) + 1) if sum(len(x[2]) for x in p[s:e]) >= 16]
            for e in enough[:9]:
                if first.setdefault(tuple(x[2] for x in p[s:e]), (k, s)) != (k, s):
                    cut[k] |= set(range(s, e))
    out = {}
    for k, t in texts.items():
        gone = cut[k]
        left = t if t is None or not gone else "".join(t[a:b] for j, (a, b, _) in enumerate(found[k]) if j not in gone)
        if gone:
            left = t[: found[k][0][0]] + left
            left = left.rstrip() if len(found[k]) - 1 in gone else left
        out[k] = (left, len(gone))
    return out


def test_against_every_run_of_sentences(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["text"].isascii() or len(r["text"].lower()) == len(r["text"])}
    some = [t for t in texts.values() if len(t) > 800][:20]
    texts |= {900 + k: f"{a[:300]} {b[100:700]} {c[50:200]}" for k, (a, b, c) in enumerate(zip(some, some[3:], some[7:]))}
    texts |= {990: None, 991: "", 992: some[0] + "\n" + some[0]}
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in sp.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == plain_brute(texts) and sum(n > 0 for _, n in found.values()) > 10


def brute(texts):
    first, cut = {}, defaultdict(list)
    for k in sorted(texts):
        for h, s, e in zip(*sp.spans(texts[k] or "")):
            if first.setdefault(h, (k, s)) != (k, s):
                cut[k].append((s, e))
    return {k: sp.remove(t, cut[k]) if t is not None else (None, 0) for k, t in texts.items()}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in sp.deduplicate(docs).collect()}
    assert found == want and sum(n for _, n in found.values()) > 0


HAN = "".join(chr(0x4E00 + k) for k in range(2000))


def test_texts_without_blanks(spark):
    rng = random.Random(3)
    sentence = lambda: "".join(rng.choice(HAN) for _ in range(rng.randrange(6, 30))) + rng.choice("。！？")
    passage = "".join(sentence() for _ in range(8))
    heads, tails = (["".join(sentence() for _ in range(4)) for _ in range(3)] for _ in range(2))
    rows = [(k, h + passage + t) for k, (h, t) in enumerate(zip(heads, tails))]
    rows += [(10, "ราชการไทยเปิดให้บริการประชาชนทุกวันทำการที่ศาลากลางจังหวัดและที่ว่าการอำเภอทุกแห่งทั่วประเทศ"), (11, "คำนำ ราชการไทยเปิดให้บริการประชาชนทุกวันทำการที่ศาลากลางจังหวัดและที่ว่าการอำเภอทุกแห่งทั่วประเทศ")]
    found = {r["doc_id"]: r["text"] for r in sp.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == rows[0][1] and found[10] == rows[3][1]
    assert [found[k] for k in (1, 2)] == [heads[k] + tails[k] for k in (1, 2)]
    assert len(found[11]) < 30
    assert [w for _, _, w in sp.sentences("abc。def 好的。ok")] == ["abc。", "def 好 的 。", "ok"]


@pytest.mark.parametrize("copies", [400])
def test_a_passage_in_many_documents(spark, copies):
    passage = " ".join(f"p{k}" + ("." if k % 6 == 5 else "") for k in range(60))
    rows = [(k, f"This is the own text of number {k}, and it is {k * k}.\n{passage}\nThe end of {k} comes after {k + 1}.") for k in range(copies)]
    found = {r["doc_id"]: r["text"] for r in sp.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == rows[0][1]
    assert all(found[k] == rows[k][1].replace(passage + "\n", "") for k in range(1, copies))


def test_odd_rows(odd_documents, no_documents):
    rows = sp.deduplicate(odd_documents).collect()
    assert len(rows) == 11
    texts = {r["doc_id"]: r for r in rows}
    assert texts[4]["text"] is None and texts[3]["text"] == "" and texts[6]["text"] == " \t\n\x0b\x0c\r "
    # row 1 stands twice: one keeps its first sentence, which all others repeat, the other loses all, like row 2
    assert sorted(r["text"] for r in rows if r["doc_id"] == 1) == ["", "the cat and the dog are in the house."] and texts[2]["text"] == ""
    out = sp.without_repeats(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == 11
    assert sp.deduplicate(no_documents).collect() == [] and sp.without_repeats(no_documents).collect() == []
