import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing as mx

GAP = " \t\n\x0b\x0c\r"


def draw(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def words_of(text):
    return [w for w in "".join(" " if c in GAP else c for c in text or "").split(" ") if w]


def brute(rows):
    """Taken words of each row, one word of the streams at a time."""
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(len(words_of(r["text"])) for r in rows if r["source"] == s) for s in names}
    weight = {s: mx.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(size.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= share
    taken = {}
    for sid, s in enumerate(names):
        own = sorted((k for k, r in enumerate(rows) if r["source"] == s), key=lambda k: (draw(mx.SEED, "order", rows[k]["doc_id"], hashlib.md5((rows[k]["text"] or "").encode()).hexdigest()), rows[k]["doc_id"]))
        stream = [k for k in own for _ in words_of(rows[k]["text"])]
        taken |= dict.fromkeys(own, 0)
        want, n = int(np.floor(target[s] + 0.5)), -(-len(stream) // mx.BLOCK)
        full, tail = divmod(len(stream), mx.BLOCK)
        slot = 0
        while want > 0:
            turn, at = divmod(slot, n)
            tail_at = draw(mx.SEED, "tail", sid, turn) % n if tail else n
            if at == tail_at:
                block = full
            else:
                block = at - (at > tail_at)
                for k in range(1, mx.ROUNDS + 1):
                    partner = (draw(mx.SEED, "turn", sid, turn, k) - block) % max(full, 1)
                    if draw(mx.SEED, "swap", sid, turn, k, max(block, partner)) % 2 == 0:
                        block = partner
            got = stream[block * mx.BLOCK : (block + 1) * mx.BLOCK][:want]
            for k in got:
                taken[k] += 1
            want -= len(got)
            slot += 1
    return target, taken


@pytest.mark.parametrize("block", [7, 64])
def test_against_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(mx, "BLOCK", block)
    rows = documents.select("doc_id", "text", "source").filter(F.col("doc_id") % 2 == 0).collect()
    rows = [r for r in rows if len(words_of(r["text"])) < 300] + [{"doc_id": 1001, "text": None, "source": "src1"}, {"doc_id": 1002, "text": "a b c d e", "source": None}, {"doc_id": 1003, "text": " \n", "source": ""}]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    target, taken = brute(rows)
    found = {r["doc_id"]: r for r in mx.mix(frame).collect()}
    for k, r in enumerate(rows):
        got = found[r["doc_id"]]
        assert got["size"] == len(words_of(r["text"])) and abs(got["target"] - target[r["source"]]) < 1e-6
        assert got["taken"] == taken[k] <= 3 * got["size"]


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    frame = spark.range(n).select(F.col("id"), mx.permuted(F.col("id"), F.lit(n), F.lit("x")).alias("to"))
    assert sorted(r["to"] for r in frame.collect()) == list(range(n))


def thrown(seed, sid, n):
    """Shard of each of a source's n slots: shards take drawn counts one after another."""
    counts = [0] * mx.SHARDS
    for slot in range(n):
        counts[draw(seed, "shard", sid, slot) % mx.SHARDS] += 1
    return [shard for shard, c in enumerate(counts) for _ in range(c)]


def test_shards_are_drawn(spark, documents):
    table = mx.sources(mx.measured(documents)).persist()
    counts = mx.shard_counts(table).persist()
    mixed = mx.slots(table, counts).persist()
    assert mixed.agg(F.sum("take")).first()[0] == table.agg(F.sum(F.floor(F.col("target") + 0.5))).first()[0]
    assert mixed.groupBy("sid", "pass", "block").count().filter("count > 1").isEmpty()
    drawn = {(r["sid"], r["shard"]): r["slots"] for r in counts.collect()}
    for sid in {s for s, _ in drawn}:
        n = sum(c for (s, _), c in drawn.items() if s == sid)
        want = thrown(mx.SEED, sid, n)
        assert [drawn.get((sid, k), 0) for k in range(mx.SHARDS)] == [want.count(k) for k in range(mx.SHARDS)]
        assert all(want[r["slot"]] == r["shard"] for r in mixed.filter(F.col("sid") == sid).collect())


def test_the_draw_decides_the_shards(documents, monkeypatch):
    """Another draw gives the shards other words of the same documents; a shard's words are those of the counts drawn for it."""
    def by_shard(rows):
        return {r["doc_id"]: [tuple(x) for x in r["by_shard"] or []] for r in rows}

    rows = mx.mix(documents).collect()
    assert all(sum(n for _, n in found) == r["taken"] for r, found in zip(rows, by_shard(rows).values()))
    whole = mx.draw
    monkeypatch.setattr(mx, "draw", lambda *parts: whole(*["other" if isinstance(p, str) and p == "shard" else p for p in parts]))
    other = mx.mix(documents).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in other}
    assert by_shard(rows) != by_shard(other)


def test_odd_rows(odd_documents, no_documents):
    rows = mx.mix(odd_documents).collect()
    assert len(rows) == 11 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == sum(r["size"] for r in rows)
    assert mx.mix(no_documents).collect() == []
    nothing = mx.mix(odd_documents.filter("doc_id in (3, 4, 6)")).collect()
    assert [r["taken"] for r in nothing] == [0, 0, 0]


def test_mixed_documents(odd_documents, documents, no_documents):
    for docs in (odd_documents, documents, no_documents):
        out = mx.mixed_documents(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        taken = {(r["doc_id"]): 0 for r in rows}
        for r in rows:
            taken[r["doc_id"]] += len(words_of(r["text"]))
            assert r["n_chars"] == len(r["text"])
        want = {}
        for r in mx.mix(docs).collect():
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
        assert taken == {k: n for k, n in want.items() if n}
        sharded = mx.mixed_documents(docs, "shard_of")
        assert sharded.columns == [*docs.columns, "shard_of"] and sharded.filter("shard_of is null or shard_of < 0 or shard_of >= 16").isEmpty()


@pytest.mark.parametrize("block", [2, 5])
def test_parts_are_cut_from_the_text(spark, monkeypatch, block):
    """Parts keep the text's own white space; what lies before a part's first word and behind its last goes."""
    monkeypatch.setattr(mx, "BLOCK", block)
    texts = {k: f"  line{k} one\nline two\t\tand {k}\n\nline\x0bthree\u2028 end{k} \u0085 \n" for k in range(40)}
    frame = spark.createDataFrame([(k, t, f"s{k % 3}") for k, t in texts.items()], "doc_id long, text string, source string")
    mixed = {r["doc_id"]: r for r in mx.mix(frame).collect()}
    found = {}
    for r in mx.mixed_documents(frame).collect():
        found.setdefault(r["doc_id"], []).append(r["text"])
    partly = 0
    for k, r in mixed.items():
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[k])]
        assert r["size"] == len(at)
        want = [texts[k]] * r["passes"]
        joined = []
        for p in r["parts"] or []:
            if joined and joined[-1][1] == p["from"]:
                joined[-1][1] = p["upto"]
            else:
                joined.append([p["from"], p["upto"]])
        if joined:
            partly += 1
            want.append(texts[k] if joined == [[0, len(at)]] else "\n".join(texts[k][at[a][0] : at[b - 1][1]] for a, b in joined))
        assert sorted(found.get(k, [])) == sorted(want)
    assert partly > 3


@pytest.mark.parametrize("text", ["abc \u2028", "abc\t\u0085", "abc \u2029", "abc\n", "\x0b", "", " a", "a  b ", None, "\u0085"])
def test_words_are_counted_by_the_contract(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(mx.word_count()).first()[0] == len(words_of(text)) == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_same_rows_same_mix(documents):
    a, b = (sorted((r["doc_id"], r["taken"]) for r in mx.mix(d).collect()) for d in (documents, documents.repartition(7)))
    assert a == b
