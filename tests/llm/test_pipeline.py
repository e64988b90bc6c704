import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import test_mixing  # noqa: E402
import test_quality  # noqa: E402
import test_shingles  # noqa: E402
import test_spans  # noqa: E402

from strandloom.llm import mixing, packing, simhash  # noqa: E402
from strandloom.llm.common import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def near(rows):
    """doc_ids that stay of components of a Jaccard similarity of 0.8, all pairs compared."""
    sets = [test_shingles.grams(r["text"]) for r in rows]
    forest = simhash.Forest(len(rows))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    if pairs:
        forest.link(*map(np.array, zip(*pairs)))
    least = {}
    for r, root in zip(rows, forest.roots().tolist()):
        least[root] = min(r["doc_id"], least.get(root, r["doc_id"]))
    return set(least.values())


def mixed(rows):
    """(doc_id, words) of all rows that the mix gives: whole texts and parts, from the streams of test_mixing."""
    return Counter({rows[k]["doc_id"]: n for k, n in test_mixing.brute(rows)[1].items() if n})


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # beside the table's own: copies, a near copy, a repeated passage
    base = [r for r in rows_of(docs) if 60 < len(r["text"].split()) < 200][:8]
    words = base[1]["text"].split(" ")
    words[len(words) // 2] = "otherword"
    more = [dict(base[0], doc_id=50_001), dict(base[1], doc_id=50_002, text=" ".join(words)), dict(base[2], doc_id=50_003, text=base[3]["text"] + "\n" + base[2]["text"])]
    docs = docs.union(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in more], docs.schema))
    before, columns = rows_of(docs), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        after = rows_of(docs)
        if name != "packing":
            assert docs.columns == columns and after and all(r["n_chars"] == len(r["text"]) for r in after if name in ("mixture", "repeated_spans"))
        ids = sorted(r["doc_id"] for r in after)
        if name == "quality":
            assert ids == sorted(r["doc_id"] for r, (_, _, kept) in zip(before, test_quality.brute(before)) if kept)
            assert {r["doc_id"]: r for r in after} == {r["doc_id"]: r for r in before if r["doc_id"] in set(ids)}
        elif name == "near_duplicates":
            assert set(ids) == near(before) and len(ids) < len(before) and 50_001 not in ids and 50_002 not in ids
        elif name == "repeated_spans":
            want = test_spans.plain_brute({r["doc_id"]: r["text"] for r in before})
            assert {r["doc_id"]: r["text"] for r in after} == {k: t for k, (t, _) in want.items()} and any(n for _, n in want.values())
        elif name == "mixture":
            found = Counter()
            for r in after:
                found[r["doc_id"]] += len(test_mixing.words_of(r["text"]))
            assert found == mixed(before)
            whole = {r["doc_id"]: r["text"] for r in before}
            assert all(piece in whole[r["doc_id"]] for r in after for piece in r["text"].split("\n") if piece)
        else:
            encoder = packing.Encoder(packing.vocabulary_path())
            want = Counter()
            for r, ids_ in zip(before, encoder.tokenizer.encode_batch([r["text"] for r in before], add_special_tokens=False)):
                got = np.array([*ids_.ids, 2], "<u4")
                for s in range(0, len(got), 4096):
                    want[r["doc_id"], s, len(got[s : s + 4096]), zlib.crc32(got[s : s + 4096].tobytes()), len(got)] += 1
            assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in after) == want
            at = {}
            for r in after:
                at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert all(sum(n for _, n in p) <= 4096 and o == sum(n for _, n in sorted(p)[:k]) for p in at.values() for k, (o, _) in enumerate(sorted(p)))
        before = after


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, docs.select(*rows[0].__fields__).collect()))


@pytest.mark.parametrize("table", ["odd_documents", "no_documents"])
def test_odd_rows_through_all_stages(spark, request, table):
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        last, docs = docs.count(), materialize(stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns
        assert docs.count() <= last * (1 if name in ("quality", "near_duplicates", "repeated_spans") else mixing.MOST + 1)
    assert table != "no_documents" or docs.isEmpty()


def test_each_stage_takes_odd_rows(spark, odd_documents):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents, SF).count() >= (0 if name == "quality" else 1)
