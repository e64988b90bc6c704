"""Counts of whole batches of reads, by rules read by read."""

from collections import Counter

from strandloom.operators import qc
from strandloom.plans import catalog

ROWS = [
    (0, "a:b:c:d:1101:x:y", "acgtN" * 30, "I!+5?" * 30), (1, "a:b:c:d:1102:x:y", "AGATCGGAAGAGAGATCGGAAGAG", "#" * 24), (2, "short", "", ""), (3, "a:b:7:c:d", None, None),
    (4, "a:b:c:d:1101:x:y", "ccagatcggaagagc", "é😀" + "I" * 13), (5, "a:b:c:d:1101:x:y", "GGGGGGGGGGGGG", "I" * 13), (6, "a:b:c:d:1101:x:y", "AGATCGGAAG", "5" * 10), (7, "a:b:c:d:1102:x:y", "AG", "+!"),
]


def test_what_is_counted(spark, monkeypatch):
    for at_once in (1 << 20, 40):
        monkeypatch.setattr(qc, "_AT_ONCE", at_once)
        batch = spark.createDataFrame(ROWS, "ord long, id string, seq string, qual string").coalesce(1)
        found = {tuple(r[:4]): r["n"] for r in qc._tally(batch).collect()}
        want = Counter()
        for _, id_, seq, qual in ROWS:
            tile = {7: 4, 5: 2}.get(len(id_.split(":")))
            tile = int(id_.split(":")[tile]) if tile else None
            want.update(("q", tile, i + 1, ord(c) - 33) for i, c in enumerate(qual or ""))
            want.update(("c", None, i + 1, ord(c.upper())) for i, c in enumerate(seq or ""))
            want[("l", None, None if seq is None else len(seq), None if seq is None else sum(c in "GCgc" for c in seq))] += 1
            if qual:
                want[("m", None, None, int(sum(ord(c) - 33 for c in qual) / len(qual) + 0.5))] += 1
            for k, (_, text) in enumerate(qc.ADAPTERS):
                if seq and text in seq.upper():
                    want[("p", None, seq.upper().index(text) + 1, k)] += 1
        assert found == want


def test_characters_never_are_rows(spark):
    """Only sequences that are tracked, and k-mers of every 50th read, are split."""
    plan = catalog.queries()["fastqc_base_quality"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
