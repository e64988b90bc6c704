import random
import time

import numpy as np
import pytest

import __spark_entry__ as entry
from strandloom.functions import align
from strandloom.plans.views import spark_view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["nw_align", "sw_align"])
def test_whole_reads_are_aligned(spark, name):
    reads = {r["ord"]: r["seq"] for r in spark_view(spark, SF, "reads").select("ord", "seq").collect()}
    rows = entry.queries()[name](spark, SF).collect()
    assert rows and all(r["a"] == reads[r["ord"]] for r in rows) and max(len(r["a"]) for r in rows) > 60


def test_a_batch_of_reads_is_aligned_in_little_time():
    """2,048 pairs of 150 bases: by rows and columns they took 7 seconds, by anti-diagonals half a one; ties and lengths mixed in a block change nothing."""
    rng = np.random.default_rng(5)
    draw = lambda n: "".join(rng.choice(list("ACGT"), n))
    pairs = [(draw(150), draw(150)) for _ in range(2048)]
    began = time.process_time()
    found = align.align(pairs)
    assert time.process_time() - began < 3
    few = [*pairs[:3], ("ACGT", "ACGT"), (draw(400), draw(7)), ("A", "T"), (draw(9), draw(300))]
    for local in (False, True):
        assert align.align(few, local) == [align.align([p], local)[0] for p in few]
    assert align.align(few)[:3] == found[:3]


@pytest.mark.parametrize("scores", [{}, {"match": 2, "mismatch": -3, "gap_open": 2, "gap_extend": 1}, {"match": 5, "gap_open": 0}, {"gap_open": 1, "gap_extend": 0}])
def test_shifted_pairs_are_aligned_as_by_whole_matrices(monkeypatch, scores):
    """Pairs that overlap exactly, by letters few or many, with repeats, and with changes that break the overlap."""
    rnd, pairs = random.Random(7), []
    for _ in range(1500):
        n, letters = rnd.randint(1, 60), rnd.choice(["A", "AC", "ACGT", "ACGTN"])
        text = "".join(rnd.choice(letters) for _ in range(n + 40))
        if rnd.random() < 0.3:
            text = (text[: rnd.randint(1, 9)] * 120)[: n + 40]
        s = rnd.randint(0, min(n, 20))
        a, b = text[:n], text[s : s + rnd.randint(1, n)]
        if rnd.random() < 0.2:
            b = "".join(c if rnd.random() > 0.05 else "T" for c in b)
        pairs.append((a, b) if rnd.random() < 0.7 else (b, a))
    found = align.align(pairs, True, **scores)
    monkeypatch.setattr(align, "_shifted", lambda *_: None)
    assert found == align.align(pairs, True, **scores)


def test_mates_that_overlap_exactly_take_no_matrix(monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ACGTN") for _ in range(200)) for _ in range(300)]
    monkeypatch.setattr(align, "_block", lambda *_: pytest.fail("a matrix"))
    found = align.align([(t[:150], t[k % 40 : k % 40 + 150]) for k, t in enumerate(texts)], True)
    assert found == [(150 - k % 40, "=" * (150 - k % 40), k % 40, 0) for k in range(300)]
