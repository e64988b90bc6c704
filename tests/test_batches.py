"""Kernels on batches against those on one read."""

import tracemalloc

import numpy as np
import pytest

from strandloom.functions import batches as bt
from strandloom.functions import kernels as kn

RNG = np.random.default_rng(6)


def reads(n, most=90):
    out = ["", "A", "G" * 40, "N" * 30, kn.TRUSEQ_R1, "acgt" * 10 + kn.TRUSEQ_R1[:12], "ACGT" * 5 + "GGGGAGGGGGGGCGGGGGG", "T" * 9, "T" * 10, "ACGTACGTAA" + "A" * 25]
    for _ in range(n):
        seq = "".join(RNG.choice(list("ACGTNacg"), int(RNG.integers(0, most))))
        if RNG.random() < 0.5:
            seq += kn.TRUSEQ_R1[: int(RNG.integers(3, 33))]
        if RNG.random() < 0.4:
            seq += "".join(RNG.choice(list("GGGGGGGA"), int(RNG.integers(5, 30))))
        if RNG.random() < 0.3:
            seq += "".join(RNG.choice(list("TTTTTTTTTC"), int(RNG.integers(5, 30))))
        out.append(seq)
    return out


def none(x):
    return -1 if x is None else x


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2])
def test_cuts(rate):
    seqs = reads(400)
    rows, size = bt.matrix(seqs)
    zero = np.zeros(len(seqs), np.int64)
    back = bt.moved(rows, zero, size, reverse=True)
    arrays = [kn.array(s) for s in seqs]
    for least in (3, 5, 12):
        assert bt.adapter_starts(rows, size, kn.array(kn.TRUSEQ_R1), least, rate).tolist() == [none(kn.adapter_start(a, kn.array(kn.TRUSEQ_R1), least, rate)) for a in arrays]
    for least, most, per in ((10, 5, 8), (1, 0, 3), (20, 9, 2)):
        assert bt.poly_tails(back, size, "G", least, most, per).tolist() == [none(kn.poly_tail(a, "G", least, most, per)) for a in arrays]
        assert bt.dominant_tails(back, size, least, most, per).tolist() == [none(kn.dominant_tail(a, least, most, per)) for a in arrays]


def mates(n):
    for _ in range(n):
        insert = "".join(RNG.choice(list("ACGT"), int(RNG.integers(0, 130))))
        one = list(insert[:80] + kn.TRUSEQ_R1[: max(0, 80 - len(insert))])
        two = list(kn.text(kn.reverse_complement(kn.array(insert)))[: int(RNG.integers(0, 90))])
        for x in (one, two):
            for at in range(len(x)):
                if RNG.random() < 0.04:
                    x[at] = str(RNG.choice(list("ACGTNg")))
        yield "".join(one), "".join(two)


def test_overlaps():
    pairs = [*mates(300), ("", ""), ("A" * 60, ""), ("", "A" * 60), ("A" * 60, "T" * 60), ("ACGT" * 20, "ACGT" * 20)]
    (one, n), (two, m) = bt.matrix([p[0] for p in pairs]), bt.matrix([p[1] for p in pairs])
    for require, limit, share in ((30, 5, 0.2), (10, 2, 0.1), (50, 0, 0.0)):
        found, offset, size = bt.trim_overlaps(one, n, bt.complements(two, m), m, require, limit, share)
        want = [kn.trim_overlap(kn.array(a), kn.reverse_complement(kn.array(b)), require, limit, share) for a, b in pairs]
        assert [(int(o), int(s)) if f else None for f, o, s in zip(found, offset, size)] == want
        found, offset, size, wrong = bt.merge_overlaps(one, n, bt.complements(two, m, merging=True), m, require, limit, share * 100, 20)
        want = [kn.merge_overlap(kn.array(a), kn.array(b), require, limit, share * 100, 20) for a, b in pairs]
        assert [(int(o), int(s), int(w)) if f else None for f, o, s, w in zip(found, offset, size, wrong)] == want


def test_parts(monkeypatch):
    monkeypatch.setattr(bt, "AT_ONCE", 50)
    lengths = np.array([3, 0, 9, 200, 1, 1, 1, 60, 5])
    found = list(bt.parts(lengths))
    assert [k for s in found for k in range(s.start, s.stop)] == list(range(9))
    assert all(s.stop - s.start == 1 or lengths[s].max() * (s.stop - s.start) <= 50 for s in found) and list(bt.parts(np.zeros(0, int))) == []


@pytest.mark.parametrize("ktrim", ["f", "r", "l"])
@pytest.mark.parametrize("settings", [{}, {"hdist": 1}, {"maskmiddle": False, "rcomp": False}, {"mink": 6}])
def test_windows_left_by_references(ktrim, settings):
    refs = kn.References([kn.TRUSEQ_R1, "acgtACGTNACGTACGTACGTAC"], k=15, **settings)
    seqs = reads(500)
    quals = ["".join(RNG.choice(list("!I5"), len(s))) for s in seqs]
    for rest in ({}, {"min_hits": 3, "min_share": 0.3}, {"qtrim": "rl", "trimq": 11}):
        start, end, kept = bt.kept_windows(seqs, quals, refs, ktrim=ktrim, **rest)
        assert [(int(s), int(e)) if k else None for s, e, k in zip(start, end, kept)] == [kn.kept_window(s, q, refs, ktrim=ktrim, **rest) for s, q in zip(seqs, quals)]


def test_matrices_of_a_part_are_small():
    """Counters and windows of the reads of a part stay within some tens of MB, as each core has a worker of its own."""
    (first, *_) = list(bt.parts(np.full(50_000, 150)))
    seqs = ["ACGTTGCAGG" * 15] * (first.stop - first.start)
    tracemalloc.start()
    rows, size = bt.matrix(seqs)
    bt.dominant_tails(rows, size)
    bt.adapter_starts(rows, size, kn.array(kn.TRUSEQ_R1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 << 20
