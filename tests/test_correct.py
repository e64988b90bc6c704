import random

import numpy as np
import pytest

from strandloom.operators import correct as ec
from strandloom.operators import kmers as km
from strandloom.storage import materialize


@pytest.fixture(scope="module")
def genome():
    random.seed(7)
    return "".join(random.choice("ACGT") for _ in range(400))


def reads_of(genome, broken):
    """Ten copies of each stretch of 100, and reads with errors: {ord: (start, [places])}."""
    rows, n = [], 0
    for s in range(0, 301, 10):
        for _ in range(10):
            rows.append((n, f"r{n}", genome[s : s + 100], "I" * 100))
            n += 1
    truth = {}
    for start, places in broken:
        seq = list(genome[start : start + 100])
        for p in places:
            seq[p] = {"A": "C", "C": "G", "G": "T", "T": "A"}[seq[p]]
        truth[n] = (start, places)
        rows.append((n, f"r{n}", "".join(seq), "I" * 100))
        n += 1
    return rows, truth


def test_substitutions_are_undone(spark, genome):
    rows, truth = reads_of(genome, [(50, [40]), (120, [0]), (10, [99]), (200, [20, 70]), (250, [5, 50, 95]), (33, [30, 36])])
    rows += [(9001, "short", "ACGT", "IIII"), (9002, "ns", genome[:80] + "N" * 20, "I" * 100), (9003, "alien", "".join(random.choice("ACGT") for _ in range(100)), "I" * 100)]
    out = {r["ord"]: r for r in ec.correct(spark.createDataFrame(rows, "ord long, id string, seq string, qual string"), materialize, k=21).collect()}
    given = {r[0]: r for r in rows}
    for n, (start, places) in truth.items():
        want = list(genome[start : start + 100])
        for p in places:
            want[p] = want[p].lower()
        assert out[n]["seq"] == "".join(want) and out[n]["n_corrected"] == len(places)
        assert [out[n]["qual"][p] for p in places] == ["\"#$%"["ACGT".index(given[n][2][p])] for p in places]
        assert set(out[n]["qual"][p] for p in range(100) if p not in places) == {"?"}
    clean = [r for n, r in out.items() if n not in truth and n < 9000]
    assert all(r["n_corrected"] == 0 and r["seq"] == given[r["ord"]][2] and r["correctable"] for r in clean)
    assert all(not out[n]["correctable"] and out[n]["seq"] == given[n][2] and out[n]["qual"] == given[n][3] for n in (9001, 9002, 9003))
    row = ec.report(ec.correct(spark.createDataFrame(rows, "ord long, id string, seq string, qual string"), materialize, k=21)).first()
    assert (row["reads_corrected"], row["bases_corrected"], row["uncorrectable"]) == (6, 10, 3)


def test_switches(spark, genome):
    rows, truth = reads_of(genome, [(50, [40])])
    df = spark.createDataFrame([*rows, (9003, "alien", "".join(random.choice("ACGT") for _ in range(100)), "I" * 100)], "ord long, id string, seq string, qual string")
    (n,) = truth
    assert {r["n_corrected"] for r in ec.correct(df, materialize, k=21, no_correct=True).collect()} == {0}
    assert 9003 not in {r["ord"] for r in ec.correct(df, materialize, k=21, discard=True).collect()}
    assert n not in {r["ord"] for r in ec.correct(df, materialize, k=21, no_correct=True, drop_unique=True).collect()}
    with pytest.raises(ValueError):
        ec.correct(df, materialize, k=20)


def test_unitigs(spark):
    """Against walks over the same graph, one node at a time."""
    random.seed(9)
    genome = "".join(random.choice("ACGT") for _ in range(300))
    frame = spark.createDataFrame([(k, genome[s : s + 60]) for k, s in enumerate(range(0, 240, 7))] + [(999, "ACGGT" * 9)], "ord long, seq string")
    edges = {(r["source"], r["target"]) for r in km.graph_edges(frame, 12).collect()}
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    nodes = set(out) | set(into)
    follow = {a: b for a in nodes if len(out.get(a, ())) == 1 for b in out[a] if a != b and len(into[b]) == 1}
    heads = nodes - set(follow.values())
    paths, seen = {}, set()
    for h in sorted(heads) + sorted(nodes):
        if h in seen:
            continue
        at, path = h, []
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = follow.get(at)
        paths[h] = path
    found = {}
    for r in km.unitigs(km.graph_edges(frame, 12), materialize).collect():
        found.setdefault(r["unitig"], []).append((r["place"], r["node"]))
    assert {h: [n for _, n in sorted(p)] for h, p in found.items()} == paths


def test_rounds_take_only_the_reads_that_the_last_one_changed(spark):
    """One read of 41 takes several rounds; the other ones are written before and after them, not in each."""
    rng = np.random.default_rng(4)
    genome = "".join(rng.choice(list("ACGT"), 120))
    wrong = list(genome)
    for at in (60, 85):
        wrong[at] = "ACGT"["ACGT".index(wrong[at]) - 1]
    df = spark.createDataFrame([(i, f"r{i}", s, "I" * 120) for i, s in enumerate([genome] * 40 + ["".join(wrong)])], "ord long, id string, seq string, qual string")
    sizes = []

    def store(frame):
        out = materialize(frame)
        if out.columns == ["ord", "seq"]:
            sizes.append(out.count())
        return out

    rows = {r["ord"]: r for r in ec.correct(df, store, k=11, min_cov=3).collect()}
    assert rows[40]["seq"].upper() == genome and rows[40]["n_corrected"] == 2
    assert sum(n > 1 for n in sizes) <= 3 and sizes.count(1) == 2
