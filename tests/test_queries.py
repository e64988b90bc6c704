import inspect
import math
import statistics
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__
from oracle import compare, connect
from strandloom.functions import align, special
from strandloom.operators import kmers as km
from strandloom.plans import catalog
from strandloom.plans.views import spark_view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    compare(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


def rows_of(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_what_has_no_oracle():
    """All queries that SQL doesn't tell are held against brute force below."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"fastq_correct", "fastq_correct_report", "nw_align", "sw_align", "padj_hommel", "stouffer", "unitigs"}


def test_hommel(spark):
    rows = rows_of(spark, "padj_hommel")
    want = np.minimum(1, special.hommel(np.array([r["p"] for r in rows])))
    assert len(rows) == 1500 and np.allclose([r["adjusted"] for r in rows], want)


def test_stouffer(spark):
    normal = statistics.NormalDist()
    p = [r["p"] for r in rows_of(spark, "padj_none")]
    z = -sum(normal.inv_cdf(min(max(x, 1e-300), 1 - 1e-15)) for x in p) / math.sqrt(len(p))
    (found,) = rows_of(spark, "stouffer")
    assert found["n"] == len(p) and math.isclose(found["z"], z, rel_tol=1e-6, abs_tol=1e-6) and math.isclose(found["p_value"], 1 - normal.cdf(z), abs_tol=1e-6)


@pytest.mark.parametrize("name", ["nw_align", "sw_align"])
def test_scores_of_alignments(spark, name):
    """Scores by trying, for every cell, gaps of every length, on short pairs and a long one."""
    rows = sorted(rows_of(spark, name), key=lambda r: (len(r["a"]) * len(r["b"]), r["ord"]))
    assert len(rows) > 1000
    match, mismatch, first, more = (inspect.signature(align.align).parameters[k].default for k in ("match", "mismatch", "gap_open", "gap_extend"))
    local = name == "sw_align"
    for r in [*rows[:25], rows[len(rows) // 3], rows[-1]]:
        a, b = r["a"], r["b"]
        h = np.full((len(a) + 1, len(b) + 1), -(10**6))
        h[0, 0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i and j:
                    h[i, j] = h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch)
                if i:
                    h[i, j] = max(h[i, j], (h[:i, j] - first - more * np.arange(i, 0, -1)).max())
                if j:
                    h[i, j] = max(h[i, j], (h[i, :j] - first - more * np.arange(j, 0, -1)).max())
                if local:
                    h[i, j] = max(h[i, j], 0)
        assert r["score"] == (h.max() if local else h[-1, -1]), r


def test_unitigs(spark):
    """Maximal paths, followed node by node over the edges' own query."""
    edges = {(r["source"], r["target"]) for r in km.graph_edges(spark_view(spark, SF, "reads"), 16).collect()}
    out, into = defaultdict(set), defaultdict(set)
    for s, t in edges:
        out[s].add(t)
        into[t].add(s)
    before = {t: s for s, t in edges if s != t and len(out[s]) == 1 and len(into[t]) == 1}
    after = {s: t for t, s in before.items()}
    want = {}
    for node in {n for e in edges for n in e}:
        if node not in before:
            place, at = 0, node
            while at is not None:
                want[at] = (node, place)
                at, place = after.get(at), place + 1
    for node in sorted({n for e in edges for n in e}):  # circles, from their smallest node
        place, at = 0, node
        while at not in want:
            want[at] = (node, place)
            at, place = after[at], place + 1
    rows = rows_of(spark, "unitigs")
    assert len(rows) == len(want) and {r["node"]: (r["unitig"], r["place"]) for r in rows} == want


def test_correction(spark):
    """What is changed is in lower case, stands beside the same bases as before, and makes k-mers that enough reads have; the report adds it up."""
    given = {r["ord"]: r for r in spark_view(spark, SF, "reads").collect()}
    counts = {r["kmer"]: r["n"] for r in km.count(spark_view(spark, SF, "reads"), 11).collect()}
    rows = rows_of(spark, "fastq_correct")
    assert {r["ord"] for r in rows} == set(given)
    changed = 0
    for r in rows:
        was = given[r["ord"]]["seq"]
        places = [i for i, c in enumerate(r["seq"]) if c.islower()]
        assert len(r["seq"]) == len(was) and all(c == w for i, (c, w) in enumerate(zip(r["seq"], was)) if i not in places)
        assert r["n_corrected"] == len(places) and all(r["seq"][i].upper() != was[i] for i in places)
        seq = r["seq"].upper()
        windows = [seq[i : i + 11] for i in range(len(seq) - 10)]
        solid = [counts.get(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))), 0) >= 3 for w in windows]
        assert not r["correctable"] or any(solid)
        assert all(any(solid[max(0, i - 10) : i + 1]) for i in places)
        changed += bool(places)
    (report,) = rows_of(spark, "fastq_correct_report")
    assert report["reads"] == len(rows) and report["reads_corrected"] == changed and report["bases_corrected"] == sum(r["n_corrected"] for r in rows) and report["uncorrectable"] == sum(not r["correctable"] for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


ORDERED = {
    "bed_sort": ["chrom", "chrom_start", "chrom_end"], "fasta_sort_name": ["id", "ord"], "fastq_sort": ["id", "ord"], "fastq_interleave": ["place"], "vcf_sort": ["chrom", "pos", "ord"], "gff_sort": ["seqid", "start_pos", "ord"],
    "bam_sort_coord": ["rname", "pos", "ord"], "bam_sort_name": ["qname", "ord"],
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order(spark, name):
    rows = [tuple(r[c] for c in ORDERED[name]) for r in catalog.queries()[name](spark, SF).collect()]
    assert rows == sorted(rows)


def test_sort_by_length(spark):
    for name, sign in (("fasta_sort_len", 1), ("fasta_sort_len_desc", -1)):
        rows = [(sign * len(r["seq"]), r["ord"]) for r in catalog.queries()[name](spark, SF).collect()]
        assert rows == sorted(rows)
