import numpy as np
import pytest

from strandloom.functions import special
from strandloom.operators import intervals as iv
from strandloom.operators import kmers as km
from strandloom.operators import science as op
from strandloom.operators import sequences as sq


def test_hommel_in_n_log_n_steps_is_hommel():
    rng = np.random.default_rng(0)
    for _ in range(300):
        p = np.round(rng.random(int(rng.integers(1, 40))) ** rng.choice([1, 3]), int(rng.choice([1, 2, 9])))
        values, ties = np.unique(p, return_counts=True)
        found = dict(zip(values, special.hommel_ties(values, ties)))
        assert np.allclose([found[x] for x in p], np.minimum(1, special.hommel(p)))
    assert len(special.hommel_ties(np.zeros(0), np.zeros(0, int))) == 0


def test_hommel_of_many(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(30_000), 6)
    found = op.adjust(spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)], "ord long, p double"), "hommel").collect()
    assert len(found) == len(p) and all(r["p"] <= r["adjusted"] <= 1 for r in found)
    rank = sorted(found, key=lambda r: r["p"])
    assert all(a["adjusted"] <= b["adjusted"] + 1e-12 for a, b in zip(rank, rank[1:]))
    # never above Hochberg's
    upper = {r["ord"]: r["adjusted"] for r in op.adjust(spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)], "ord long, p double"), "hochberg").collect()}
    assert all(r["adjusted"] <= upper[r["ord"]] + 1e-12 for r in found)


def brute_lineages(parents):
    out = set()
    for node in parents:
        at, distance = node, 0
        out.add((node, node, 0))
        while at in parents and parents[at] != at:
            at, distance = parents[at], distance + 1
            out.add((node, at, distance))
    return out


def test_lineages_of_any_depth(spark):
    rng = np.random.default_rng(2)
    chain = {1: 1, **{k: k - 1 for k in range(2, 202)}}
    tree = {1: 1, **{k: int(rng.integers(1, k)) for k in range(2, 400)}}
    orphans = {1: 1, 5: 9, 6: 5}
    for parents in (chain, tree, orphans, {1: 1}):
        nodes = spark.createDataFrame(list(parents.items()), "tax_id int, parent int")
        rows = op.lineages(nodes).collect()
        assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == brute_lineages(parents)
    members = spark.createDataFrame([("a", 201), ("a", 150), ("b", 7)], "grp string, tax_id int")
    chained = spark.createDataFrame(list(chain.items()), "tax_id int, parent int")
    assert {tuple(r) for r in op.lowest_common_ancestor(chained, members).collect()} == {("a", 150), ("b", 7)}


def test_a_circle_of_parents_is_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        op.lineages(spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, 2)], "tax_id int, parent int"))


def test_merged_ids_are_followed(spark):
    merged = spark.createDataFrame([(k, k + 1) for k in range(1, 9)] + [(50, 51)], "old_id int, new_id int")
    ids = spark.createDataFrame([(1,), (5,), (9,), (50,), (77,)], "tax_id int")
    assert dict(op.resolve(ids, merged).collect()) == {1: 9, 5: 9, 9: 9, 50: 51, 77: 77}
    assert dict(op.resolve(ids, merged, hops=3).collect())[1] == 4
    assert dict(op.resolve(ids, merged.limit(0)).collect()) == {k: k for k in (1, 5, 9, 50, 77)}


@pytest.mark.parametrize("piece", [4, 512])
def test_windows_of_long_sequences(spark, monkeypatch, piece):
    monkeypatch.setattr(km, "PIECE", piece)
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in (0, 1, 3, 4, 5, 8, 9, 511, 512, 513, 1024, 3000)]
    frame = spark.createDataFrame([(k, str(k), s, "".join(rng.choice(list("#5I"), len(s))) if s else "") for k, s in enumerate(seqs)], "ord long, id string, seq string, qual string")
    for k in (1, 3, 4, 7):
        want = {(o, i, s[i : i + k]) for o, s in enumerate(seqs) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]}
        rows = km.kmers(frame, k).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        codes = {(r["ord"], r["pos"]): r["code"] for r in km.rolling(frame, k).collect()}
        assert codes == {(o, i + k - 1): None if "N" in s[i : i + k] else int("".join(str("ACGT".index(c)) for c in s[i : i + k]), 4) for o, s in enumerate(seqs) for i in range(len(s) - k + 1)}
    for pattern in ("A", "GA", "ACAC", "ACGTACG", "NA"):
        rows = km.locate(frame, pattern).collect()
        want = {(o, i) for o, s in enumerate(seqs) for i in range(len(s) - len(pattern) + 1) if s.startswith(pattern, i)}
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert km.locate(frame, "").count() == sum(len(s) + 1 for s in seqs)


@pytest.mark.parametrize("chunk", [5, 64, 1 << 14])
def test_regions_of_chunked_sequences(spark, monkeypatch, chunk):
    monkeypatch.setattr(sq, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    seqs = {name: "".join(rng.choice(list("ACGT"), n)) for name, n in (("a", 100), ("b", 0), ("c", 7), ("d", 64))}
    fasta = spark.createDataFrame([(k, f"{n} text", s) for k, (n, s) in enumerate(seqs.items())], "ord long, id string, seq string")
    regions = [(n, int(s), int(e)) for n in [*seqs, "none"] for s, e in rng.integers(0, 110, (20, 2))] + [("a", 3, 9)] * 3 + [("c", 0, 7), ("d", 0, 64), ("a", 5, 5)]
    found = sorted((r["chrom"], r["chrom_start"], r["chrom_end"], r["seq"]) for r in iv.get_fasta(spark.createDataFrame(regions, "chrom string, chrom_start long, chrom_end long"), fasta).collect())
    assert found == sorted((n, s, e, seqs[n][s : max(s, e)]) for n, s, e in regions if n in seqs)
    fetched = sorted(tuple(r) for r in sq.fetch(fasta, spark.createDataFrame([(n, s + 1, e) for n, s, e in regions], "name string, first long, last long")).collect())
    assert fetched == sorted((n, s + 1, e, seqs[n][s : max(s, e)]) for n, s, e in regions if n in seqs)


@pytest.mark.parametrize("tile", [3, 50, 1 << 20])
def test_merging_over_tiles(spark, tile):
    rng = np.random.default_rng(5)
    rows = [(f"c{rng.integers(2)}", int(s), int(s + n)) for s, n in zip(rng.integers(0, 400, 120), rng.integers(1, 30, 120))]
    for distance in (0, 4):
        want = []
        for chrom in ("c0", "c1"):
            for s, e in sorted((s, e) for c, s, e in rows if c == chrom):
                if want and want[-1][0] == chrom and s <= want[-1][2] + distance:
                    want[-1][2:] = [max(want[-1][2], e), want[-1][3] + 1]
                else:
                    want.append([chrom, s, e, 1])
        found = iv.merge(spark.createDataFrame(rows, "chrom string, chrom_start long, chrom_end long"), distance, tile, counts=True).collect()
        assert sorted((r["chrom"], r["chrom_start"], r["chrom_end"], r["n"]) for r in found) == sorted(map(tuple, want))


def test_coded_kmers_are_the_spelt_ones(spark):
    """All k that are coded, dense or not, against k-mers as texts; a read with one k-mer of its own goes."""
    rng = np.random.default_rng(8)
    reads = ["".join(rng.choice(list("ACGTN"), int(n), p=[0.3, 0.3, 0.19, 0.19, 0.02])) for n in rng.integers(0, 60, 60)]
    reads = [*reads, *reads, None, "", "acgtacgtacgtacgt", "A" * 70, "ACGTéACGTACGTACGTACGTACGTACGTACGTACGTACG"]
    rows = [(i, s, None if s is None else "".join(rng.choice(list("!5I"), len(s), p=[0.05, 0.35, 0.6]))) for i, s in enumerate(reads)]
    df = spark.createDataFrame(rows, "ord long, seq string, qual string").repartition(3)
    turned = str.maketrans("ACGT", "TGCA")
    for k in (1, 4, 8, 11, 12, 31):
        windows = [(o, p, s[p : p + k].upper(), min(ord(c) for c in q[p : p + k]) >= 53) for o, s, q in rows if s for p in range(len(s) - k + 1)]
        plain = [(o, min(w, w[::-1].translate(turned)), g) for o, _, w, g in windows if set(w) <= set("ACGT")]
        counts, good, of = {}, {}, {}
        for o, w, g in plain:
            counts[w], good[w], of[w] = counts.get(w, 0) + 1, good.get(w, 0) + g, o
        assert {tuple(r) for r in km.count(df, k).select("kmer", "n").collect()} == set(counts.items())
        assert {tuple(r) for r in km.spectrum(df, k).select("kmer", "coverage", "good").collect()} == {(w, min(n, 255), min(good[w], 63)) for w, n in counts.items()}
        gone = {of[w] for w, n in counts.items() if n == 1}
        assert sorted(r["ord"] for r in km.without_unique(df, k).collect()) == [o for o, _, _ in rows if o not in gone]
        codes = {(o, p + k - 1, sum("ACGT".index(c) << 2 * (k - 1 - i) for i, c in enumerate(w)) if set(w) <= set("ACGT") else None) for o, p, w, _ in windows}
        assert {tuple(r) for r in km.rolling(df, k).collect()} == codes


def test_unique_kmers_are_not_joined_with_all_others(spark):
    """The plan has one exchange of k-mers by code, and none of a row for each k-mer of each read."""
    df = spark.createDataFrame([(1, "ACGTACGTAC")], "ord long, seq string")
    plan = km.without_unique(df, 8)._jdf.queryExecution().toString()
    assert "LeftSemi" not in plan
