"""numpy kernels against the same rules written base by base."""

import math
import random

import numpy as np
import pytest

from strandloom.functions import align, hmm, phylo, special
from strandloom.functions import kernels as kn

random.seed(3)


def bases(n, letters="ACGT"):
    return "".join(random.choice(letters) for _ in range(n))


def plain_adapter(seq, adapter, least, rate):
    for start in range(len(seq)):
        pairs = list(zip(seq[start:].upper(), adapter.upper()))
        if len(pairs) >= least and np.float32(sum(a != b for a, b in pairs)) / np.float32(len(pairs)) <= np.float32(rate):
            return start
    return None


def test_adapter():
    for _ in range(300):
        seq = bases(random.randint(0, 40), "ACGTacgtN")
        if random.random() < 0.6:
            cut = random.randint(0, 30)
            seq = seq[:cut] + kn.TRUSEQ_R1[: random.randint(0, 25)]
        assert kn.adapter_start(kn.array(seq), kn.array(kn.TRUSEQ_R1)) == plain_adapter(seq, kn.TRUSEQ_R1, 5, 0.2)


def plain_poly(seq, base, least, most, per):
    wrong, last, scanned = 0, None, 0
    for k, c in enumerate(reversed(seq.upper())):
        if c == base:
            last = len(seq) - 1 - k
        else:
            wrong += 1
        if wrong > most or (wrong > (k + 1) // per and k + 1 >= least):
            break
        scanned += 1
    return last if scanned >= least else None


def test_poly_tail():
    for _ in range(400):
        seq = bases(random.randint(0, 30)) + bases(random.randint(0, 40), "GGGGGGGGGGGGg" + random.choice(["A", "GT", ""]))
        assert kn.poly_tail(kn.array(seq)) == plain_poly(seq, "G", 10, 5, 8)


def test_dominant_tail():
    assert kn.dominant_tail(kn.array("CCGTCCGT" + "A" * 20)) == 8
    assert kn.dominant_tail(kn.array("CCGTCGTC" + "AAAAAAAAAANAAAAA")) == 8
    assert kn.dominant_tail(kn.array("ACGTACGTACGTACGT")) is None
    assert kn.dominant_tail(kn.array("AAAA")) is None and kn.dominant_tail(kn.array("")) is None


def test_trim_overlap():
    insert = bases(60)
    r1, r2 = insert + kn.TRUSEQ_R1[:20], kn.text(kn.reverse_complement(kn.array(insert))) + kn.TRUSEQ_R2[:20]
    assert kn.trim_overlap(kn.array(r1), kn.reverse_complement(kn.array(r2))) == (-20, 60)
    assert kn.trim_overlap(kn.array(r1[:20]), kn.array(r2)) is None
    for _ in range(40):
        a, b = bases(random.randint(20, 60)), bases(random.randint(20, 60))
        found = kn.trim_overlap(kn.array(a), kn.array(b), 20, 12, 0.6)
        want = None
        if min(len(a), len(b)) >= 20:
            for offset in [*range(len(a) - 20 + 1), *range(-1, -(len(b) - 20) - 1, -1)]:
                pairs = list(zip(a[offset:], b)) if offset >= 0 else list(zip(a, b[-offset:]))
                if sum(x != y for x, y in pairs) <= min(12, int(np.float32(len(pairs)) * np.float32(0.6))):
                    want = offset, len(pairs)
                    break
        assert found == want


def test_merge():
    insert = bases(90)
    r1, r2 = insert[:70], kn.text(kn.reverse_complement(kn.array(insert[20:])))
    seq, qual, n1, n2, changed = kn.merge_pair(r1, "I" * 70, r2, "I" * 70)
    assert (seq, len(qual), n1, n2, changed) == (insert, 90, 70, 20, 0)
    bad = r1[:40] + ("A" if r1[40] != "A" else "C") + r1[41:]
    assert kn.merge_pair(bad, "I" * 40 + "#" + "I" * 29, r2, "I" * 70, correct=True)[0] == insert
    assert kn.merge_pair(bad, "I" * 70, r2, "I" * 70, correct=True)[0] != insert
    # the first fifty agree, so what follows doesn't matter
    assert kn.merge_pair(insert, "I" * 90, kn.text(kn.reverse_complement(kn.array(insert[:60] + bases(30)))), "I" * 90)[2] == 90
    assert kn.merge_pair(bases(70), "I" * 70, bases(70), "I" * 70) is None


def near(word, distance):
    found = {word}
    for _ in range(distance):
        found |= {w[:k] + c + w[k + 1 :] for w in found for k in range(len(w)) for c in "ACGT"}
    return found


@pytest.mark.parametrize("hdist, mask, rcomp", [(0, False, True), (0, True, False), (1, True, True), (1, False, False)])
def test_references(hdist, mask, rcomp):
    refs = [bases(25), bases(12)]
    found = kn.References(refs, k=9, hdist=hdist, maskmiddle=mask, rcomp=rcomp)
    hide = (lambda w: w[:4] + "." + w[5:]) if mask else (lambda w: w)
    both = refs + ([kn.text(kn.reverse_complement(kn.array(r))) for r in refs] if rcomp else [])
    words = {hide(v) for r in both for k in range(len(r) - 8) for v in near(r[k : k + 9], hdist)}
    for _ in range(50):
        read = bases(random.randint(5, 20), "ACGTN") + random.choice(refs)[3 : random.randint(3, 15)] + bases(6)
        assert found.hits(kn.array(read)).tolist() == [hide(read[k : k + 9]) in words and "N" not in read[k : k + 9] for k in range(max(0, len(read) - 8))]


def test_short_tips_and_windows():
    ref = "AGATCGGAAGAGCACACGTC"
    refs = kn.References([ref], k=12, mink=5)
    body = "T" * 30
    assert refs.right_cut(kn.array(body + ref)) == 30 and refs.right_cut(kn.array(body + ref[:7])) == 30 and refs.right_cut(kn.array(body + ref[:4])) is None
    assert refs.left_cut(kn.array(ref[-6:] + body)) == 6
    q = "I" * 37
    assert kn.kept_window(body + ref[:7], q, refs, ktrim="r") == (0, 30)
    assert kn.kept_window("ACGTACGTACGTAC", "#" * 2 + "I" * 10 + "#" * 2, None, qtrim="rl", trimq=10) == (2, 12)
    assert kn.kept_window("ACGT", "IIII", None) is None
    with pytest.raises(ValueError):
        kn.References([ref], k=40)


def plain_score(a, b, local):
    low = -(10**9)
    h = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = [r[:] for r in h], [r[:] for r in h]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                e[i][j] = max(h[i - 1][j] - 6, e[i - 1][j] - 1)
            if j:
                f[i][j] = max(h[i][j - 1] - 6, f[i][j - 1] - 1)
            diagonal = h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1) if i and j else 0 if i == j == 0 else low
            h[i][j] = max(diagonal, e[i][j], f[i][j], 0 if local else low)
    return max(map(max, h)) if local else h[-1][-1]


@pytest.mark.parametrize("local", [False, True])
def test_alignments(local):
    pairs = [(bases(random.randint(1, 25)), bases(random.randint(1, 25))) for _ in range(60)]
    pairs += [(a, a[:5] + a[random.randint(5, 9) :]) for a, _ in pairs if len(a) > 10]
    for (a, b), (score, ops, i, j) in zip(pairs, align.align(pairs, local)):
        assert score == plain_score(a, b, local)
        # the operations are an alignment with this score
        total, gap = 0, ""
        for o in ops:
            if o in "=X":
                assert (a[i] == b[j]) == (o == "=")
                total, i, j = total + (1 if o == "=" else -1), i + 1, j + 1
            else:
                total -= 1 + (5 if o != gap else 0)
                i, j = i + (o == "I"), j + (o == "D")
            gap = o
        assert total == score
        assert local or (i, j) == (len(a), len(b))


def test_hmm_against_all_paths():
    from itertools import product

    m = hmm.Hmm([0.6, 0.4, 0.0], [[0.5, 0.3, 0.2], [0.1, 0.6, 0.3], [0.3, 0.3, 0.4]], [[0.5, 0.5], [0.1, 0.9], [0.7, 0.3]])
    for seen in product(range(2), repeat=5):
        chance = {}
        for path in product(range(3), repeat=5):
            p = m.start[path[0]] * m.emit[path[0], seen[0]]
            for t in range(1, 5):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], seen[t]]
            chance[path] = p
        assert math.isclose(m.log_likelihood(seen), math.log(sum(chance.values())))
        assert math.isclose(chance[tuple(m.viterbi(seen))], max(chance.values()))
    with pytest.raises(ValueError):
        m.viterbi([])
    with pytest.raises(ValueError):
        m.log_likelihood([5])


def test_special_functions():
    assert math.isclose(special.incomplete_beta(2, 3, 0.4), 0.5248)
    # Student's t with one degree of freedom is Cauchy's
    assert all(math.isclose(special.student_sf(t, 1), 0.5 - math.atan(t) / math.pi, abs_tol=1e-12) for t in (-3, -0.5, 0, 1, 9))
    assert math.isclose(special.chi2_sf_even(11.98293, 2), 0.0175, abs_tol=1e-4)
    assert math.isclose(special.binomial_sf(3, 10, 0.5), 0.9453125)
    assert math.isclose(special.normal_cdf(1.959964), 0.975, abs_tol=1e-6)


def test_fisher_and_hwe():
    for a, b, c, d in [(3, 1, 1, 3), (0, 5, 4, 1), (10, 2, 3, 15), (1, 0, 0, 1)]:
        n, k, m = a + b + c + d, a + c, a + b
        p = {x: math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(max(0, m - n + k), min(m, k) + 1)}
        odds, two = special.fisher_exact(a, b, c, d)
        assert math.isclose(two, sum(v for v in p.values() if v <= p[a] + 1e-12))
        assert math.isclose(special.fisher_exact(a, b, c, d, "less")[1], sum(v for x, v in p.items() if x <= a))
        assert odds == (math.inf if b == 0 or c == 0 else a * d / b / c)
    for hets, h1, h2 in [(10, 5, 5), (0, 3, 4), (7, 0, 2), (5, 20, 1), (0, 9, 0)]:
        n, rare = hets + h1 + h2, 2 * min(h1, h2) + hets
        ways = {k: math.factorial(n) // (math.factorial(k) * math.factorial((rare - k) // 2) * math.factorial(n - k - (rare - k) // 2)) * 2**k for k in range(rare % 2, min(rare, 2 * n - rare) + 1, 2)}
        total = sum(ways.values())
        assert math.isclose(special.hwe_exact(hets, h1, h2), sum(w for w in ways.values() if w <= ways[hets]) / total, rel_tol=1e-9)


def test_hommel_by_closed_tests():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 8):
        p = rng.random(n) ** 2
        want = []
        for i in range(n):  # the largest Simes p of all sets with i in them
            worst = 0.0
            for mask in range(1 << n):
                if mask >> i & 1:
                    s = sorted(p[j] for j in range(n) if mask >> j & 1)
                    worst = max(worst, min(len(s) * v / (k + 1) for k, v in enumerate(s)))
            want.append(worst)
        assert np.allclose(special.hommel(p), want)


def test_newick():
    text = "((A:1,B:2)x:0.5,(C,D:0.03)'q r')root;"
    nodes = phylo.parse(text)
    assert phylo.write(nodes) == text and [n[2] for n in nodes if n[4]] == ["A", "B", "C", "D"]
    assert phylo.parse("(a,b)") == phylo.parse("(a,b);")
    for bad in ("(a,b", "a,b;", "(a))", "(a,b);c"):
        with pytest.raises(ValueError):
            phylo.parse(bad)
    deep = "(" * 3000 + "a" + ")" * 3000 + ";"
    assert phylo.write(phylo.parse(deep)) == deep


def test_texts_of_pairs_are_put_together_as_arrays_are():
    """Without a base to correct no array is made; a quality that isn't ASCII takes the arrays."""
    rnd = np.random.default_rng(3)
    for _ in range(300):
        n, m = rnd.integers(1, 40, 2)
        s1, s2 = ("".join(rnd.choice(list("ACGTUNacgt-"), x)) for x in (n, m))
        q1, q2 = ("".join(chr(c) for c in rnd.integers(33, 74, x)) for x in (n, m))
        offset = int(rnd.integers(-m + 1, n))
        size = int(min(n - max(offset, 0), m - max(-offset, 0)))
        len1, len2 = max(offset, 0) + size, m - size if offset > 0 else 0
        rc, rq = kn.text(kn.reverse_complement(kn.array(s2), merging=True)), q2[::-1]
        want = (s1[:len1] + rc[size : size + len2], q1[:len1] + rq[size : size + len2], len1, len2, 0)
        assert kn.join_pair(s1, q1, s2, q2, (offset, size, 3)) == want == kn.join_pair(s1, q1, s2, q2, (offset, size, 0), True)


def test_merging_without_corrections_makes_no_arrays(monkeypatch):
    monkeypatch.setattr(kn, "array", lambda *_: pytest.fail("an array"))
    assert kn.join_pair("ACGTA", "IIIII", "GGTAC", "55555", (2, 3, 0), True) == ("ACGTACC", "IIIII55", 5, 2, 0)
