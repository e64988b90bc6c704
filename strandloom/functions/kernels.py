"""numpy kernels on single reads, for Arrow-batched operators. Sequences are byte arrays (uint8)."""

from __future__ import annotations

import numpy as np

# The Illumina TruSeq adapters of read 1 and read 2.
TRUSEQ_R1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
TRUSEQ_R2 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


def _table(pairs: tuple[str, str], other: int | None = None) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8) if other is None else np.full(256, other, np.uint8)
    for a, b in zip(*pairs):
        out[ord(a)] = ord(b)
    return out


_KEEP_CASE = _table(("ACGTacgt", "TGCAtgca"))
_MERGE = _table(("ACGTU", "TGCAA"), ord("N"))
_MERGE_BYTES = _MERGE.tobytes()
_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def array(text: str | bytes | None) -> np.ndarray:
    return np.frombuffer((text or "").encode() if not isinstance(text, bytes) else text, np.uint8)


def text(a: np.ndarray) -> str:
    return a.tobytes().decode()


def upper(a: np.ndarray) -> np.ndarray:
    return _UPPER[a]


def reverse_complement(a: np.ndarray, merging: bool = False) -> np.ndarray:
    """Case kept and other characters left as they are; merging: upper case only, all others N."""
    return (_MERGE if merging else _KEEP_CASE)[a[::-1]]


def adapter_start(seq: np.ndarray, adapter: np.ndarray, least: int = 5, rate: float = 0.2) -> int | None:
    """The first place from which the read agrees with the adapter's front, up to a share of mismatches; at least `least` bases must be compared."""
    n, m = len(seq), len(adapter)
    if not m or n < least or m < least:
        return None
    starts = n - least + 1
    padded = np.concatenate((upper(seq), np.zeros(m, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, m)[:starts]
    compared = np.minimum(n - np.arange(starts), m)
    differs = (rows != upper(adapter)) & (np.arange(m) < compared[:, None])
    ok = differs.sum(axis=1).astype(np.float32) / compared.astype(np.float32) <= np.float32(rate)
    return int(ok.argmax()) if ok.any() else None


def poly_tail(seq: np.ndarray, base: str = "G", least: int = 10, most_mismatches: int = 5, per: int = 8) -> int | None:
    """Where the read's tail of one base starts: the scan from its end goes on while mismatches stay within both limits."""
    n = len(seq)
    if not n:
        return None
    match = upper(seq)[::-1] == ord(base.upper())
    scanned = np.arange(1, n + 1)
    wrong = np.cumsum(~match)
    stop = (wrong > most_mismatches) | ((wrong > scanned // per) & (scanned >= least))
    reach = int(stop.argmax()) if stop.any() else n
    if reach < least:
        return None
    hits = np.flatnonzero(match[: reach + 1])
    return n - 1 - int(hits[-1]) if len(hits) else None


def dominant_tail(seq: np.ndarray, least: int = 10, most_mismatches: int = 5, per: int = 8) -> int | None:
    """Where the read's tail of its most frequent base starts; N counts for every base."""
    n = len(seq)
    if not n:
        return None
    back = upper(seq)[::-1]
    counts = np.cumsum((back[None, :] == np.frombuffer(b"ACGT", np.uint8)[:, None]) | (back == ord("N")), axis=1)
    scanned = np.arange(1, n + 1)
    bad = (scanned - counts > np.minimum(most_mismatches, scanned // per)).all(axis=0)
    stop = bad & ((scanned - 1 >= per) | (scanned + 1 >= least))
    reach = int(stop.argmax()) if stop.any() else n
    if reach + 1 < least:
        return None
    last = min(reach, n - 1)
    base = b"ACGT"[int(counts[:, last].argmax())]
    hits = np.flatnonzero(back[: last + 1] == base)
    return n - 1 - int(hits[-1]) if len(hits) else None


def trim_overlap(r1: np.ndarray, r2_rc: np.ndarray, require: int = 30, limit: int = 5, share: float = 0.2) -> tuple[int, int] | None:
    """(offset, length) of the first overlap within its budget of mismatches: offsets of mate 2 into mate 1 upwards from 0, then downwards from -1."""
    n, m = len(r1), len(r2_rc)
    if n < require or m < require:
        return None
    a, b = upper(r1), upper(r2_rc)
    share = np.float32(min(max(0.0 if share != share else share, 0.0), 1.0))
    for offset in [*range(n - require + 1), *range(-1, -(m - require) - 1, -1)]:
        x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
        size = min(len(x), len(y))
        if np.count_nonzero(x[:size] != y[:size]) <= min(limit, int(np.float32(size) * share)):
            return offset, size
    return None


def merge_overlap(r1: np.ndarray, r2: np.ndarray, require: int = 30, limit: int = 5, percent: float = 20, whole: int = 50) -> tuple[int, int, int] | None:
    """(offset, length, mismatches) of the first overlap for merging. Comparison is by case, and mismatches beyond the budget only reject
    among the first `whole` bases: a longer overlap that gets past them is taken whatever follows.
    """
    a, b = r1, reverse_complement(r2, merging=True)
    n, m = len(a), len(b)
    for offset in [*range(max(0, n - require)), *range(0, -max(0, m - require), -1)]:
        x, y = (a[offset:], b) if offset >= 0 else (a, b[-offset:])
        size = min(len(x), len(y))
        budget = min(limit, int(size * (percent / 100)))
        wrong = x[:size] != y[:size]
        total = int(np.count_nonzero(wrong))
        early = int(np.count_nonzero(wrong[:whole]))
        if total <= budget or (early <= budget and size > whole):
            return offset, size, total
    return None


def merge_pair(seq1: str, qual1: str, seq2: str, qual2: str, require: int = 30, limit: int = 5, percent: float = 20, correct: bool = False) -> tuple[str, str, int, int, int] | None:
    """Merged sequence and qualities, the bases from either mate, and corrected bases; None without an overlap.

    correct: where mates disagree, Q30 or better overrules Q14 or worse.
    """
    found = merge_overlap(array(seq1), array(seq2), require, limit, percent)
    return found and join_pair(seq1, qual1, seq2, qual2, found, correct)


def join_pair(seq1: str, qual1: str, seq2: str, qual2: str, found: tuple[int, int, int], correct: bool = False) -> tuple[str, str, int, int, int]:
    """merge_pair, given the overlap."""
    offset, size, wrong = found
    if not (correct and wrong) and seq1.isascii() and seq2.isascii() and qual1.isascii() and qual2.isascii():  # no base changes: texts are put together as they are
        len1, len2 = max(offset, 0) + size, len(seq2) - size if offset > 0 else 0
        behind = seq2[:len2][::-1].encode().translate(_MERGE_BYTES).decode()
        return seq1[:len1] + behind, qual1[:len1] + qual2[::-1][size : size + len2], len1, len2, 0
    s1, s2 = array(seq1), array(seq2)
    q1, rc, rq = array(qual1), reverse_complement(s2, merging=True), array(qual2)[::-1]
    at1, at2 = max(offset, 0), max(-offset, 0)
    changed = 0
    if correct and wrong:
        s1, q1, rc, rq = s1.copy(), q1.copy(), rc.copy(), rq.copy()
        one, two = slice(at1, at1 + size), slice(at2, at2 + size)
        differ = s1[one] != rc[two]
        first = differ & (q1[one] >= 63) & (rq[two] <= 47)
        second = differ & (rq[two] >= 63) & (q1[one] <= 47) & ~first
        x, y, p, q = s1[one], rc[two], q1[one], rq[two]
        y[first], q[first] = x[first], p[first]
        x[second], p[second] = y[second], q[second]
        changed = int(first.sum() + second.sum())
    len1 = at1 + size
    len2 = len(rc) - size if offset > 0 else 0
    return text(np.concatenate((s1[:len1], rc[size : size + len2]))), text(np.concatenate((q1[:len1], rq[size : size + len2]))), len1, len2, changed


def kmer_codes(seq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a base, first base highest, of every window; and which windows are all ACGT."""
    n = len(seq) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    code = _CODE[seq]
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out << np.uint64(2) | (code[j : j + n] & 3).astype(np.uint64)
    bad = np.concatenate(([0], np.cumsum(code == 255)))
    return out, bad[k:] == bad[:-k]


class References:
    """K-mers of reference sequences with their neighbours, and the short ones (mink to k - 1) that may stand at a read's ends."""

    def __init__(self, sequences: list[str], k: int = 27, mink: int = 0, hdist: int = 0, hdist2: int = 0, rcomp: bool = True, maskmiddle: bool = True):
        if not 1 <= k <= 31 or not 0 <= hdist <= 3 or not 0 <= hdist2 <= 3 or mink > k:
            raise ValueError("k is 1 to 31, distances are 0 to 3, and mink is at most k")
        self.k, self.mink = k, mink
        # the middle base is a wildcard, but not where short k-mers are looked for, too
        self.mask = ~np.uint64(3 << 2 * (k - 1 - k // 2)) if maskmiddle and mink == 0 else ~np.uint64(0)
        both = [t for s in sequences for a in [array(s)] for t in ([a, reverse_complement(a)] if rcomp else [a])]
        self.full = np.unique(np.concatenate([self._near(t, k, hdist) for t in both] or [np.zeros(0, np.uint64)]) & self.mask)
        self.tips = {n: np.unique(np.concatenate([self._near(t, n, hdist2) for t in both] or [np.zeros(0, np.uint64)])) for n in (range(mink, k) if mink else ())}

    @staticmethod
    def _near(seq: np.ndarray, k: int, distance: int) -> np.ndarray:
        """Codes of the windows of upper-case ACGT and of all k-mers up to `distance` substitutions away."""
        codes, ok = kmer_codes(seq, k)
        plain = np.concatenate(([0], np.cumsum(seq != upper(seq))))
        ok = ok & (plain[k:] == plain[:-k]) if len(ok) else ok
        found = np.unique(codes[ok])
        for _ in range(distance):
            shifts = np.arange(k, dtype=np.uint64) * np.uint64(2)
            moved = [found ^ (np.uint64(x) << s) for s in shifts for x in (1, 2, 3)]
            found = np.unique(np.concatenate([found, *moved]))
        return found

    def __len__(self) -> int:
        return len(self.full)

    def hits(self, seq: np.ndarray) -> np.ndarray:
        """For every window, whether it is a reference k-mer."""
        codes, ok = kmer_codes(seq, self.k)
        return ok & np.isin(codes & self.mask, self.full)

    def right_cut(self, seq: np.ndarray) -> int | None:
        """Where the first reference k-mer starts, or else the longest short one at the read's end."""
        full = np.flatnonzero(self.hits(seq))
        if len(full):
            return int(full[0])
        for n in range(min(self.k - 1, len(seq)), self.mink - 1, -1) if self.mink else ():
            code, ok = kmer_codes(seq[len(seq) - n :], n)
            if ok.all() and np.isin(code, self.tips[n]).all():
                return len(seq) - n
        return None

    def left_cut(self, seq: np.ndarray) -> int | None:
        """Behind the first reference k-mer, or else behind the longest short one at the read's start."""
        full = np.flatnonzero(self.hits(seq))
        if len(full):
            return int(full[0]) + self.k
        for n in range(min(self.k - 1, len(seq)), self.mink - 1, -1) if self.mink else ():
            code, ok = kmer_codes(seq[:n], n)
            if ok.all() and np.isin(code, self.tips[n]).all():
                return n
        return None


def kept_window(seq: str, qual: str, refs: References | None, ktrim: str = "f", qtrim: str = "f", trimq: int = 6, minlength: int = 10, min_hits: int = 1, min_share: float = 0.0, offset: int = 33) -> tuple[int, int] | None:
    """(start, end) of what k-mer filter or trim, then quality trim, then the least length leave of a read; None: it goes."""
    s, q = array(seq), array(qual)
    start, end = 0, len(s)
    if refs is not None and len(refs):
        if ktrim == "f":
            n = int(refs.hits(s).sum())
            if n and (n >= min_hits or min_share > 0 and n / max(len(s) - refs.k + 1, 1) >= min_share):
                return None
        elif ktrim == "r" and (cut := refs.right_cut(s)) is not None:
            end = cut
        elif ktrim == "l" and (cut := refs.left_cut(s)) is not None:
            start = min(cut, end)
    if qtrim != "f" and end > start:
        good = np.flatnonzero(np.maximum(q[start:end].astype(int) - offset, 0) >= trimq)
        if "r" in qtrim:
            end = start + int(good[-1]) + 1 if len(good) else start
        if "l" in qtrim:
            start = start + int(good[0]) if len(good) else end
    return (start, end) if end - start >= minlength else None
