"""Pairwise alignment with affine gaps: the matrices of a block of pairs are filled together, an anti-diagonal at a time.

No cell of an anti-diagonal waits for another one, so that each step takes all its cells in all pairs at once. Of a matrix only the last two
anti-diagonals are kept as numbers; what the way back asks of a cell is kept as flags, and all pairs of a block go back together, too.
"""

from __future__ import annotations

import numpy as np

#: Pairs of a block, and cells of its matrices.
PAIRS, CELLS = 256, 1 << 23


def _codes(texts: list[str], width: int, pad: int, kind: type) -> np.ndarray:
    """A column of characters a text, filled up with pad."""
    out = np.full((len(texts), width), pad, np.uint8)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.upper().encode(), np.uint8)
    return np.ascontiguousarray(out.T).astype(kind)


def align(pairs: list[tuple[str, str]], local: bool = False, match: int = 1, mismatch: int = -1, gap_open: int = 5, gap_extend: int = 1) -> list[tuple[int, str, int, int]]:
    """(score, operations, start in a, start in b) of each pair; a gap of length n costs gap_open + n * gap_extend.

    Operations are = (match), X (mismatch), I (base of a alone) and D (base of b alone). The way back takes the diagonal
    where it can, else I, else D. Local alignments end in the first best cell by rows and have no operations at score 0.
    An empty sequence is an error.
    """
    if any(not a or not b for a, b in pairs):
        raise ValueError("a sequence is empty")
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda x: (len(pairs[x][0]), len(pairs[x][1])))
    if local and match > 0 > mismatch and gap_open >= 0 <= gap_extend and gap_open + gap_extend > 0:
        _shifted(pairs, order, out, match, mismatch, gap_open + gap_extend)
        order = [x for x in order if out[x] is None]
    at = 0
    while at < len(order):  # pairs of like lengths make a block
        upto, widest = at, 0
        while upto < len(order) and upto - at < PAIRS:
            a, b = pairs[order[upto]]
            widest = max(widest, len(b))
            if upto > at and (len(a) + 1) * (widest + 1) * (upto - at + 1) > CELLS:
                break
            upto += 1
        block = order[at:upto]
        for x, found in zip(block, _block([pairs[x] for x in block], local, match, mismatch, gap_open, gap_extend)):
            out[x] = found
        at = upto
    return out


#: Bases by which a sequence's front is looked for in another one.
SEED = 16


def _shift(a: str, b: str) -> int | None:
    """Where b begins in a, if one of them ends where the bases still agree."""
    s = a.find(b[:SEED])
    while s >= 0 and not b.startswith(a[s : s + len(b)]):
        s = a.find(b[:SEED], s + 1)
    return s if s >= 0 else None


def _shifted(pairs: list[tuple[str, str]], order: list[int], out: list, match: int, mismatch: int, first: int) -> None:
    """Put the local alignments of pairs of which all bases of one diagonal agree, and no other alignment is as good, into their places of `out`.

    A way that meets that diagonal, of `size` cells, has no more matches before and behind than the diagonal has, and if it isn't on it, a gap: it is worse.
    A way that doesn't meet it and scores match * size or more has g gaps of at most match * (shorter - size) / first, and of its g + 1 straight stretches
    the best has its share of match * size + first * g at least. If no other diagonal has such a stretch, there is no such way.
    """
    found = []
    for x in order:
        a, b = pairs[x][0].upper(), pairs[x][1].upper()
        s = _shift(a, b)
        if s is None and (t := _shift(b, a)) is not None:
            s = -t
        if s is not None:
            size = min(len(a) - max(s, 0), len(b) - max(-s, 0))
            gaps = match * (min(len(a), len(b)) - size) // first
            found.append((x, s, size, min(match * size, -(-(match * size + first * gaps) // (gaps + 1)))))
    for at in range(0, len(found), PAIRS):
        block = found[at : at + PAIRS]
        most = _best_stretches([pairs[f[0]] for f in block], np.array([f[1] for f in block]), match, mismatch)
        for (x, s, size, least), other in zip(block, most.tolist()):
            if other < least:
                out[x] = (match * size, "=" * size, max(s, 0), max(-s, 0))


def _best_stretches(pairs: list[tuple[str, str]], without: np.ndarray, match: int, mismatch: int) -> np.ndarray:
    """The best score of a stretch without gaps of each pair, on all diagonals i - j but one."""
    n, m = (max(len(p[s]) for p in pairs) for s in (0, 1))
    kind = np.uint8 if match * min(n, m) + match - mismatch < 256 else np.int64
    a, b = _codes([p[0] for p in pairs], n, 0, np.uint8), _codes([p[1] for p in pairs], m, 1, np.uint8)
    now, best = (np.zeros((n + m - 1, len(pairs)), kind) for _ in range(2))
    same = np.empty(a.shape, bool)
    z = same.view(np.uint8) if kind is np.uint8 else np.empty(a.shape, kind)
    for j in range(m):  # the diagonal i - j has the row i - j + m - 1
        x, y = now[m - 1 - j : m - 1 - j + n], best[m - 1 - j : m - 1 - j + n]
        np.equal(a, b[j], out=same)
        np.multiply(same.view(np.uint8), kind(match - mismatch), out=z)
        np.add(x, z, out=x)
        np.maximum(x, kind(-mismatch), out=x)
        np.subtract(x, kind(-mismatch), out=x)
        np.maximum(y, x, out=y)
    best[without + m - 1, np.arange(len(pairs))] = 0
    return best.max(axis=0)


def _block(pairs: list[tuple[str, str]], local: bool, match: int, mismatch: int, gap_open: int, gap_extend: int) -> list[tuple[int, str, int, int]]:
    size_a, size_b = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    n, m, k = int(size_a.max()), int(size_b.max()), len(pairs)
    first = gap_open + gap_extend
    most = abs(gap_open) + (n + m + 1) * (abs(gap_extend) + abs(match) + abs(mismatch))
    kind, low = (np.int16, -(1 << 14)) if most < 1 << 13 else (np.int32, -(1 << 29))
    # b is turned round: the cells (i, d - i) of an anti-diagonal meet a and b in the same direction
    a, b = _codes([p[0] for p in pairs], n, 0, kind), _codes([p[1] for p in pairs], m, 1, kind)[::-1].copy()
    # a cell (i, j) has the row begins[i + j] + i of the flags
    d = np.arange(n + m + 1)
    above, below = np.maximum(0, d - m), np.minimum(n, d)
    begins = np.concatenate(([0], np.cumsum(below - above + 1)))[:-1] - above
    cells = (n + 1) * (m + 1)
    diagonal, vertical, opens_up, opens_left = (np.zeros((cells, k), bool) for _ in range(4))
    positive = np.zeros((cells, k), bool) if local else None
    edge = np.zeros(max(n, m) + 1, kind) if local else np.where(d == 0, 0, -(gap_open + gap_extend * d))[: max(n, m) + 1].astype(kind)
    if not local:
        vertical[begins[1 : n + 1] + d[1 : n + 1]] = True
        for to, size in ((opens_up, n), (opens_left, m)):
            ok = edge[1 : size + 1] == edge[:size] - first
            to[begins[1 : size + 1] + (d[1 : size + 1] if to is opens_up else 0)] = ok[:, None]
    last, h, far = (np.full((n + 1, k), low, kind) for _ in range(3))  # anti-diagonals d - 1, d and d - 2
    up, left = (np.full((n + 1, k), low, kind) for _ in range(2))
    t1, t2, t3 = (np.empty((n, k), kind) for _ in range(3))
    last[0] = 0
    score = np.zeros(k, np.int64)
    ends = size_a + size_b
    by_end = {int(e): np.flatnonzero(ends == e) for e in np.unique(ends)}
    best, best_at = (np.zeros((n + 1, k), kind) for _ in range(2)) if local else (None, None)
    uneven = bool((size_b != m).any())
    for e in range(1, n + m + 1):
        s, t = max(1, e - m), min(n, e - 1) + 1
        if s < t:
            x, y, z = t1[: t - s], t2[: t - s], t3[: t - s]
            to = slice(begins[e] + s, begins[e] + t)
            np.subtract(last[s - 1 : t - 1], first, out=x)
            np.subtract(up[s - 1 : t - 1], gap_extend, out=y)
            np.greater_equal(x, y, out=opens_up[to])
            np.maximum(x, y, out=up[s:t])
            np.subtract(last[s:t], first, out=x)
            np.subtract(left[s:t], gap_extend, out=y)
            np.greater_equal(x, y, out=opens_left[to])
            np.maximum(x, y, out=left[s:t])
            np.bitwise_xor(a[s - 1 : t - 1], b[m - e + s : m - e + t], out=z)
            np.minimum(z, 1, out=z)
            np.multiply(z, mismatch - match, out=z)
            np.add(z, match, out=z)
            np.add(z, far[s - 1 : t - 1], out=z)
            now = h[s:t]
            np.maximum(z, up[s:t], out=now)
            np.maximum(now, left[s:t], out=now)
            if local:
                np.maximum(now, 0, out=now)
                np.greater(now, 0, out=positive[to])
                better = now > best[s:t]
                if uneven:  # what is behind b's end is none of its cells
                    better &= np.arange(s, t)[:, None] >= e - size_b
                np.copyto(best[s:t], now, where=better)
                np.copyto(best_at[s:t], (e - np.arange(s, t)).astype(kind)[:, None], where=better)
            np.equal(now, z, out=diagonal[to])
            np.equal(now, up[s:t], out=vertical[to])
        if e <= m:
            h[0], left[0] = edge[e], low if local else edge[e]
        if e <= n:
            h[e], up[e], left[e] = edge[e], low if local else edge[e], low
        if not local and e in by_end:
            score[by_end[e]] = h[size_a[by_end[e]], by_end[e]]
        far, last, h = last, h, far
    i, j = size_a.copy(), size_b.copy()
    if local:
        best[np.arange(n + 1)[:, None] > size_a] = -1
        i = best.argmax(axis=0)
        j, score = best_at[i, np.arange(k)].astype(np.int64), best[i, np.arange(k)].astype(np.int64)
    ops, start, i, j = _ways_back(i, j, begins, a, b, diagonal, vertical, opens_up, opens_left, positive)
    text = ops.tobytes().decode()
    width = n + m
    return [(int(v), text[x * width + at : (x + 1) * width], *((int(p), int(q)) if local else (0, 0))) for x, (v, at, p, q) in enumerate(zip(score, start, i, j))]


_UP, _LEFT = 1, 2


def _ways_back(i, j, begins, a, b, diagonal, vertical, opens_up, opens_left, positive) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the cells (i, j), one a pair: operations as bytes that end at the right, where they begin, and the cells that are reached."""
    (n, k), m = a.shape, len(b)
    ops, start = np.full((k, n + m), ord(" "), np.uint8), np.full(k, n + m)
    end_i, end_j = i.copy(), j.copy()
    x, gap = np.arange(k), np.zeros(k, np.int8)
    flags = [f.ravel() for f in (diagonal, vertical, opens_up, opens_left)]
    at = n + m
    while True:
        cell = (begins[i + j] + i) * k + x
        going = (positive.ravel().take(cell) | (gap > 0)) if positive is not None else (i > 0) | (j > 0)
        if not going.all():
            done = ~going
            end_i[x[done]], end_j[x[done]], start[x[done]] = i[done], j[done], at
            x, i, j, gap, cell = x[going], i[going], j[going], gap[going], cell[going]
        if not len(x):
            return ops, start, end_i, end_j
        straight, upward, opens, opens_too = (f.take(cell) for f in flags)
        straight &= gap == 0
        gap = np.where(gap == 0, np.where(upward, _UP, _LEFT), gap)
        same = a.ravel().take((i - 1) * k + x) == b.ravel().take(np.minimum(m - j, m - 1) * k + x)
        at -= 1
        goes_up, goes_left = ~straight & (gap == _UP), ~straight & (gap == _LEFT)
        ops[x, at] = np.where(straight, np.where(same, ord("="), ord("X")), np.where(goes_up, ord("I"), ord("D")))
        i, j = i - (straight | goes_up), j - (straight | goes_left)
        # a gap ends where opening it here is as good as having it longer, and at the matrix's edge
        over = straight | goes_up & (opens | (i == 0)) | goes_left & (opens_too | (j == 0))
        gap = np.where(over, 0, gap).astype(np.int8)
