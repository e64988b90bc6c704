"""Read kernels on whole batches: reads as rows of a matrix, a loop over places or offsets instead of reads.

Each agrees with the function of one read of the same kind in `kernels`. -1 stands for none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import kernels as kn

#: Characters of a matrix.
AT_ONCE = 1 << 18


def parts(lengths: np.ndarray) -> Iterator[slice]:
    """Ranges of rows whose matrix is small enough, or that are one row."""
    k = 0
    while k < len(lengths):
        widest = np.maximum.accumulate(np.maximum(lengths[k : k + AT_ONCE], 1))
        n = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), AT_ONCE, "right")))
        yield slice(k, k + n)
        k += n


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes, filled up with zeros, and their lengths."""
    raw = [t.encode() for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), int(lengths.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return out, lengths


def moved(rows: np.ndarray, start: np.ndarray, size: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Windows of the rows, moved to the left, or turned round; zeros behind."""
    width = int(size.max(initial=0))
    at = np.arange(width)
    source = (start + size - 1)[:, None] - at if reverse else start[:, None] + at
    inside = at < size[:, None]
    return np.where(inside, np.take_along_axis(rows, np.where(inside, source, 0), axis=1) if rows.shape[1] else 0, 0).astype(np.uint8)


def adapter_starts(windows: np.ndarray, size: np.ndarray, adapter: np.ndarray, least: int = 5, rate: float = 0.2) -> np.ndarray:
    """kernels.adapter_start of each window."""
    m, width = len(adapter), windows.shape[1]
    out = np.full(len(windows), -1, np.int64)
    if m < max(least, 1) or width < least:
        return out
    starts = width - least + 1
    upper = np.concatenate((kn.upper(windows), np.zeros((len(windows), m), np.uint8)), axis=1)
    compared = np.minimum(size[:, None] - np.arange(starts), m).astype(np.int32)
    wrong = np.zeros((len(windows), starts), np.int32)
    for j, c in enumerate(kn.upper(adapter)):
        wrong += (upper[:, j : j + starts] != c) & (j < compared)
    valid = compared >= least if least <= m else np.zeros_like(wrong, bool)
    ok = valid & (wrong.astype(np.float32) / np.maximum(compared, 1).astype(np.float32) <= np.float32(rate))
    found = ok.any(axis=1) & (size >= least)
    out[found] = ok[found].argmax(axis=1)
    return out


def _first(stop: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each row first stops, its size if it doesn't."""
    return np.where(stop.any(axis=1), stop.argmax(axis=1), size) if stop.shape[1] else size.copy()


def _last_hit(hits: np.ndarray) -> np.ndarray:
    """The last hit of each row, -1 without one."""
    return np.where(hits.any(axis=1), hits.shape[1] - 1 - hits[:, ::-1].argmax(axis=1), -1) if hits.shape[1] else np.full(len(hits), -1)


def poly_tails(backward: np.ndarray, size: np.ndarray, base: str = "G", least: int = 10, most_mismatches: int = 5, per: int = 8) -> np.ndarray:
    """kernels.poly_tail of each window, given turned round."""
    at = np.arange(backward.shape[1])
    valid = at < size[:, None]
    match = (kn.upper(backward) == ord(base.upper())) & valid
    wrong = np.cumsum(~match, axis=1, dtype=np.int32)
    stop = ((wrong > most_mismatches) | (wrong > (at + 1) // per) & (at + 1 >= least)) & valid
    reach = _first(stop, size)
    hit = _last_hit(match & (at <= reach[:, None]))
    return np.where((size > 0) & (reach >= least) & (hit >= 0), size - 1 - hit, -1)


def dominant_tails(backward: np.ndarray, size: np.ndarray, least: int = 10, most_mismatches: int = 5, per: int = 8) -> np.ndarray:
    """kernels.dominant_tail of each window, given turned round."""
    if not backward.shape[1]:
        return np.full(len(backward), -1)
    at = np.arange(backward.shape[1])
    valid, back = at < size[:, None], kn.upper(backward)
    unknown = back == ord("N")
    counts = np.stack([np.cumsum(((back == c) | unknown) & valid, axis=1, dtype=np.int32) for c in b"ACGT"])
    bad = (at + 1 - counts > np.minimum(most_mismatches, (at + 1) // per)).all(axis=0)
    stop = bad & ((at >= per) | (at + 2 >= least)) & valid
    reach = _first(stop, size)
    last = np.maximum(np.minimum(reach, size - 1), 0)
    best = np.take_along_axis(counts, np.broadcast_to(last[None, :, None], (4, len(back), 1)), axis=2)[:, :, 0].argmax(axis=0)
    hit = _last_hit((back == np.frombuffer(b"ACGT", np.uint8)[best][:, None]) & (at <= last[:, None]) & valid)
    return np.where((size > 0) & (reach + 1 >= least) & (hit >= 0), size - 1 - hit, -1)


def _overlaps(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, offsets: list[int], allowed, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pair the first offset at which allowed(offset) holds and fits(sizes, mismatches by place) is true: found, offset, size, mismatches."""
    found, at, size, total = (np.zeros(len(a), t) for t in (bool, np.int64, np.int64, np.int64))
    for offset in offsets:
        rows = np.flatnonzero(~found & allowed(offset))
        if not len(rows):
            continue
        left, right = max(offset, 0), max(-offset, 0)
        sizes = np.minimum(n[rows] - left, m[rows] - right)
        width = max(int(sizes.max()), 0)
        wrong = (a[rows, left : left + width] != b[rows, right : right + width]) & (np.arange(width) < sizes[:, None])
        ok = fits(sizes, wrong)
        hit = rows[ok]
        found[hit], at[hit], size[hit], total[hit] = True, offset, sizes[ok], wrong[ok].sum(axis=1)
    return found, at, size, total


def trim_overlaps(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, require: int = 30, limit: int = 5, share: float = 0.2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kernels.trim_overlap of each pair of windows: found, offset, size."""
    a, b = kn.upper(a), kn.upper(b)
    share = np.float32(min(max(0.0 if share != share else share, 0.0), 1.0))
    whole = (n >= require) & (m >= require)
    widest, other = int(n.max(initial=0)), int(m.max(initial=0))
    offsets = [*range(widest - require + 1), *range(-1, -(other - require) - 1, -1)]
    allowed = lambda o: whole & ((o <= n - require) if o >= 0 else (-o <= m - require))
    fits = lambda sizes, wrong: wrong.sum(axis=1) <= np.minimum(limit, (sizes.astype(np.float32) * share).astype(np.int64))
    return _overlaps(a, n, b, m, offsets, allowed, fits)[:3]


def merge_overlaps(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, require: int = 30, limit: int = 5, percent: float = 20, whole: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kernels.merge_overlap of each pair: mates 1, and mates 2 turned to their strand: found, offset, size, mismatches."""

    def fits(sizes: np.ndarray, wrong: np.ndarray) -> np.ndarray:
        budget = np.minimum(limit, (sizes * (percent / 100)).astype(np.int64))
        return (wrong.sum(axis=1) <= budget) | (wrong[:, :whole].sum(axis=1) <= budget) & (sizes > whole)

    ahead = _overlaps(a, n, b, m, list(range(max(0, int(n.max(initial=0)) - require))), lambda o: o < n - require, fits)
    rest = np.flatnonzero(~ahead[0])
    if len(rest):
        n2, m2 = n[rest], m[rest]
        back = _overlaps(a[rest], n2, b[rest], m2, list(range(0, -max(0, int(m2.max(initial=0)) - require), -1)), lambda o: -o < m2 - require, fits)
        for all_, some in zip(ahead, back):
            all_[rest] = some
    return ahead


def complements(rows: np.ndarray, size: np.ndarray, merging: bool = False) -> np.ndarray:
    """kernels.reverse_complement of each window."""
    turned = moved(rows, np.zeros(len(rows), np.int64), size, reverse=True)
    return np.where(turned > 0, (kn._MERGE if merging else kn._KEEP_CASE)[turned], 0).astype(np.uint8)


def rolling_codes(flat: np.ndarray, k: int, canonical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of k bytes, two bits a base, first base highest, k up to 31; the smaller of both strands' if canonical; and which are all ACGT (either case).

    Windows are put together from shorter ones, so that it takes log k steps.
    """
    n = max(len(flat) - k + 1, 0)
    code = kn._CODE[flat]
    one = (code & 3).astype(np.int64)
    other = 3 - one
    ahead, back, w = one, other, 1
    for bit in bin(k)[3:]:
        ahead, back, w = ahead[:-w] << 2 * w | ahead[w:], back[w:] << 2 * w | back[:-w], 2 * w
        if bit == "1":
            ahead, back, w = ahead[:-1] << 2 | one[w:], other[w:] << 2 * w | back[:-1], w + 1
    bad = np.concatenate(([0], np.cumsum(code == 255, dtype=np.int32)))
    return (np.minimum(ahead[:n], back[:n]) if canonical else ahead[:n]), bad[k : k + n] == bad[:n]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts one behind another as bytes, one a character, each with a zero behind it; their lengths, and where they begin."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    flat = np.frombuffer("".join(f"{t or ''}\0" for t in texts).encode("ascii", "replace"), np.uint8)
    return flat, lengths, np.cumsum(lengths + 1) - lengths - 1


#: Windows that are taken at once.
WINDOWS = 1 << 19


def window_codes(texts: list[str | None], k: int, canonical: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of all windows of some texts: number of the text, place in it, code, and whether it is all ACGT."""
    flat, lengths, begins = joined(texts)
    for s in range(0, len(flat) - k + 1, WINDOWS):
        code, ok = rolling_codes(flat[s : s + WINDOWS + k - 1], k, canonical)
        at = np.arange(s, s + len(code))
        first, last = np.searchsorted(begins, [at[0], at[-1]], "right") - 1
        text = np.repeat(np.arange(first, last + 1), np.diff(np.concatenate(([at[0]], begins[first + 1 : last + 1], [at[-1] + 1]))))
        place = at - begins[text]
        inside = place <= lengths[text] - k
        yield text[inside], place[inside], code[inside], ok[inside]


def reference_hits(seqs: list[str], refs: kn.References) -> tuple[np.ndarray, np.ndarray]:
    """Number of the read and place of all windows that are reference k-mers, in order."""
    # a table of 16 bits of a hash lets few others through
    spread = lambda c: ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    near = np.zeros(1 << 16, bool)
    near[spread(refs.full)] = True
    reads, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text, place, code, ok in window_codes(seqs, refs.k):
        code = code.astype(np.uint64) & refs.mask
        some = np.flatnonzero(near[spread(code)] & ok)
        some = some[np.isin(code[some], refs.full)]
        reads.append(text[some])
        places.append(place[some])
    return np.concatenate(reads), np.concatenate(places)


def kept_windows(seqs: list[str], quals: list[str], refs: kn.References | None, ktrim: str = "f", qtrim: str = "f", trimq: int = 6, minlength: int = 10, min_hits: int = 1, min_share: float = 0.0, offset: int = 33) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kernels.kept_window of each read: start, end, and whether it stays."""
    n = np.array([len(s) for s in seqs], np.int64)
    if qtrim != "f" or refs is not None and refs.mink:  # by the read
        found = [kn.kept_window(s, q, refs, ktrim, qtrim, trimq, minlength, min_hits, min_share, offset) for s, q in zip(seqs, quals)]
        windows = np.array([w or (0, 0) for w in found], np.int64).reshape(-1, 2)
        return windows[:, 0], windows[:, 1], np.array([w is not None for w in found], bool)
    start, end, gone = np.zeros_like(n), n.copy(), np.zeros(len(n), bool)
    if refs is not None and len(refs):
        reads, places = reference_hits(seqs, refs)
        if ktrim == "f":
            hits = np.bincount(reads, minlength=len(n))
            gone = (hits > 0) & ((hits >= min_hits) | (min_share > 0) & (hits / np.maximum(n - refs.k + 1, 1) >= min_share))
        elif ktrim in "rl":
            hit, first = np.unique(reads, return_index=True)
            if ktrim == "r":
                end[hit] = places[first]
            else:
                start[hit] = np.minimum(places[first] + refs.k, n[hit])
    return start, end, ~gone & (end - start >= minlength)
