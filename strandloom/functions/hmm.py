"""Hidden Markov models with discrete symbols: most likely path and likelihood."""

from __future__ import annotations

import numpy as np


class Hmm:
    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = (np.asarray(x, float) for x in (start, move, emit))
        n = len(self.start)
        if not n or self.move.shape != (n, n) or self.emit.ndim != 2 or len(self.emit) != n:
            raise ValueError("start, move and emit don't fit each other")

    def _symbols(self, seen) -> np.ndarray:
        seen = np.asarray(seen, int)
        if not len(seen) or seen.min() < 0 or seen.max() >= self.emit.shape[1]:
            raise ValueError("an empty sequence, or a symbol that the model lacks")
        return seen

    def viterbi(self, seen) -> list[int]:
        """The most likely states; ties go to the lowest state."""
        seen = self._symbols(seen)
        with np.errstate(divide="ignore"):
            start, move, emit = np.log(self.start), np.log(self.move), np.log(self.emit)
        best, came = start + emit[:, seen[0]], []
        for s in seen[1:]:
            ways = best[:, None] + move
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + emit[:, s]
        path = [int(best.argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        return path[::-1]

    def log_likelihood(self, seen) -> float:
        """Of all paths, by forward sums scaled to one; minus infinity if the sequence is impossible."""
        seen = self._symbols(seen)
        total, at = 0.0, self.start * self.emit[:, seen[0]]
        for k in range(len(seen)):
            if k:
                at = (at @ self.move) * self.emit[:, seen[k]]
            scale = at.sum()
            if scale <= 0:
                return float("-inf")
            total += np.log(scale)
            at = at / scale
        return float(total)
