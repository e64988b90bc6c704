"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 long, words padded by blanks) in
order of frequency. A document's profile is held against each language's: every n-gram adds the distance
of its two ranks, or the profile's length where the language lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

PROFILE = 400
#: A letter's number is its code point and one, so that every letter of every script has its own; 0 is what isn't one. An n-gram's number
#: has its letters as digits to this base, with its length before them.
_BASE = 0x110002
#: Letters below this number are packed into 10 bits each while they are counted, which is what Latin texts need.
_PACKED = 1 << 10
#: Characters of a document that are counted at once.
_AT_ONCE = 1 << 20
#: Distinct n-grams that a task holds for a language before it hands its counts on.
_HELD = 1 << 21

_letter: np.ndarray | None = None


def _fold(text: str) -> np.ndarray:
    """One number for each letter, 0 for each run of anything else, at both ends too."""
    global _letter
    if _letter is None:
        _letter = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    raw = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    codes = np.concatenate(([0], np.where(_letter[raw], raw + 1, 0), [0])).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def _number(length, a, b, c) -> np.ndarray:
    return ((np.int64(length - 1) * _BASE + a) * _BASE + b) * _BASE + c


def _count(codes: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending, and counts of the n-grams that begin at the first `upto` places."""
    packed = not len(codes) or int(codes.max()) < _PACKED
    c = codes if packed else codes.astype(np.int64)
    one = c[:upto]
    one, two, three = one[one > 0], (c[:-1], c[1:]), (c[:-2], c[1:-1], c[2:])
    two = [x[:upto] for x in two]
    three = [x[:upto][three[1][:upto] > 0] for x in three]  # a trigram has a letter in its middle
    if not packed:
        return np.unique(np.concatenate((_number(1, 0, 0, one), _number(2, 0, *two), _number(3, *three))), return_counts=True)
    g, n = np.unique(np.concatenate((one, two[0] << 10 | two[1] | np.uint32(1 << 30), three[0] << 20 | three[1] << 10 | three[2] | np.uint32(1 << 31))), return_counts=True)
    g = g.astype(np.int64)
    # the same order, as the length stands before the letters in either form
    return _number((g >> 30) + 1, g >> 20 & 1023, g >> 10 & 1023, g & 1023), n


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's n-grams and how often each occurs, most frequent first, ties by number."""
    codes = _fold(text)
    parts = [_count(codes[k : k + _AT_ONCE + 2], _AT_ONCE) for k in range(0, max(len(codes), 1), _AT_ONCE)]
    g, n = parts[0]
    if len(parts) > 1:
        g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    return g[order], n[order]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by language, merged over what a task has read."""
    held: dict[str, tuple[list[np.ndarray], list[np.ndarray], int]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        grams, times, _ = held[lang]
        g, at = np.unique(np.concatenate(grams), return_inverse=True)
        return g, np.bincount(at, weights=np.concatenate(times)).astype(np.int64)

    def out(lang: str) -> pa.RecordBatch:
        g, n = merged(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
            g, n = ngrams(text.as_py())
            grams, times, size = held.get(lang, ([], [], 0))
            grams.append(g)
            times.append(n)
            held[lang] = grams, times, size + len(g)
            if size + len(g) > _HELD:
                g, n = merged(lang)
                if len(g) > _HELD // 2:
                    yield out(lang)
                    del held[lang]
                else:
                    held[lang] = [g], [n], len(g)
    for lang in held:
        yield out(lang)


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its most frequent n-grams in order, over all documents that are not held out.

    At most `size` rows a language reach the driver.
    """
    learned = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = learned.transform(small_batches).mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # rank in parts first, so that no task ranks a whole language's n-grams
    part = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= size)
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(found)], np.int64) for lang, found in sorted(out.items())}


class Ranker:
    """Profiles as sorted arrays, ready to be held against documents."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = list(by_lang), size
        self.sorted = [(np.sort(g), np.argsort(g, kind="stable")) for g in by_lang.values()]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the best mean out-of-place distance as a share of the worst possible. Ties go to the language first by code point."""
        if not self.langs or not text:
            return "und", 0.0
        found = ngrams(text)[0][: self.size]
        if not len(found):
            return "und", 0.0
        place = np.arange(len(found))
        sums = []
        for grams, rank in self.sorted:
            at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
            sums.append(np.where(grams[at] == found, np.minimum(np.abs(rank[at] - place), self.size), self.size).sum())
        best = int(np.argmin(sums))
        return self.langs[best], float(1 - sums[best] / (len(found) * self.size))


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang, ...).

    Profiles come from texts with a lang whose crc32(doc_id) modulo 5 is not 0; predictions use the text
    alone. lang_pred is `und`, with score 0, if text is null or has no letter, or if nothing could be learned.
    Repeated rows come back row by row; an empty table gives an empty result; other columns are ignored.
    """
    ranker = docs.sparkSession.sparkContext.broadcast(Ranker(profiles(docs, size), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ranker.value.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.transform(small_batches).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
