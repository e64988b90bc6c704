"""Quality rules by distribution divergence.

A document's histogram of character classes, and its histogram of common function words, are compared
with references of its language by Jensen-Shannon distance (base 2, 0 to 1). References are medians over
the documents (classes) and pooled counts (words), so that they cover the whole table and yet are not
bent by the junk in it. Every language has its own, drawn to that of all languages by as much as a few documents weigh:
one document of a language changes little, and many count for themselves, without a number at which this turns.
Documents too short to have a distribution are only judged by the base rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from not have or but they".split(),
    "fr": "de la le et les des en un du que une est pour qui dans par au sur pas avec ce il ne se plus".split(),
    "de": "der die und in den von zu das mit sich des für im auf ist nicht eine dem ein als auch es an werden aus".split(),
    "es": "de la que el en y los se del las un por con no una para su es al lo como más o pero sus".split(),
}
SYMBOLS = "#*$%&|<>"
#: Classes of characters; gap and line together are exactly what separates words. Digits and what stands in numbers, addresses and
#: names (brackets, hyphens, quotes) count with letters, so that a telephone number doesn't make a short text odd.
CLASSES = ("word", "upper", "gap", "line", "stop", "symbol", "other")
_WORD, _UPPER, _GAP, _LINE, _STOP, _SYMBOL, _OTHER = range(len(CLASSES))
#: Reject above this distance of classes, and only documents of at least so many words.
MAX_CLASS_DISTANCE, MIN_WORDS = 0.14, 50
#: Common words count from so many words on. The limit of their distance is a share of the distance that a text without any has:
#: the shorter a text, the further chance alone takes it, so that the share falls with the number of words, from most to least.
MIN_COMMON, MOST_SHARE, LEAST_SHARE, SHARE_WORDS = 100, 0.95, 0.5, 60
#: Documents of all languages, and common words of theirs, that a language's own are put on top of.
PRIOR_DOCS, PRIOR_WORDS = 50.0, 5000.0
_BINS = 512

_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
_DIGEST = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def _class_of(c: str) -> int:
    if c == "\n":
        return _LINE
    if c in " \t\x0b\x0c\r":
        return _GAP
    if c in SYMBOLS:
        return _SYMBOL
    if c.isalpha():
        return _UPPER if c.isupper() else _WORD
    return _WORD if c.isdigit() or c in "'\"()[]{}-–—’“”«»/@+_" else _STOP if c in ".,;:?!" else _OTHER


_class_table: np.ndarray | None = None


def _classes(text: str) -> np.ndarray:
    global _class_table
    if _class_table is None:  # built once a worker, from the rule above
        _class_table = np.array([_class_of(chr(c)) if not 0xD800 <= c < 0xE000 else _OTHER for c in range(0x110000)], np.uint8)
    return np.bincount(_class_table[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=len(CLASSES))


def _split(text: str) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+`; str.split would also cut at other white space."""
    return [w.decode() for w in text.encode().split()] if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = upto = 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def digest(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, common-word counts with all others last."""
    text = text or ""
    words = _split(text)
    classes = _classes(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    found = Counter(_split(text.lower()))
    common = [found[w] + found[w + ","] + found[w + "."] for w in _VOCABULARY]
    return len(words), int(classes.sum() - classes[_GAP] - classes[_LINE]), int(classes[_SYMBOL]), len(lines) - len(set(lines)), repeated_words(words), classes.tolist(), [*common, max(0, len(words) - sum(common))]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [digest(t.as_py()) for t in b.column("text")]
        columns = list(zip(*found)) if found else [[]] * 7
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[5:])], [f.split()[0] for f in _DIGEST.split(", ")])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """One thin row for each document: its counts and histograms."""
    return _texts(docs).transform(small_batches).mapInArrow(_digested, _DIGEST)


def _matrix(column, width: int) -> np.ndarray:
    """A list column of fixed length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch and language: documents by class and binned share, and pooled word counts."""
    for b in batches:
        rows: list[tuple[str | None, int, int, int]] = []
        classes, common = _matrix(b.column("classes"), len(CLASSES)), _matrix(b.column("common"), len(_VOCABULARY) + 1)
        words, langs = b.column("n_words").to_numpy(), np.array(b.column("lang").to_pylist(), object)
        judged = words >= MIN_WORDS
        for lang in set(langs[judged]):
            own = judged & (langs == lang)
            share = classes[own] / classes[own].sum(axis=1, keepdims=True)
            bins = np.minimum((np.sqrt(share) * _BINS).astype(int), _BINS - 1)
            for k in range(len(CLASSES)):
                counts = np.bincount(bins[:, k], minlength=_BINS)
                rows += [(lang, k, int(x), int(counts[x])) for x in np.flatnonzero(counts)]
            pooled = common[own].sum(axis=0)
            rows += [(lang, -1, int(x), int(pooled[x])) for x in np.flatnonzero(pooled)]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int32(), pa.int64())))], ["lang", "kind", "bin", "n"])


def _reference(bins: np.ndarray, words: np.ndarray) -> tuple[list[float], list[float]]:
    """Shares of classes, from the medians of binned shares, and of common words."""
    upto = bins.cumsum(axis=1)
    middle = (upto < upto[:, -1:] / 2).sum(axis=1)
    # the lowest bin holds shares under 4 in a million
    median = np.where(middle == 0, 1e-5, ((middle + 0.5) / _BINS) ** 2)
    return (median / median.sum()).tolist(), (words / max(words.sum(), 1e-300)).tolist()


def _counts(kind: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of documents by class and binned share, and counts of common words, from rows (kind, bin, n)."""
    bins, words = np.zeros((len(CLASSES), _BINS)), np.zeros(len(_VOCABULARY) + 1)
    of_class = kind >= 0
    bins[kind[of_class], at[of_class]] = n[of_class]
    words[at[~of_class]] = n[~of_class]
    return bins, words


def references(found: DataFrame) -> tuple[DataFrame, tuple[list[float], list[float]] | None]:
    """(lang, ref_classes, ref_common), one row for each language, and the pooled reference, from digests of all documents, or from the documents (then in one pass of one worker).

    The languages' table stays distributed, however many there are; a language's counts are 7 x 512 bins and some 100 words at most, and
    only the pooled ones reach the driver. The pooled reference is None where no document is judged.
    """
    rows, run = (found.select("lang", "n_words", "classes", "common"), _partial) if "classes" in found.columns else (_texts(found), lambda batches: _partial(_digested(batches)))
    table = materialize(rows.transform(small_batches).mapInArrow(run, "lang string, kind int, bin int, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")), "references")
    all_ = table.groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()
    if not len(all_):
        return table.select("lang", F.lit(None).cast("array<double>").alias("ref_classes"), F.lit(None).cast("array<double>").alias("ref_common")), None
    bins, words = _counts(all_["kind"].to_numpy(), all_["bin"].to_numpy(), all_["n"].to_numpy())
    shares, word_shares = bins / np.maximum(bins.sum(axis=1, keepdims=True), 1), words / max(words.sum(), 1)

    def of_language(rows: pd.DataFrame) -> pd.DataFrame:
        own, own_words = _counts(rows["kind"].to_numpy(), rows["bin"].to_numpy(), rows["n"].to_numpy())
        classes, common = _reference(own + PRIOR_DOCS * shares, own_words + PRIOR_WORDS * word_shares)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "ref_classes": [classes], "ref_common": [common]})

    refs = table.filter("lang is not null").groupBy("lang").applyInPandas(of_language, "lang string, ref_classes array<double>, ref_common array<double>")
    return materialize(refs, "language-references"), _reference(bins, words)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (square root of the divergence, base 2) of each row of p from q, or from the same row of q; rows of zeros: 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.where(total, total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(terms.sum(axis=1) / 2, 0)), 0.0)


def _own(column, pooled: list[float]) -> np.ndarray:
    """A column of references as a matrix, the pooled one where there is none."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.tile(np.array(pooled), (len(column), 1))
    if there.any():
        out[there] = _matrix(column.drop_null(), len(pooled))
    return out


def judge(b: pa.RecordBatch, pooled: tuple[list[float], list[float]] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and word distances, base_failed and kept of a batch of digests with their languages' references."""
    classes, common = _matrix(b.column("classes"), len(CLASSES)), _matrix(b.column("common"), len(_VOCABULARY) + 1)
    by_class, by_word, most = np.zeros(b.num_rows), np.zeros(b.num_rows), np.ones(b.num_rows)
    if pooled is not None and b.num_rows:
        own = _own(b.column("ref_common"), pooled[1])
        by_class, by_word = jensen_shannon(classes, _own(b.column("ref_classes"), pooled[0])), jensen_shannon(common, own)
        none = np.zeros_like(own)
        none[:, -1] = 1
        most = jensen_shannon(none, own)
    words, repeated = b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy()
    failed = (words < 50) | (100 * repeated > 50 * words)
    most = most * np.minimum(MOST_SHARE, LEAST_SHARE + SHARE_WORDS / np.maximum(words, 1))
    odd = (words >= MIN_WORDS) & (by_class > MAX_CLASS_DISTANCE) | (words >= MIN_COMMON) & (by_word > most)
    return by_class, by_word, failed, ~failed & ~odd


_SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def quality(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of every row of docs(doc_id, text, lang, ...).

    base_failed: under 50 words, or over half of the words lie in 3-word windows that occur twice.
    kept: not base_failed, and both distances are within their limits; a distance at its limit is. Null and empty texts have no
    words and fail. A null lang is held against the pooled reference. Repeated rows are judged
    alike, one by one. An empty table gives an empty result; other columns of docs are ignored.
    """
    found = materialize(digests(docs), "digests")
    refs, pooled = references(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(7) if k != 1), *map(pa.array, judge(b, pooled))], [f.split()[0] for f in _SCORED.split(", ")])

    return found.join(refs, "lang", "left").select(*found.columns, "ref_classes", "ref_common").transform(small_batches).mapInArrow(run, _SCORED)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, lang, ...) that quality keeps, with all columns as they are, whatever their names.

    Null, empty and short texts go, as in quality; of rows that are repeated all stay or all go; an empty table gives an empty result. Texts are read twice,
    and only shuffled if the languages' references, a kilobyte each, are too many for Spark to broadcast.
    """
    refs, pooled = references(docs.select("doc_id", "lang", "text"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    plain = docs.toDF(*names)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(t.as_py()) for t in b.column(text)]
            columns = list(zip(*found)) if found else [[]] * 7
            thin = pa.RecordBatch.from_arrays([b.column("ref_classes"), b.column("ref_common"), *(pa.array(columns[k], pa.int64()) for k in (0, 4)), *(pa.array(c, pa.list_(pa.int64())) for c in columns[5:])], ["ref_classes", "ref_common", "n_words", "n_repeat_words", "classes", "common"])
            yield b.select(names).filter(pa.array(judge(thin, pooled)[3]))

    return plain.join(refs.withColumnRenamed("lang", "of_lang"), F.col(lang).cast("string") == F.col("of_lang"), "left").drop("of_lang").transform(small_batches).mapInArrow(run, schema).toDF(*docs.columns)
