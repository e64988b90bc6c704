"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; long ones are cut further behind the word with the least hash of any eight in a row, so that the cuts
of a passage, seven words from its ends, are the same wherever it stands. From every sentence on, and up to every sentence, the shortest run of
several sentences with enough words is hashed: a longer run is repeated only where these, which cover it, are, so that hashing them
does what hashing every run would. Hashes are counted over all documents, and sentences covered by any span that isn't the first of its hash are removed.

In scripts that put no blanks between words, every letter counts as a word, and a full stop ends a sentence whatever follows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, row_keys, small_batches

#: A span has so many sentences and so many words at least; a sentence has so many words at most. Of any MOST words in a row
#: the one with the least hash ends a piece: whether a word does depends on MOST - 1 words on either side alone. So a passage of
#: 46 words holds a span whatever stands around it: 7 words that its surroundings reach, up to 8 to a cut, three pieces, 7 words.
SENTENCES, WORDS, MOST = 3, 16, 8
#: 64-bit words, powers of two, of the filter that tells most spans that occur once from the others; what it lets through is joined, so its size decides what that costs, never what is found.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 16, 1 << 22

#: Letters of scripts without blanks between words (Thai, Lao, Tibetan, Myanmar, Khmer, and from kana to the Han characters, in all planes), and the full stops of such scripts.
_SOLID = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e80-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3040-\u30ff\u3100-\u312f\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_STOP = "\u3002\uff01\uff1f\uff61\u17d4\u104b\u0f0d"
_STOPS, _HAS_SOLID = re.compile(f"(?<=[{_STOP}])"), re.compile(f"[{_SOLID}]")
_WORD, _SOLID_WORD = re.compile(r"\S+"), re.compile(rf"[^\s{_SOLID}{_STOP}]*[{_STOP}]|[{_SOLID}]|[^\s{_SOLID}{_STOP}]+")
#: White space beyond the seven bits.
_WIDE_GAP = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_GAP = np.zeros(256, bool)
_GAP[[*range(9, 14), *range(28, 33)]] = True
#: Odd factors whose powers give bytes their place in a word's hash and words theirs in a span's, with their inverses modulo 2^64; numbers for bytes, and what marks a word that begins a sentence.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(f, -1, 1 << 64) for f in _FACTORS)
_BYTES = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BEGINS = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of texts that are hashed at once.
_AT_ONCE = 1 << 19


def _plain(text: str) -> str:
    """The text in lower case, places kept, a line to each sentence."""
    low = text.lower()
    if len(low) != len(text):  # a letter became two: letter by letter, so that places stay
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    # a full stop, a mark and a blank end a sentence like a line does; places stay
    low = low.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")
    return low if low.isascii() else _WIDE_GAP.sub(" ", low)


def _parted(low: str) -> str:
    """What _plain gives, with blanks between words, and lines between sentences, where their script has none."""
    if low.isascii() or not _HAS_SOLID.search(low):
        return low
    return "\n".join(" ".join(_SOLID_WORD.findall(x)) for line in low.split("\n") for x in _STOPS.split(line))


def _places(low: str) -> list[int]:
    """Where each word of what _plain gives begins."""
    solid = not low.isascii() and _HAS_SOLID.search(low)
    return [w.start() for w in (_SOLID_WORD if solid else _WORD).finditer(low)]


def _powers(factor: int, n: int, held: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """The first n powers modulo 2^64, or more."""
    p = held.get(factor, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate((p, p * np.uint64(pow(factor, len(p), 1 << 64))))
    held[factor] = p
    return p


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _hashed(values: np.ndarray, first: np.ndarray, upto: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of the runs first..upto of values: polynomials whose place doesn't matter, mixed."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(_FACTORS[kind], len(values))[: len(values)])))
    return _mixed((total[upto] - total[first]) * _powers(_INVERSES[kind], len(values) + 1)[first] + (upto - first).astype(np.uint64))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of the words of UTF-8 bytes, a piece of the text at a time that ends between words."""
    gap = np.concatenate((_GAP[raw], [True]))
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    first, upto = edge[0::2], edge[1::2]
    out, k = [], 0
    while k < len(first):
        n = max(k + 1, int(np.searchsorted(upto, first[k] + _AT_ONCE, "right")))
        base = first[k]
        out.append(_hashed(_BYTES[raw[base : upto[n - 1]]], first[k:n] - base, upto[k:n] - base, 0))
        k = n
    return first, np.concatenate(out) if out else np.zeros(0, np.uint64)


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that _parted gives: hashes of all their words, how many words are over at the end of each piece, and how many pieces at the end of each text.

    A piece is a sentence, or what a long one is cut into.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(encoded), np.uint8)
    first, h = _words(raw)
    n = len(h)
    sentence = np.searchsorted(np.flatnonzero(raw == 10), first)
    ends = np.zeros(n + 1, bool)
    ends[1:n][sentence[1:] != sentence[:-1]] = True
    ends[n] = n > 0
    if n >= MOST:
        # windows that lie in one sentence; of equal words the last
        inside = np.flatnonzero(sentence[: n - MOST + 1] == sentence[MOST - 1 :])
        for k in range(0, len(inside), _AT_ONCE):
            at = inside[k : k + _AT_ONCE]
            least = MOST - 1 - np.lib.stride_tricks.sliding_window_view(h, MOST)[at, ::-1].argmin(axis=1)
            ends[at + least + 1] = True
    ends = np.flatnonzero(ends)
    over = np.cumsum([len(e) + 1 for e in encoded])
    return h, ends, np.searchsorted(ends, np.searchsorted(first, over, "left"), "right")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, words, normal form) of each sentence: lower case, words joined by one blank. It lasts to the next one's start."""
    low = _plain(text)
    ends, at, words = _cut([_parted(low)])[1].tolist(), _places(low), _parted(low).split()
    return [(at[s], e - s, " ".join(words[s:e])) for s, e in zip([0, *ends], ends)]


def runs(counts: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the shortest spans from and up to each sentence, given the sentences' words and how many sentences are over at the end of each text; in order, each once."""
    n = len(counts)
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    text = np.searchsorted(upto, np.arange(n), "right")
    begin, stop = np.concatenate(([0], upto[:-1]))[text], upto[text]
    from_, over = np.arange(n), np.arange(1, n + 1)
    end = np.maximum(from_ + SENTENCES, np.searchsorted(total, total[:-1] + WORDS, "left"))
    start = np.minimum(over - SENTENCES, np.searchsorted(total, total[1:] - WORDS, "right") - 1)
    ok, back = end <= stop, start >= begin
    key = np.sort(np.concatenate((from_[ok] * (n + 1) + end[ok], start[back] * (n + 1) + over[back])))
    key = key[np.diff(key, prepend=-1) > 0]
    return key // (n + 1), key % (n + 1) - 1


def spans_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (unsigned), text, first and last sentence of each span. A span's hash comes from its words' hashes, with marks where sentences begin."""
    out, k = [], 0
    while k < len(texts):
        n, size = k, 0
        while n < len(texts) and (n == k or size + len(texts[n] or "") <= _AT_ONCE):
            size += len(texts[n] or "")
            n += 1
        h, ends, upto = _cut([_parted(_plain(t or "")) for t in texts[k:n]])
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
        first, last = runs(ends - begins, upto)
        h[begins] ^= _BEGINS
        text = np.searchsorted(upto, first, "right")
        base = np.concatenate(([0], upto[:-1]))[text]
        out.append((_hashed(h, begins[first], ends[last], 1), text + k, first - base, last - base))
        k = n
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last sentence of each span of one text."""
    h, _, first, last = spans_of([text])
    return h, first, last


def remove(text: str, covered: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the covered sentences (first, last), and how many went."""
    if not covered:
        return text, 0
    low = _plain(text)
    ends, places = _cut([_parted(low)])[1], _places(low)
    at = [*(places[s] for s in [0, *ends[:-1].tolist()]), len(text)]
    gone = np.zeros(len(at) - 1, bool)
    for s, e in covered:
        gone[s : e + 1] = True
    out, kept_from = [], 0
    for k in np.flatnonzero(gone).tolist():
        out.append(text[kept_from : at[k]])
        kept_from = at[k + 1]
    out.append(text[kept_from:])
    left = "".join(out)
    return left.rstrip() if gone[-1] else left, int(gone.sum())


#: What a row is known by: its doc_id, hashes of its text and of its place in its file.
_ROW = ("doc_id", "version", "place")


def _emit(full: bool, bits):
    """Spans of texts: their hashes alone, or with their places, then only those that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value if bits is not None else None
        for b in batches:
            h, rows, first, last = spans_of(b.column("text").to_pylist())
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["hash"])
                continue
            seen = np.flatnonzero(table[h & np.uint64(len(table) - 1)] >> (h >> np.uint64(58)) & np.uint64(1))
            at = pa.array(rows[seen])
            yield pa.RecordBatch.from_arrays([pa.array(h[seen].view(np.int64)), *(b.column(c).take(at) for c in _ROW), pa.array(first[seen].astype(np.int32)), pa.array(last[seen].astype(np.int32))], ["hash", *_ROW, "first", "last"])

    return run


def _filter(often: DataFrame) -> np.ndarray:
    """A bit for each hash in `often`, and for few others: between FILTER_WORDS and MOST_FILTER_WORDS words of 64 bits, by the number of hashes."""
    need = often.count() // 4  # 16 bits or more a hash let through one in 16 of the others
    size = min(MOST_FILTER_WORDS, max(FILTER_WORDS, 1 << need.bit_length()))
    word, bit = F.col("hash").bitwiseAND(F.lit(size - 1)).cast("int"), F.shiftrightunsigned("hash", 58).cast("int")
    # as many rows as words at most, in columns: rows one by one would take the driver a hundred times the filter's bytes
    marked = often.select(word.alias("word"), bit.alias("bit")).withColumn("mask", F.expr("shiftleft(1L, bit)")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(size, np.uint64)
    table[marked["word"].to_numpy()] = marked["mask"].to_numpy().view(np.uint64)
    return table


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, version, place): docs' rows as structs and what they are known by; rows equal in all columns differ in their place."""
    rows = row_keys(docs)
    return rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("version"), F.xxhash64("part", "place").alias("place"))


def _covered(rows: DataFrame) -> DataFrame:
    """What rows are known by, and `spans`, of rows with spans that occur before: structs of first and last sentence."""
    texts = rows.select(*_ROW, F.col("row.text").cast("string").alias("text")).filter("text is not null")
    often = materialize(texts.select("text").transform(small_batches).mapInArrow(_emit(False, None), "hash long").groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "often")
    bits = rows.sparkSession.sparkContext.broadcast(_filter(often))
    found = texts.transform(small_batches).mapInArrow(_emit(True, bits), "hash long, doc_id long, version long, place long, first int, last int")
    repeated = materialize(found.join(often, "hash"), "repeated")
    at = F.struct(*_ROW, "first")
    firsts = materialize(repeated.groupBy("hash").agg(F.min(at).alias("earliest")), "firsts")
    later = repeated.join(firsts, "hash").filter(~at.eqNullSafe(F.col("earliest")))
    out = materialize(later.groupBy(*_ROW).agg(F.collect_set(F.struct("first", "last")).alias("spans")), "covered")
    release(often, repeated, firsts)
    return out


def _without(docs: DataFrame) -> DataFrame:
    """(row, n_removed): docs' rows as structs, their texts without repeated spans."""
    rows = _keyed(docs)
    cuts = _covered(rows)
    same = rows["doc_id"].eqNullSafe(cuts["doc_id"]) & (rows["version"] == cuts["version"]) & (rows["place"] == cuts["place"])
    # spans unfold to far more than their file's bytes, by which a broadcast would be chosen; a text travels beside its row's other columns, not twice
    others = [c for c in docs.columns if c != "text"]
    joined = rows.join(cuts.hint("merge"), same, "left").select(F.struct(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("rest"), F.col("row.text").cast("string").alias("text"), "spans")
    schema = T.StructType([joined.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cut = b.column("text"), b.column("spans").is_valid().to_numpy(zero_copy_only=False)
            removed = np.zeros(b.num_rows, np.int64)
            left = []
            for k in np.flatnonzero(cut).tolist():
                text, removed[k] = remove(texts[k].as_py(), [(s["first"], s["last"]) for s in b.column("spans")[k].as_py()])
                left.append(text)
            if left:
                texts = pc.replace_with_mask(texts, pa.array(cut), pa.array(left, texts.type))
            yield pa.RecordBatch.from_arrays([b.column("rest"), texts, pa.array(removed)], ["rest", "text", "n_removed"])

    cleaned = joined.transform(small_batches).mapInArrow(run, schema)
    return cleaned.select(F.struct(*[F.col("text") if c == "text" else F.col("rest").getField(f"c{others.index(c)}").alias(c) for c in docs.columns]).alias("row"), "n_removed")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed) for every row of docs(doc_id, text, ...).

    The first place of a span is that of the smallest doc_id (nulls first), then the earliest in its text; a document that
    repeats itself loses the later places too. Rows equal in doc_id and text are copies like any other: one of them is the first.
    Texts without removed sentences stay as they are, to the character. Null texts stay null, a text
    all of which is repeated becomes empty. An empty table gives an empty result; other columns are ignored.
    """
    out = _without(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "n_removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with its columns and all its rows, the texts without repeated spans, as in deduplicate, whatever the columns' names.

    n_chars, if there is such a column, follows a text that has lost something. Null and empty texts stay as they are, an empty table gives an empty result.
    """
    out = _without(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("row.text")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])
