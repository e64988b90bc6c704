"""Packing token sequences by minimum bin slack.

Documents become token ids and are cut into full windows and a remainder. The remainders' lengths form a
multiset over 1..4095, whose counts reach the driver whatever the corpus' size. There each window is
filled by a bitset subset-sum: the longest remaining length is set, one big integer holds all sums that the
rest of the multiset can reach, and backtracking gives how many pieces of each length make the sum closest
to capacity. A filling is used as often as the counts allow, so that fillings number some thousands at most.
Pieces are numbered within their length and find window and offset by that number.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

CAPACITY, END = 4096, 2
#: Parts of texts whose ids a worker keeps, twice; bytes of text that are cut into parts at once.
_KEPT, _AT_ONCE = 500_000, 1 << 20
#: Pieces of one length that one task numbers by itself.
_RUN = 4096

#: What the tokenizer's own pattern cannot cut differently: runs of letters with apostrophes inside or before, of digits, of
#: punctuation. Only texts of the characters below are cut so.
_LETTER = "[a-zß-öø-ÿ]+"
_PART = re.compile(rf"{_LETTER}(?:'{_LETTER})*|'{_LETTER}(?:'{_LETTER})*|[0-9]+|[!-/:-@\[-`{{-~]+")
_OTHER = re.compile(r"[^\x09-\x0D\x20-\x7Eß-öø-ÿ]")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, put together from the ids of their parts.

    The tokenizer lowers case, drops white space and encodes each run of letters, digit and run of punctuation by
    itself, so that equal parts have equal ids wherever they stand. Texts with other characters than ASCII and
    Latin letters go through the tokenizer whole.
    """

    def __init__(self, path: str):
        # a task has one core, and threads of its own would only hold memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        words = [p for p in missing if p.isalpha()]
        for k in range(0, len(words), 4000):
            some = words[k : k + 4000]
            raw = self._encode([" ".join(some)])[0]
            ids = np.frombuffer(raw, "<u4")
            at = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(at) != len(some):  # a word would have to end in two places
                self.parts.update(zip(some, self._encode(some)))
                continue
            s = 0
            for p, e in zip(some, at.tolist()):
                self.parts[p] = raw[s:e]
                s = e
        others = [p for p in missing if not p.isalpha()]
        self.parts.update(zip(others, self._encode(others)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.parts) > _KEPT:  # what is found again in the elder half moves on, the rest goes
            self.elder, self.parts = self.parts, {}
        low = [t.lower() for t in texts]
        whole = [k for k, t in enumerate(low) if "<|" in t or _OTHER.search(t)]
        out: list = [None] * len(texts)
        for k, ids in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = ids
        cut = {k: _PART.findall(t) for k, t in enumerate(low) if out[k] is None}
        missing: set[str] = set()
        for parts in cut.values():
            missing.update(parts)
        missing -= self.parts.keys()
        if again := missing & self.elder.keys():
            self.parts.update((p, self.elder[p]) for p in again)
            missing -= again
        if missing:
            self._learn(missing)
        ids = self.parts.__getitem__
        for k, parts in cut.items():
            out[k] = b"".join(map(ids, parts))
        return out


_encoders: dict[str, Encoder] = {}

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, spread long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents' ids and the end id, cut after every `capacity`; `spread` is a number that tells equal rows apart.

    with_ids adds the binary column ids (little-endian, 32 bits).
    """
    path = path or vocabulary_path()
    names = [f.split()[0] for f in _PIECES.split(", ")] + ["ids"] * with_ids
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, task, made = _encoders[path], TaskContext.get().partitionId(), 0
        for b in batches:
            texts, ids = b.column("text"), b.column("doc_id").to_pylist()
            sizes = np.cumsum(np.array([x or 0 for x in pa.compute.binary_length(texts).to_pylist()]))
            done = 0
            while done < len(ids):
                stop = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + _AT_ONCE)))
                rows = []
                for doc, found in zip(ids[done:stop], encoder.encode([t or "" for t in texts.slice(done, stop - done).to_pylist()])):
                    found += end
                    total = len(found) // 4
                    for s in range(0, total, capacity):
                        part = found[4 * s : 4 * (s + capacity)]
                        rows.append((doc, s, len(part) // 4, zlib.crc32(part), total, zlib.crc32(f"{task} {made}".encode()), part))
                        made += 1
                done = stop
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)][: len(names)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(small_batches).mapInArrow(run, _PIECES + ", ids binary" * with_ids)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """How many pieces of each length come closest to `room`, by bitset subset-sum with backtracking; lengths descend."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for n in lengths:
        if not counts[n] or n > room:
            continue
        steps.append((n, reach))
        left, part = min(counts[n], room // n), 1
        while left:  # 1, 2, 4, ... pieces and the rest: every number up to `left`
            part = min(part, left)
            reach |= reach << part * n & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        if k:
            out.append((n, k))
    return out


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces)]) that use up counts of pieces by length, slack kept least window by window."""
    counts = {n: c for n, c in counts.items() if c}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        more = dict(fullest(lengths, counts, capacity - longest))
        counts[longest] += 1
        more[longest] = more.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in more.items())
        for n, k in more.items():
            counts[n] -= times * k
        lengths = [n for n in lengths if counts[n]]
        out.append((times, sorted(more.items(), reverse=True)))
    return out


class Plan:
    """Fillings as arrays: where the r-th piece of a length goes."""

    def __init__(self, made: list[tuple[int, list[tuple[int, int]]]]):
        rows, used, window = [], {}, 0
        for times, filling in made:
            offset = 0
            for n, k in filling:
                rows.append((n, used.get(n, 0), k, window, offset))
                used[n] = used.get(n, 0) + times * k
                offset += n * k
            window += times
        rows.sort()
        self.windows = window
        self.length, self.first, self.each, self.window, self.offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        self.key = self.length << 48 | self.first

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of pieces by length and number within the length."""
        at = np.searchsorted(self.key, length << 48 | number, "right") - 1
        behind = number - self.first[at]
        return self.window[at] + behind // self.each[at], self.offset[at] + behind % self.each[at] * length


def numbered(table: DataFrame) -> DataFrame:
    """The table with `number`, gapless from 0 within a length. Lengths are cut into runs, so that a frequent one is spread over many tasks."""
    runs = max(1, -(-table.count() // _RUN))
    cut = table.withColumn("run", F.pmod("spread", F.lit(runs)))
    counts = cut.groupBy("length", "run").agg(F.count("*").alias("n"))
    base = counts.select("length", "run", (F.sum("n").over(Window.partitionBy("length").orderBy("run")) - F.col("n")).alias("base"))
    own = Window.partitionBy("length", "run").orderBy("doc_id", "start", "spread", "ids_crc32")
    return cut.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "run"]).withColumn("number", F.col("base") + F.col("own")).drop("run", "own", "base")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and the end id; null and empty texts are the end id alone. Documents longer than a
    window fill windows of their own, cut after each `capacity`; what is left of them and all others share windows. Windows are padded
    behind their pieces. Repeated rows and null ids are packed like any others; an empty table gives an empty result; other
    columns of docs are ignored. with_ids adds ids, from which windows() puts sequences together.
    """
    table = materialize(pieces(docs, path, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = docs.sparkSession.sparkContext.broadcast(Plan(fillings(counts, capacity)))
    ranked = numbered(table)
    kept, ids = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], ["ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window, offset = plan.value.place(b.column("length").to_numpy().astype(np.int64), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(window), pa.array(offset), *(b.column(c) for c in ids)], [*kept, "sequence_id", "offset", *ids])

    out = ranked.transform(small_batches).mapInArrow(run, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    return out.withColumn("length", F.col("length").cast("long"))


def windows(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """(sequence_id, used, ids binary) from pack(..., with_ids=True): whole windows, padded at the end. A window has at most `capacity` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    padding = F.unhex(F.repeat(F.lit(np.array([pad], "<u4").tobytes().hex()), (F.lit(capacity) - F.col("used")).cast("int")))
    return joined.withColumn("ids", F.concat("ids", padding))
