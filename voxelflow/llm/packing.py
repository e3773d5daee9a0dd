"""Packing documents into sequences of at most CAPACITY tokens by minimum bin slack.

Every document is encoded, ended by id 0, and cut into pieces only where it is longer than a sequence. Bins depend on lengths
alone, and there are at most CAPACITY different ones, so the plan is made on the histogram of lengths: the longest piece left
opens a bin, a subset-sum dynamic programme over the lengths left (a bit per sum, in one long integer) finds the fullest
combination beside it, and the pattern is taken as often as the counts allow before the next one is sought. A piece's rank among
those of its length names its bin: it is the piece's number in its input partition, counted where it is made, plus the pieces
of that length in the partitions before, a running sum over a row per partition and length. So nothing is sorted and no length is
ranked in one task. The driver holds counts per length and patterns, never pieces. Each pattern but the last of its length leaves
less than half of some length's count, so that there are at most CAPACITY * log2(pieces) of them.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import KEPT, stored, tidy

CAPACITY = 2048
#: Running sums (a row per partition and length, 32 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_SUMS = 1_000_000
#: Words, and characters in them, that a worker remembers; past that it starts afresh.
REMEMBERED, REMEMBERED_CHARACTERS = 700_000, 20_000_000
#: Bytes of text that are encoded together.
TOGETHER = 1 << 20

# white space for Python only, and a letter whose lower case depends on its place for Python only
_ODD = re.compile("[\x1c-\x1fΣ]")


class _Known(dict):
    """Numbers of words; a new word gets the next one and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and never joins characters across it, word by word.

    It also lower-cases and parts letters and digits from signs. Words repeat, so the ids of a word are remembered and a text's
    ids are gathered from those of its words; a new word that ends in signs is put together from what stands before them and
    the signs. New words of Latin letters are encoded as one text and parted where an id ends a word, if the vocabulary marks those.
    Only where Python and the tokenizer disagree is the whole text encoded as it is.
    """

    def __init__(self, path: str):
        os.environ.update({"TOKENIZERS_PARALLELISM": "false", "RAYON_NUM_THREADS": "1"})  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        letters = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)
        marks = np.flatnonzero(self.last[self._encode([letters])[0]])
        self.parts = len(marks) == 1 and marks[0] == len(self._encode([letters])[0]) - 1
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.characters = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def _keep(self, numbers: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Note the ids of words by their numbers."""
        while len(self.known) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and the ends of each in them."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _learn(self) -> None:
        known, joined = self.known, []
        whole, plain = ([], []), ([], [])  # numbers, words
        base = len(known) - len(known.new)  # new words are numbered in their order
        i = 0
        while i < len(known.new):  # what stands before signs may be new, too
            word = known.new[i]
            if word.isalpha():
                numbers, words = plain if self.parts and (word.isascii() or max(word) < "\u0250") else whole
                numbers.append(base + i)
                words.append(word)
            else:
                core = word.rstrip(string.punctuation)
                if core and len(core) < len(word) and core[-1].isalnum() and core[-1] < "\u0250":
                    joined.append((base + i, known[core], known[word[len(core) :]]))
                else:
                    whole[0].append(base + i)
                    whole[1].append(word)
            i += 1
        self.characters += sum(map(len, known.new))
        known.new.clear()
        for at in range(0, len(plain[0]), 4096):
            numbers, words = (c[at : at + 4096] for c in plain)
            flat = np.array(self._encode([" ".join(words)])[0], np.uint32)
            ends = np.flatnonzero(self.last[flat])
            if len(ends) == len(words):
                self._keep(np.array(numbers), np.diff(ends, prepend=-1), flat)
            else:
                whole[0].extend(numbers)
                whole[1].extend(words)
        encoded = self._encode(whole[1])
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self._keep(np.array(whole[0], np.int64), sizes, np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())))
        if joined:
            numbers, cores, signs = np.array(joined, np.int64).T
            flat, ends = self._gather(np.stack([cores, signs], 1).ravel())
            self._keep(numbers, np.diff(ends[1::2], prepend=0), flat)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without an end."""
        if len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self._forget()
        odd = {i: np.array(self._encode([t])[0], np.uint32) for i, t in enumerate(texts) if _ODD.search(t)}
        words = [[] if i in odd else t.lower().split() for i, t in enumerate(texts)]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if self.known.new:
            self._learn()
        flat, ends = self._gather(at)
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])]
        return [odd[i] if i in odd else flat[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


_encoders: dict[str, WordEncoder] = {}
KEPT["packing"] = _encoders.clear


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about TOGETHER bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum([len(t.as_buffer() or b"") for t in batch.column("text")])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _pieces(path: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part_id = encoder(path), TaskContext.get().partitionId()
        before = np.zeros(capacity + 1, np.int64)
        for batch in _parts(batches):
            row, piece, start, length, crc, place = [], [], [], [], [], []
            for i, found in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.append(found, np.uint32(0)).astype("<u4")
                for p, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    place.append(int(before[len(part)]))
                    before[len(part)] += 1
            yield pa.record_batch([batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part_id, np.int32)), pa.array(place, pa.int64())], ["id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return pieces


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as counted, whose sum is the largest that fits in `room`."""
    mask = (1 << (room + 1)) - 1
    reach = 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            layers.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
            if reach >> room:
                break
        if reach >> room:
            break
    at = reach.bit_length() - 1
    chosen: list[int] = []
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            chosen += [length] * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins have each. Each length must be from 1 to `capacity`."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        pattern = [first, *fullest({k: v for k, v in left.items() if v}, capacity - first)]
        left[first] += 1
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((pattern, times))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: the ranks at which runs begin, each run's first sequence, and its offset."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            ranks, sequences, offsets = out.setdefault(length, ([], [], []))
            ranks.append(used.get(length, 0))
            sequences.append(sequence)
            offsets.append(offset)
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return out


def runs(plan: dict[int, tuple[list[int], list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`slots` as flat arrays: length and rank of each run's first piece in one number, ascending; its sequence; its offset."""
    names = [(length << 48) + rank for length in sorted(plan) for rank in plan[length][0]]
    return np.array(names, np.int64), *(np.array([x for length in sorted(plan) for x in plan[length][k]], np.int64) for k in (1, 2))


def _place(plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sequences, offsets = plan.value
        for batch in batches:
            name = (batch.column("length").to_numpy() << 48) + batch.column("rank").to_numpy()
            at = np.searchsorted(names, name, "right") - 1
            yield pa.record_batch([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + name - names[at]), pa.array(offsets[at])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: path of a vocabulary file, on all machines; by default the public word-level one. A document is the ids of its
    text (null: empty) and then id 0; only one of more than `capacity` ids is cut, into pieces of `capacity`, the last of which
    may be shorter. Sequences are numbered from 0; offsets have no gaps. Rows repeated with one id are documents of their own;
    a null id is kept. Other columns are ignored; an empty table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    counted = [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())]
    pieces = stored(source.mapInArrow(tidy(_pieces(tokenizer, capacity), "packing"), T.StructType([*fields, *counted])))

    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(parts.select("length", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = docs.sparkSession.sparkContext.broadcast(runs(slots(minimum_bin_slack(counts, capacity))))
    few = sums.count() <= BROADCAST_SUMS
    before = sums.select("length", "part", "before")
    ranked = pieces.join(F.broadcast(before) if few else before, ["length", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    placed = ranked.mapInArrow(tidy(_place(plan)), T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return placed.withColumnRenamed("id", id_col)
