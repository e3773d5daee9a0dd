"""SentencePiece encoding by sampling: Gumbel top-k without replacement over the lattice of segmentations, by A* search.

The vocabulary never joins characters across the start of a word, so a text's lattice is a chain of word lattices, and the
probability of a segmentation is the product over its words. Word lattices of a batch are built and summed (backward
log-sums) together, each distinct word once.

The search is top-down. The set of all segmentations has the Gumbel maximum G; a set is split into the word choices that its maximum
takes and, for each word, the rest, whose maximum is a Gumbel of the rest's log-probability cut off at G. A queue holds the
rests by their maxima; the next sample is the largest, split again. So the k largest perturbed log-probabilities are found
exactly, without listing segmentations, and they are k draws without replacement. A rest is entered by drawing its word from what is
left of the lattice without the choices taken. The inclusion score is the chance that a segmentation's perturbed value exceeds the (k+1)-th.

All noise comes from a counter-based generator keyed by the row, so a row's samples don't depend on partitions or retries.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import tidy
from .words import mix

#: Segmentations per text.
SAMPLES = 2
_SPACE = "▁"
_LITERAL = ""  # stands for a literal ▁ in the lattice, which no piece holds: it becomes bytes
_WORDS = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+$")
#: Edges of lattices (18 bytes each) that a worker keeps.
REMEMBERED = 8_000_000
#: Bytes of text that are sampled together.
TOGETHER = 1 << 21


class Vocabulary:
    """Pieces by the hash of their characters, with log-weights by Zipf's law of their rank: -alpha * log(rank + offset)."""

    def __init__(self, path: str, alpha: float, offset: float = 3.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        normal = [i for i in range(size) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        pieces = [self.model.id_to_piece(i) for i in normal]
        self.longest = max(map(len, pieces))
        weight = -alpha * np.log(np.array([-self.model.get_score(i) for i in normal]) + offset)
        hashes = np.array([_code(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.weights = hashes[order], np.array(normal, np.int32)[order], weight[order]
        self.filter = np.zeros(1 << 22, bool)
        slot = (self.hashes >> np.uint64(42)).astype(np.int64)
        self.filter[slot] = True
        self.slots = np.zeros(1 << 22, np.int32)  # the piece of a slot, -1 where several share it
        self.slots[slot] = np.arange(len(slot))
        self.slots[slot[1:][slot[1:] == slot[:-1]]] = -1
        self.bytes = np.array([self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_weight = -alpha * np.log(size + offset)
        surfaces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(size)))]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_size = np.fromiter(map(len, surfaces), np.int64, size)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 text of each sequence of ids, without the space that stands before it."""
        if not ids:
            return []
        flat = np.concatenate(ids)
        sizes = self.surface_size[flat]
        ends = np.cumsum(sizes)
        text = self.surface[np.repeat(self.surface_start[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [text[a + (text[a : a + 1] == b" ") : b] if a < b else b"" for a, b in zip(cuts, cuts[1:])]


_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _code(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_STEP) + ord(c) + 1) & ((1 << 64) - 1)
    return h * int(_SPREAD) & ((1 << 64) - 1)


@functools.cache
def vocabulary(path: str, alpha: float) -> Vocabulary:
    """This process's vocabulary of a file."""
    return Vocabulary(path, alpha)


@dataclass
class Edges:
    """Lattices of words laid end to end. A node is a character of a word; its edges are the pieces that begin there, the longest first.

    first[node] is the node's first edge. An edge has its piece (a number in the vocabulary, or the vocabulary's size plus the code of
    a character that becomes bytes), its length, the log-probability of taking it where its node is reached, and the sum of
    the probabilities of the node's edges up to it, which for the last one is infinite.
    """

    first: np.ndarray
    piece: np.ndarray
    length: np.ndarray
    logp: np.ndarray
    below: np.ndarray


def lattice(texts: list[str], v: Vocabulary) -> Edges:
    """The lattices of words; a character that no piece holds is one step of as many bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from a node to its word's end
    node, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    found = []
    for n in range(v.longest):
        if n:
            more = left[node] > n
            node, h = node[more], h[more]
        if not len(node):
            break
        h = h * _STEP + codes[node + n] + np.uint64(1)
        spread = h * _SPREAD
        slot = (spread >> np.uint64(42)).astype(np.int64)
        maybe = np.flatnonzero(v.filter[slot])
        slot, mixed = slot[maybe], spread[maybe]
        where = v.slots[slot]
        if (shared := where < 0).any():
            where[shared] = np.minimum(np.searchsorted(v.hashes, mixed[shared]), len(v.hashes) - 1)
        hit = v.hashes[where] == mixed
        at, where = node[maybe[hit]], where[hit]
        found.append((at, where.astype(np.int64), np.full(len(at), n + 1, np.int64), v.weights[where]))
        if n == 0:
            bare = np.ones(len(codes), bool)
            bare[at] = False
            at = np.flatnonzero(bare)
            c = codes[at].astype(np.int64)
            found.append((at, len(v.ids) + c, np.ones(len(at), np.int64), v.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
    at, piece, length, weight = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
    order = np.argsort(at, kind="stable")
    away = left[at[order]]
    order = order[np.argsort(away.astype(np.uint16) if away.max(initial=0) < 1 << 16 else away, kind="stable")]  # nodes nearer to their word's end come first
    at, piece, length, weight = at[order], piece[order], length[order], weight[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    starts = np.flatnonzero(new)
    first = np.zeros(len(codes), np.int64)
    first[at[starts]] = starts
    rest = left[at] - length
    back = np.zeros(len(codes) + 1)  # log-sums from a node to its word's end
    target = np.where(rest > 0, at + length, len(codes))
    logp = np.empty(len(at))
    steps = left[at[starts]]
    cuts = np.flatnonzero(np.concatenate([[True], steps[1:] != steps[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = starts[a:b]
        stop = starts[b] if b < len(starts) else len(at)
        through = weight[own[0] : stop] + back[target[own[0] : stop]]
        count = np.diff(own, append=stop)
        top = np.maximum.reduceat(through, own - own[0])
        total = top + np.log(np.add.reduceat(np.exp(through - np.repeat(top, count)), own - own[0]))
        back[at[own]] = total
        logp[own[0] : stop] = through - np.repeat(total, count)
    share = np.cumsum(np.exp(logp))
    below = share - np.repeat(share[starts] - np.exp(logp[starts]), np.diff(starts, append=len(at)))
    below[np.append(starts[1:], len(at)) - 1] = np.inf
    return Edges(first, piece.astype(np.int32), length.astype(np.int16), logp.astype(np.float32), below)


def _uniform(key: np.ndarray, spot: np.ndarray, call: np.ndarray | int, step: int) -> np.ndarray:
    """Numbers between 0 and 1 of a counter-based generator: one for each row key, place in the text, call and step."""
    x = mix(key + spot.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    x = mix(x + (np.uint64(call) << np.uint64(32)) + np.uint64(step))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(key: np.ndarray, spot: np.ndarray, call: int) -> np.ndarray:
    return -np.log(-np.log(_uniform(key, spot, call, (1 << 32) - 1)))


def split_words(text: str) -> list[str]:
    """A text's words as the vocabulary writes them, without the space that each begins with.

    A space stands before the text and before what follows each space; of several the last one begins the word.
    """
    if not text:
        return []
    text = text.replace(_SPACE, _LITERAL)
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _WORDS.findall(_SPACE + text.replace(" ", _SPACE))]


class _Known(dict):
    """Numbers of words; a new word gets the next one and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Lattices:
    """The lattices of the words that a worker has met, up to REMEMBERED edges; past that it starts afresh."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.begin = np.zeros(1, np.int64)  # a word's first node, and behind the last word the next one's
        self.edges = Edges(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, np.float32), np.zeros(0))
        self.nodes = self.used = 0

    def learn(self) -> None:
        """Sum the lattices of the new words."""
        new = [_SPACE + w for w in self.known.new]
        if not new:
            return
        made = lattice(new, self.v)
        made.first += self.used
        old, nodes, used = self.edges, self.nodes + len(made.first), self.used + len(made.piece)
        if nodes > len(old.first):
            old.first = np.concatenate([old.first, np.empty(nodes, np.int64)])
        if used > len(old.piece):
            for name in ("piece", "length", "logp", "below"):
                x = getattr(old, name)
                setattr(old, name, np.concatenate([x, np.empty(used, x.dtype)]))
        old.first[self.nodes : nodes] = made.first
        for name in ("piece", "length", "logp", "below"):
            getattr(old, name)[self.used : used] = getattr(made, name)
        ends = self.nodes + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        self.begin = np.concatenate([self.begin, ends])
        self.nodes, self.used = nodes, used
        self.known.new.clear()


class Batch:
    """The words of some texts, with their lattices."""

    def __init__(self, texts: list[list[str]], lattices: Lattices):
        if lattices.used > REMEMBERED:
            lattices.forget()
        self.v = lattices.v
        self.ends = np.cumsum([0, *map(len, texts)])
        self.word = np.fromiter(map(lattices.known.__getitem__, chain.from_iterable(texts)), np.int64, self.ends[-1])
        lattices.learn()
        self.begin, self.edges = lattices.begin, lattices.edges

    def draw(self, words: np.ndarray, key: np.ndarray, spot: np.ndarray, call: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each word by forward sampling: pieces of all in order, how many each has, log-probabilities."""
        logp, count = np.zeros(len(words)), np.zeros(len(words), np.int64)
        node, end = self.begin[words], self.begin[words + 1]
        live, found = np.arange(len(words)), []
        while len(live):
            edge = self.edges.first[node]
            u = _uniform(key[live], spot[live], call, len(found))
            todo = np.flatnonzero(self.edges.below[edge] < u)
            while len(todo):
                edge[todo] += 1
                todo = todo[self.edges.below[edge[todo]] < u[todo]]
            logp[live] += self.edges.logp[edge]
            count[live] += 1
            found.append((live, self.edges.piece[edge]))
            node = node + self.edges.length[edge]
            more = node < end
            live, node, end = live[more], node[more], end[more]
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for step, (chosen, pieces) in enumerate(found):
            out[first[chosen] + step] = pieces
        return out, count, logp

    def draw_other(self, word: int, taken: dict[tuple[int, ...], float], key: int, spot: int, call: int) -> tuple[tuple[int, ...], float]:
        """A segmentation of a word among those that aren't `taken` (pieces: log-probability), by what is left below each step."""
        path: list[int] = []
        logp, node, end, step = 0.0, int(self.begin[word]), int(self.begin[word + 1]), 0
        while node < end:
            a = b = int(self.edges.first[node])
            while not np.isinf(self.edges.below[b]):
                b += 1
            pieces, steps = self.edges.piece[a : b + 1].tolist(), self.edges.length[a : b + 1].tolist()
            mass = np.exp(logp + self.edges.logp[a : b + 1].astype(np.float64))
            for t, p in taken.items():
                if list(t[: len(path)]) == path and t[len(path)] in pieces:
                    mass[pieces.index(t[len(path)])] -= np.exp(p)
            mass = np.maximum(mass, 0)
            for i, x in enumerate(pieces):  # what is taken is gone, whatever rounding left of it
                if tuple([*path, x]) in taken and node + steps[i] == end:
                    mass[i] = 0
            total = np.cumsum(mass)
            u = float(_uniform(np.array([key], np.uint64), np.array([spot]), call, step)[0]) * total[-1]
            i = min(int(np.searchsorted(total, u)), len(total) - 1)
            path.append(pieces[i])
            logp += float(self.edges.logp[a + i])
            node += steps[i]
            step += 1
        return tuple(path), logp

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        """The ids of pieces; a character without one becomes those of its bytes."""
        n = len(self.v.ids)
        odd = np.flatnonzero(pieces >= n)
        if not len(odd):
            return self.v.ids[pieces]
        codes = pieces[odd] - n
        out = self.v.ids[np.minimum(pieces, n - 1)]
        out[odd] = self.v.bytes[np.minimum(codes, 255)]
        if (long := codes > 127).any():
            parts, done = [], 0
            for at, code in zip(odd[long].tolist(), codes[long].tolist(), strict=True):
                raw = chr(code).replace(_LITERAL, _SPACE).encode("utf-8", "surrogatepass")
                parts += [out[done:at], self.v.bytes[list(raw)]]
                done = at + 1
            out = np.concatenate([*parts, out[done:]])
        return out


@dataclass
class Sample:
    """A segmentation of a text: its pieces, the number of pieces before each word, the log-probability before each, its value."""

    pieces: np.ndarray
    counts: np.ndarray
    before: np.ndarray
    value: float

    @property
    def logp(self) -> float:
        return float(self.before[-1])


@dataclass(order=True)
class _Rest:
    """Segmentations that agree with a sample before a word and take none of some choices there."""

    order: float  # minus the maximum
    number: int
    word: int = field(compare=False)
    sample: Sample = field(compare=False)
    taken: dict[tuple[int, ...], float] = field(compare=False)


def _log_rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - exp(logp)), minus infinity where nothing is left."""
    left = -np.expm1(np.minimum(logp, 0))
    return np.where(left > 1e-12, np.log(np.maximum(left, 1e-300)), -np.inf)


def _below(location: np.ndarray, top: np.ndarray | float, gumbel: np.ndarray) -> np.ndarray:
    """Gumbel values of a location, given that they are below `top`."""
    return -np.logaddexp(-top, -(location + gumbel))


def sample_batch(batch: Batch, keys: np.ndarray, k: int) -> list[tuple[list[Sample], float]]:
    """For each text up to k distinct segmentations, with falling values, and the value of the next one, minus infinity if there is
    none. All texts take their steps together; the noise of one doesn't depend on the others."""
    texts = len(batch.ends) - 1
    out: list[tuple[list[Sample], float]] = [([], -np.inf) for _ in range(texts)]
    queues: list[list[_Rest]] = [[] for _ in range(texts)]
    made = 0

    def step(todo: list[tuple[int, int, Sample | None, tuple[int, ...], float, float]], call: int, most: int) -> list[Sample]:
        """Complete segmentations: text, word, the sample that leads there, the choice at the word, its log-probability, the maximum.

        The `most` largest rests of each are queued: as many as can still be taken, and the one after.
        """
        nonlocal made
        starts = [batch.ends[t] + w + (lead is not None) for t, w, lead, _, _, _ in todo]
        sizes = np.array([batch.ends[t[0] + 1] - a for t, a in zip(todo, starts, strict=True)], np.int64)
        spots = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes, strict=True)]) if len(todo) else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(todo)), sizes)
        text = np.array([t[0] for t in todo], np.int64)
        key, spot = keys[text][own], spots - batch.ends[text][own]
        pieces, counts, logp = batch.draw(batch.word[spots], key, spot, call)
        first = np.concatenate([[0], np.cumsum(sizes)])
        piece_ends = np.concatenate([[0], np.cumsum(counts)])
        tops = np.array([t[5] for t in todo])
        made_here = []
        starting = np.zeros(len(todo))
        for i, (_, w, lead, choice, p, top) in enumerate(todo):
            a, b = first[i], first[i + 1]
            mine, n = pieces[piece_ends[a] : piece_ends[b]], piece_ends[a : b + 1] - piece_ends[a]
            if lead is None:
                made_here.append(Sample(mine, n, np.concatenate([[0.0], np.cumsum(logp[a:b])]), top))
                continue
            cut, start = int(lead.counts[w]), float(lead.before[w]) + p
            starting[i] = start
            made_here.append(Sample(np.concatenate([lead.pieces[:cut], choice, mine]), np.concatenate([lead.counts[: w + 1], cut + len(choice) + n]), np.concatenate([lead.before[: w + 1], start + np.concatenate([[0.0], np.cumsum(logp[a:b])])]), top))
        if not len(spots):
            return made_here
        run = np.cumsum(logp) - logp
        before = run - np.repeat(run[np.minimum(first[:-1], len(run) - 1)], sizes) + starting[own]
        values = _below(before + _log_rest(logp), tops[own], _gumbel(key, spot, call))
        full = np.flatnonzero(sizes)
        for _ in range(most):
            best = np.maximum.reduceat(values, first[:-1][full])
            at = np.flatnonzero((values == np.repeat(best, sizes[full])) & ~np.isneginf(values))
            if not len(at):
                break
            for j in at.tolist():
                i = int(own[j])
                made += 1
                s, w = made_here[i], int(spot[j])
                choice = tuple(s.pieces[s.counts[w] : s.counts[w + 1]].tolist())
                heapq.heappush(queues[todo[i][0]], _Rest(-float(values[j]), made, w, s, {choice: float(logp[j])}))
            values[at] = -np.inf
        return made_here

    tops = _gumbel(keys, np.full(texts, -1), 0)
    for (found, _), s in zip(out, step([(t, 0, None, (), 0.0, float(tops[t])) for t in range(texts)], 1, k), strict=True):
        found.append(s)
    for r in range(1, k):
        todo = []
        rests = [(t, heapq.heappop(queues[t])) for t in range(texts) if queues[t]]
        at = np.array([t for t, _ in rests], np.int64)
        spot = np.array([rest.word for _, rest in rests], np.int64)
        # a draw that isn't taken yet is one of what is left; only the others are drawn from what is left step by step
        pieces, counts, logs = batch.draw(batch.word[batch.ends[at] + spot], keys[at], spot, 4 * r + 2)
        ends = np.cumsum(counts)
        gumbels = _gumbel(keys[at], spot, 4 * r)
        for i, (t, rest) in enumerate(rests):
            top, w = -rest.order, rest.word
            choice, p = tuple(pieces[ends[i] - counts[i] : ends[i]].tolist()), float(logs[i])
            if choice in rest.taken:
                choice, p = batch.draw_other(int(batch.word[batch.ends[t] + w]), rest.taken, int(keys[t]), w, 4 * r)
            taken = rest.taken | {choice: p}
            left = _log_rest(np.logaddexp.reduce(list(taken.values())))
            if not np.isneginf(left):
                made += 1
                value = float(_below(rest.sample.before[w] + left, top, gumbels[i]))
                heapq.heappush(queues[t], _Rest(-value, made, w, rest.sample, taken))
            todo.append((t, w, rest.sample, choice, p, top))
        for job, s in zip(todo, step(todo, 4 * r + 1, k - r), strict=True):
            out[job[0]][0].append(s)
    return [(found, -queues[t][0].order if queues[t] else -np.inf) for t, (found, _) in enumerate(out)]


def _sample_rows(path: str, k: int, alpha: float, full: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        known = Lattices(v)
        for part in _parts(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            batch = Batch([split_words(t) for t in texts], known)
            keys = part.column("key").to_numpy().view(np.uint64)
            row, rank, logs, values, scores, ids = [], [], [], [], [], []
            for i, (found, below) in enumerate(sample_batch(batch, keys, k)):
                for r, s in enumerate(found):
                    row.append(i)
                    rank.append(r)
                    logs.append(s.logp)
                    values.append(s.value)
                    scores.append(1.0 if np.isneginf(below) else float(-np.expm1(-np.exp(min(s.logp - below, 700.0)))))
                    ids.append(batch.ids(s.pieces))
            take = pa.array(row, pa.int64())
            if full:
                yield pa.record_batch([part.column("id").take(take), pa.array(rank, pa.int32()), pa.array(logs), pa.array(values), pa.array(scores), pa.array(ids, pa.list_(pa.int32()))], ["id", "sample", "log_prob", "perturbed", "inclusion", "ids"])
            else:
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                same = [d == raw[i] for d, i in zip(v.decode(ids), row, strict=True)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.record_batch([part.column("id").take(take), pa.array(rank, pa.int32()), pa.array(np.round(logs, 6)), pa.array(np.round(values, 6)), pa.array(np.round(scores, 9)), pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["id", "sample", "log_prob", "perturbed", "inclusion", "n_pieces", "ids_crc32", "decodes"])

    return rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about TOGETHER characters, one row at least."""
    for batch in batches:
        ends = np.cumsum([len(t.as_buffer() or b"") for t in batch.column("text")])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _sampled(docs: DataFrame, tokenizer: str | None, k: int, alpha: float, seed: int, id_col: str, text_col: str, full: bool) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("piece_bpe_32k.model")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"))
    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("sample", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("log_prob", "perturbed", "inclusion"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if full else [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decodes", T.BooleanType())]
    return source.mapInArrow(tidy(_sample_rows(tokenizer, k, alpha, full)), T.StructType(fields)).withColumnRenamed("id", id_col)


def sample_segmentations(docs: DataFrame, tokenizer: str | None = None, k: int = SAMPLES, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs` up to k distinct segmentations of its text: id_col, sample (from 0), log_prob, perturbed, inclusion, ids.

    tokenizer: path of a SentencePiece model, on all machines; by default the public one. Fewer than k rows come where there are
    fewer segmentations; null and empty text have one, of no pieces and probability one. Rows of one id get the same noise, so
    repeated rows get the same samples; a null id is a key, too. Other columns are ignored; an empty table gives an empty result.
    """
    return _sampled(docs, tokenizer, k, alpha, seed, id_col, text_col, True)


def segmentation_digests(docs: DataFrame, tokenizer: str | None = None, k: int = SAMPLES, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `sample_segmentations`, with n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and decodes (whether the ids decode to
    the text) in place of ids."""
    return _sampled(docs, tokenizer, k, alpha, seed, id_col, text_col, False)


def decode(samples: DataFrame, tokenizer: str | None = None, ids_col: str = "ids") -> DataFrame:
    """`samples` with the column `text`, which its ids decode to; null ids give null. A column `text` is replaced."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("piece_bpe_32k.model")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer, 1.0)
        for batch in batches:
            texts = [None if x is None else v.decode([np.array(x, np.int64)])[0].decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    kept = samples.drop("text")
    return kept.mapInArrow(tidy(rows), T.StructType([*kept.schema, T.StructField("text", T.StringType())]))
