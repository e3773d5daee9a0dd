"""Words and word shingles of Arrow text columns as 64-bit hashes.

`exact_words` hashes each word by itself with a strong hash, for sets that decide something. `word_features` computes sums over
whole buffers, which is quicker and does for counts and candidates: different words can be made that it can't tell apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import SPACE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
#: For `word_hashes`: letters, digits and all bytes beyond ASCII make words; signs separate them, too.
PLAIN = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at a time; a longer text is cut between words.
CHUNK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE)]), dtype=np.uint64)


_POWERS = _powers(256)


def _hash_chunk(data: np.ndarray, heads: np.ndarray, is_word: np.ndarray, beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (kind, word) of the words in `data`, and where they start. heads: positions where a text starts."""
    global _POWERS
    solid = is_word[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = heads[heads < len(data)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros((1 + len(beginnings), 0), np.uint64), starts
    at = np.flatnonzero(solid)
    sizes = np.diff(np.searchsorted(at, starts), append=len(at))
    inside = np.arange(len(at)) - np.repeat(np.searchsorted(at, starts), sizes)
    if (longest := int(sizes.max())) > len(_POWERS):
        _POWERS = _powers(2 * longest)
    terms = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * _POWERS[inside]
    first = np.cumsum(sizes) - sizes
    found = [mix(np.add.reduceat(terms, first) ^ (sizes.astype(np.uint64) << np.uint64(48)))]
    for n in beginnings:
        part = mix(np.add.reduceat(np.where(inside < n, terms, np.uint64(0)), first) ^ np.uint64(n << 56))
        found.append(np.where(sizes > n, part, np.uint64(0)))
    return np.stack(found), starts


def word_hashes(text: pa.Array, is_word: np.ndarray = _IS_WORD) -> Iterator[np.ndarray]:
    """The first row of `word_features`, without beginnings."""
    for found in word_features(text, is_word):
        yield found[0]


def word_features(text: pa.Array, is_word: np.ndarray = _IS_WORD, beginnings: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """For each text, the hash of each of its words: maximal runs of bytes of `is_word`, A-Z lower-cased; null has none.

    By default a word is what stands outside `[\\x20\\x09-\\x0D]`. A row follows for each of `beginnings`: the hash of as many
    first bytes, 0 for words that aren't longer.
    """
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, count=len(text) + 1, offset=8 * text.offset) if len(text) else np.zeros(1, np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * CHUNK or j > i + 1:
            found, starts = _hash_chunk(data[a:b], offsets[i:j] - a, is_word, beginnings)
            yield from np.split(found, np.searchsorted(starts, offsets[i + 1 : j] - a), axis=1)
        else:
            parts = []
            while a < b:
                end = min(b, a + CHUNK)
                while end < b and is_word[data[end]]:
                    stop = min(b, end + CHUNK)
                    gap = np.flatnonzero(~is_word[data[end:stop]])
                    end = end + int(gap[0]) if len(gap) else stop
                parts.append(_hash_chunk(data[a:end], np.zeros(1, np.int64), is_word, beginnings)[0])
                a = end
            yield np.concatenate(parts, axis=1)
        i = j


def exact_words(text: pa.Array) -> Iterator[np.ndarray]:
    """For each text the xxh3 hashes of its words, in order: runs outside `[\\x20\\x09-\\x0D]`, A-Z lower-cased; null has none."""
    for value in text:
        raw = value.as_buffer()
        data = raw.to_pybytes().lower() if raw is not None else b""
        if len(data) <= 2 * CHUNK:
            yield _hashed(data)
            continue
        parts, a = [], 0
        while a < len(data):
            end = _BLANK.search(data, min(len(data), a + CHUNK))
            b = end.end() if end else len(data)
            parts.append(_hashed(data[a:b]))
            a = b
        yield np.concatenate(parts)


def _hashed(data: bytes) -> np.ndarray:
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than `size` make one shingle, none make none."""
    if not len(words):
        return words
    if len(words) < size:
        marked = mix(words + np.arange(1, len(words) + 1, dtype=np.uint64))
        return mix(np.bitwise_xor.reduce(marked, keepdims=True) + np.uint64(len(words)))
    n = len(words) - size + 1
    total = words[:n].copy()
    for j in range(1, size):
        total = total * _BASE + words[j : j + n]
    return np.unique(mix(total))
