"""Vectorised word scanning and hashing of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``. All white space bytes are ASCII, so scanning UTF-8 bytes is exact.
A word's hash is the sum of random 64-bit values, one for each (place in the word, byte), finished with a mixer: no words
are related by the order of their letters, as they would be under a polynomial modulo a power of two. Runs of
words are hashed by joining halves through the mixer, for the same reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SLICE_BYTES = 1 << 18

#: So many places of a word have their values in a table; those of later places are worked out.
PLACES = 64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Odd constants that set hash families apart.
_SEED, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(place: np.ndarray, byte: np.ndarray, family: int) -> np.ndarray:
    """Random value of a byte at a place of a word."""
    x = place.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)
    return mix(mix(x * np.uint64(_SEED) + np.uint64(_STEP * (2 * family + 1) % (1 << 64))))


_TABLES = [_values(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256), PLACES), k) for k in range(2)]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes (one row at least): first, last + 1, bytes, offsets within them."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(texts.is_valid())
    if not valid.all() and (np.diff(offsets)[~valid] > 0).any():
        yield from slices(texts.fill_null(""), limit)
        return
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(body: np.ndarray, offsets: np.ndarray, fold: bool, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the index of each row's first word (one more entry than rows).

    ``family`` (0 or 1) chooses between two independent hashes."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[body]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = offsets[offsets < len(body)]
    begins[edge] = word[edge]
    edge = offsets[offsets > 0] - 1
    ends[edge] = word[edge]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, word_hashes(body, begin, end, fold, family), np.searchsorted(begin, offsets)


def word_hashes(body: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool, family: int) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1], dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    text = body[place + np.repeat(begin.astype(np.int32), size)]
    if fold:
        text = FOLD[text]
    value = _TABLES[family][np.minimum(place, PLACES - 1) << 8 | text]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        value[late] = _values(place[late], text[late], family)
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(_STEP))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words, starting at each word of the concatenation.

    Runs that cross a row's end are the caller's to discard."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = hashes, 1, None, 0
    while True:
        if length & size:
            out = power if out is None else _join(out, power[done:])
            done += size
        if 2 * size > length:
            return out[:n]
        power, size = _join(power, power[size:]), 2 * size


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a run from those of its two parts."""
    n = min(len(a), len(b))
    return mix(a[:n] * np.uint64(_STEP) + b[:n])


def sequence(hashes: np.ndarray) -> int:
    """Hash of a whole row of words."""
    return int(mix(np.cumsum(mix(hashes + np.arange(1, len(hashes) + 1, dtype=np.uint64) * np.uint64(_SEED)))[-1:] + np.uint64(len(hashes)))[0]) if len(hashes) else 0
