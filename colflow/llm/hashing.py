"""Vectorised word and shingle hashes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: bytes hashed at a time; a longer text is hashed in stretches of about this size
BLOCK = 1 << 18

_SPACES = b" \t\n\x0b\x0c\r"
#: bytes.translate tables: words as they stand, and with A-Z lower-cased
PLAIN = bytes(32 if c in _SPACES else c for c in range(256))
FOLDED = bytes(32 if c in _SPACES else c + 32 if 65 <= c <= 90 else c for c in range(256))

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (the finalizer of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15


def _table(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, the powers of ``BASE`` and of its inverse. Tables for
    a stretch are kept by the worker; longer ones, for a longer word, are not."""
    if length > 2 * BLOCK:
        return _letters(), _table(BASE, length), _table(pow(BASE, -1, 1 << 64), length)
    return _kept_powers()


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _letters(), _table(BASE, 2 * BLOCK), _table(pow(BASE, -1, 1 << 64), 2 * BLOCK)


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of ``data`` (bytes; words apart by blanks)."""
    inside = np.concatenate(([False], data != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    letters, up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all ``texts`` in order, and where each text's
    begin (one entry more than texts). ``table`` says what separates words."""
    joined = b" ".join(texts).translate(table) + b" "
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts, hashes, at = [], [], 0
    while at < len(joined):
        # stretches end on a blank; a word longer than a stretch stays whole
        stop = joined.find(b" ", min(at + BLOCK, len(joined) - 1)) + 1 or len(joined)
        s, h = _block(np.frombuffer(joined, np.uint8, stop - at, at))
        starts.append(s + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` words in sequence, by the position of the first."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out + words[i : i + count] + U(0x9E3779B97F4A7C15))
    return out


def batches_of(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts in UTF-8) in groups of about ``limit`` bytes; null
    is the empty text."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if group and size + len(raw) > limit:
            yield first, group
            group, size, first = [], 0, i
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield first, group
