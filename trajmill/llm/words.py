"""Vectorised hashing of words and shingles in batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, extended on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.ones(max(n, BLOCK_BYTES + 1024), np.uint64)
            for name, base in (("up", _BASE), ("down", _BACK)):
                steps[1:] = base
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, list]]:
    """Ranges of whole texts of about ``limit`` bytes, with their texts; no more of an Arrow batch than a piece becomes Python strings at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(size):
        held = size[first - 1] if first else 0
        end = min(int(np.searchsorted(size, held + limit)) + 1, len(size))
        yield first, end, column.slice(first, end - first).to_pylist()
        first = end


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and for each text the index of its first word (and the end)."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    begin = np.concatenate([[1], 1 + np.cumsum([len(r) + 1 for r in raw])])
    space = _SPACE[buf]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:])
    up, down = POWERS.upto(len(buf))
    total = np.cumsum(_BYTE[buf] * up)
    return mixed((total[last] - total[first - 1]) * down[first]), np.searchsorted(first, begin)


def shingles(texts: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside the text, and each text's first index (and the end).

    A text with fewer words than a shingle has one shingle, its whole word sequence; one without words has none.
    """
    hashes, at = word_hashes(texts)
    n = len(hashes)
    value = np.zeros(n, np.uint64)
    weight = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(words)], np.uint64)
    for j in range(min(words, n)):
        value[: n - j] += hashes[j:] * weight[j]
    count = np.diff(at)
    owner = np.repeat(np.arange(len(texts)), count)
    left = at[1:][owner] - np.arange(n)  # words from here to the end of the text
    keep = left >= words
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        for i in short:  # at most words - 1 hashes each
            value[at[i]] = (hashes[at[i]: at[i + 1]] * weight[: count[i]]).sum() + np.uint64(count[i])
        keep[at[:-1][short]] = True
    value, owner = mixed(value[keep]), owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))
