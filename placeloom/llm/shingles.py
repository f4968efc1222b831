"""Sets of word shingles as sorted 64-bit hashes, worked out for a whole Arrow column with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (A-Z lower-cased), and the row it is of."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    words = span_hashes(_LOWER[raw], starts, ends)
    return words, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `size` words, and where each text's begin.

    A text with fewer words has one shingle of all; one without words, or null, has none.
    """
    n = len(texts)
    words, row = word_hashes(texts)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    count = np.bincount(row, minlength=n)
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total += mixed(words[k : len(words) - size + 1 + k] + np.uint64(k)) * np.uint64(2 * k + 1) if len(total) else 0
    same = row[: len(total)] == row[size - 1 :] if len(total) else np.empty(0, bool)
    hashes, owner = mixed(total[same]), row[: len(total)][same]
    few = (count > 0) & (count < size)
    if few.any():
        first = np.cumsum(count) - count
        short = np.zeros(n, np.uint64)
        for k in range(size - 1):
            has = few & (count > k)
            short[has] += mixed(words[first[has] + k] + np.uint64(k)) * np.uint64(2 * k + 1)
        which = np.flatnonzero(few)
        hashes = np.concatenate((hashes, mixed(short[which] + count[which].astype(np.uint64))))
        owner = np.concatenate((owner, which))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set: equal sets have equal names."""
    sums = lambda x: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[bounds])
    return mixed(sums(mixed(hashes))), mixed(sums(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))))
