"""Words of letters, digits and non-ASCII characters (A-Z lower-cased), and their CRC, a whole Arrow column at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from placeloom.llm.shingles import span_hashes

#: What parts words, once A-Z are lower-cased: every ASCII character but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """The words of some texts: bytes starts[i] to ends[i] of raw, in text row[i] of `texts` in all."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    texts: int

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.raw.astype(np.uint64), self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)

    def beginnings(self, letters: int) -> np.ndarray:
        """A 64-bit hash of the first `letters` characters of each word, of all of a shorter one; other ones than of words."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        first = (self.raw & 0xC0) != 0x80
        at = np.append(np.flatnonzero(first), np.full(letters, len(self.raw)))
        ends = np.minimum(self.ends, at[np.cumsum(first)[self.starts] - 1 + letters])
        return ~span_hashes(self.raw.astype(np.uint64), self.starts, ends)

    def counts(self) -> np.ndarray:
        """How many words each text has."""
        return np.bincount(self.row, minlength=self.texts)

    def follows(self) -> np.ndarray:
        """Which words have one before them in their text."""
        out = np.zeros(len(self.row), bool)
        out[1:] = self.row[1:] == self.row[:-1]
        return out


def words_of(texts: pa.Array) -> Words:
    """The words of whole texts; a null one has none."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]] if n else np.empty(0, np.uint8)
    if not len(raw):
        none = np.empty(0, np.int64)
        return Words(raw, none, none, none, n)
    offsets = offsets - offsets[0]
    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return Words(raw, starts, ends, np.searchsorted(offsets, starts, "right") - 1, n)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table()
#: State of the CRC before the first byte; the CRC is the state with all bits turned.
CRC_START = np.uint32(0xFFFFFFFF)


def crc_step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """States after one byte more each."""
    return _CRC[(state ^ np.asarray(byte, np.uint32)) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc_on(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """States after the bytes starts[i] to ends[i] of raw each, byte by byte for all at once, longest first."""
    order = np.argsort(starts - ends, kind="stable")
    state, starts, lengths = state[order].astype(np.uint32), starts[order], (ends - starts)[order]
    # how many are longer than k bytes
    longer = len(lengths) - np.cumsum(np.bincount(lengths)) if len(lengths) else []
    for k, n in enumerate(longer):
        if n:
            state[:n] = crc_step(state[:n], raw[starts[:n] + k])
    out = np.empty_like(state)
    out[order] = state
    return out


class Index:
    """Numbers 0, 1, ... of known 64-bit hashes, looked up in an open table of slots."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.append(np.asarray(hashes, np.uint64), np.uint64(0))
        self.mask = np.uint64((1 << max(4, int(4 * len(self.known)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, len(self.known) - 1, np.int32)
        self.steps = 0
        left = np.arange(len(hashes), dtype=np.int32)
        while len(left):
            at = (self.known[left] + np.uint64(self.steps)) & self.mask
            free = self.slots[at] == len(self.known) - 1
            self.slots[at[free][::-1]] = left[free][::-1]
            left = left[self.slots[at] != left]
            self.steps += 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        for step in range(self.steps):
            slot = self.slots[(hashes[left] + np.uint64(step)) & self.mask]
            hit = (self.known[slot] == hashes[left]) & (slot < len(self.known) - 1)
            out[left[hit]] = slot[hit]
            left = left[~hit & (slot < len(self.known) - 1)]
        return out
