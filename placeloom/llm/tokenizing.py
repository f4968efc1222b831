"""Token ids of whole texts with the tokenizers library, a column at a time.

A byte-level BPE cuts a text before every space that a non-space follows, whatever surrounds it.
So a text is split there (and at other sure places), the distinct pieces of a batch are looked up or encoded once, and the
ids are gathered with numpy: the same ids as one encode of the whole text, several times faster.
Pieces of up to SHORT bytes are told apart by a 64-bit hash and remembered in arrays of bounded
size; longer ones are encoded each time. Texts in which a space precedes other white space, or that
may hold a special token, are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from placeloom.llm.shingles import span_hashes

#: A space before any white space, where the cut isn't sure, or the start of a special token.
UNSURE = "[ ][\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|<\\|"
#: Pieces that a worker remembers at most; the used ones stay when it forgets.
REMEMBERED = 2_000_000
#: Bytes of a piece that is remembered.
SHORT = 64
#: Rows and bytes of a small batch where several arrays of eight times its bytes are held at once: a worker keeps what it once took.
FINE = (256, 500_000)


_LETTER, _MARK, _SOLID = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[[x for x in range(33, 127) if not _LETTER[x]]] = True
#: Bytes that begin no white space: ASCII from ! on, and those of letters and signs beyond.
_SOLID[33:127] = True
_SOLID[0xC3:0xE1] = _SOLID[0xE4:] = True


def pieces_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first, lead) of the pieces of texts: where each lies, the first of each text, and whether a space leads it.

    Cuts that hold in any text: before a space that a non-space follows, around a single line feed between
    others than white space, and between a letter or digit and the punctuation up to the next cut.
    """
    spaces = np.flatnonzero(raw == 32)
    feeds = np.flatnonzero(raw[1:-1] == 10) + 1
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    feeds = feeds[(raw[feeds - 1] > 32) & (raw[feeds - 1] < 127) & _SOLID[raw[feeds + 1]] & ~edge[feeds] & ~edge[feeds + 1]]
    begin = np.sort(np.concatenate((offsets[:-1], spaces + 1, feeds, feeds + 1)), kind="stable")
    end = np.sort(np.concatenate((spaces, offsets[1:], feeds, feeds + 1)), kind="stable")
    first = np.arange(len(offsets) - 1) + np.searchsorted(spaces, offsets[:-1]) + 2 * np.searchsorted(feeds, offsets[:-1])
    lead = np.zeros(len(begin), bool)
    lead[begin > 0] = raw[begin[begin > 0] - 1] == 32
    lead[first] = False
    if len(raw):
        bare = np.maximum.accumulate(np.where(_MARK[raw], -1, np.arange(len(raw))))[np.maximum(end - 1, 0)]
        split = np.flatnonzero((bare >= begin) & (bare + 1 < end) & _LETTER[raw[np.maximum(bare, 0)]])
        more = np.zeros(len(begin) + 1, np.int64)
        more[split + 1] = 1
        at = bare[split] + 1
        begin, end, lead = np.insert(begin, split + 1, at), np.insert(end, split, at), np.insert(lead, split + 1, False)
        first = first + np.cumsum(more)[first]
    return begin, end, first, lead


class TextEncoder:
    """Encodes Arrow columns of texts; one for each vocabulary file and Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys, self.used = np.empty(0, np.uint64), np.empty(0, bool)
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _remember(self, keys: np.ndarray, found: list[np.ndarray]) -> None:
        """Adds sorted new keys and their ids."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(size) - size)
        self.size, self.used, self.keys = np.insert(self.size, at, size), np.insert(self.used, at, True), np.insert(self.keys, at, keys)
        self.ids = np.concatenate([self.ids, *found])

    def _shrink(self) -> None:
        """Keeps what was used since the last time, if that is little enough."""
        keep = np.flatnonzero(self.used)
        if len(keep) > REMEMBERED // 2:
            return self._forget()
        start, size = self.start[keep], self.size[keep]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        self.keys, self.start, self.size, self.used = self.keys[keep], ends - size, size, np.zeros(len(keep), bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        unsure = np.asarray(pc.match_substring_regex(texts, UNSURE))
        plain = pc.if_else(pa.array(unsure), "", texts) if unsure.any() else texts
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        raw = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begin, end, first, lead = pieces_of(raw, offsets)
        hashes = span_hashes(raw, begin, end) + lead
        spelled = lambda i: (" " if lead[i] else "") + raw[begin[i] : end[i]].tobytes().decode()

        if len(self.keys) > REMEMBERED:
            self._shrink()
        short = np.flatnonzero(end - begin <= SHORT)
        wanted, sample, back = np.unique(hashes[short], return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, wanted)
        new = np.ones(len(wanted), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != wanted[at < len(self.keys)]
        if new.any():
            self._remember(wanted[new], self._encoded([spelled(i) for i in short[sample[new]]]))
            at = np.searchsorted(self.keys, wanted)
        self.used[at] = True
        long = np.flatnonzero(end - begin > SHORT)
        more = self._encoded([spelled(i) for i in long]) if len(long) else []
        more_size = np.fromiter(map(len, more), np.int64, len(more))
        pool = np.concatenate([self.ids, *more]) if more else self.ids
        start, size = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        start[short], size[short] = self.start[at][back], self.size[at][back]
        start[long], size[long] = len(self.ids) + np.cumsum(more_size) - more_size, more_size
        ends = np.cumsum(size)
        out = pool[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        lengths = np.add.reduceat(size, first)
        if unsure.any():
            rows = np.split(out, np.cumsum(lengths)[:-1])
            which = np.flatnonzero(unsure)
            for i, ids in zip(which, self._encoded(texts.take(pa.array(which)).to_pylist()), strict=True):
                rows[i] = ids
            out, lengths = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        return out, lengths


@functools.cache
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> list[np.ndarray]:
    """The ids of each text, the end id after them."""
    rows = np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []
    tail = np.array([end], ids.dtype)
    return [np.concatenate(x) for x in zip(rows, itertools.repeat(tail))]


def small_batches(batches, rows: int = 1024, chars: int = 2_000_000, column: str = "text"):
    """Record batches of bounded text size: a few very long texts don't meet in one batch."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(size, base + chars, "right"))))
            yield batch.slice(at, end - at)
            at = end
