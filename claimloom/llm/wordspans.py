"""Words of many texts at once: spans, 64-bit hashes and rolling window hashes on Arrow buffers with numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at a time; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def _byte_set(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Lookup table that is False for the given byte ranges, True elsewhere."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words between blanks: anything but space and U+0009 to U+000D.
BLANK_WORDS = _byte_set([(0x20, 0x20), (0x09, 0x0D)])
#: Words of letters and digits: ASCII letters and digits and everything beyond ASCII.
ALNUM_WORDS = _byte_set([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers; every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix((np.arange(1, 257, dtype=U64) * U64(_STEP)))
_BASE = 0xD1342543DE82EF95 | 1
_WINDOW_BASE = 0xA0761D6478BD642F | 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand and kept up to a bound."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = self._make(self.base, n), self._make(self.inverse, n)
            if n > 2 * CHUNK_BYTES:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]

    @staticmethod
    def _make(base: int, n: int) -> np.ndarray:
        out = np.full(n, U64(base))
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WINDOW_BASE)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, so that temporaries stay small; no row is left out."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    slot = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    give_back()


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free memory to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


#: Bytes that small pieces of work may have used before their memory is given back.
GIVE_BACK_BYTES = 16 << 20
_used = 0


def give_back(used: int | None = None) -> None:
    """Returns memory that Arrow and numpy have freed: a Python worker outlives its task and would keep it.

    That takes some milliseconds.  A caller with very many small pieces of work tells how many bytes it ``used``; memory
    then goes back once these add up.
    """
    global _used
    if used is not None:
        _used += used
        if _used < GIVE_BACK_BYTES:
            return
    _used = 0
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def spans(buf: np.ndarray, offs: np.ndarray, word: np.ndarray = BLANK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, n + 1 word offsets per text) of all words; a word never runs over the end of its text."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = word[buf]
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    firsts = offs[:-1][offs[:-1] < len(buf)]
    before[firsts] = False
    after[firsts[firsts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial in its bytes, then mixed with its length."""
    out = np.empty(len(starts), U64)
    low = 0
    while low < len(starts):  # a slice of the bytes at a time, so that sums and powers stay small
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + CHUNK_BYTES, side="right")))
        first, last = starts[low:high] - starts[low], ends[low:high] - starts[low]
        up, down = _BYTE_POWERS.get(int(last[-1]))
        total = np.zeros(int(last[-1]) + 1, U64)
        np.cumsum(_BYTE[buf[starts[low] : ends[high - 1]]] * up, out=total[1:])
        out[low:high] = mix((total[last] - total[first]) * down[first] + (last - first).astype(U64) * U64(_STEP))
        low = high
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rolling polynomial hash of ``width`` consecutive word hashes, one for every start (of all texts run together)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _WORD_POWERS.get(len(words))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n] + U64(width))


def window_starts(word_offs: np.ndarray, width: int) -> np.ndarray:
    """Index of the first word of every window that lies inside one text."""
    counts = np.maximum(np.diff(word_offs) - width + 1, 0)
    return ragged_range(word_offs[:-1], counts)


def ragged_range(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (counts[0] of them), then the same for the next one, ..."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - counts), counts)
