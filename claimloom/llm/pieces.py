"""Pieces that tokenizers cut texts into before merging, for many texts at once, and tokenizer files by path."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import wordspans as ws
from .language import code_points

OTHER, LETTER, NUMBER, SPACE, OPEN = range(5)
# White space of Unicode.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Endings that the tokenizers' patterns keep with their apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _classes() -> np.ndarray:
    of = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        of[code] = LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OPEN if category == "Cn" else OTHER
    of[list(WHITE_SPACE)] = SPACE
    return of


def classes(code: np.ndarray, byte_level: Tokenizer) -> np.ndarray:
    """Class of every code point.  The library knows later characters than Python does; those are asked for once."""
    table = _classes()
    out = table[code]
    if (out == OPEN).any():
        for new in np.unique(code[out == OPEN]).tolist():
            spans = [s for _, s in byte_level.pre_tokenizer.pre_tokenize_str(f"x{chr(new)}1")]
            table[new] = LETTER if spans[0] == (0, 2) else NUMBER if spans[-1] == (1, 3) else OTHER
        out = table[code]
    return out


def contractions(code: np.ndarray, kind: np.ndarray, may_start: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(places, length) of apostrophes with an ending: an apostrophe that starts a run of symbols of length one."""
    at = np.flatnonzero((code == 0x27) & may_start)
    at = at[at + 1 < len(code)]
    found, left = [], at
    padded = np.append(code, np.zeros(2, code.dtype))
    for ending in ENDINGS:
        match = np.ones(len(left), bool)
        for k, char in enumerate(ending):
            match &= padded[left + 1 + k] == ord(char)
        found.append((left[match], 1 + len(ending)))
        left = left[~match]
    return found


def char_bytes(buf: np.ndarray) -> np.ndarray:
    """Byte places where characters start, and the end."""
    return np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))


def unique_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct byte slices: (index of each slice's text, bytes of the distinct texts, their starts, their lengths)."""
    if len(starts) and (starts[1:] == ends[:-1]).all():
        data, offsets = buf[starts[0] : ends[-1]], np.append(starts, ends[-1]) - starts[0]
    else:
        data = buf[ws.ragged_range(starts, ends - starts)]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    coded = array.dictionary_encode()
    raw, offs = ws.text_buffers(coded.dictionary)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), raw, offs[:-1], np.diff(offs)


__all__ = ["LETTER", "NUMBER", "OTHER", "SPACE", "char_bytes", "classes", "code_points", "contractions", "tokenizer", "unique_slices"]
