"""Token counts of every prefix of a text, by dynamic programming over the pieces of a byte-level BPE tokenizer.

The count of a prefix is the sum over the pieces before its last one, plus the last piece's prefix count, which the
table of the piece has (see ``bpe``).  Distinct pieces of a few megabytes of text get their tables once, all together.
The counts are stored with the text, so that "how many tokens has this prefix" and "which prefix fits a budget" are
lookups; nothing is encoded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .bpe import BytePairs
from .pieces import NUMBER, OTHER, SPACE, char_bytes, classes, code_points, contractions, tokenizer, unique_slices

BUDGET = 512
#: Pieces of more bytes than this are tabled one at a time, the others all together.
LONG_PIECE = 256

_OUT = "n_bytes long, n_tokens long, fits long, prefix_counts binary"


@cache
def _model(path: str) -> BytePairs:
    return BytePairs.from_file(path)


def _piece_marks(code: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]]:
    """(starts of all pieces, starts and ends of white space runs before a word, apostrophes with endings), in characters."""
    kind = classes(code, tokenizer(path))
    n = len(code)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:n]
    start = ~same
    space = kind == SPACE
    # The last of a run of white space before something else is a piece of its own; a plain space joins what follows.
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    run_last = np.flatnonzero(goes_on)
    start[run_last] = True
    joins = run_last[code[run_last] == 0x20]
    start[joins + 1] = False
    heads = np.flatnonzero(space & ~same)
    run_head = heads[np.searchsorted(heads, run_last, side="right") - 1] if len(run_last) else run_last
    long_run = run_last > run_head
    # An apostrophe that starts a piece and has an ending right after it.
    may = start & (kind == OTHER)
    ends = []
    for at, size in contractions(code, kind, may):
        inside = np.searchsorted(offs, at, side="right") == np.searchsorted(offs, at + size - 1, side="right")
        at = at[inside]
        for k in range(1, size):
            start[at + k] = False
        after = at + size
        after = after[after < n]
        start[after[kind[after] != SPACE]] = True
        ends.append((at, size))
    # ... what follows a space that joined keeps its place: after[...] above is never such a word's first letter.
    return np.flatnonzero(start), run_head[long_run], run_last[long_run], ends


def prefix_counts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(token counts of all prefixes by character, texts run together; n + 1 offsets); no special tokens inside."""
    buf, byte_offs = ws.text_buffers(texts)
    code, offs = code_points(texts)
    if not len(code):
        return np.zeros(0, np.int64), offs
    chars = char_bytes(buf)
    piece, run_head, run_last, endings = _piece_marks(code, offs, path)
    starts = chars[np.append(piece, run_head)]
    ends = chars[np.append(np.append(piece[1:], len(code)), run_last + 1)]
    n = len(piece)
    which, raw, at, size = unique_slices(buf, starts[:n], ends[:n]) if not len(run_head) else unique_slices(buf, starts, ends)
    model = _model(path)
    table_at = np.concatenate([[0], np.cumsum(size)])
    table = np.zeros(int(table_at[-1]), np.int32)
    short = np.flatnonzero(size <= LONG_PIECE)
    table[ws.ragged_range(table_at[short], size[short])] = model.prefix_counts(raw, at[short], size[short])
    for k in np.flatnonzero(size > LONG_PIECE):
        table[table_at[k] : table_at[k + 1]] = model.prefix_counts_of(raw[at[k] : at[k] + size[k]].tobytes())
    total = table[table_at[1:] - 1].astype(np.int64)
    # Tokens before each piece inside its text.
    before = np.concatenate([[0], np.cumsum(total[which[:n]])])
    text_first = np.searchsorted(piece, offs)
    of_text = np.searchsorted(offs, piece, side="right") - 1
    before_piece = before[:-1] - before[text_first[of_text]]
    length = ends[:n] - starts[:n]
    counts = table[ws.ragged_range(table_at[which[:n]], length)] + np.repeat(before_piece, length)
    counts = counts[chars[1:] - 1]
    # A prefix that ends with a run of white space has the whole run as one piece.
    if len(run_head):
        base = before_piece[np.searchsorted(piece, run_head, side="right") - 1]
        counts[run_last] = base + total[which[n:]]
    # A prefix that ends inside an ending of two letters has apostrophe and letter apart.
    for place, width in endings:
        if width == 3:
            counts[place + 1] = counts[place] + 1
    return counts, offs


def _split_specials(text: str, specials: list[str]) -> list[tuple[str, int]]:
    """Parts between special tokens; each part carries the special token after it but for its last character."""
    parts, at = [], 0
    while True:
        found = min(((text.find(s, at), s) for s in specials if text.find(s, at) >= 0), default=None)
        if found is None:
            return [*parts, (text[at:], len(text) - at)]
        parts.append((text[at : found[0]] + found[1][:-1], found[0] - at))
        at = found[0] + len(found[1])


def counts_of_batch(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Prefix counts by text, special tokens found as the library finds them."""
    specials = [t.content for t in tokenizer(path).get_added_tokens_decoder().values() if t.special]
    buf, offs = ws.text_buffers(texts)
    raw = buf.tobytes()
    spots = [s for s in specials if raw.find(s.encode()) >= 0]
    if not spots:
        counts, at = prefix_counts(texts, path)
        return [counts[a:b] for a, b in zip(at, at[1:])]
    parts = [_split_specials(raw[a:b].decode(errors="replace"), spots) for a, b in zip(offs, offs[1:])]
    counts, at = prefix_counts(pa.array([t for row in parts for t, _ in row], pa.string()), path)
    out, k = [], 0
    for row in parts:
        done, base = [], 0
        for i, (_, plain) in enumerate(row):
            own = counts[at[k] : at[k + 1]] + base
            done.append(own)
            if i + 1 < len(row):
                base = (int(own[plain - 1]) if plain else base) + 1
                done.append(np.array([base]))
            k += 1
        out.append(np.concatenate(done))
    return out


def pack_counts(counts: np.ndarray) -> bytes:
    """Differences of neighbouring counts: one signed byte each, or four where one of them does not fit."""
    steps = np.diff(counts, prepend=0)
    if len(steps) and (steps.min() < -128 or steps.max() > 127):
        return b"\x04" + steps.astype("<i4").tobytes()
    return b"\x01" + steps.astype("i1").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i4" if data[:1] == b"\x04" else "i1", offset=1).astype(np.int64))


def _run(text: str, path: str, budget: int, schema: pa.Schema, n_carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ws.chunks(batch, text):
                texts = piece.column(text)
                counts = counts_of_batch(texts, path)
                size = np.diff(ws.text_buffers(texts)[1])
                tokens = [int(c[-1]) if len(c) else 0 for c in counts]
                fits = [len(c) if t <= budget else int(np.flatnonzero(c <= budget)[-1]) + 1 if (c <= budget).any() else 0 for c, t in zip(counts, tokens)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:n_carried], pa.array(size.astype(np.int64)), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64()),
                                                  pa.array([pack_counts(c) for c in counts], pa.binary())], schema=schema)

    return run


def count_tokens(docs: DataFrame, path: str, *, carry: list[str], budget: int = BUDGET, text_col: str = "text") -> DataFrame:
    """``carry`` and every text's bytes, tokens, the longest prefix of at most ``budget`` tokens, and all prefix counts.

    ``n_tokens`` is what the tokenizer file's library gives without added tokens, special strings inside texts found.
    ``fits`` counts characters.  ``prefix_counts`` holds the count of every prefix by character (``unpack_counts``).
    A null text counts as empty: no bytes, no tokens.  Rows keep their partitions; repeated rows give repeated rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    out = StructType([*rows.drop("_text").schema.fields, *StructType.fromDDL(_OUT).fields])
    return rows.mapInArrow(_run("_text", path, budget, to_arrow_schema(out), len(carry)), out)
