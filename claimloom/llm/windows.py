"""Substring deduplication: hashes of every fixed-length word window are counted, repeated windows are removed.

A window's hash is a rolling polynomial over its words' hashes (Rabin-Karp, modulo 2**64).  Texts are handled in
chunks of a few megabytes.  Every chunk sends each bucket of the hash range its distinct hashes, and the bucket
answers which of them occur in another chunk too.  A window that repeats inside its chunk needs no answer, so a
passage that a third of all documents share costs one hash per chunk.  The texts themselves travel once, compressed
by chunk, to meet the answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws

WIDTH = 35
#: Bytes of text that make one bucket of the hash range, so that a bucket stays small however large the input is.
BYTES_PER_BUCKET = 4 << 20
#: Bytes of text in one chunk.
CHUNK = 4 * ws.CHUNK_BYTES

_SENT = "bucket int, chunk string, hashes binary, places binary, repeated binary"
_MEET = "chunk string, texts binary, places binary"
_OUT = "n_words long, removed array<struct<first:int,end:int>>, text string"


def _numbered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Chunks with a name that a second reading of the same partition gives again."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in ws.chunks(batch, text, CHUNK):
            yield f"{part}-{n}", piece
            n += 1


def _windows(texts: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Bytes, word spans, word offsets, first word of every window and the windows' hashes."""
    buf, offs = ws.text_buffers(texts)
    starts, ends, words = ws.spans(buf, offs, ws.BLANK_WORDS)
    first = ws.window_starts(words, width)
    hashes = ws.window_hashes(ws.word_hashes(buf, starts, ends), width)[first] if len(first) else np.zeros(0, ws.U64)
    return buf, starts, ends, words, first, hashes


def _alone(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, their places, mask of those that occur once)."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    once = np.ones(len(ordered), bool)
    once[1:] &= ~same
    once[:-1] &= ~same
    return ordered, order, once


def _pack(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of every number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _send(text: str, width: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = (64 - bits + 7) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, piece in _numbered(batches, text):
            hashes = _windows(piece.column(text), width)[5]
            if not len(hashes):
                continue
            ordered, order, once = _alone(hashes)
            head = np.ones(len(ordered), bool)
            head[1:] = ordered[1:] != ordered[:-1]
            single, many = ordered[once], ordered[head & ~once]
            # In text order the places are small gaps, which compress well.
            places = order[once]
            bucket = (single >> ws.U64(64 - bits)).astype(np.int64)
            by = np.lexsort((places, bucket))
            single, places, bucket = single[by], places[by], bucket[by]
            many_bucket = (many >> ws.U64(64 - bits)).astype(np.int64)
            rows: dict[str, list] = {k: [] for k in ("bucket", "chunk", "hashes", "places", "repeated")}
            for b in np.union1d(bucket, many_bucket).tolist():
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                mlo, mhi = np.searchsorted(many_bucket, [b, b + 1])
                rows["bucket"].append(b)
                rows["chunk"].append(name)
                rows["hashes"].append(_pack(single[lo:hi], size))
                rows["places"].append(_pack(np.diff(places[lo:hi], prepend=0), 3))
                rows["repeated"].append(_pack(many[mlo:mhi], size))
            yield pa.record_batch([pa.array(rows["bucket"], pa.int32()), pa.array(rows["chunk"], pa.string()), *(pa.array(rows[k], pa.binary()) for k in ("hashes", "places", "repeated"))],
                                  names=list(rows))

    return run


def _answer(bits: int) -> Callable[[pa.Table], pa.Table]:
    size = (64 - bits + 7) // 8

    def run(table: pa.Table) -> pa.Table:
        ws.give_back()  # of the bucket before
        single = [_unpack(x, size) for x in table["hashes"].to_pylist()]
        many = [_unpack(x, size) for x in table["repeated"].to_pylist()]
        ordered = np.sort(np.concatenate([*single, *many, *many]))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        names, places = [], []
        if len(twice):
            for name, own, gaps in zip(table["chunk"].to_pylist(), single, table["places"].to_pylist()):
                at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
                found = twice[at] == own
                if found.any():
                    names.append(name)
                    places.append(np.cumsum(_unpack(gaps, 3).astype(np.int64))[found].astype("<u4").tobytes())
        return pa.table({"chunk": pa.array(names, pa.string()), "texts": pa.nulls(len(names), pa.binary()), "places": pa.array(places, pa.binary())})

    return run


def _texts(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, piece in _numbered(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(piece)
            yield pa.record_batch([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.binary())], names=["chunk", "texts", "places"])

    return run


def _cut(text: str, width: int, arrow_out: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        ws.give_back()
        packed = [x for x in table["texts"].to_pylist() if x is not None]
        if len(packed) != 1:
            raise RuntimeError(f"chunk {table['chunk'][0]} came {len(packed)} times: the table was split in another way when it was read again")
        piece = pa.ipc.open_stream(packed[0]).read_all().combine_chunks()
        texts = piece.column(text)
        buf, starts, ends, words, first, hashes = _windows(texts, width)
        gone = np.zeros(len(starts) + 1, np.int64)
        if len(hashes):
            _, order, once = _alone(hashes)
            bad = np.zeros(len(hashes), bool)
            bad[order[~once]] = True
            for x in table["places"].to_pylist():
                if x is not None:
                    bad[np.frombuffer(x, "<u4")] = True
            np.add.at(gone, first[bad], 1)
            np.add.at(gone, first[bad] + width, -1)
        removed = np.cumsum(gone)[:-1] > 0
        return pa.table([piece.column(0), *_results(buf, starts, ends, words, removed, texts)], schema=arrow_out)

    return run


def _results(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, removed: np.ndarray, texts: pa.Array) -> list[pa.Array]:
    n_rows = len(words) - 1
    row = np.repeat(np.arange(n_rows), np.diff(words))
    # Maximal runs of removed words, by row.
    edge = np.ones(len(removed), bool)
    edge[1:] = (removed[1:] != removed[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(edge & removed)
    run_ends = np.append(np.flatnonzero(edge), len(removed))
    tails = run_ends[np.searchsorted(run_ends, heads, side="right")] if len(heads) else heads
    base = words[:-1][row[heads]] if len(heads) else heads
    per_row = np.searchsorted(row[heads], np.arange(n_rows + 1)) if len(heads) else np.zeros(n_rows + 1, np.int64)
    spans = pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array((heads - base).astype(np.int32)), pa.array((tails - base).astype(np.int32))], names=["first", "end"]))
    keep = ~removed
    # Kept words with one space after each but a row's last.
    length = ends[keep] - starts[keep] + 1
    last = np.zeros(len(length), bool)
    kept_row = row[keep]
    last[-1:] = True
    last[:-1] = kept_row[1:] != kept_row[:-1]
    out = np.append(buf, np.uint8(0x20))[ws.ragged_range(starts[keep], length)]
    stop = np.cumsum(length)
    out[stop - 1] = 0x20
    if last.any():
        drop = np.ones(len(out), bool)
        drop[stop[last] - 1] = False
        out = out[drop]
    size = np.bincount(kept_row, weights=length - last, minlength=n_rows).astype(np.int64) if len(kept_row) else np.zeros(n_rows, np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), n_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    return [pa.array(np.diff(words).astype(np.int64)), spans, text]


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that a repeated window covers; one row per input row.

    Returns the id, ``n_words``, ``removed`` (maximal runs of removed words as [first, end) word numbers) and ``text``
    (kept words joined by one space).  A window is repeated if its words also start anywhere else, in the same text
    or another; windows are judged on the input.  Texts of fewer than ``width`` words keep all words; null and empty
    texts have none and keep an empty text.  Repeated rows repeat all their windows.  Other columns are ignored, ids
    may be null or shared.

    Equality is equality of 64-bit hashes: among n distinct windows about n**2 / 2**65 pairs collide by chance.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    narrow = docs.select(id_col, text_col)
    size = narrow.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(24, max(4, math.ceil(math.log2(max(size, 1) / BYTES_PER_BUCKET + 1))))
    sent = narrow.mapInArrow(_send(text_col, width, bits), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answer(bits), _MEET)
    meet = narrow.mapInArrow(_texts(text_col), _MEET).unionByName(answers)
    out = StructType([narrow.schema[id_col], *StructType.fromDDL(_OUT).fields])
    return meet.groupBy("chunk").applyInArrow(_cut(text_col, width, to_arrow_schema(out)), out)
