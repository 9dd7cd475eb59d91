"""Token ids of all documents in id order, written as compressed, checksummed blocks and read back.

The file format is a Parquet table of segments.  A segment holds the documents of some megabytes of text, in order:
their ids and token counts, and their token ids cut into blocks that the range coder compresses.  Blocks are reset and
carry the number and crc32 of their ids, so any block can be read alone and damage is found.  (part, segment) orders
the file; nothing else is needed to read it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from . import wordspans as ws
from .pieces import NUMBER, OTHER, SPACE, classes, contractions, tokenizer
from .tables import cut_lineage, scratch_path

END_ID = 1
#: Bytes of text in a segment.
SEGMENT_BYTES = 12 << 20
#: Bytes of text whose distinct pieces are found together.
CHUNK_BYTES = 2 << 20

_SEGMENT = "part int, segment int, n_ids long, doc_ids array<{id}>, n_tokens array<int>, block_ids array<int>, block_crc32 array<long>, blocks array<binary>"


#: Pieces whose ids a worker keeps; a table that is full starts anew.
KNOWN_PIECES = 1 << 18
#: Pieces that the library encodes in one call.
_TOGETHER = 500
#: Code points below this, but one, are found alike before and after the library normalises a text.
_PLAIN = 0x250


@cache
def _kinds(path: str) -> np.ndarray:
    """Class of every plain code point."""
    return classes(np.arange(_PLAIN), tokenizer(path))


class _Pieces:
    """The ids of pieces as the library gives them, each asked for once."""

    def __init__(self, path: str) -> None:
        self.library = tokenizer(path)
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 15, np.int64)

    def _encode(self, letters: list[bytes], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece).  Pieces of a to z, which nothing but merging changes, go to the library's
        model.  Others go together with spaces between them; where the ids do not show as many ends of words as there
        are pieces, each goes alone."""
        merge = self.library.model.tokenize
        merged = [[token.id for token in merge(p.decode())] for p in letters]
        groups = [pieces[k : k + _TOGETHER] for k in range(0, len(pieces), _TOGETHER)]
        ids, widths = [np.array([i for m in merged for i in m], np.int32)], [np.array([len(m) for m in merged], np.int64)]
        for group, found in zip(groups, self.library.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            own = np.array(found.ids, np.int32)
            last = np.flatnonzero(self.ends[own])
            if len(last) == len(group) and last[-1] == len(own) - 1:
                widths.append(np.diff(last, prepend=-1))
            else:
                alone = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in group], add_special_tokens=False)]
                own, width = np.array([i for e in alone for i in e], np.int32), np.array([len(e) for e in alone])
                widths.append(width)
            ids.append(own)
        return np.concatenate(ids), np.concatenate(widths)

    def find(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first, number) of the ids of each of these distinct pieces in ``ids``."""
        if len(self.row) + len(pieces) > KNOWN_PIECES:
            self.forget()
        rows = np.fromiter(map(self.row.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            by_kind: tuple[list[int], list[int]] = [], []
            for k in fresh.tolist():
                by_kind[not pieces[k].isalpha()].append(k)  # of bytes: true for ASCII letters only
            letters, others = ([pieces[k] for k in ks] for ks in by_kind)
            fresh, new = np.array(by_kind[0] + by_kind[1]), letters + others
            ids, widths = self._encode(letters, others)
            n, last = len(self.row), int(self.at[len(self.row)])
            self.row.update(zip(new, range(n, n + len(new))))
            if n + len(new) >= len(self.at):
                self.at = np.concatenate([self.at, np.zeros(len(self.at) + len(new), np.int64)])
            if last + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.int32)])
            self.ids[last : last + len(ids)] = ids
            self.at[n + 1 : n + 1 + len(new)] = last + np.cumsum(widths)
            rows[fresh] = n + np.arange(len(new))
        return self.at[rows], self.at[rows + 1] - self.at[rows]


@cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def _kind_of_bytes(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character that every byte is of, places of bytes that are of no plain character)."""
    kinds = _kinds(path)
    kind = np.concatenate([kinds[:0x80], np.full(0x80, OTHER, kinds.dtype)])[buf]
    high = np.flatnonzero(buf >= 0x80)
    if not len(high):
        return kind, high
    byte = buf[high]
    begins = np.zeros(len(buf) + 1, bool)
    begins[offs] = True
    # A plain character is a byte C2 to C9 and one of 80 to BF after it in the same text.
    leads = (byte >= 0xC2) & (byte <= 0xC9)
    whole = np.zeros(len(high), bool)
    whole[:-1] = leads[:-1] & (byte[1:] < 0xC0) & (high[1:] == high[:-1] + 1) & ~begins[high[1:]]
    first = np.flatnonzero(whole)
    code = ((byte[first].astype(np.int64) & 0x1F) << 6) | (byte[first + 1] & 0x3F)
    plain = (code < _PLAIN) & (code != 0x130)  # the lower case of 0x130 is two characters
    first = first[plain]
    kind[high[first]] = kind[high[first] + 1] = kinds[code[plain]]
    strange = np.ones(len(high), bool)
    strange[first] = strange[first + 1] = False
    return kind, high[strange]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts run together, n + 1 offsets), as the library gives them without added tokens.

    The library encodes every distinct piece once.  Texts with characters or strings that its normaliser or its
    special tokens treat across pieces are given to it whole.
    """
    library = tokenizer(path)
    buf, offs = ws.text_buffers(texts)
    n, n_texts = len(buf), len(offs) - 1
    raw = buf.tobytes()
    kind, strange = _kind_of_bytes(buf, offs, path)
    odd = np.zeros(n_texts, bool)
    odd[np.searchsorted(offs, strange, side="right") - 1] = True
    for special in (t.content.encode() for t in library.get_added_tokens_decoder().values()):
        at = raw.find(special)
        while at >= 0:
            odd[np.searchsorted(offs, at, side="right") - 1] = True
            at = raw.find(special, at + 1)
    for i in np.flatnonzero(odd).tolist():  # no pieces of these
        kind[offs[i] : offs[i + 1]] = SPACE
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & ((buf[1:] & 0xC0) != 0x80))
    start[offs] = True
    start = start[:n]
    small = ws.LOWER[buf]
    for at, size in contractions(small, kind, start & (kind == OTHER)):
        inside = np.searchsorted(offs, at, side="right") == np.searchsorted(offs, at + size - 1, side="right")
        at = at[inside]
        for k in range(1, size):
            start[at + k] = False
        after = at + size
        start[after[after < n]] = True
    begin = np.flatnonzero(start)
    size = np.diff(begin, append=n)
    use = kind[begin] != SPACE
    begin, size = begin[use], size[use]
    ids, counts = np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
    if len(begin):
        places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(small[kind != SPACE])])
        coded = array.dictionary_encode()
        known = _pieces(path)
        words, cuts = ws.text_buffers(coded.dictionary)
        words, cuts = words.tobytes(), cuts.tolist()
        at, width = known.find([words[x:y] for x, y in zip(cuts, cuts[1:])])
        which = coded.indices.to_numpy()
        width = width[which]
        ids = known.ids[ws.ragged_range(at[which], width)]
        upto = np.concatenate([[0], np.cumsum(width)])
        counts = np.diff(upto[np.searchsorted(begin, offs)])
    if not odd.any():
        return ids, np.concatenate([[0], np.cumsum(counts)])
    plain_at, parts = np.concatenate([[0], np.cumsum(counts)]), []
    for i in range(n_texts):
        own = np.array(library.encode(raw[offs[i] : offs[i + 1]].decode(errors="replace"), add_special_tokens=False).ids, np.int32) if odd[i] else ids[plain_at[i] : plain_at[i + 1]]
        parts.append(own)
        counts[i] = len(own)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def _segments(path: str, end_id: int, vocabulary: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(part: int, segment: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, counts = [], []
        texts = pa.chunked_array([p.column("_text") for p in pieces]).combine_chunks()
        for small in ws.chunks(pa.record_batch([texts], names=["_text"]), "_text", CHUNK_BYTES):
            own, offs = encode_texts(small.column("_text"), path)
            ids.append(np.insert(own, offs[1:], end_id))
            counts.append(np.diff(offs) + 1)
        stream = np.concatenate(ids)
        blocks = rangecoder.encode(stream, vocabulary)
        doc_ids = pa.chunked_array([p.column(0) for p in pieces]).combine_chunks()
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(stream)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([np.concatenate(counts)], pa.list_(pa.int32())),
            pa.array([[b[0] for b in blocks]], pa.list_(pa.int32())), pa.array([[b[1] for b in blocks]], pa.list_(pa.int64())),
            pa.array([[b[2] for b in blocks]], pa.list_(pa.binary()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for piece in ws.chunks(batch, "_text"):
                held.append(piece)
                size += len(ws.text_buffers(piece.column("_text"))[0])
                if size >= SEGMENT_BYTES:
                    yield row(part, segment, held)
                    segment, held, size = segment + 1, [], 0
                    ws.give_back()
        if held:
            yield row(part, segment, held)

    return run


def write_ids(docs: DataFrame, path: str, out: str, *, by_id: bool = True, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of every text, each text closed by ``end_id``, in ascending order of the documents' ids.

    A null text counts as empty.  Documents without an id come first; documents that share an id are ordered by a
    hash of their text, so equal rows are the only ties and their order cannot be seen.  Without ``by_id`` rows stay
    in the order and the partitions they come in, for input that is already in the order wanted.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    vocabulary = max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_tie"))
    schema = StructType.fromDDL(_SEGMENT.format(id=rows.schema["_id"].dataType.simpleString()))
    ordered = rows.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie") if by_id else rows
    ordered = ordered.select("_id", "_text")
    ordered.mapInArrow(_segments(path, end_id, vocabulary, to_arrow_schema(schema)), schema).write.option("compression", "none").parquet(out)


def _read(vocabulary: int, schema: pa.Schema, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                own = lambda name: one.column(name)[0].values
                ids = rangecoder.decode(list(zip(own("block_ids").to_pylist(), own("block_crc32").to_pylist(), own("blocks").to_pylist())), vocabulary)
                counts = own("n_tokens").to_numpy()
                offs = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                raw = memoryview(ids.astype("<u4").tobytes())
                n = len(counts)
                cuts = (4 * offs).tolist()
                columns = [
                    pa.array(np.repeat(one.column("part").to_numpy(), n)), pa.array(np.repeat(one.column("segment").to_numpy(), n)), own("doc_ids"),
                    pa.array(offs[:-1]), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:])], pa.int64())]
                if with_ids:
                    columns.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.array(cuts, np.int32)), pa.py_buffer(raw)]))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            ws.give_back()

    return run


def read_ids(spark: SparkSession, path: str, stored: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian, four bytes each).

    Without ``with_ids`` they are read and checked in the same way, but do not leave the task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    vocabulary = max(tokenizer(path).get_vocab_size(with_added_tokens=True), END_ID + 1)
    segments = spark.read.parquet(stored)
    # Offsets: of parts from one number per part, of segments inside their part.
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut_lineage(sizes.withColumn("_inside", inside).join(parts.select("part", before.alias("_before")), "part")
                         .select("part", "segment", (F.col("_inside") + F.col("_before")).alias("_start")))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    out = StructType.fromDDL(f"part int, segment int, doc_id {kind}, first long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    read = segments.drop("n_ids").mapInArrow(_read(vocabulary, to_arrow_schema(out), with_ids), out)
    return read.join(starts, ["part", "segment"]).select("doc_id", (F.col("_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def stored_ids(docs: DataFrame, path: str, *, with_ids: bool = True, **options) -> DataFrame:
    """Writes the ids to a new folder of the shared space and reads them back.  An empty table gives an empty one."""
    spark = docs.sparkSession
    out = scratch_path(spark, "ids")
    write_ids(docs, path, out, **options)
    return read_ids(spark, path, out, with_ids=with_ids)
