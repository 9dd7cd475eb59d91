"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches.  A run is a table of (line, documents, largest id), bucketed and sorted by the line's hash.
A batch merge-anti-joins the runs there are: lines that a run already knows well enough add nothing.  What is left
becomes a run of its own on the lowest level.  A level holds one run; a second one is merge-joined with it into a run
of the next level.  Runs and batches share the buckets, so that runs are never shuffled again.

Whether a line goes is known when all batches are in.  Lines that alone make up a ten-thousandth of a batch are few
(a fixed number per batch at most) and reach their documents by broadcast, all others by a shuffle, in which none of
them weighs anything.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, settle
from . import wordspans as ws

MIN_CHARS, MIN_DOCS = 20, 3
#: Batches that the documents are dealt to by descending id.
BATCHES = 4
#: A line with this part of a batch's lines is hot; a batch has no more hot lines than this number.
HOT = 10_000


def lines_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, n + 1 line offsets per text); a text of k line feeds has k + 1 lines."""
    feeds = np.flatnonzero(buf == 0x0A)
    starts, ends = np.sort(np.concatenate([offs[:-1], feeds + 1])), np.sort(np.concatenate([feeds, offs[1:]]))
    return starts, ends, np.searchsorted(feeds, offs) + np.arange(len(offs))


def line_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the lines whose key has ``min_chars`` code points, hashes of their keys)."""
    solid = np.flatnonzero(ws.BLANK_WORDS[buf])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    which = np.flatnonzero(high - low > 0)
    first, last = solid[low[which]], solid[high[which] - 1] + 1
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    long = points[last] - points[first] >= min_chars
    return which[long], ws.word_hashes(ws.LOWER[buf], first[long], last[long])


def _hash_lines(text: str, min_chars: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ws.chunks(batch, text):
                buf, offs = ws.text_buffers(piece.column(text))
                starts, ends, lines = lines_of(buf, offs)
                which, hashes = line_keys(buf, starts, ends, min_chars)
                row = np.searchsorted(lines, which, side="right") - 1
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                own = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(own), piece.column(1).take(own), pa.array(hashes[new].view(np.int64))], schema=schema)

    return run


def _cut(text: str, min_chars: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ws.chunks(batch, text):
                texts = pc.fill_null(piece.column(text), "")
                buf, offs = ws.text_buffers(texts)
                starts, ends, lines = lines_of(buf, offs)
                keep = np.ones(len(starts), bool)
                gone = piece.column("_gone")
                hit = np.flatnonzero(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
                if len(hit):
                    which, hashes = line_keys(buf, starts, ends, min_chars)
                    bounds = np.searchsorted(which, lines)
                    for r in hit.tolist():
                        a, b = bounds[r], bounds[r + 1]
                        keep[which[a:b][np.isin(hashes[a:b], gone[r].values.to_numpy().view(ws.U64))]] = False
                    texts = _join(buf, starts, ends, lines, keep)
                dropped = np.concatenate([[0], np.cumsum(~keep)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(lines)), pa.array(np.diff(dropped[lines])), texts.cast(pa.string())], schema=schema)

    return run


def _join(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Kept lines of every text with one line feed between them."""
    row = np.repeat(np.arange(len(lines) - 1), np.diff(lines))[keep]
    size = (ends - starts)[keep] + 1
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    out = np.append(buf, np.uint8(0x0A))[ws.ragged_range(starts[keep], size)]
    stop = np.cumsum(size)
    out[stop - 1] = 0x0A
    stays = np.ones(len(out), bool)
    stays[stop[last] - 1] = False
    total = np.bincount(row, weights=size - last, minlength=len(lines) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(total)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lines) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[stays].tobytes())])


class LineRuns:
    """Levels of sorted runs in the shared folder: (line, n, top, hot), one row per line in a run."""

    def __init__(self, spark: SparkSession, *, min_docs: int = MIN_DOCS) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def add(self, held: DataFrame, hot_from: int) -> None:
        """``held``: (id, line), one row per document and line.  Lines of ``hot_from`` documents are marked as hot.

        A line that a run has in ``min_docs`` documents, one of them with a larger id, needs no further row.
        """
        own = held.groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("top")).withColumn("hot", F.col("n") >= hot_from)
        for run in self.runs():
            known = run.filter(F.col("n") >= self.min_docs).select(F.col("line").alias("_line"), F.col("top").alias("_top"))
            beaten = F.coalesce(F.col("top") <= F.col("_top"), F.col("top").isNull())
            own = own.join(known, (F.col("line") == F.col("_line")) & ~F.col("hot") & beaten, "left_anti")
        run, level = self._write(own), 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._write(_merge(self.levels[level], run)), None
            level += 1
        self.levels[level:level + 1] = [run]

    def _write(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "run")
        name = path.rsplit("/", 1)[-1].replace("-", "_")
        rows.write.format("parquet").bucketBy(self.buckets, "line").sortBy("line").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def repeated(self) -> DataFrame:
        """(line, top, hot) of all lines that ``min_docs`` documents hold."""
        all_runs = functools.reduce(_merge, self.runs())
        return all_runs.filter((F.col("n") >= self.min_docs) & F.col("top").isNotNull()).select("line", "top", "hot")


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join of their buckets."""
    b = b.select("line", F.col("n").alias("_n"), F.col("top").alias("_top"), F.col("hot").alias("_hot"))
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    return a.join(b, "line", "full_outer").select(
        "line", (F.coalesce("n", zero) + F.coalesce("_n", zero)).alias("n"), F.greatest("top", "_top").alias("top"), (F.coalesce("hot", no) | F.coalesce("_hot", no)).alias("hot"))


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Takes out lines that ``min_docs`` documents hold, except in the document with the largest id.

    A line's key is the line without blanks (space, U+0009 to U+000D) at its ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` code points are left alone.  Returns the id, ``n_lines`` (before), ``n_dropped`` and ``text`` (the
    other lines, joined by line feeds), one row per row of ``docs``; other columns are ignored.

    A null or empty text is one empty line and stays.  Every row counts as a document, repeated rows too; all rows
    with the largest id keep the line.  An id that is null is smaller than all others; a line that only rows without
    an id hold is left alone.  Ids are integers.  Equal lines are lines of equal 64-bit hashes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    schema = StructType([*rows.schema.fields[:2], *StructType.fromDDL("line long").fields])
    batch = F.lit(0)
    for low in cuts:  # the newest documents come first; those without an id last
        batch = batch + F.coalesce(F.col("id") < low, F.lit(True)).cast("int")
    held = cut_lineage(rows.mapInArrow(_hash_lines("text", min_chars, to_arrow_schema(schema)), schema).withColumn("batch", batch), "batch")
    runs = LineRuns(spark, min_docs=min_docs)
    for b, size in sorted(held.groupBy("batch").count().collect()):
        runs.add(held.filter(F.col("batch") == b).select("id", "line"), math.ceil(size / HOT))
    if not runs.runs():
        runs.add(held.select("id", "line"), 1)
    repeated = settle(runs.repeated())
    hot, rest = F.broadcast(repeated.filter("hot")), repeated.filter("NOT hot")
    found = held.join(hot, "line").unionByName(held.join(hot, "line", "left_anti").join(rest, "line"))
    gone = found.filter(F.coalesce(F.col("id") < F.col("top"), F.lit(True))).groupBy("id", "_row").agg(F.collect_set("line").alias("_gone"))
    gone = gone.select(F.col("id").alias("_id"), F.col("_row").alias("_own"), "_gone")
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_own")), "left").select("id", "text", "_gone")
    out = StructType([docs.schema[id_col], *StructType.fromDDL("n_lines long, n_dropped long, text string").fields])
    return met.mapInArrow(_cut("text", min_chars, to_arrow_schema(out)), out)

