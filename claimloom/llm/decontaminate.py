"""Benchmark decontamination: an FM-index over every shard of the training texts is searched for the test phrases.

A shard is some megabytes of texts inside a task.  Words that no test phrase has are one symbol, and a run of them is
kept once: no phrase can cross it.  All phrases are searched backwards at the same time; occurrences come from sampled
suffix positions and are merged into removal spans.  Test phrases are handled in blocks of a stated size, one pass over
the rows after the other, without a shuffle; what a pass has found is written for the next.  One item is never split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .fmindex import FMIndex
from .tables import cut_lineage

WINDOW = 13
#: Bytes of test texts in one block: the bound of what is collected and broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of training text under one index.
SHARD_BYTES = 2 << 20

_HITS = "n_words long, spans array<struct<first:int,end:int>>, items array<string>"


@dataclass
class Phrases:
    """Distinct windows as symbol rows, and the items each comes from."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    item_starts: np.ndarray
    item_of: np.ndarray
    items: list[str]


def phrases(items: pa.Table, window: int) -> Phrases:
    """``items``: columns item and text."""
    buf, offs = ws.text_buffers(items["text"])
    buf = ws.LOWER[buf]
    starts, ends, words = ws.spans(buf, offs, ws.ALNUM_WORDS)
    vocabulary, symbol = np.unique(ws.word_hashes(buf, starts, ends), return_inverse=True)
    symbol = np.append(symbol + 2, np.zeros(window, np.int64))
    size = np.diff(words)
    count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    first = ws.ragged_range(words[:-1], count)
    item = np.repeat(np.arange(len(size)), count)
    length = np.minimum(size, window)[item]
    rows = symbol[first[:, None] + np.arange(window)] * (np.arange(window) < length[:, None])
    patterns, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
    pairs = np.unique(np.stack([which.ravel(), item]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
    return Phrases(vocabulary, patterns, (patterns > 0).sum(axis=1), np.searchsorted(pairs[0], np.arange(len(patterns) + 1)), pairs[1], items["item"].to_pylist())


def occurrences(symbol: np.ndarray, row: np.ndarray, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, number of its first word) of every occurrence; ``symbol`` is 1 for a word that no phrase has."""
    # Runs of unknown words shrink to one, and one stands between rows.
    other = symbol == 1
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    keep = ~other | np.concatenate([[True], ~other[:-1]]) | new_row
    kept = np.flatnonzero(keep)
    text = np.insert(symbol[kept], np.flatnonzero(new_row[kept]), 1)
    word = np.insert(kept, np.flatnonzero(new_row[kept]), -1)
    index = FMIndex(text, len(known.vocabulary) + 1)
    low, high = index.search(known.patterns, known.lengths)
    counts = high - low
    pattern = np.repeat(np.arange(len(counts)), counts)
    return pattern, word[index.locate(ws.ragged_range(low, counts))]


def _search(text: str, known: Callable[[], Phrases], schema: pa.Schema, n_carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def hits(piece: pa.RecordBatch, block: Phrases) -> pa.RecordBatch:
        buf, offs = ws.text_buffers(piece.column(text))
        buf = ws.LOWER[buf]
        starts, ends, words = ws.spans(buf, offs, ws.ALNUM_WORDS)
        n_rows = len(words) - 1
        row = np.repeat(np.arange(n_rows), np.diff(words))
        covered = np.zeros(len(starts) + 1, np.int64)
        pair_row = pair_item = np.zeros(0, np.int64)
        if len(starts) and len(block.patterns):
            hashes = ws.word_hashes(buf, starts, ends)
            at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
            symbol = np.where(block.vocabulary[at] == hashes, at + 2, 1)
            pattern, word = occurrences(symbol, row, block)
            np.add.at(covered, word, 1)
            np.add.at(covered, word + block.lengths[pattern], -1)
            n_items = block.item_starts[pattern + 1] - block.item_starts[pattern]
            pair_row = np.repeat(row[word], n_items)
            pair_item = block.item_of[ws.ragged_range(block.item_starts[pattern], n_items)]
        # What earlier blocks found is merged in.
        before_spans, before_items = piece.column("spans").to_pylist(), piece.column("items").to_pylist()
        for r, (spans, _) in enumerate(zip(before_spans, before_items)):
            for span in spans or ():
                covered[words[r] + span["first"]] += 1
                covered[words[r] + span["end"]] -= 1
        hit = np.cumsum(covered)[:-1] > 0
        edge = np.concatenate([[True], (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])]) if len(hit) else np.zeros(0, bool)
        heads = np.flatnonzero(edge & hit)
        stops = np.append(np.flatnonzero(edge), len(hit))
        tails = stops[np.searchsorted(stops, heads, side="right")] if len(heads) else heads
        base = words[row[heads]] if len(heads) else heads
        per_row = np.searchsorted(row[heads], np.arange(n_rows + 1)) if len(heads) else np.zeros(n_rows + 1, np.int64)
        spans = pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array((heads - base).astype(np.int32)), pa.array((tails - base).astype(np.int32))], names=["first", "end"]))
        pairs = np.unique(np.stack([pair_row, pair_item]), axis=1)
        cuts = np.searchsorted(pairs[0], np.arange(n_rows + 1))
        items = [sorted({*(old or ()), *(block.items[i] for i in pairs[1, a:b] if block.items[i] is not None)}) if b > a or old else [] for old, a, b in zip(before_items, cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([*piece.columns[:n_carried], pa.array(np.diff(words).astype(np.int64)), spans, pa.array(items, pa.list_(pa.string()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = known()
        for batch in batches:
            for piece in ws.chunks(batch, text, SHARD_BYTES):
                yield hits(piece, block)

    return run


def find_phrases(docs: DataFrame, benchmark: DataFrame, *, carry: list[str], window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``carry`` and, for every text, its words, the word spans that benchmark windows cover, and the items they are of.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.  A window is ``window``
    consecutive words of an item; a shorter item is one window.  ``spans`` are maximal [first, end) word numbers;
    ``items`` are the items' ids as strings, sorted, each once.  Null and empty texts have no words; items without
    words have no windows, items without an id are searched but not listed; several items may share windows.  Rows
    of ``docs`` stay as they are and in their partitions; repeated rows give repeated rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    text = text_col if text_col in carry else "_text"
    state = docs.select(*carry, *([] if text_col in carry else [F.col(text_col).alias(text)]), F.lit(0).cast("bigint").alias("n_words"),
                        F.array().cast("array<struct<first:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(phrases(part.toArrow(), window))
        # The text goes along to the next block; after the last one only if it is asked for.
        kept = [*carry] if b == blocks - 1 or text in carry else [*carry, text]
        out = StructType([*state.select(*kept).schema.fields, *StructType.fromDDL(_HITS).fields])
        state = state.mapInArrow(_search(text, lambda shared=shared: shared.value, to_arrow_schema(out), len(kept)), out)
        if b < blocks - 1:  # one pass at a time: a chain would hold one worker and one broadcast per block
            state = cut_lineage(state)
            shared.unpersist()
    return state


def span_words(spans: str = "spans"):
    """Number of words in the spans."""
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def contaminated(n_hit, n_words):
    """At least one hit word, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
