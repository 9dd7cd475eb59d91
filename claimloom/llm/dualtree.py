"""Ranked lexical search by dual trees.

The items asked for (the queries) and every batch of documents are ordered so that similar ones stand together, and
are cut into trees by position.  A node of either tree holds, for every term, the largest coordinate below it: the
weight asked for, or the impact in a document.  The product of two such maxima bounds the score of every pair below the
two nodes.  A pair of nodes is dropped if its bound is less than the weakest of the scores that the items below have as
their kth; whole batches go this way.  What is left is scored exactly, in integers.

Bounds are doubles, raised by more than they can have been rounded; scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import wordspans as ws

TOP = 10
#: Bytes of item texts that are searched for at a time: the bound of what is collected and broadcast.
BLOCK_BYTES = 4 << 20
#: Documents under one tree, and documents or items under a node of each level.
TREE_ROWS = 4096
DOC_LEVELS, ITEM_LEVELS = (512, 64, 8), (64, 8, 1)
#: The first search, which only finds scores to start from, takes the documents of one hash value in this many.
SEED_PARTS = 64
#: Bounds are raised by this factor; a sum of n doubles is off by less than n / 2**53 of it.
SLACK = 1 + 1e-7


@dataclass
class Items:
    """The items of one block: distinct terms, and per item its terms and how often it asks for each."""

    vocabulary: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    docs: int = 0
    length: int = 1
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def wanted(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weight times repeats) of an item."""
        a, b = self.starts[item], self.starts[item + 1]
        return self.terms[a:b], self.times[a:b] * self.weights[self.terms[a:b]]


def _term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms per text; text, hash and count of its distinct terms)."""
    buf, offs = ws.text_buffers(texts)
    buf = ws.LOWER[buf]
    starts, ends, words = ws.spans(buf, offs, ws.ALNUM_WORDS)
    row, hashes = np.repeat(np.arange(len(words) - 1), np.diff(words)), ws.word_hashes(buf, starts, ends)
    return np.diff(words), *_runs(row, hashes)


def _runs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) and how often each comes."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def read_items(texts: pa.ChunkedArray) -> Items:
    size, row, hashes, times = _term_counts(texts)
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    return Items(vocabulary, np.searchsorted(row, np.arange(len(size) + 1)), terms.ravel(), times)


def _count_terms(vocabulary: Callable[[], np.ndarray], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document its length and its asked terms; per chunk one row that counts documents, terms and holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary()
        for batch in batches:
            for piece in ws.chunks(batch, "text"):
                buf, offs = ws.text_buffers(piece.column("text"))
                buf = ws.LOWER[buf]
                starts, ends, words = ws.spans(buf, offs, ws.ALNUM_WORDS)
                size = np.diff(words)
                hashes = ws.word_hashes(buf, starts, ends)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                asked = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
                row, term, count = _runs(np.repeat(np.arange(len(size)), size)[asked], at[asked])
                cuts = np.searchsorted(row, np.arange(len(size) + 1))
                has = np.flatnonzero(np.diff(cuts))
                holders = np.unique(term, return_counts=True)
                n = len(has)
                ids = pa.concat_arrays([piece.column("id").take(pa.array(has)), pa.nulls(1, piece.column("id").type)])
                offsets = pa.array(np.concatenate([[0], cuts[has + 1], [len(term) + len(holders[0])]]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([a, b]).astype(np.int32))) for a, b in ((term, holders[0]), (count, holders[1]))]
                docs = np.zeros(n + 1, np.int64)
                docs[-1] = (size > 0).sum()
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.append(size[has], size.sum()).astype(np.int64)), *lists, pa.array(docs), pa.array(np.arange(n + 1) == n)], schema=schema)

    return run


class _Levels:
    """Maxima of one batch of documents: for every term the nodes that have it, level by level, documents last."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray, rows: int) -> None:
        # Documents whose weightiest term is the same stand together.
        weight = impact * weights[term]
        by = np.lexsort((-weight, row))
        head = np.ones(len(by), bool)
        head[1:] = row[by][1:] != row[by][:-1]
        lead = np.zeros(rows, np.int64)
        lead[row[by][head]] = term[by][head]
        self.doc = np.argsort(lead, kind="stable")
        place = np.empty(rows, np.int64)
        place[self.doc] = np.arange(rows)
        node = place[row]
        order = np.lexsort((node, term))
        node, term, top = node[order], term[order], impact[order]
        self.levels = [(term, node, top)]
        for below, size in zip((1, *DOC_LEVELS[::-1]), (*DOC_LEVELS[::-1], TREE_ROWS)):
            node = node // (size // below)
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (term[1:] != term[:-1])
            at = np.flatnonzero(new)
            term, node, top = term[at], node[at], np.maximum.reduceat(top, at) if len(at) else top
            self.levels.insert(0, (term, node, top))
        # The whole batch, nodes of DOC_LEVELS documents, documents.
        self.counts = [1, *(-(-rows // s) for s in DOC_LEVELS), rows]

    def _met(self, level: int, terms: np.ndarray, wanted: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, product of what is wanted and what the node has at most) of all nodes left that have one of the terms."""
        term, node, top = self.levels[level]
        low, high = np.searchsorted(term, terms), np.searchsorted(term, terms, side="right")
        at, want = ws.ragged_range(low, high - low), np.repeat(wanted, high - low)
        keep = alive[node[at]]
        return node[at[keep]], top[at[keep]] * want[keep]

    def bounds(self, level: int, terms: np.ndarray, wanted: np.ndarray, alive: np.ndarray) -> np.ndarray:
        node, product = self._met(level, terms, wanted, alive)
        return np.bincount(node, weights=product, minlength=self.counts[level]) * SLACK

    def scores(self, terms: np.ndarray, wanted: np.ndarray, alive: np.ndarray) -> np.ndarray:
        node, product = self._met(-1, terms, wanted, alive)
        # Sums of both halves are exact in doubles.
        high, low = (np.bincount(node, weights=x, minlength=self.counts[-1]).astype(np.int64) for x in (product >> 20, product & 0xFFFFF))
        return (high << 20) + low


def item_tree(items: Items) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Levels of (items, terms, largest weight asked for) over the items in their order."""
    levels = []
    for size in ITEM_LEVELS:
        nodes = []
        for start in range(0, len(items.order), size):
            own = items.order[start : start + size]
            wanted = [items.wanted(i) for i in own]
            terms, which = np.unique(np.concatenate([t for t, _ in wanted]), return_inverse=True)
            most = np.zeros(len(terms), np.int64)
            np.maximum.at(most, which.ravel(), np.concatenate([w for _, w in wanted]))
            nodes.append((own, terms, most))
        levels.append(nodes)
    return levels


class Best:
    """The k best (score, id) of every item so far; ids that are null come last among equal scores."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.kth = k, least.copy()
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in least]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(scores) > self.k:
            # Everything that ties with the kth stays.
            floor = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= floor
            scores, ids, null = scores[keep], ids[keep], null[keep]
        order = np.lexsort((ids, null, -scores))[: self.k]
        own = self.held[item]
        own += [(-int(scores[j]), bool(null[j]), int(ids[j])) for j in order.tolist()]
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.kth[item] = max(self.kth[item], -own[-1][0])


def search_batch(docs: _Levels, ids: np.ndarray, null: np.ndarray, tree: list, best: Best) -> None:
    """Goes down both trees at once; a pair of nodes is left where its bound is below all kth scores of its items."""
    at_top = [(0, np.ones(1, bool))]
    for level, nodes in enumerate(tree):
        size = ITEM_LEVELS[level]
        below = []
        for parent, alive in at_top if level else [(None, np.ones(1, bool))]:
            span = range(len(nodes)) if parent is None else range(parent * (ITEM_LEVELS[level - 1] // size), min(len(nodes), (parent + 1) * (ITEM_LEVELS[level - 1] // size)))
            for q in span:
                own, terms, most = nodes[q]
                weakest = best.kth[own].min()
                open_nodes = alive
                for doc_level in (0, 1) if level == 0 else (level + 1,):
                    if doc_level:
                        ratio = TREE_ROWS // DOC_LEVELS[0] if doc_level == 1 else DOC_LEVELS[doc_level - 2] // DOC_LEVELS[doc_level - 1]
                        open_nodes = np.repeat(open_nodes, ratio)[: docs.counts[doc_level]]
                    bound = docs.bounds(doc_level, terms, most, open_nodes)
                    open_nodes = open_nodes & (bound >= weakest) & (bound > 0)
                    if not open_nodes.any():
                        break
                else:
                    below.append((q, open_nodes))
        at_top = below
    for q, alive in at_top:
        own, terms, most = tree[-1][q]
        scores = docs.scores(terms, most, np.repeat(alive, DOC_LEVELS[-1])[: docs.counts[-1]])
        hit = np.flatnonzero((scores >= best.kth[own[0]]) & (scores > 0))
        if len(hit):
            best.add(int(own[0]), scores[hit], ids[docs.doc[hit]], null[docs.doc[hit]])


def _search(shared: Callable[[], Items], k: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared()
        tree, best = item_tree(items), Best(items.least, k)
        kind = pa.int64()
        for batch in batches:
            kind = batch.column("id").type
            for start in range(0, batch.num_rows, TREE_ROWS):
                piece = batch.slice(start, TREE_ROWS)
                sizes = piece.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                term, tf = (piece.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
                length = piece.column("n").to_numpy()
                m = np.array([25 + (75 * n * items.docs) // items.length for n in length.tolist()], np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
                ids = piece.column("id").fill_null(0).to_numpy()
                search_batch(_Levels(row, term, impact, items.weights, len(sizes)), ids, piece.column("id").is_null().to_numpy(zero_copy_only=False), tree, best)
        found = [(i, -score, None if null else doc) for i, own in enumerate(best.held) for score, null, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[2] for x in found], kind), pa.array([x[1] for x in found], pa.int64())], schema=schema)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for every query: query id, ``rank``, document id, ``score``.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.  With N documents that
    have a term, L terms in all, df holders of a term, n terms in a document and tf of one of them there, the score
    sums w * ((1000000000 * tf) div (1000 * tf + 8 * m)) over the query's terms, repeats included, where w is
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m is 25 + (75 * n * N) div L.

    Equal scores come by ascending id, null ids last.  Null and empty texts have no terms: such documents count
    nowhere, such queries get no rows.  Repeated rows are ranked each for itself, repeated queries answered each for
    itself; queries without an id are answered under null.  Other columns are ignored.  Ids of documents are integers.

    Queries are taken in blocks of ``BLOCK_BYTES`` of text, each of which reads the documents once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_text).alias("text")).filter(F.col("text").isNotNull())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    counted = StructType([rows.schema["id"], *StructType.fromDDL("n long, terms array<int>, counts array<int>, docs long, total boolean").fields])
    found_schema = StructType([*StructType.fromDDL("item int").fields, StructField("doc", rows.schema["id"].dataType), *StructType.fromDDL("score long").fields])
    out = None
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query", "text"), F.lit(blocks)) == b)).toArrow()
        items = read_items(part["text"])
        vocabulary = spark.sparkContext.broadcast(items.vocabulary)
        vectors = cut_lineage(rows.mapInArrow(_count_terms(lambda v=vocabulary: v.value, to_arrow_schema(counted)), counted))
        items = _weighed(items, vectors.filter("total"))
        vectors = vectors.filter("NOT total").drop("docs", "total")
        first = spark.sparkContext.broadcast(items)
        run = lambda df, known: _ranked(df.mapInArrow(_search(lambda s=known: s.value, k, to_arrow_schema(found_schema)), found_schema), k)
        # A kth score among some documents is one that the kth score among all cannot be below.
        seeds = run(vectors.filter(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_PARTS)) == 0), first).filter(F.col("rank") == k).select("item", "score").toArrow()
        items.least[seeds["item"].to_numpy()] = seeds["score"].to_numpy()
        known = spark.sparkContext.broadcast(items)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(part.num_rows), pa.int32()), "query": part["query"]}))
        best = run(vectors, known).join(names, "item").select(F.col("query").alias(query_id), "rank", F.col("doc").alias(id_col), "score")
        out = best if out is None else out.unionByName(best)
    return out


def _weighed(items: Items, totals: DataFrame) -> Items:
    """Items with weights, counts of the corpus, and an order in which those that share weighty terms are neighbours."""
    sums = totals.agg(F.sum("docs"), F.sum("n")).first()
    items.docs, items.length = int(sums[0] or 0), max(1, int(sums[1] or 0))
    # One row per term of this block's items, which BLOCK_BYTES bounds.
    holders = totals.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df")).toArrow()
    df = np.zeros(len(items.vocabulary), np.int64)
    df[holders["terms"].to_numpy()] = holders["df"].to_numpy()
    items.weights = np.array([math.floor(1000 * math.log((2 * items.docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    n = len(items.starts) - 1
    lead = np.full(n, -1, np.int64)
    for i in range(n):
        terms, wanted = items.wanted(i)
        if len(terms):
            lead[i] = terms[np.argmax(np.where(df[terms] > 1, wanted, -1))]
    items.order = np.argsort(lead, kind="stable")[int((lead < 0).sum()):]
    items.least = np.zeros(n, np.int64)
    return items
