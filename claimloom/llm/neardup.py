"""Near-duplicate documents: MinHash bands find candidates, sequential Bayesian tests prune them, sets confirm them.

Documents with one and the same shingle set are one node.  Within a band's bucket every node is first tested against
the bucket's most central one, so a bucket of n nodes gives n - 1 candidates.  Nodes that this links form components; buckets
that still hold several components are then searched for links between them.  That search compares signatures inside
tasks, in blocks of bounded size; what passes the test is decided on the sets in the same blocks, and only links that
join something come back, never all pairs.

The test reads two signatures a batch at a time.  With a uniform prior, the similarity after m equal hashes of n has
a Beta(m + 1, n - m + 1) distribution; a pair is dropped as soon as the probability that its similarity reaches the
threshold falls below ``MISS``.  What is left is decided on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordspans as ws
from .components import components
from .tables import cut_lineage, with_row_key

WIDTH = 5
#: A pair with similarity 0.8 shares a bucket with probability 1 - (1 - 0.8**5)**32 > 1 - 4e-6.
BANDS, ROWS = 32, 5
#: Hashes compared between two tests.
BATCH = 16
#: A pair is dropped when the chance that it reaches the threshold is below this.
MISS = 1e-7
#: Nodes of one block when a bucket of several components is searched.
BLOCK = 256

_HASHES = BANDS * ROWS
_SEED = ws.mix(np.arange(1, _HASHES + 1, dtype=ws.U64) * ws.U64(0xD6E8FEB86659FD93))
_XOR, _ODD = (_SEED >> ws.U64(32)).astype(np.uint32), _SEED.astype(np.uint32) | np.uint32(1)


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, sorted; fewer words than ``width`` are one shingle, no words none."""
    buf, offs = ws.text_buffers(texts)
    buf = ws.LOWER[buf]
    starts, ends, words = ws.spans(buf, offs, ws.BLANK_WORDS)
    hashed = ws.word_hashes(buf, starts, ends)
    rolled = ws.window_hashes(hashed, width)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(ws.window_hashes(hashed[a:b], b - a))
        else:
            out.append(np.zeros(0, ws.U64))
    return out


def signature(shingle: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over the set."""
    low = shingle.astype(np.uint32)
    best = np.full(_HASHES, np.uint32(0xFFFFFFFF))
    for k in range(0, len(low), 2048):
        np.minimum(best, ((low[k : k + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=best)
    return best


def _node(shingle: np.ndarray) -> int:
    """One number for a set, in any order of its members."""
    total = (int(ws.mix(shingle).sum(dtype=ws.U64)) + len(shingle) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    return int(ws.mix(np.array([total], ws.U64)).view(np.int64)[0])


_BAND_SALT = np.arange(1, BANDS + 1, dtype=ws.U64) * ws.U64(0xE7037ED1A0B428DB)


def _bands(signatures: np.ndarray) -> np.ndarray:
    """Band keys (rows x BANDS) of signatures (rows x hashes)."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(ws.U64)
    key = np.tile(_BAND_SALT, (len(signatures), 1))
    for k in range(ROWS):
        key = ws.mix(key ^ parts[:, :, k]) + _BAND_SALT
    return ws.mix(key).view(np.int64)


def _sketch(width: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ws.chunks(batch, "_text"):
                sets = shingles(piece.column("_text"), width)
                filled = np.array([len(s) > 0 for s in sets], bool)
                signatures = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, _HASHES), np.uint32)
                keys = _bands(signatures)
                raw = signatures.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([raw[4 * _HASHES * i : 4 * _HASHES * (i + 1)] if f else None for i, f in enumerate(filled)], pa.binary()),
                    pa.array([k if f else None for k, f in zip(keys, filled)], pa.list_(pa.int64()))], schema=schema)

    return run


@cache
def least_matches(percent: int) -> list[int]:
    """For n = BATCH, 2 * BATCH, ... compared hashes, the least number of equal ones that does not rule a pair out.

    P(similarity >= t) after m of n is P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, _HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _passing(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Indexes of the pairs (left[a], right[b]) that no test rules out."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(percent)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal[alive] += (left[a[alive], part] == right[b[alive], part]).sum(axis=1)
        alive = alive[equal[alive] >= least]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    raw, _ = ws.text_buffers(column)
    return raw.view("<u4").reshape(-1, _HASHES) if raw.flags.c_contiguous and raw.ctypes.data % 4 == 0 else np.frombuffer(raw.tobytes(), "<u4").reshape(-1, _HASHES)


def _test_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _signatures(batch.column("a_sig")), _signatures(batch.column("b_sig"))
            every = np.arange(batch.num_rows)
            equal = (left == right).sum(axis=1)
            kept = _passing(left, right, every, every, percent)
            yield pa.record_batch([batch.column("a").take(pa.array(kept)), batch.column("b").take(pa.array(kept)), pa.array(equal[kept].astype(np.int32))], names=["a", "b", "equal"])

    return run


_CELL = "key long, i int, j int"


def _search_cell(percent: int) -> Callable[[pa.Table], pa.Table]:
    """The pairs of a cell that no test rules out, as one row: the nodes in them and two lists of their numbers."""
    def run(table: pa.Table) -> pa.Table:
        ws.give_back(2 * table.nbytes)  # of the cells before
        table = table.combine_chunks()
        node, root = table["node"].to_numpy(), table["root"].to_numpy()
        sig = _signatures(table["sig"].combine_chunks())
        bands = _bands(sig)
        band = int(np.flatnonzero((bands == table["key"][0].as_py()).all(axis=0))[0])
        left, right = np.flatnonzero(table["first"].to_numpy()), np.flatnonzero(table["second"].to_numpy())
        twice = table["first"].to_numpy() & table["second"].to_numpy()
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(left), 64):
            a, b = np.meshgrid(left[k : k + 64], right, indexing="ij")
            a, b = a.ravel(), b.ravel()
            apart = (root[a] != root[b]) & ((node[a] < node[b]) | ~(twice[a] & twice[b]))  # a block with itself has each pair two times
            a, b = a[apart], b[apart]
            # A pair is tested in the first of the buckets that both are in.
            for earlier in range(band):
                fresh = bands[a, earlier] != bands[b, earlier]
                a, b = a[fresh], b[fresh]
            kept = _passing(sig, sig, a, b, percent)
            found_a.append(a[kept])
            found_b.append(b[kept])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if not len(a):
            return table.slice(0, 0).select(["key", "i", "j"]).append_column("nodes", pa.array([], pa.list_(pa.int64()))).append_column("left", pa.array([], pa.binary())).append_column("right", pa.array([], pa.binary()))
        used, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        number = number.astype("<u4")
        return table.slice(0, 1).select(["key", "i", "j"]).append_column("nodes", pa.array([node[used]], pa.list_(pa.int64()))).append_column(
            "left", pa.array([number[: len(a)].tobytes()], pa.binary())).append_column("right", pa.array([number[len(a) :].tobytes()], pa.binary()))

    return run


def _enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Is the similarity of two sorted sets at least ``percent`` hundredths?"""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm_cell(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links of a cell, decided on full sets; a pair that is joined through others already needs no link of its own."""
    def run(table: pa.Table) -> pa.Table:
        ws.give_back(2 * table.nbytes)
        pairs = table.filter(pa.compute.is_valid(table["nodes"]))
        nodes = pairs["nodes"][0].as_py()
        left, right = (np.frombuffer(pairs[c][0].as_py(), "<u4").tolist() for c in ("left", "right"))
        sets = {n: np.frombuffer(s, "<u8") for n, s in zip(table["node"].to_pylist(), table["set"].to_pylist()) if s is not None}
        own, parent, found = [sets[n] for n in nodes], list(range(len(nodes))), []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(left, right):
            rx, ry = find(x), find(y)
            if rx != ry and _enough(own[x], own[y], percent):
                parent[rx] = ry
                found.append((nodes[x], nodes[y]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ws.chunks(batch, "_text"):
                yield pa.record_batch([piece.column("node"), pa.array([s.astype("<u8").tobytes() for s in shingles(piece.column("_text"), width)], pa.binary())], names=["node", "members"])

    return run


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_enough(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column("a_set"), batch.column("b_set"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


_PAIR = "a long, b long"


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs a, b with ``column`` of both nodes."""
    return (pairs.join(table.select(F.col("node").alias("a"), F.col(column).alias(f"a_{column}")), "a")
            .join(table.select(F.col("node").alias("b"), F.col(column).alias(f"b_{column}")), "b"))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept``,
    ``row_key`` (of id and text) and ``survives``.

    Two documents are linked when the intersection of their sets of ``width``-word shingles (A-Z lower-cased) is at
    least ``percent`` hundredths of the union.  A text of fewer words is one shingle; null and empty texts have none
    and are linked with nothing, not with each other.  ``kept`` marks rows whose id is the component's (repeated rows
    of it are all kept).  Rows without an id take part: their component's id is the smallest there is, or null.
    ``survives`` marks one document of every component, by id and then key, and every text without words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = with_row_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_row", "_id", "_text")
    rows = rows.select("_id", "_row", "_text")
    schema = StructType([*rows.drop("_text").schema.fields, *StructType.fromDDL("n_shingles long, node long, sig binary, bands array<long>").fields])
    sketched = cut_lineage(rows.mapInArrow(_sketch(width, to_arrow_schema(schema)), schema))

    # Buckets with more than one node.  The node that meets the most others over all its buckets is the likeliest
    # centre of its group; every node of a bucket is tested against the bucket's most central one.
    entries = sketched.filter("node IS NOT NULL").select("node", F.explode("bands").alias("key"))
    shared = cut_lineage(entries.groupBy("key").agg(F.min("node").alias("_first"), F.max("node").alias("_last")).filter("_first < _last").select("key"))
    members = cut_lineage(entries.join(shared, "key").select("key", "node").distinct())
    sizes = members.groupBy("key").agg(F.count("*").alias("_size"))
    central = cut_lineage(members.join(sizes, "key").groupBy("node").agg(F.sum("_size").alias("_met")))
    reps = cut_lineage(members.join(central, "node").groupBy("key").agg(F.max_by("node", "_met").alias("rep")))
    pairs = members.join(reps, "key").filter("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    touched = members.select("node").distinct()
    # One signature and one row for every node that has a candidate.
    about = cut_lineage(sketched.join(touched, "node", "left_semi").groupBy("node").agg(F.min_by("sig", "_row").alias("sig"), F.min("_row").alias("_row")))
    tested = cut_lineage(_with_both(pairs, about, "sig").mapInArrow(_test_pairs(percent), f"{_PAIR}, equal int"))

    # Shingle sets of those nodes, from one of their rows each.
    wanted = about.select("_row", "node")
    sets_of = lambda needed: rows.select("_row", "_text").join(
        wanted.join(needed, "node", "left_semi").select("_row", "node"), "_row").dropDuplicates(["node"]).select("node", "_text").mapInArrow(_sets(width), "node long, members binary")
    nodes_of = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def confirmed(candidates: DataFrame) -> DataFrame:
        sets = cut_lineage(sets_of(nodes_of(candidates)).withColumnRenamed("members", "set"))
        return _with_both(candidates.select("a", "b"), sets, "set").mapInArrow(_confirm(percent), _PAIR)

    # Each node's most similar candidate first: one pair per node joins most of what belongs together.
    best = tested.groupBy(F.col("b").alias("_b")).agg(F.max(F.struct("equal", "a")).alias("_best")).select(F.col("_best.a").alias("a"), F.col("_b").alias("b"))
    links = cut_lineage(confirmed(cut_lineage(best)))
    roots = cut_lineage(components(links))

    # Buckets that still hold several components: their nodes in blocks, every two blocks in a cell.
    rooted = cut_lineage(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_size")).filter("_low < _high").select("key", F.ceil(F.col("_size") / BLOCK).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    cells = (rooted.join(mixed, "key").withColumn("_block", block)
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .select("key", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "node", "root",
                     (F.col("_block") <= F.col("_other")).alias("first"), (F.col("_block") >= F.col("_other")).alias("second")))
    found = cut_lineage(cells.join(about.select("node", "sig"), "node").groupBy("key", "i", "j").applyInArrow(
        _search_cell(percent), f"{_CELL}, nodes array<long>, left binary, right binary"))
    # The sets of the nodes in those pairs go to their cells; links come back, at most one less than a cell has nodes.
    needed = cut_lineage(found.select("key", "i", "j", F.explode("nodes").alias("node")))
    sets = cut_lineage(sets_of(needed.select("node").distinct()).withColumnRenamed("members", "set"))
    meet = needed.join(sets, "node").unionByName(found, allowMissingColumns=True)
    more = cut_lineage(meet.groupBy("key", "i", "j").applyInArrow(_confirm_cell(percent), _PAIR))
    if not more.isEmpty():
        roots = cut_lineage(components(links.unionByName(more)))

    placed = cut_lineage(sketched.select("_id", "_row", "n_shingles", "node").join(roots, "node", "left").select("_id", "_row", "n_shingles", F.coalesce("root", "node").alias("root")))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    ids = cut_lineage(placed.filter("root IS NOT NULL").groupBy("root").agg(first.alias("_first")))
    alone = F.col("root").isNull()
    judged = placed.join(ids, "root", "left").select(
        F.col("_id").alias(id_col), "n_shingles", F.when(alone, F.col("_id")).otherwise(F.col("_first.id")).alias("component_id"),
        F.col("_row").alias("row_key"), (alone | (F.col("_row") == F.col("_first.row"))).alias("survives"))
    return judged.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
