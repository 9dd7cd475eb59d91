"""Prefix trie of conversations from vertical bitmaps.

Conversations are sorted by their turns, so that a subtree is a contiguous range, and cut into shards.  A shard indexes
(position, turn) to bitsets of its conversations; a depth-first search intersects a node's bitset with the postings of
the next position, which gives its children, counts by popcount and the conversations that end there.

All figures of a node are sums over shards once every shard knows how many turns its first conversation shares with
the one before it and its last with the one after it: a node that an earlier shard has too counts there.  Only nodes on
these shared paths lie in several shards, and only they are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, settle

#: Turns in one range of sorted conversations (a task's work), conversations under one bitset, and their turns.
RANGE_TURNS = 100_000
SHARD_CONVERSATIONS, SHARD_TURNS = 1024, 50_000

_NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, member_chars long, node_chars long, "
          "ends_sha256 string, node binary, parent binary, place long, ends binary")
_NOBODY = hashlib.sha256(b"").hexdigest()


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``turns`` (a hash of role and text, by turn) and ``chars`` (code points).

    Turns come by number, null first; turns with the same number (repeated rows too) come in the order of their hashes.
    Null roles and texts are empty.  Rows without a conversation id belong to none and are left out.  A conversation is
    one row of 12 bytes a turn.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", F.xxhash64(role, text).alias("key"), F.char_length(text).alias("chars")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.key").alias("turns"), F.col("t.chars").alias("chars"))


def with_shared_heads(own: DataFrame, *, every: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % ``every``, h = crc32(c as text) % ``most``.

    Its own turns after its first h follow, if any.  A head that does not exist is empty, a shorter one is taken whole.
    The remainder of a negative id is negative, as in SQL.
    """
    head = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), *(F.slice(c, 1, most).alias(f"_{c}") for c in ("turns", "chars")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = own.withColumn("_h", h).join(head, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left")

    def rebuilt(c: str):
        empty = F.array().cast(own.schema[c].dataType)
        tail = F.when(F.size(c) > F.col("_h"), F.slice(F.col(c), F.col("_h") + 1, F.size(c)))
        return F.concat(F.coalesce(F.slice(F.col(f"_{c}"), F.lit(1), F.col("_h")), empty), F.coalesce(tail, empty)).alias(c)

    return met.select("conv_id", rebuilt("turns"), rebuilt("chars"))


def _shared(a: str, b: str):
    """Number of turns at the beginning that two sequences share, -1 if there is only one."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(F.col(a), F.lit(1), n), F.slice(F.col(b), F.lit(1), n), lambda x, y: x != y), True)
    return F.when(F.col(a).isNull() | F.col(b).isNull(), -1).when(at > 0, at - 1).otherwise(n).cast("int")


def _common(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _digests(turns: np.ndarray, n: int) -> list[bytes]:
    """Keys of the first n + 1 nodes on a path."""
    state, out = hashlib.md5(), []
    for d in range(n + 1):
        out.append(state.copy().digest())
        state.update(turns[d : d + 1].tobytes())
    return out


def _shard(ids: list[int], turns: list[list[int]], chars: list[list[int]], before: int, after: int, place: int) -> pa.RecordBatch:
    """Nodes of one shard of sorted conversations.

    ``before``, ``after``: turns shared with the conversations before the first and after the last one (-1: there is
    none).  Nodes that other shards have too carry their key, and their ids instead of a digest of them.
    """
    n = len(ids)
    postings: dict[tuple[int, int], int] = {}
    longer: dict[int, int] = {}
    for i, sequence in enumerate(turns):
        bit = 1 << i
        for d, key in enumerate(sequence):
            postings[d, key] = postings.get((d, key), 0) | bit
            longer[d] = longer.get(d, 0) | bit
    front = _digests(np.array(turns[0], np.int64), before)
    back = _digests(np.array(turns[-1], np.int64), after)
    last = 1 << (n - 1)
    members, depths, parents, ends = [], [], [], []
    stack = [((1 << n) - 1, 0, -1)]
    while stack:
        bits, depth, parent = stack.pop()
        me = len(members)
        rest = bits & longer.get(depth, 0)
        members.append(bits)
        depths.append(depth)
        parents.append(parent)
        ends.append(bits ^ rest)
        while rest:
            first = (rest & -rest).bit_length() - 1
            child = bits & postings[depth, turns[first][depth]]
            stack.append((child, depth + 1, me))
            rest &= ~child
    size = len(members)
    least, member_chars, node_chars = [1 << 63] * size, [0] * size, [0] * size
    leaves, children, has_child = [0] * size, [0] * size, [False] * size
    keys: list[bytes | None] = [None] * size
    own_ends, digest = [b""] * size, [_NOBODY] * size
    for me in range(size - 1, -1, -1):  # children come after their parents
        bits, depth, parent = members[me], depths[me], parents[me]
        continued, goes_on = bool(bits & 1) and depth <= before, bool(bits & last) and depth <= after
        if ends[me]:
            left, who = ends[me], []
            while left:
                bit = left & -left
                who.append(ids[bit.bit_length() - 1])
                left ^= bit
            least[me] = min(least[me], who[0])
            if continued or goes_on:
                own_ends[me] = np.array(who, np.int64).tobytes()
            else:
                digest[me] = hashlib.sha256(",".join(map(str, who)).encode()).hexdigest()
        here = chars[(bits & -bits).bit_length() - 1][depth - 1] if depth else 0
        member_chars[me] += bits.bit_count() * here
        if not continued:
            node_chars[me] += here
        if not has_child[me] and not goes_on:
            leaves[me] = 1
        if continued:
            keys[me] = front[depth]
        elif goes_on:
            keys[me] = back[depth]
        if parent >= 0:
            least[parent] = min(least[parent], least[me])
            member_chars[parent] += member_chars[me]
            node_chars[parent] += node_chars[me]
            leaves[parent] += leaves[me]
            has_child[parent] = True
            children[parent] += not continued
    above = [keys[p] if p >= 0 else None for p in parents]
    columns = [
        pa.array(least, pa.int64()), pa.array(depths, pa.int64()), pa.array([least[p] if p >= 0 and keys[p] is None else None for p in parents], pa.int64()),
        pa.array([b.bit_count() for b in members], pa.int64()), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(member_chars, pa.int64()),
        pa.array(node_chars, pa.int64()), pa.array(digest, pa.string()), pa.array(keys, pa.binary()), pa.array(above, pa.binary()), pa.array([place] * size, pa.int64()),
        pa.array(own_ends, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _NODES.split(", ")])


def _range_nodes(table: pa.Table) -> pa.Table:
    """One range of conversations, shard by shard."""
    part, before, after = (table.column(c)[0].as_py() for c in ("part", "before", "after"))
    turns, chars, ids = (table.column(c).to_pylist() for c in ("turns", "chars", "conv_id"))
    order = sorted(range(len(ids)), key=lambda i: (turns[i], ids[i]))
    out, start = [], 0
    while start < len(order):
        stop, held = start, 0
        while stop < len(order) and stop - start < SHARD_CONVERSATIONS and (stop == start or held + len(turns[order[stop]]) <= SHARD_TURNS):
            held += len(turns[order[stop]])
            stop += 1
        own = order[start:stop]
        next_shared = after if stop == len(order) else _common(turns[own[-1]], turns[order[stop]])
        out.append(_shard([ids[i] for i in own], [turns[i] for i in own], [chars[i] for i in own], before, next_shared, (part << 32) + start))
        before, start = next_shared, stop
    return pa.Table.from_batches(out)


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and place in, one digest per node out; nothing but the running digest is held."""
    node, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for key, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            text = ",".join(map(str, np.frombuffer(ends, np.int64).tolist())).encode()
            if key == node:
                state.update(b"," + text)
                continue
            if state is not None:
                done.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["_ends_of", "_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["_ends_of", "_sha256"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (``conv_id``, unique and not null; ``turns``; ``chars``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes of the subtree, the node included), ``saved_tokens`` (code points that are not stored
    again because conversations share nodes, over the subtree) and ``ends_sha256`` of the ids that end here, ascending.
    Conversations without turns end at the root; equal conversations share a leaf; without conversations there is no
    node at all.  Other columns are ignored.
    """
    sequences = cut_lineage(sequences.select("conv_id", "turns", "chars"))
    total = sequences.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    placed = cut_lineage(sequences.repartitionByRange(max(1, -(-total // RANGE_TURNS)), "turns", "conv_id").withColumn("part", F.spark_partition_id().cast("long")))
    # Two rows of edges for each range: as many as there are tasks.
    edge = placed.groupBy("part").agg(*(f(F.struct("turns", "conv_id"))["turns"].alias(c) for f, c in ((F.min, "first"), (F.max, "last"))))
    by_part = Window.orderBy("part")
    beside = edge.withColumn("previous", F.lag("last").over(by_part)).withColumn("next", F.lead("first").over(by_part))
    edges = settle(beside.select("part", _shared("previous", "first").alias("before"), _shared("last", "next").alias("after")))
    nodes = cut_lineage(placed.join(edges, "part").groupBy("part").applyInArrow(_range_nodes, _NODES))
    spread = nodes.filter(F.col("node").isNotNull())
    ended = (spread.filter(F.length("ends") > 0).select("node", "place", "ends").repartition("node").sortWithinPartitions("node", "place")
             .mapInArrow(_digest_ends, "_ends_of binary, _sha256 string"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "member_chars", "node_chars")]
    merged = spread.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), *sums)
    merged = cut_lineage(merged.join(ended, F.col("node") == F.col("_ends_of"), "left").withColumn("ends_sha256", F.coalesce("_sha256", F.lit(_NOBODY))))
    found = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", (F.col("member_chars") - F.col("node_chars")).alias("saved_tokens"), "ends_sha256"]
    whole = nodes.filter(F.col("node").isNull())
    # Most nodes have their parent in their own shard; the others look it up among the merged ones.
    settled = whole.filter(F.col("parent").isNull()).select(*found, "parent_conv_id").unionByName(
        merged.filter(F.col("parent").isNull()).select(*found, F.lit(None).cast("long").alias("parent_conv_id")))
    looked_up = whole.filter(F.col("parent").isNotNull()).select(*found, "parent").unionByName(merged.filter(F.col("parent").isNotNull()).select(*found, "parent"))
    parents = merged.select(F.col("node").alias("_node"), F.col("conv_id").alias("parent_conv_id"))
    return settled.unionByName(looked_up.join(parents, F.col("parent") == F.col("_node")).drop("parent", "_node"))
