"""Ranked search, prefix trie and line dedup against plain versions, on odd rows and in small pieces."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import dualtree, linededup, oracles, prefixtrie, queries
from contract import compare

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score long, id string, terms string, line string, _gone string, query string"
TALK = "conv_id long, turn long, role string, text string, turns string, depth string, node string"


@pytest.fixture(scope="module")
def texts(spark):
    found = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    line, other = "A line that stands in many documents", "\t a LINE that stands IN many documents \r"
    odd = [(900, None), (901, ""), (902, "\n\n"), (903, line), (904, f"x\n{other}\ny"), (905, f"{line}\n{line}"), (905, f"{line}\n{line}"), (None, f"{line}\nz"), (None, None),
           (906, "Ünïcode line of more than twenty\nünïcode line of more than twenty"), (907, "ünïcode line of more than twenty"), (908, "ünïcode line of more than twenty\n"),
           (909, "nineteen characters"), (910, "nineteen characters"), (911, "nineteen characters"), (912, "twenty characters..."), (913, "twenty characters..."), (914, "Twenty Characters...\n" * 3),
           (915, "漢字 equal"), (916, "漢字 equal"), (917, "漢字 EQUAL"), (None, "漢字 equal"), (918, "equal " * 50), (919, "word " * 30_000 + "\n" + "x" * 300_000 + "\n" + line)]
    return [*found, *odd]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, "l", 1, "i", "t", "li", "g", "q") for r in texts], DOCS).repartition(5).cache()


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def test_lines(docs, texts, spark):
    assert bag(linededup.drop_repeated_lines(docs).collect()) == bag(brute.lines(texts))
    assert bag(linededup.drop_repeated_lines(docs, min_chars=3, min_docs=2, batches=7).collect()) == bag(brute.lines(texts, 3, 2))
    assert linededup.drop_repeated_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_cold_lines_reach_their_documents_too(docs, texts, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 100)
    assert bag(linededup.drop_repeated_lines(docs, min_chars=3, min_docs=2).collect()) == bag(brute.lines(texts, 3, 2))
    monkeypatch.setattr(linededup, "HOT", 0.01)  # no line is hot
    assert bag(linededup.drop_repeated_lines(docs, min_chars=3, min_docs=2).collect()) == bag(brute.lines(texts, 3, 2))


def test_runs_are_merged_level_by_level(spark):
    rng = random.Random(3)
    batches = [sorted({(1000 - 100 * b - rng.randrange(100), rng.randrange(60)) for _ in range(150)}) for b in range(6)]
    runs = linededup.LineRuns(spark)
    for batch in batches:
        runs.add(spark.createDataFrame(batch, "id long, line long"), 10**9)
    assert [x is not None for x in runs.levels] == [False, True, True]
    assert all(r.count() == r.select("line").distinct().count() for r in runs.runs())
    assert sum(r.agg(F.sum("n")).first()[0] or 0 for r in runs.runs()) < sum(map(len, batches))  # well-known lines added nothing
    want = {}
    for doc, line in (x for batch in batches for x in batch):
        want.setdefault(line, []).append(doc)
    assert bag(runs.repeated().select("line", "top").collect()) == bag((k, max(v)) for k, v in want.items() if len(v) >= 3)
    merge = linededup._merge(*runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merge and "Exchange" not in merge


def test_search(docs, texts, spark):
    items = [(i, t) for i, t in enumerate(t for _, t in texts[:40])] + [(50, None), (51, ""), (52, "equal Equal 漢字"), (None, "equal"), (53, "equal"), (53, "equal"), (54, "nowhereatall"), (55, "word " * 3000)]
    asked = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, rank string")
    want = bag(brute.ranked(texts, items))
    assert bag(dualtree.ranked_search(docs, asked).collect()) == want
    assert bag(dualtree.ranked_search(docs, asked, k=2).collect()) == bag(x for x in want if x[1] <= 2)
    empty = spark.createDataFrame([], DOCS)
    assert dualtree.ranked_search(empty, asked).collect() == [] and dualtree.ranked_search(docs, asked.limit(0)).collect() == []


def test_search_in_small_trees_and_blocks(docs, texts, spark, monkeypatch):
    monkeypatch.setattr(dualtree, "TREE_ROWS", 64)
    monkeypatch.setattr(dualtree, "DOC_LEVELS", (16, 8, 4))
    monkeypatch.setattr(dualtree, "ITEM_LEVELS", (6, 3, 1))
    monkeypatch.setattr(dualtree, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(dualtree, "SEED_PARTS", 2)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = dualtree.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert bag(got.collect()) == bag(brute.ranked(texts, items))


def test_node_pairs_are_pruned():
    """Documents of other words than the items' fall with the first bounds."""
    items = dualtree.read_items(pa.chunked_array([["a b c", "a b d"]]))
    items.weights, items.order, items.least = dualtree.np.array([5, 5, 9, 9]), dualtree.np.arange(2), dualtree.np.array([0, 0])
    row, term = dualtree.np.repeat(dualtree.np.arange(100), 2), dualtree.np.tile(dualtree.np.array([0, 1]), 100)
    levels = dualtree._Levels(row, term, dualtree.np.full(200, 3), items.weights, 100)
    best = dualtree.Best(items.least, 2)
    met = []
    levels.scores = lambda terms, wanted, alive, real=levels.scores: met.append(int(alive.sum())) or real(terms, wanted, alive)
    ids, null = dualtree.np.arange(100), dualtree.np.zeros(100, bool)
    dualtree.search_batch(levels, ids, null, dualtree.item_tree(items), best)
    assert [[d for _, _, d in own] for own in best.held] == [[0, 1], [0, 1]] and len(met) == 2
    best.kth[:] = 31  # one more than any of these documents can reach
    dualtree.search_batch(levels, ids, null, dualtree.item_tree(items), best)
    assert len(met) == 2


@pytest.fixture(scope="module")
def talk(spark):
    found = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(8)
    more = []
    for c in range(100, 420):  # many equal ones, prefixes of each other, and a long one
        kind = rng.randrange(4)
        turns = [f"t{i}" for i in range(rng.randrange(1, 4))] if kind == 0 else ["same", "talk"] if kind == 1 else [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
        more += [(c, i, rng.choice(["user", None]) if kind == 3 else "user", t) for i, t in enumerate(turns)]
    more += [(500, i, "user", f"turn {i}") for i in range(300)] + [(501, i, "user", f"turn {i}") for i in range(200)]
    more += [(600, None, None, None), (600, 0, "", ""), (None, 1, "user", "nobody's"), (-7, 3, "user", "late"), (-7, None, "user", "früh")]
    return [*found, *more]


def test_trie(spark, talk, monkeypatch):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in talk], TALK).repartition(4)
    own = prefixtrie.with_shared_heads(prefixtrie.conversation_turns(table))
    want = bag(brute.trie(brute.rebuilt(talk)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert bag(prefixtrie.prefix_trie(own).select(*columns).collect()) == want
    assert len({r[:2] for r in want}) == len(want)
    # Small shards and ranges: most nodes near the root lie in several of them.
    monkeypatch.setattr(prefixtrie, "RANGE_TURNS", 150)
    for conversations, turns in ((1, 10), (3, 40), (50, 1000)):
        monkeypatch.setattr(prefixtrie, "SHARD_CONVERSATIONS", conversations)
        monkeypatch.setattr(prefixtrie, "SHARD_TURNS", turns)
        nodes, before = [], -1
        rows = sorted(((r["turns"], r["conv_id"], r["chars"]) for r in own.collect()), key=lambda r: r[:2])
        table_ = pa.table({"conv_id": [r[1] for r in rows], "turns": [r[0] for r in rows], "chars": [r[2] for r in rows], "part": [0] * len(rows), "before": [before] * len(rows), "after": [-1] * len(rows)})
        nodes = prefixtrie._range_nodes(table_)
        assert sum(x for x, d in zip(nodes["n_convs"].to_pylist(), nodes["depth"].to_pylist()) if d == 0) == len(rows)
    assert bag(prefixtrie.prefix_trie(own).select(*columns).collect()) == want
    assert prefixtrie.prefix_trie(own.limit(0)).collect() == []


def test_repeated_turns_have_one_order(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "a")]
    orders = {tuple(prefixtrie.conversation_turns(spark.createDataFrame(rows[i:] + rows[:i], "conv_id long, turn long, role string, text string")).first()["turns"]) for i in range(3)}
    assert len(orders) == 1


def test_ends_are_digested_in_order_over_batches():
    import numpy as np

    batch = lambda rows: pa.RecordBatch.from_pydict({"node": [r[0] for r in rows], "place": [r[1] for r in rows], "ends": [np.array(r[2], np.int64).tobytes() for r in rows]})
    out = [r for b in prefixtrie._digest_ends(iter([batch([(b"a", 1, [1, 2]), (b"a", 2, [5])]), batch([(b"a", 9, [7]), (b"b", 3, [4])])])) for r in zip(*b.to_pydict().values())]
    assert out == [(b"a", hashlib.sha256(b"1,2,5,7").hexdigest()), (b"b", hashlib.sha256(b"4").hexdigest())]


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_prefix_trie", "op13_line_dedup"])
def test_registered_queries_and_their_sql(spark, name):
    query, sql = queries.ALL[name]
    ok, note = compare.compare(spark, compare.oracle(SF), query, sql, SF)
    assert ok, note


def test_sql_is_registered():
    assert {oracles.RANKED_SEARCH, oracles.PREFIX_TRIE, oracles.LINE_DEDUP} <= {sql for _, sql in queries.ALL.values()}
