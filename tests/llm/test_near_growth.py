"""Near-duplicates: memory is not given back for every small cell, and one exchange of the texts takes the rest out."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from claimloom.llm import neardup
from claimloom.llm import wordspans as ws


def test_small_cells_do_not_trim_memory_one_by_one(monkeypatch):
    trims = []
    monkeypatch.setattr(ws, "_trim", lambda: trims.append)
    monkeypatch.setattr(ws, "_used", 0)
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    sig = [neardup.signature(base), neardup.signature(base[2:])]
    sig[1][: neardup.ROWS] = sig[0][: neardup.ROWS]
    key = int(neardup._bands(np.stack(sig))[0, 0])
    cell = pa.table({"key": [key] * 2, "i": pa.array([0] * 2, pa.int32()), "j": pa.array([0] * 2, pa.int32()), "node": [0, 1], "root": [0, 1],
                     "sig": pa.array([s.astype("<u4").tobytes() for s in sig]), "first": [True] * 2, "second": [True] * 2})
    found = [neardup._search_cell(80)(cell) for _ in range(500)]
    assert all(f["nodes"][0].as_py() == [0, 1] for f in found)
    assert len(trims) <= 1
    monkeypatch.setattr(ws, "GIVE_BACK_BYTES", 1000)  # what adds up does go back
    neardup._search_cell(80)(cell)
    assert len(trims) >= 1


def test_texts_are_shuffled_once_to_take_the_rest_out(spark, tmp_path):
    known = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{known} x{i}", "en", "s", 9) for i in range(4)] + [(100 + i, f"text {i} " * 5, "en", "s", 9) for i in range(50)]
    rows += [(7, "twice the same", "en", "s", 9)] * 2 + [(8, None, "en", "s", 9)] * 2
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_dedup(spark, spark.read.parquet(path), "")
        got = sorted(tuple(r) for r in kept.collect())
        plan = kept._jdf.queryExecution().sparkPlan().toString() + kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    gone = {1, 2, 3}
    assert [r[0] for r in got] == sorted({r[0] for r in rows} - gone)
    assert len([line for line in plan.splitlines() if "Scan parquet [doc_id" in line or "FileScan parquet [doc_id" in line]) <= 2  # once in each of the two plans
