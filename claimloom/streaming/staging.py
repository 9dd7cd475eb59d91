"""Staged capture: a checkpointed stream of evidence into batch folders, and a batch read that finalises them.

Every micro-batch overwrites its own folder, so a batch replayed after a crash repeats nothing.  First-value-wins and
"a record captured again replaces its earlier rows" need all rows of a job, so finalising is a batch read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.audit import PACK_VERSION, POLICY, manifest
from ..operators.numbering import number_rows
from ..operators.publish import media_refs_by_record
from ..session import cut_lineage, settle

#: Rows of evidence in one part of a pack.
PART_ROWS = 10_000


def _write_batch(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def stage_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start staging ``stream`` (job, record_id, capture, seq, field, ...) below ``path``.

    ``capture`` numbers the captures of a record (or is the capture's time); rows of one capture may come in any
    number of files and batches.

    With ``available_now`` the query takes everything present and stops; otherwise it keeps running.  Starting it
    again with the same checkpoint continues where it stopped.
    """
    writer = stream.writeStream.foreachBatch(_write_batch(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def staged(spark: SparkSession, path: str) -> DataFrame | None:
    """The staged rows, None before the first batch; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def list_staged(spark: SparkSession, path: str) -> DataFrame:
    """(job, record_id) of everything on disk right now."""
    rows = staged(spark, path)
    if rows is None:
        return spark.createDataFrame([], "job string, record_id string")
    return rows.select("job", "record_id").distinct()


def finalize(spark: SparkSession, path: str) -> DataFrame:
    """All rows of every record's latest capture, wherever its batches lie.

    Reads only what is on disk, so it gives the same answer whenever and however often it runs, and however the rows
    were dealt over files and batches.  A replayed batch has replaced its own folder, so nothing is there twice.
    """
    rows = spark.read.parquet(path).drop("batch_id")
    latest = rows.groupBy("job", "record_id").agg(F.max("capture").alias("capture"))
    return rows.join(settle(latest), ["job", "record_id", "capture"], "left_semi")


@dataclass
class FinalPack:
    """What one finalising gives, all of it from one snapshot of the staged rows."""

    evidence: DataFrame  # the rows of every record's latest capture
    parts: DataFrame  # pack, path, content: header and evidence lines
    manifest: DataFrame  # pack, path, sha256
    media: DataFrame  # job, record_id, chunk_no, refs


def finalize_pack(spark: SparkSession, path: str, media_path: str | None = None, part_rows: int = PART_ROWS) -> FinalPack:
    """Staged evidence as packs, one per job, with the media of the same captures.

    The staged rows are read once and written as a snapshot: header, parts, manifest and media agree whatever is
    staged meanwhile.  A pack's lines stand in the order of records and ``seq``, ``part_rows`` to a part
    (``evidence.jsonl``, ``evidence-00001.jsonl``, ...), so finalising the same rows again gives the same bytes.
    ``media_path`` holds staged (job, record_id, capture, seq, url, media_type); references of captures that a later
    one has replaced are left out.
    """
    snapshot = cut_lineage(finalize(spark, path))
    columns = [c for c in snapshot.columns if c not in ("job", "capture")]
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    numbered = number_rows(snapshot.select("job", "record_id", "seq", "field", line.alias("line")), ["job"], ["record_id", "seq", "field", "line"])
    part = F.floor((F.col("row_no") - 1) / part_rows).cast("int")
    # A part is as many lines as part_rows says, never a whole job.
    texts = numbered.groupBy("job", part.alias("n")).agg(F.sort_array(F.collect_list(F.struct("row_no", "line"))).alias("l")).select(
        F.col("job").alias("pack"), F.when(F.col("n") == 0, "evidence.jsonl").otherwise(F.format_string("evidence-%05d.jsonl", "n")).alias("path"),
        F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
    latest = snapshot.select("job", "record_id", "capture").distinct()
    if media_path is None:
        media = spark.createDataFrame([], "job string, record_id string, seq long, url string, media_type string")
    else:
        media = spark.read.parquet(media_path).drop("batch_id").join(latest, ["job", "record_id", "capture"], "left_semi").drop("capture")
    media = cut_lineage(media)
    counts = latest.groupBy("job").agg(F.count("*").alias("product_count")).join(media.groupBy("job").agg(F.count("*").alias("media_count")), "job", "left")
    header = counts.select(F.col("job").alias("pack"), F.lit("datapackage.json").alias("path"), F.to_json(F.struct(
        F.lit(PACK_VERSION).alias("version"), F.create_map(F.lit("program"), F.lit("staging")).alias("producer"), "product_count",
        F.coalesce("media_count", F.lit(0)).alias("media_count"), F.lit(POLICY).alias("provenance_policy"))).alias("text"))
    parts = cut_lineage(texts.unionByName(header).select("pack", "path", F.col("text").cast("binary").alias("content")))
    by_record = media.select(F.struct("job", "record_id").alias("record_id"), "seq", "url", "media_type")
    refs = media_refs_by_record(by_record).select("record_id.job", "record_id.record_id", "chunk_no", "refs")
    return FinalPack(snapshot, parts, manifest(parts), refs)
