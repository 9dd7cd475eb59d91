"""Reading inputs and writing intermediate tables for the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, shared_folder

__all__ = ["cut_lineage", "learn_rows", "read_table", "scratch_path", "shared_folder", "small_batches", "with_row_key"]

#: Bytes of an Arrow batch: rows here are whole texts and sets, and a batch is held by Spark and by Python.
BATCH_BYTES = "16m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, unless it already has smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(filter(str.isdigit, spark.conf.get(key))) or 0) == 64 << 20:
        spark.conf.set(key, BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    small_batches(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


def learn_rows(doc_id: Column, modulus: int, held_out: int) -> Column:
    """True where a document may be learned from: crc32 of its id as text leaves another remainder than ``held_out``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus != held_out


def with_row_key(df: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a 16-byte key of (id, text).

    Repeated rows share it and get equal answers; rows that only share an id, or have none, keep apart.  It stands for
    the text in shuffles, and rows without an id are still spread over all tasks.
    """
    null = F.lit("-")
    return df.withColumn(
        name,
        F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), null),
                                  F.when(F.col(text_col).isNull(), null).otherwise(F.concat(F.lit("+"), F.col(text_col)))).cast("binary"))),
    )
