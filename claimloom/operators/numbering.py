"""Exact row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _sliced(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned by group and order and written once: a large group lies in many slices that stay as they are."""
    return cut_lineage(df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()))


def _offsets(sliced: DataFrame, group: list[str], amount: Column) -> DataFrame:
    """What the slices of a group before each slice amount to: as many rows as there are slices."""
    sizes = sliced.groupBy(*group, "_slice").agg(amount.alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str = "row_no") -> DataFrame:
    """1-based position of each row within its group, without putting a whole group into one task.

    Rows are range-partitioned by group and order, which splits a large group over many slices.  The slices are
    written once, so that a retried task cannot move a row; each slice is numbered by itself and shifted by the
    number of rows in the slices before it.
    """
    sliced = _sliced(df, group, order)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(_offsets(sliced, group, F.count("*")), [*group, "_slice"])
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_inside", "_before")
    )


def count_before(df: DataFrame, group: list[str], order: list[str], flag: Column, out: str) -> DataFrame:
    """How many earlier rows of its group have the flag, for groups of any size: slices and sums before each slice."""
    sliced = _sliced(df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int")), group, order)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_inside", F.coalesce(F.sum("_flag").over(inside), F.lit(0)))
        .join(_offsets(sliced, group, F.sum("_flag")), [*group, "_slice"])
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_inside", "_before", "_flag")
    )
