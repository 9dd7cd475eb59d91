"""Lines of text files with their place, whatever way Spark splits the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

#: Names the place of a row while it is read.
PLACE = ("_file", "_block", "_row")


def row_place() -> list[Column]:
    """File, start of the block in it, and a number that grows from row to row of a block.

    A block is read by one task from front to back, so these three order the rows of a file as they stand in it.
    """
    return [F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]), F.monotonically_increasing_id().alias(PLACE[2])]


def number_lines(placed: DataFrame, out: str = "line_no", group: list[str] | None = None) -> DataFrame:
    """Replaces the place by a 1-based number: within each ``group``, or over all files in the order of their names.

    Numbers come from range slices and their sizes, so a file may hold any share of the rows.
    """
    group = group or []
    return number_rows(placed, group, [c for c in PLACE if c not in group], out).drop(*[c for c in PLACE if c not in group])
