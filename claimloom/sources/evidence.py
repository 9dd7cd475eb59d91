"""Evidence rows as JSON lines, and the rule every row must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import number_lines, row_place

EVIDENCE = (
    "record_id STRING, field STRING, value STRING, source_uri STRING, method STRING, confidence DOUBLE, "
    "absence BOOLEAN, ts DOUBLE, seq BIGINT"
)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines to evidence; blank lines are skipped, unreadable ones kept in ``_corrupt_record``.

    Rows written without ``seq`` get their position: files in the order of their names, rows as they stand in a file,
    counted from 0 whatever way the files are split.  Files whose rows all have one are not numbered.
    """
    raw = spark.read.schema(f"{EVIDENCE}, _corrupt_record STRING").json(path)
    if raw.filter("seq IS NULL").isEmpty():
        return raw
    numbered = number_lines(raw.select("*", *row_place()), "_at")
    return numbered.withColumn("seq", F.coalesce("seq", F.col("_at") - 1)).select(*raw.columns)


def write_evidence(evidence: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Evidence as JSON lines; nulls are written, since an absence is a null value that was stated."""
    evidence.write.mode(mode).option("ignoreNullFields", "false").json(path)


def evidence_problems(record_id: Column, field: Column, value: Column, source_uri: Column, absence: Column) -> Column:
    """Array of rule violations of one row, empty when it is sound."""
    name = F.concat_ws(".", F.coalesce(record_id, F.lit("None")), F.coalesce(field, F.lit("None")))
    absent = F.coalesce(absence, F.lit(False))
    quoted = F.concat(F.lit("'"), value, F.lit("'"))
    return F.array_compact(F.array(
        F.when(absent & value.isNotNull(), F.concat(
            name, F.lit(" is stated as absent but has the value "), quoted)),
        F.when(~absent & value.isNull(), F.concat(
            name, F.lit(" has neither a value nor a stated absence"))),
        F.when(~absent & value.isNotNull() & (F.coalesce(source_uri, F.lit("")) == ""), F.concat(
            name, F.lit(" = "), quoted, F.lit(" has no source"))),
    ))


def _problems() -> Column:
    return evidence_problems(*[F.col(c) for c in ("record_id", "field", "value", "source_uri", "absence")])


def validated(evidence: DataFrame, mode: str = "strict") -> DataFrame:
    """``strict`` stops the job on the first bad row; ``audit`` adds a ``problems`` column instead."""
    if mode == "audit":
        return evidence.withColumn("problems", _problems())
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    checked = evidence.withColumn("_problems", _problems())
    text = F.concat(F.lit("Invalid evidence row — "), F.array_join("_problems", "; "))
    # The check sits in a filter, so it cannot be pruned away with an unused column.
    return checked.filter(F.when(F.size("_problems") > 0, F.raise_error(text).cast("boolean")).otherwise(True)).drop("_problems")


def quarantine(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, bad rows with their problems)."""
    checked = validated(evidence, "audit")
    return checked.filter("size(problems) = 0").drop("problems"), checked.filter("size(problems) > 0")
