"""Researched ranges per category: what is admitted, which entry applies, and whether a value is plausible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import first_number, size_mm, mm_factor
from ..functions.text import path_text
from ..session import settle
from .match import resolve_alias

PENDING, CONFIRMED, REJECTED = "pending_review", "confirmed", "rejected"


def admit_findings(findings: DataFrame, fields: DataFrame) -> DataFrame:
    """Findings worth keeping, all pending review.

    ``findings`` has (category, ord, kind, name, min, max, unit, description, canonical_term, source_url), kind being
    range, standard, industry_reference or term.  A range must name a field of its category and carry both bounds;
    everything needs a source.  A repeated range or term replaces the earlier one.  ``fields`` has (category, name).
    """
    told = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    sourced = findings.filter(told("source_url") & told("name"))
    ranges = sourced.filter((F.col("kind") == "range") & F.col("min").isNotNull() & F.col("max").isNotNull()).join(
        fields.select("category", "name").distinct(), ["category", "name"], "left_semi"
    )
    terms = sourced.filter((F.col("kind") == "term") & told("canonical_term"))
    named = sourced.filter(F.col("kind").isin("standard", "industry_reference"))
    rest = [c for c in findings.columns if c not in ("category", "kind", "name")]
    last = (
        ranges.unionByName(terms).groupBy("category", "kind", "name")
        .agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("category", "kind", "name", "r.*")
    )
    return last.unionByName(named.select(*last.columns)).withColumn("review_status", F.lit(PENDING))


def confirmed_only(knowledge: DataFrame) -> DataFrame:
    return knowledge.filter(F.col("review_status") == CONFIRMED)


def _prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: path_text(F.slice(path, F.lit(1), n)))


def nearest_knowledge(paths: DataFrame, knowledge: DataFrame) -> DataFrame:
    """For each asked path the most specific stored entry that contains it or lies below it.

    ``paths`` has (path ARRAY); ``knowledge`` has (path ARRAY, ord, ...).  Both prefix directions become equality
    joins on the few prefixes of a path.  On equal length the entry stored first wins.
    """
    asked = paths.select("path").distinct().filter("size(path) > 0").withColumn("asked", path_text(F.col("path")))
    stored = settle(
        knowledge.select(F.col("path").alias("stored_path"), F.col("ord").alias("stored_ord")).filter("size(stored_path) > 0")
    )
    above = asked.withColumn("key", F.explode(_prefixes(F.col("path")))).join(
        stored.withColumn("key", path_text(F.col("stored_path"))), "key"
    )
    below = asked.withColumn("key", F.col("asked")).join(
        stored.withColumn("key", F.explode(_prefixes(F.col("stored_path")))), "key"
    )
    return (
        above.unionByName(below)
        .groupBy("path")
        .agg(F.min(F.struct((-F.size("stored_path")).alias("n"), "stored_ord")).alias("best"))
        .select("path", "best.stored_ord")
    )


def plausibility(value: Column, low: Column, high: Column, unit: Column | None = None) -> Column:
    """plausible, implausible or unknown; a flag only.

    Bare numbers are compared.  With ``unit`` the value's own unit is honoured and converted to the range's unit.
    """
    number = first_number(value)
    if unit is not None:
        number = F.coalesce(size_mm(value) / mm_factor(unit), number)
    decided = F.when(number.between(low, high), "plausible").otherwise("implausible")
    known = number.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, decided).otherwise("unknown")


def plausibility_report(
    evidence: DataFrame, suggestions: DataFrame, knowledge: DataFrame, ranges: DataFrame, unit_aware: bool = False
) -> DataFrame:
    """Verdict per evidence row, beside the evidence and never touching it.

    ``evidence`` has (record_id, seq, field, value); ``suggestions`` (record_id, path); ``knowledge`` (path, ord,
    review_status); ``ranges`` (ord, field, min, max, unit, source_url).  An aliased name is judged by the range it
    stands for; the observed name is reported.
    """
    nearest = nearest_knowledge(suggestions, knowledge).join(
        confirmed_only(knowledge).select(F.col("ord").alias("stored_ord")), "stored_ord", "left_semi"
    )
    applied = suggestions.join(settle(nearest), "path").select("record_id", F.col("stored_ord").alias("group_id"))
    rows = evidence.select("record_id", "seq", F.col("field").alias("name"), "value").join(applied, "record_id", "left")
    bounds = ranges.select(
        F.col("ord").alias("group_id"), F.col("field").alias("target"), "min", "max", "unit", "source_url"
    )
    named = resolve_alias(rows, ranges.select(F.col("ord").alias("group_id"), "field"))
    judged = named.join(settle(bounds), ["group_id", "target"], "left")
    verdict = plausibility(F.col("value"), F.col("min"), F.col("max"), F.col("unit") if unit_aware else None)
    return judged.withColumn("verdict", verdict).select(
        "record_id", "seq", F.col("name").alias("field"), "value", "verdict",
        F.when(F.col("verdict") != "unknown", F.col("source_url")).alias("source"),
    )
