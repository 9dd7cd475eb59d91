"""Filling a template from evidence, and turning one multi-option field into one row per option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.binding import let
from ..functions.measures import confirmed_numeric, option_list, single_axis_length
from .match import TemplateIndex, padded

EXACT, CASE_INSENSITIVE, NORMALIZED, WHOLE_WORD = 1.0, 0.95, 0.85, 0.7


def whole_word_terms(value: Column, vocabulary: Column, vocabulary_padded: Column | None = None) -> Column:
    """Vocabulary terms found in the value as whole words, in vocabulary order, each once."""
    terms = F.transform(vocabulary, padded) if vocabulary_padded is None else vocabulary_padded
    return let(terms, lambda known: let(padded(value), lambda needle: _words_in(needle, vocabulary, known)))


def _words_in(needle: Column, vocabulary: Column, terms: Column) -> Column:
    hit = lambda term, i: (F.get(terms, i) != "  ") & F.contains(needle, F.get(terms, i))
    return F.array_distinct(F.filter(vocabulary, hit))


def match_vocabulary(
    value: Column, vocabulary: Column, lowered: Column | None = None, vocabulary_padded: Column | None = None
) -> Column:
    """Struct (term, method, confidence, terms), strictest level first.

    Two or more hits at a level are an ambiguity and end the search; ``terms`` then lists the whole-word hits.
    """
    lowered = F.transform(vocabulary, F.lower) if lowered is None else lowered
    terms = F.transform(vocabulary, padded) if vocabulary_padded is None else vocabulary_padded
    found = let(F.struct(lowered.alias("lowered"), terms.alias("padded")), lambda known: _ladder(value, vocabulary, known["lowered"], known["padded"]))
    empty = t.is_blank(value) | (F.coalesce(F.size(vocabulary), F.lit(0)) <= 0)
    return F.when(empty, _level(F.lit(None), "no_match", 0.0)).otherwise(found)


def _level(term: Column, method: str, confidence: float, words: Column | None = None) -> Column:
    words = F.array().cast("array<string>") if words is None else words
    return F.struct(
        term.cast("string").alias("term"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), words.alias("terms"))


def _ladder(value: Column, vocabulary: Column, lowered: Column, terms: Column) -> Column:
    def hits(haystack: Column, needle: Column) -> Column:
        return F.size(haystack) - F.size(F.array_remove(haystack, needle))

    def at(haystack: Column, needle: Column) -> Column:
        return F.get(vocabulary, (F.array_position(haystack, needle) - 1).cast("int"))

    def ladder(b: Column) -> Column:
        words = _words_in(b["padded"], vocabulary, terms)
        contained = let(
            words,
            lambda w: F.when(F.size(w) == 1, _level(w[0], "whole_word_containment", WHOLE_WORD))
            .when(F.size(w) > 1, _level(F.lit(None), "whole_word_containment_ambiguous", 0.0, w))
            .otherwise(_level(F.lit(None), "no_match", 0.0)),
        )
        unclear = lambda method: _level(F.lit(None), f"{method}_ambiguous", 0.0, words)
        return (
            F.when(b["exact"] == 1, _level(value, "exact", EXACT))
            .when(b["exact"] > 1, unclear("exact"))
            .when(b["lower"] == 1, _level(at(lowered, F.lower(value)), "case_insensitive", CASE_INSENSITIVE))
            .when(b["lower"] > 1, unclear("case_insensitive"))
            .when(b["norm"] == 1, _level(at(terms, b["padded"]), "normalized", NORMALIZED))
            .when(b["norm"] > 1, unclear("normalized"))
            .otherwise(contained)
        )

    counted = let(
        padded(value),
        lambda p: F.struct(
            p.alias("padded"), hits(vocabulary, value).alias("exact"), hits(lowered, F.lower(value)).alias("lower"),
            F.when(p == "  ", 0).otherwise(hits(terms, p)).alias("norm"),
        ),
    )
    return let(counted, ladder)


def field_values(evidence: DataFrame, matched: DataFrame, index: TemplateIndex) -> DataFrame:
    """First usable value per record and template field; blanks and absences never fill a field.

    ``matched`` holds one (record_id, template_id) row per record.
    """
    return _routed(evidence, matched, index).groupBy("record_id", "template_id", "field_canon").agg(
        F.min_by("value", "seq").alias("value")
    )


def _routed(evidence: DataFrame, matched: DataFrame, index: TemplateIndex) -> DataFrame:
    routes = index.routes.select("template_id", "canon", "has_length", "field_canon")
    direct = index.routes.filter("direct AND NOT has_length").select(
        "template_id", F.col("canon").alias("again"), F.col("canon").alias("again_canon")
    )
    usable = (
        ~F.coalesce(F.col("absence"), F.lit(False))
        & (F.coalesce(F.col("field"), F.lit("")) != "")
        & ~t.is_blank(F.col("value"))
    )
    return (
        evidence.filter(usable)
        .select(
            "record_id", "seq", "value", t.canonical(F.col("field")).alias("canon"),
            single_axis_length(F.col("value")).alias("has_length"),
        )
        .join(matched.select("record_id", "template_id"), "record_id")
        .join(routes, ["template_id", "canon", "has_length"], "left")
        .withColumn("again", F.when(F.col("field_canon").isNull(), t.canonical(F.col("canon"))))
        .join(direct, ["template_id", "again"], "left")
        .withColumn("field_canon", F.coalesce("field_canon", "again_canon"))
        .filter("field_canon IS NOT NULL")
        .select("record_id", "template_id", "field_canon", "value", "seq")
    )


def numeric_status(value: Column) -> Column:
    """One confirmed measurement fills the field; an option list is a variant; anything else needs a person."""
    several = let(
        option_list(value),
        lambda options: F.when(options.isNotNull(), _status("variant_candidate", None, "multi_option_numeric", options))
        .otherwise(_status("needs_input", None, "not_one_confirmed_number", None)),
    )
    return F.when(confirmed_numeric(value), _status("populated", value, None, None)).otherwise(several)


def dropdown_status(m: Column) -> Column:
    """Status from a :func:`match_vocabulary` result."""
    return (
        F.when(m["term"].isNotNull(), _status("populated", m["term"], m["method"], None))
        .when(F.endswith(m["method"], F.lit("_ambiguous")), _status("variant_candidate", None, m["method"], m["terms"]))
        .otherwise(_status("needs_input", None, "not_in_vocabulary", None))
    )


def text_status(value: Column) -> Column:
    """Any text that is not blank fills a plain field as it is."""
    return F.when(t.is_blank(value), _status("needs_input", None, "no_evidence", None)).otherwise(
        _status("populated", value, None, None)
    )


def _status(status: str, value, reason, candidates) -> Column:
    as_text = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
    return F.struct(
        F.lit(status).alias("status"), as_text(value).alias("value"), as_text(reason).alias("reason"),
        (F.array().cast("array<string>") if candidates is None else candidates).alias("candidates"),
    )


def populate(evidence: DataFrame, matched: DataFrame, index: TemplateIndex) -> DataFrame:
    """One row per matched record and writable field with status, value, reason and candidates.

    Every field appears, filled or not: empty rows are added to the evidence before the one aggregation per
    (record, field), so no second join with the evidence is needed.
    """
    slots = index.fields.select("template_id", "field_canon")
    empty = matched.select("record_id", "template_id").join(slots, "template_id").select(
        "record_id", "template_id", "field_canon",
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("seq"),
    )
    raw = (
        _routed(evidence, matched, index)
        .unionByName(empty)
        .groupBy("record_id", "template_id", "field_canon")
        .agg(F.min_by("value", "seq").alias("raw"))
        .join(index.fields, ["template_id", "field_canon"])
    )
    vocabulary = F.when(F.col("type") == "dropdown", F.col("vocabulary"))
    has_vocabulary = (F.col("type") == "dropdown") & (F.coalesce(F.size("vocabulary"), F.lit(0)) > 0)
    hit = match_vocabulary(F.col("raw"), vocabulary, F.col("vocabulary_lower"), F.col("vocabulary_padded"))
    status = (
        F.when(F.col("raw").isNull(), _status("needs_input", None, "no_evidence", None))
        .when(F.col("type") == "numeric", numeric_status(F.col("raw")))
        .when(has_vocabulary, dropdown_status(F.col("hit")))
        .otherwise(text_status(F.col("raw")))
    )
    return (
        raw.withColumn("hit", F.when(has_vocabulary & F.col("raw").isNotNull(), hit))
        .withColumn("s", status)
        .select("record_id", "template_id", "field_ord", "name", "required", "type", "s.*")
    )


def readiness(population: DataFrame, *keys: str) -> DataFrame:
    """Per record: missing required fields (in template order), counts and review status.

    The list holds template fields only, so it is bounded by the template.
    """
    keys = keys or ("record_id", "template_id")
    filled = (F.col("status") == "populated") & F.col("value").isNotNull()
    gap = F.when(F.col("required") & ~filled, F.struct("field_ord", "name"))
    return (
        population.groupBy(*keys)
        .agg(
            F.transform(F.array_sort(F.collect_list(gap)), lambda g: g["name"]).alias("missing_required"),
            F.count_if(F.col("status") == "populated").alias("populated_count"),
            F.count_if(F.col("status") != "populated").alias("needs_input_count"),
        )
        .withColumn(
            "status", F.when(F.size("missing_required") == 0, "ready_for_review").otherwise("incomplete")
        )
    )


# ---------------------------------------------------------------- variants

def _with_axis(population: DataFrame) -> DataFrame:
    # A record holds one row per template field, so this window is bounded by the template.
    whole = Window.partitionBy("record_id")
    open_axis = (F.col("status") == "variant_candidate") & (F.size("candidates") > 0)
    axis = F.when(open_axis, F.struct(F.size("candidates").alias("n"), (-F.col("field_ord")).alias("o"), "name", "candidates"))
    return population.withColumn("axis", F.max(axis).over(whole)).withColumn("open_axis", open_axis)


def variant_axis(population: DataFrame) -> DataFrame:
    """Records with a multi-option field: the field with most options (the earliest on a tie) and the fields left flagged."""
    marked = _with_axis(population).filter("axis IS NOT NULL")
    left_over = F.when(F.col("open_axis") & (F.col("name") != F.col("axis.name")), F.struct("field_ord", "name"))
    return marked.groupBy("record_id").agg(
        F.max("axis.name").alias("expanded_field"),
        F.max("axis.n").alias("option_count"),
        F.transform(F.array_sort(F.collect_list(left_over)), lambda g: g["name"]).alias("other_variant_fields"),
    )


def expand_variants(population: DataFrame) -> DataFrame:
    """One copy of the record per option of its axis; other multi-option fields stay as they are."""
    marked = _with_axis(population)
    copies = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("axis.n"), F.lit(1)), F.lit(1)) - 1)
    rows = marked.withColumn("variant_no", F.explode(copies))
    chosen = F.coalesce(F.col("name") == F.col("axis.name"), F.lit(False)) 
    return rows.select(
        "record_id", "variant_no", "template_id", "field_ord", "name", "required", "type",
        F.when(chosen, "populated").otherwise(F.col("status")).alias("status"),
        F.when(chosen, F.get("axis.candidates", F.col("variant_no"))).otherwise(F.col("value")).alias("value"),
        F.when(chosen, "variant_expansion").otherwise(F.col("reason")).alias("reason"),
        F.when(chosen, F.array().cast("array<string>")).otherwise(F.col("candidates")).alias("candidates"),
    )
