"""Category suggestions from free text: shared words between a text and a category's own vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.binding import let
from ..session import settle

MIN_SCORE = 0.03


def category_words(templates: DataFrame) -> DataFrame:
    """(template_id, word): words of the path, the naming convention's literals and the breadcrumb."""
    everything = F.concat_ws(
        " ", F.array_join("category_path", " "), t.naming_literals(F.col("naming_convention")),
        F.coalesce("breadcrumb", F.lit("")),
    )
    return templates.select("template_id", F.explode(t.word_set(everything)).alias("word"))


def rank_categories(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Document x category sharing at least one word: shared words, their number, and the score.

    ``docs`` has (doc_id, text).  Whole texts are read, but only their distinct words that some category knows leave
    the scan, so the shuffle grows with the hits and not with the text.
    """
    words = settle(category_words(templates))
    doc_words = docs.select("doc_id", t.word_set(F.col("text")).alias("words")).select(
        "doc_id", F.size("words").alias("n_words"), F.explode("words").alias("word")
    )
    return (
        doc_words.join(words, "word")
        .groupBy("doc_id", "n_words", "template_id")
        .agg(F.count("*").alias("matched"), F.array_sort(F.collect_list("word")).alias("terms"))
        .select(
            "doc_id", "template_id", "n_words", "matched", (F.col("matched") / F.col("n_words")).alias("score"), "terms"
        )
    )


def _common_prefix(low, high):
    """Common leading parts of two paths; of the smallest and the largest of a set it is the prefix of them all."""
    pairs = F.arrays_zip(low.alias("a"), high.alias("b"))
    differs = F.transform(pairs, lambda p: ~F.coalesce(p["a"] == p["b"], F.lit(False)))
    cut = F.array_position(differs, F.lit(True))
    return F.when(cut == 0, low).otherwise(F.slice(low, F.lit(1), F.greatest(cut.cast("int") - 1, F.lit(0))))


def top_suggestion(ranked: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per document with a hit: the single best path, or the part all equally good paths share.

    Counts share the document's denominator, so ties are ties of integers.  All of a document's categories are one
    state, of at most as many as there are templates, so what is ranked is read once; the shared part of a set of
    paths is found from its smallest and largest member.
    """
    paths = settle(templates.select("template_id", "category_path"))
    seen = ranked.join(paths, "template_id").groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.collect_list(F.struct("matched", "category_path", "terms")).alias("all"))
    best = let(F.array_max(F.transform("all", lambda x: x["matched"])), lambda most: F.filter("all", lambda x: x["matched"] == most))
    tied = seen.select("doc_id", "n_words", best.alias("best"))
    path = let(F.transform("best", lambda x: x["category_path"]), lambda p: _common_prefix(F.array_min(p), F.array_max(p)))
    return tied.select(
        "doc_id", path.alias("path"), (F.col("best")[0]["matched"] / F.col("n_words")).alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("best", lambda x: x["terms"])))).alias("terms"), F.size("best").cast("bigint").alias("tied_count"),
    )


def accepted(suggestions: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Suggestions good enough to state; an empty shared path states nothing."""
    return suggestions.filter((F.col("score") >= min_score) & (F.size("path") > 0))


def suggest(docs: DataFrame, templates: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    return accepted(top_suggestion(rank_categories(docs, templates), templates), min_score)
