"""Quality rules: word and line counts, and the distance of a document's histograms from its language's, natively.

A document is compared with all documents of its language that pass the base rules: once by how its characters fall
into classes, once by how its words fall on the language's common words.  The distance is Jensen-Shannon (square root
of the divergence with base 2, 0 to 1).  Short texts say little about a distribution, so each distance counts only
from a least number of characters or words on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .tables import cut_lineage

# The most frequent function words of each language.
COMMON_WORDS: Mapping[str, Sequence[str]] = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "with", "as", "be", "by"),
    "de": ("der", "die", "und", "das", "von", "zu", "mit", "den", "ist", "für", "nicht", "ein", "eine", "als", "auch", "des"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour", "qui", "dans", "par", "pas"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "para", "su"),
}
#: Character classes as regular expressions; what none of them takes is the last bin (letters beyond ASCII, mostly).
CLASSES = ("[a-z]", "[ \\t\\n\\x0B\\f\\r]", "[A-Z]", "[.,;:!?'\"()-]", "[0-9]", "[#*$%&|<>]")
BLANK_CLASS, SYMBOL_CLASS = 1, 5
MIN_WORDS = 50
MIN_CHARS_COMPARED = 400
MIN_WORDS_COMPARED = 80
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in the array, first occurrence included.

    Window hashes are sorted, so that equal ones are neighbours; no window is compared with all others.  Which
    windows repeat is looked up in the short list of repeated hashes, or, where that list is long, read off the
    windows sorted together with their places; both give the same.
    """
    def covered(starts: Column) -> Column:
        widths = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(widths, F.lit(0), lambda total, n: total + n)

    def neighbours(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, i: (F.get(ordered, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(ordered, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
        return let(F.array_sort(F.transform(same, lambda x: x["p"])), covered)

    def places(hashes: Column, twice: Column) -> Column:
        looked_up = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda p: p.isNotNull())
        with_place = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= 32, let(looked_up, covered)).otherwise(let(F.array_sort(with_place), neighbours))

    def repeats(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, i: F.get(s, i + 1) == h)))
        return let(twice, lambda t: places(hashes, t))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, let(windows, repeats)).otherwise(F.lit(0)).cast("bigint")


def class_bins(text: Column) -> Column:
    """Characters of each class in turn, and the rest; each class is counted on what the classes before it left."""
    def counted(left: Column, classes: Sequence[str]) -> Column:
        if not classes:
            return F.array(F.length(left).cast("bigint"))
        return let(F.regexp_replace(left, classes[0] + "+", ""), lambda rest: F.concat(
            F.array((F.length(left) - F.length(rest)).cast("bigint")), counted(rest, classes[1:])))

    return counted(text, CLASSES)


def text_features(docs: DataFrame, common_words: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """The base counts and the two histograms of every text, one projection without a shuffle.

    A null text has no words, lines or characters.  ``lang`` picks the list of common words; a null or unknown
    language has none, so that all its words fall into the last bin.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    lists = F.coalesce(*[F.when(lang == k, F.array(*map(F.lit, v))) for k, v in common_words.items()], F.array().cast("array<string>"))
    # Lower-casing whole texts is dear; the spellings that count are written out, and only hits are lower-cased.
    every = sorted({f(w) + end for v in common_words.values() for w in v for f in (str.lower, str.capitalize, str.upper) for end in ("", *".,;:!?")})

    base = docs.select(
        "doc_id", lang.alias("lang"), text.alias("text"), _split(text, "[ \\t\\n\\x0B\\f\\r]+").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"))
    counts = base.select(
        "doc_id", "lang", "words", F.size("words").cast("bigint").alias("n_words"), F.length("text").cast("bigint").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        class_bins(F.col("text")).alias("class_bins"),
        F.transform(F.filter("words", lambda w: w.isin(every)), lambda w: F.regexp_replace(F.lower(w), "[.,;:!?]$", "")).alias("hits"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    return counts.select(
        "doc_id", "lang", "n_words", (F.col("n_chars") - F.get("class_bins", F.lit(BLANK_CLASS))).alias("word_chars"),
        F.get("class_bins", F.lit(SYMBOL_CLASS)).alias("n_symbols"), "n_dup_lines", "n_repeat_words", "n_chars", "class_bins",
        let(F.transform(lists, lambda name: F.size(F.filter("hits", lambda h: h == name)).cast("bigint")), lambda bins: F.concat(
            bins, F.array(F.col("n_words") - F.aggregate(bins, F.lit(0).cast("bigint"), lambda t, n: t + n)))).alias("word_bins"))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; null where one of them is empty."""
    def total(bins: Column) -> Column:
        return F.aggregate(bins, F.lit(0.0), lambda t, n: t + n)

    def term(p: Column, q: Column) -> Column:
        return F.when((p > 0) & (p + q > 0), p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def distance(sums: Column) -> Column:
        parts = F.zip_with(a, b, lambda x, y: let(F.struct((x / sums["a"]).alias("p"), (y / sums["b"]).alias("q")), lambda s: (
            term(s["p"], s["q"]) + term(s["q"], s["p"])) / 2))
        return F.when((sums["a"] > 0) & (sums["b"] > 0), F.sqrt(F.greatest(total(parts), F.lit(0.0))))

    return let(F.struct(total(a).alias("a"), total(b).alias("b")), distance)


def base_failed(n_words: Column, n_repeat_words: Column, min_words: int = MIN_WORDS) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > 50 * n_words)


def language_references(features: DataFrame, n_word_bins: int) -> DataFrame:
    """One row per language: both histograms summed over its documents that pass the base rules."""
    good = features.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return good.groupBy("lang").agg(
        F.array(*[F.sum(F.get("class_bins", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("class_ref"),
        F.filter(F.array(*[F.sum(F.get("word_bins", F.lit(i))) for i in range(n_word_bins)]), lambda n: n.isNotNull()).alias("word_ref"))


def quality_rules(docs: DataFrame, *, common_words: Mapping[str, Sequence[str]] = COMMON_WORDS,
                  max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
                  min_chars: int = MIN_CHARS_COMPARED, min_words: int = MIN_WORDS_COMPARED) -> DataFrame:
    """Counts, distances and the verdict of every document.

    ``kept`` is false where the base rules fail, or where a distance that counts is over its limit.  A text shorter
    than a distance's minimum, and one whose language has no reference, is not judged by that distance (null).
    Repeated rows give repeated rows; an empty table gives an empty one.  Only doc_id, text and lang are read.
    """
    # Narrow rows, written once: the text is read one time for the references and the verdicts.
    features = cut_lineage(text_features(docs, common_words))
    refs = cut_lineage(language_references(features, 1 + max([0, *map(len, common_words.values())])))
    joined = features.join(refs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    judged = joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        F.when(F.col("n_chars") >= min_chars, js_distance(F.col("class_bins"), F.col("class_ref"))).alias("class_distance"),
        F.when(F.col("n_words") >= min_words, js_distance(F.col("word_bins"), F.col("word_ref"))).alias("word_distance"))
    within = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return judged.withColumn("kept", ~F.col("base_failed") & within)
