"""The registered text queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontaminate import contaminated, find_phrases, span_words
from .dualtree import ranked_search
from .language import identify, learn_filters
from .licenses import scan_licenses
from .linededup import drop_repeated_lines
from .mixing import mix_sources
from .neardup import near_duplicates
from .prefixtrie import conversation_turns, prefix_trie, with_shared_heads
from .quality import quality_rules
from .tables import learn_rows, read_table
from .tokencounts import count_tokens
from .tokenids import stored_ids
from .toxicity import learn_toxicity, score_toxicity
from .windows import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, as often as drawn and in mixed order."""
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents", ["doc_id", "text"]), read_table(spark, sf_dir, "labels")
    learn = learn_rows(F.col("doc_id"), 3, 1)
    model = learn_toxicity(docs.filter(learn), labels.filter(learn))
    held_out = F.coalesce(~learn, F.lit(False)).alias("held_out")
    return score_toxicity(docs.select("doc_id", held_out, "text"), model, carry=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("fits").alias("chars_within_512"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_phrases(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", span_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    learn = learn_rows(F.col("doc_id"), 4, 2)
    filters = learn_filters(docs.filter(learn))
    held_out = F.coalesce(~learn, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), filters, carry=["doc_id", "held_out"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", span_words("removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(conversation_turns(read_table(spark, sf_dir, "conversations"))))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ALL: dict[str, tuple[Query, str | None]] = {
    "op1_mix_sources": (op1_mix_sources, oracles.MIX_SOURCES),
    "op2_toxicity": (op2_toxicity, None),
    "op3_near_duplicates": (op3_near_duplicates, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_token_ids": (op5_token_ids, None),
    "op6_decontaminate": (op6_decontaminate, None),
    "op7_licenses": (op7_licenses, None),
    "op8_language_id": (op8_language_id, None),
    "op9_substring_dedup": (op9_substring_dedup, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_ranked_search": (op11_ranked_search, oracles.RANKED_SEARCH),
    "op12_prefix_trie": (op12_prefix_trie, oracles.PREFIX_TRIE),
    "op13_line_dedup": (op13_line_dedup, oracles.LINE_DEDUP),
}
