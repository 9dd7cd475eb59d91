"""From raw documents to stored token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.decontaminate import contaminated, find_phrases, span_words
from claimloom.llm.language import fits_language, identify, learn_filters, least_fits
from claimloom.llm.mixing import mix_sources
from claimloom.llm.neardup import near_duplicates
from claimloom.llm.tables import cut_lineage, read_table, scratch_path, small_batches, with_row_key
from claimloom.llm.tokenids import stored_ids
from claimloom.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones, with the language found as theirs.

    Texts without a letter or a known n-gram go, and those that fit their best language less than half as well as
    its labelled documents do.
    """
    small_batches(spark)
    filters = learn_filters(docs)
    found = identify(docs, filters, carry=COLUMNS, fit=True).filter(fits_language(least_fits(docs, filters)))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates stays: the one with the smallest id.

    Documents without words stay; rows with the same id and text are one document.
    """
    small_batches(spark)
    judged = cut_lineage(near_duplicates(docs).select("row_key", "survives"))
    gone = settle(judged.filter(~F.col("survives")).select("row_key").distinct())
    # Equal keys meet in the one exchange of the texts: the join and the choice of one row both deal by the key.
    stays = with_row_key(docs.select(*COLUMNS), "row_key").join(gone, "row_key", "left_anti")
    return stays.dropDuplicates(["row_key"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which test phrases cover less than one word in twenty."""
    found = find_phrases(docs, read_table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.filter(~contaminated(span_words(), F.col("n_words"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in tempered proportions, documents repeated as drawn, in mixed order."""
    return mix_sources(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, stored in the mixed order they come in and read back: one row per document."""
    small_batches(spark)
    return stored_ids(docs, public_tokenizers.path("word_bpe_49k.json"), by_id=False, with_ids=False)


STAGES = [("language id", language_id), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mixing), ("token ids", token_ids)]

#: Stages learn models and store files, which SQL cannot express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents", COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
