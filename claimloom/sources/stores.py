"""Template and knowledge stores: JSON documents on disk to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PATH_SEPARATOR, path_text

TEMPLATE = """
zip_category STRING, filename STRING, category_path ARRAY<STRING>, category_ids MAP<STRING,STRING>,
fields ARRAY<STRUCT<name:STRING, column:STRING, type:STRING, required:BOOLEAN, conditional:BOOLEAN, locked:BOOLEAN,
  is_formula:BOOLEAN, section:STRING, dropdown_source:STRING, vocabulary:ARRAY<STRING>>>,
lookups MAP<STRING,ARRAY<STRING>>,
instructions STRUCT<breadcrumb:STRING, naming_convention:STRING, row_limit:INT, media_options:ARRAY<STRING>,
  required_fields:ARRAY<STRING>, sections:ARRAY<STRING>, raw_lines:ARRAY<STRING>>,
_corrupt_record STRING
"""

KNOWLEDGE = """
category_path ARRAY<STRING>,
plausible_ranges MAP<STRING,STRUCT<min:DOUBLE,max:DOUBLE,unit:STRING,source_url:STRING>>,
standards ARRAY<STRUCT<name:STRING,description:STRING,source_url:STRING>>,
terminology MAP<STRING,STRUCT<canonical_term:STRING,source_url:STRING>>,
researched_at STRING, review_status STRING,
industry_references ARRAY<STRUCT<name:STRING,description:STRING,source_url:STRING>>,
_corrupt_record STRING
"""


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document below ``path``; the index and unreadable files are left out."""
    raw = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        .withColumn("file", F.col("_metadata.file_path")).filter(F.col("_metadata.file_name") != "index.json")
    )
    return raw.filter("_corrupt_record IS NULL AND category_path IS NOT NULL").drop("_corrupt_record")


def read_templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(templates, template_fields).  Templates are ordered by their path text, never by the order files were found."""
    raw = _documents(spark, path, TEMPLATE).withColumn("template_id", F.sha2(F.concat_ws("\x1f", "file"), 256))
    templates = raw.select(
        "template_id", path_text(F.col("category_path")).alias("template_ord"), "zip_category", "filename", "file",
        "category_path", "category_ids", "lookups", "instructions", F.col("instructions.row_limit").alias("row_limit"),
        F.col("instructions.naming_convention").alias("naming_convention"),
        F.col("instructions.breadcrumb").alias("breadcrumb"), F.col("lookups")["Brand"].alias("brands"),
    )
    fields = raw.select("template_id", F.posexplode("fields").alias("field_ord", "f")).select(
        "template_id", "field_ord", "f.name", F.col("f.column").alias("col"), "f.type", "f.required", "f.conditional",
        "f.locked", "f.is_formula", "f.section", "f.dropdown_source", "f.vocabulary",
    )
    return templates, fields


def template_for(templates: DataFrame, path: str | list[str]) -> DataFrame:
    """The template stored for a category path; asking for an unknown path is an error."""
    key = path if isinstance(path, str) else PATH_SEPARATOR.join(path)
    wanted = templates.sparkSession.range(1).select(F.lit(key).alias("_key"))
    found = wanted.join(templates.withColumn("_key", path_text(F.col("category_path"))), "_key", "left")
    known = F.when(F.col("template_id").isNull(), F.raise_error(F.lit(f"no schema stored for {key!r}")).cast("boolean"))
    return found.filter(F.coalesce(known, F.lit(True))).drop("_key")


def template_index(templates: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, file, product_type_id, category_ids, field_count, writable_count); a later duplicate path replaces an earlier one."""
    locked = F.coalesce("locked", F.lit(False)) | F.coalesce("is_formula", F.lit(False))
    counts = fields.groupBy("template_id").agg(
        F.count("*").alias("field_count"), F.count_if(~locked).alias("writable_count")
    )
    rows = templates.join(counts, "template_id", "left").select(
        path_text(F.col("category_path")).alias("path"), "file", "category_ids",
        F.coalesce("field_count", F.lit(0)).alias("field_count"), F.coalesce("writable_count", F.lit(0)).alias("writable_count"),
    )
    # A map cannot be compared, so the winner is picked by file name and carries the map along.
    last = F.struct("file", "field_count", "writable_count", F.map_entries("category_ids").alias("ids"))
    return rows.groupBy("path").agg(F.max_by(last, "file").alias("r")).select(
        "path", "r.file", F.map_from_entries("r.ids").alias("category_ids"), "r.field_count", "r.writable_count"
    ).withColumn("product_type_id", F.try_element_at("category_ids", F.lit("product_type_id")))


def read_knowledge(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(knowledge, ranges).  Missing references are empty, a missing status is pending; order is by path text."""
    raw = _documents(spark, path, KNOWLEDGE)
    knowledge = raw.select(
        F.col("category_path").alias("path"), path_text(F.col("category_path")).alias("path_text"), "standards", "terminology",
        "plausible_ranges", F.coalesce("researched_at", F.lit("")).alias("researched_at"),
        F.coalesce("review_status", F.lit("pending_review")).alias("review_status"),
        F.coalesce("industry_references", F.array().cast(
            "array<struct<name:string,description:string,source_url:string>>")).alias("industry_references"),
    ).withColumn("ord", F.col("path_text"))
    ranges = knowledge.select("ord", F.explode("plausible_ranges").alias("field", "r")).select(
        "ord", "field", "r.min", "r.max", "r.unit", "r.source_url"
    )
    return knowledge, ranges


def upsert_knowledge(current: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with those of ``new`` replacing stored ones of the same path; one aggregation by path, no window."""
    tagged = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in tagged.columns if c not in ("_new", "path")]
    return (
        tagged.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("_new", "researched_at")).alias("r"))
        .select("path", "r.*")
    )


def knowledge_index(knowledge: DataFrame) -> DataFrame:
    """(path_text, review_status, researched_at) of every stored category."""
    return knowledge.select("path_text", "review_status", "researched_at")
