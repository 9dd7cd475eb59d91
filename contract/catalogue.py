"""Product evidence and category templates over the given ``part`` table.

The given tables hold no product specifications, so every part states its attributes through plain CASE expressions
that Spark and the SQL oracle both evaluate.  Templates are a short dimension list, as in any catalogue.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import path_array

EVIDENCE_STEPS = 16
NOUN = "split_part(p_name, ' ', 2)"
_SIZE = "CAST(p_size AS STRING)"
FIELD = f"""
CASE k
  WHEN 1 THEN 'title'
  WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Manufacturer' ELSE 'Brand' END
  WHEN 3 THEN CASE
    WHEN {NOUN} IN ('bolt', 'ring') THEN CASE WHEN p_partkey % 2 = 0 THEN 'Size' ELSE 'Height' END
    WHEN {NOUN} = 'rod' THEN CASE p_partkey % 3 WHEN 0 THEN '<Diameter (mm)>' WHEN 1 THEN 'Dia' ELSE 'Dimensions' END
    WHEN {NOUN} = 'plate' THEN 'Dimensions'
    WHEN {NOUN} IN ('gizmo', 'widget') THEN 'Profile_Height'
    WHEN {NOUN} = 'gear' THEN 'Teeth' ELSE 'Weight' END
  WHEN 4 THEN CASE WHEN {NOUN} IN ('bolt', 'ring', 'gear', 'plate') THEN 'Finish' END
  WHEN 5 THEN CASE WHEN {NOUN} <> 'rod' OR p_partkey % 2 = 0 THEN 'Material' END
  WHEN 6 THEN CASE WHEN {NOUN} IN ('plate', 'gizmo', 'widget', 'bolt') THEN
    CASE WHEN p_partkey % 2 = 0 THEN 'Color' ELSE ' colour ' END END
  WHEN 7 THEN CASE WHEN {NOUN} = 'rod' THEN CASE WHEN p_partkey % 2 = 0 THEN 'Steel Grade' ELSE 'Grade' END
    WHEN p_partkey % 13 = 0 THEN 'Grade' END
  WHEN 8 THEN CASE WHEN {NOUN} = 'rod' THEN 'Cut-Length' WHEN {NOUN} = 'plate' THEN 'Length (meters)' END
  WHEN 9 THEN 'cost'
  WHEN 10 THEN CASE WHEN p_partkey % 4 = 0 THEN 'Datasheet' WHEN p_partkey % 4 = 1 THEN 'Contact'
    WHEN p_partkey % 4 = 2 THEN 'suggested_category' END
  WHEN 11 THEN CASE WHEN {NOUN} IN ('gizmo', 'widget', 'rod') THEN 'Applications' END
  WHEN 12 THEN CASE WHEN p_partkey % 9 = 0 THEN 'Packing' END
  WHEN 13 THEN CASE WHEN p_partkey % 19 = 0 THEN 'Warranty' END
  WHEN 14 THEN CASE WHEN p_partkey % 19 = 0 THEN 'Origin' END
  WHEN 15 THEN CASE WHEN p_partkey % 19 = 0 THEN 'Certificate' END
  WHEN 16 THEN CASE WHEN p_partkey % 8 = 0 THEN 'Brand' WHEN p_partkey % 8 = 1 THEN 'Floor Price' END
END"""
VALUE = f"""
CASE k
  WHEN 1 THEN p_name
  WHEN 2 THEN CASE p_partkey % 5 WHEN 0 THEN lower(p_brand) WHEN 1 THEN p_brand || ' Ltd'
    WHEN 2 THEN replace(p_brand, '#', '-') ELSE p_brand END
  WHEN 3 THEN CASE
    WHEN {NOUN} = 'rod' THEN CASE p_partkey % 4 WHEN 0 THEN '8 mm' WHEN 1 THEN '12 mm' WHEN 2 THEN '1,2 cm'
      ELSE {_SIZE} || ' mm' END
    WHEN {NOUN} = 'plate' THEN CASE WHEN p_partkey % 2 = 0 THEN '300 x 600 mm' ELSE '1,5 x 2 x 0.5 cm' END
    WHEN {NOUN} = 'gear' THEN {_SIZE}
    WHEN {NOUN} = 'anvil' THEN {_SIZE} || ' kg'
    WHEN p_partkey % 7 = 0 THEN '8/10/12 mm / Customizable'
    WHEN p_partkey % 11 = 0 THEN {_SIZE}
    WHEN p_partkey % 4 = 0 THEN {_SIZE} || ' mm'
    WHEN p_partkey % 4 = 1 THEN {_SIZE} || ',5 cm'
    WHEN p_partkey % 4 = 2 THEN {_SIZE} || '"'
    ELSE '1.' || CAST(100 + p_size AS STRING) || ',25 mm' END
  WHEN 4 THEN p_type
  WHEN 5 THEN CASE p_partkey % 6 WHEN 0 THEN 'Aluminum Alloy' WHEN 1 THEN '  Stainless-Steel  ' WHEN 2 THEN 'PVC'
    WHEN 3 THEN 'pvc' WHEN 4 THEN 'Titanium' ELSE '  ' END
  WHEN 6 THEN CASE p_partkey % 5 WHEN 0 THEN 'Silver/Golden/Bronze' WHEN 1 THEN 'Gray' WHEN 2 THEN 'black'
    WHEN 3 THEN 'Silver, Black or Bronze' ELSE 'Purple' END
  WHEN 7 THEN CASE WHEN {NOUN} = 'rod' THEN 'Fe' || CAST(400 + p_partkey % 4 * 50 AS STRING) END
  WHEN 8 THEN CASE p_partkey % 3 WHEN 0 THEN '2.4/2.5/2.7/3 Meters' WHEN 1 THEN '12 m' ELSE '2.5' END
  WHEN 9 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)
  WHEN 10 THEN CASE WHEN p_partkey % 4 = 0 THEN 'https://example.com/' || CAST(p_partkey AS STRING) || '.pdf'
    WHEN p_partkey % 4 = 1 THEN 'sales@example.com' ELSE 'Hardware' END
  WHEN 11 THEN CASE WHEN {NOUN} = 'rod' THEN 'reinforcement' ELSE CASE p_partkey % 3
    WHEN 0 THEN 'used for a ' || {NOUN} || ' installation' WHEN 1 THEN 'gizmo and widget joints'
    ELSE 'general purposes' END END
  WHEN 12 THEN 'box'
  WHEN 16 THEN CASE WHEN p_partkey % 8 = 0 THEN 'Brand#3' ELSE '1 mm' END
  ELSE 'yes'
END"""
ABSENCE = f"(k = 7 AND {NOUN} <> 'rod')"

BRANDS = "|".join([f"Brand#{i}" for i in range(1, 24)] + ["Brand#7"])
MATERIALS = "Aluminium|Stainless Steel|PVC|Brass"
COLORS = "Silver|Gold|Bronze|Black|Grey"
TYPES = "ECONOMY|STANDARD|Promo|small|LARGE"
_FASTENER = [
    ("Name", "string", "r", "Product Information", ""), ("Brand", "dropdown", "r", "Product Information", BRANDS),
    ("Size", "numeric", "r", "Attributes", ""), ("Size Unit", "dropdown", "", "Attributes", "cm"),
    ("Finish", "dropdown", "", "Attributes", TYPES), ("Material", "dropdown", "r", "Attributes", MATERIALS),
    ("Color", "dropdown", "", "Attributes", COLORS), ("Price", "numeric", "r", "Pricing & Inventory", ""),
    ("Floor Price", "numeric", "", "Pricing & Inventory", ""), ("Product Code", "string", "rlf", "Meta", ""),
]
_BAR = [
    ("Name", "string", "r", "Product Information", ""), ("Brand", "dropdown", "r", "Product Information", BRANDS),
    ("Diameter", "numeric", "r", "Attributes", ""), ("Grade", "dropdown", "r", "Attributes", "Fe400|Fe450|Fe500"),
    ("Length", "numeric", "", "Attributes", ""), ("Length Unit", "dropdown", "", "Attributes", "m"),
    ("Price", "numeric", "r", "Pricing & Inventory", ""),
]
_PROFILE = [
    ("Name", "string", "r", "Product Information", ""), ("Brand", "dropdown", "", "Product Information", BRANDS),
    ("Size", "numeric", "r", "Attributes", ""), ("Color", "dropdown", "r", "Attributes", COLORS),
    ("Material", "string", "", "Attributes", ""), ("Applications", "string", "", "Attributes", ""),
]
# template_id, path, row limit, naming convention, fields (name, type, flags r=required l=locked f=formula, section, vocabulary)
TEMPLATES = [
    ("t01", "Hardware > Fasteners > Bolt", 50, "Pattern: [Brand] steel bolt [Size]", _FASTENER),
    ("t02", "Hardware > Fasteners > Ring", 60, "Pattern: [Brand] ring", _FASTENER),
    ("t03", "Hardware > Bars > 8mm", 40, "Pattern: reinforcement rod", _BAR),
    ("t04", "Hardware > Bars > 12mm", 40, "Pattern: reinforcement rod", _BAR),
    ("t05", "Hardware > Bars > 20mm", None, "Pattern: reinforcement rod", _BAR),
    ("t06", "Hardware > Sheets > Plate", 30, "Pattern: [Color] plate", [
        ("Name", "string", "r", "Product Information", ""), ("Brand", "dropdown", "r", "Product Information", BRANDS),
        ("Dimensions", "string", "r", "Attributes", ""), ("Finish", "dropdown", "", "Attributes", TYPES),
        ("Color", "dropdown", "r", "Attributes", COLORS), ("Length", "numeric", "", "Attributes", ""),
        ("Length Unit", "dropdown", "", "Attributes", "m"), ("Material", "dropdown", "", "Attributes", MATERIALS),
    ]),
    ("t07", "Machinery > Gears > Gear", 25, "Pattern: [Teeth] gear", [
        ("Name", "string", "r", "Product Information", ""), ("Brand", "dropdown", "r", "Product Information", BRANDS),
        ("Teeth", "string", "r", "Attributes", ""), ("Finish", "dropdown", "", "Attributes", TYPES),
        ("Material", "dropdown", "r", "Attributes", MATERIALS),
    ]),
    ("t08", "Machinery > Novelty > Gizmo Profile", 20, "Pattern: red gizmo", _PROFILE),
    ("t09", "Machinery > Novelty > Widget Profile", 20, "Pattern: blue widget", _PROFILE),
    ("t10", "Machinery > Forge > Anvil", 20, "Pattern: cold anvil", [
        ("Name", "string", "r", "Product Information", ""), ("Brand", "string", "", "Product Information", ""),
        ("Weight", "numeric", "r", "Attributes", ""), ("Material", "string", "", "Attributes", ""),
        ("Price", "string", "", "Pricing & Inventory", ""), ("Horn", "string", "r", "Attributes", ""),
        ("Face", "string", "r", "Attributes", ""), ("Hardy Hole", "string", "r", "Attributes", ""),
    ]),
    ("t11", "Misc > Forge Supplies", 20, "", [
        ("Name", "string", "", "Product Information", ""), ("Weight", "string", "", "Attributes", ""),
        ("Warranty", "string", "", "Attributes", ""), ("Price", "string", "", "Attributes", ""),
    ]),
]


def _quote(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _flag(flags: str, letter: str) -> str:
    return "true" if letter in flags else "false"


TEMPLATE_VALUES = "VALUES " + ", ".join(
    f"({_quote(i)}, {n}, {_quote(path)}, {_quote(limit)}, {_quote(naming)})"
    for n, (i, path, limit, naming, _) in enumerate(TEMPLATES)
)
FIELD_VALUES = "VALUES " + ", ".join(
    f"({_quote(i)}, {n}, {_quote(name)}, {_quote(kind)}, {_flag(flags, 'r')}, {_flag(flags, 'l')}, "
    f"{_flag(flags, 'f')}, {_quote(section)}, {_quote(vocabulary)}, {_quote(chr(65 + n))})"
    for i, _, _, _, fields in TEMPLATES
    for n, (name, kind, flags, section, vocabulary) in enumerate(fields)
)
TEMPLATE_COLUMNS = "template_id, template_ord, path, row_limit, naming_convention"
FIELD_COLUMNS = "template_id, field_ord, name, type, required, locked, is_formula, section, vocab, col"

# The same inputs as common table expressions for the oracle.
EVIDENCE_CTE = f"""
evidence AS (
  SELECT 'P' || CAST(p_partkey AS STRING) AS record_id, CAST(k AS BIGINT) AS seq, field,
    CASE WHEN absence THEN NULL ELSE value END AS value, absence, p_partkey
  FROM (SELECT p_partkey, k, {FIELD} AS field, {VALUE} AS value, {ABSENCE} AS absence
        FROM (SELECT *, unnest(range(1, {EVIDENCE_STEPS + 1})) AS k FROM part)) WHERE field IS NOT NULL)"""
TEMPLATE_CTE = f"""
templates AS (SELECT * FROM ({TEMPLATE_VALUES}) AS v({TEMPLATE_COLUMNS})),
fields AS (SELECT * FROM ({FIELD_VALUES}) AS v({FIELD_COLUMNS}))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, narrow: DataFrame, key: str) -> DataFrame:
    """Rows of a given file dealt to all cores before more is made of them: such a file is one row group."""
    return narrow.repartition(spark.sparkContext.defaultParallelism, key)


def _at(text: str, k: int) -> Column:
    """A CASE over ``k`` at one step: Spark folds it to the branch of that step."""
    return F.expr(re.sub(r"\bk\b", str(k), text.replace(NOUN, "noun")))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark, read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "p_partkey").withColumn(
        "noun", F.expr(NOUN))
    # All steps of a part at once: one row per part and step would pass through the branches of every other step.
    steps = F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("seq"), _at(FIELD, k).alias("field"), _at(VALUE, k).alias("value"), _at(ABSENCE, k).alias("absence"))
        for k in range(1, EVIDENCE_STEPS + 1)])
    stated = rows.select("p_partkey", F.explode(steps).alias("s")).select("p_partkey", "s.*")
    return stated.filter("field IS NOT NULL").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"), "seq", "field",
        F.when(~F.col("absence"), F.col("value")).alias("value"),
        F.when(~F.col("absence"), F.concat(F.lit("https://example.com/p/"), "p_partkey")).alias("source_uri"),
        F.lit("scrape").alias("method"), F.lit(0.9).alias("confidence"), "absence", F.lit(0.0).alias("ts"),
    )


def templates(spark: SparkSession) -> DataFrame:
    t = spark.sql(f"SELECT * FROM {TEMPLATE_VALUES} AS v({TEMPLATE_COLUMNS})")
    return t.select(
        "template_id", F.col("template_ord").cast("bigint").alias("template_ord"), "path",
        path_array(F.col("path")).alias("category_path"), "row_limit", "naming_convention",
        F.lit(None).cast("string").alias("breadcrumb"),
    )


def fields(spark: SparkSession) -> DataFrame:
    f = spark.sql(f"SELECT * FROM {FIELD_VALUES} AS v({FIELD_COLUMNS})")
    words = F.filter(F.split("vocab", r"\|"), lambda w: w != "")
    return f.withColumn("vocabulary", words).withColumn("conditional", F.lit(False)).drop("vocab")
