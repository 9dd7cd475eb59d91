"""Registered queries over knowledge, template sheets and packs, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.operators import audit, classify, knowledge, match
from claimloom.session import scratch_path
from claimloom.sources import sheets, stores

from . import catalogue as c
from . import sql as q
from .queries_core import evidence

# ---------------------------------------------------------------- knowledge

_KNOWLEDGE = [
    (0, "Hardware > Bars > 12mm", "confirmed"), (1, "Hardware > Bars", "pending_review"), (2, "Hardware > Fasteners", "confirmed"),
    (3, "Machinery > Novelty > Gizmo Profile", "confirmed"), (4, "Machinery > Novelty > Widget Profile", "rejected"), (5, "Hardware > Sheets > Plate > Thin", "confirmed"),
]
_RANGES = [
    (0, "Diameter", 6.0, 40.0, "mm", "https://example.com/bars"), (0, "Length", 6.0, 18.0, "m", "https://example.com/bars"),
    (2, "Size", 5.0, 300.0, "mm", "https://example.com/fasteners"), (3, "Size", 5.0, 30.0, "mm", "https://example.com/novelty"),
    (5, "Length", 1.0, 12.0, "m", "https://example.com/plate"),
]
_K_VALUES = "VALUES " + ", ".join(f"({o}, '{p}', '{s}')" for o, p, s in _KNOWLEDGE)
_R_VALUES = "VALUES " + ", ".join(f"({o}, '{f}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), '{u}', '{s}')" for o, f, lo, hi, u, s in _RANGES)
# Every part asks for the knowledge of the category its name suggests, at varying depth.
_ASKED = f"""CASE {c.NOUN} WHEN 'bolt' THEN 'Hardware > Fasteners > Bolt' WHEN 'ring' THEN 'Hardware > Fasteners' WHEN 'rod' THEN
  CASE WHEN p_partkey % 2 = 0 THEN 'Hardware > Bars > 12mm' ELSE 'Hardware > Bars > 8mm' END WHEN 'plate' THEN CASE WHEN p_partkey % 2 = 0 THEN 'Hardware > Sheets' ELSE 'Hardware' END
  WHEN 'gizmo' THEN 'Machinery > Novelty > Gizmo Profile' WHEN 'widget' THEN 'Machinery > Novelty > Widget Profile' ELSE 'Elsewhere' END"""


def _knowledge(spark):
    k = spark.sql(f"SELECT * FROM {_K_VALUES} AS v(ord, path_text, review_status)")
    return k.withColumn("path", t.path_array(F.col("path_text")))


def _ranges(spark):
    return spark.sql(f"SELECT * FROM {_R_VALUES} AS v(ord, field, min, max, unit, source_url)")


def _suggested(spark, sf):
    return c.read(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"), t.path_array(F.expr(_ASKED)).alias("path"))


_NEAREST_CTE = f"""
k AS (SELECT * FROM ({_K_VALUES}) AS v(ord, path, review_status)), ranges AS (SELECT * FROM ({_R_VALUES}) AS v(ord, field, lo, hi, unit, source_url)),
asked AS (SELECT 'P' || p_partkey AS record_id, {_ASKED} AS path FROM part),
near AS (SELECT a.path, k.ord FROM (SELECT DISTINCT path FROM asked) a JOIN k ON starts_with(a.path || ' > ', k.path || ' > ') OR starts_with(k.path || ' > ', a.path || ' > ')
  QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY len(string_split(k.path, ' > ')) DESC, k.ord) = 1)"""


def knowledge_prefix(spark, sf):
    s = _suggested(spark, sf)
    near = knowledge.nearest_knowledge(s, _knowledge(spark))
    return s.join(near, "path").groupBy(t.path_text(F.col("path")).alias("path"), "stored_ord").agg(F.count("*").alias("n"))


KNOWLEDGE_PREFIX = f"WITH {_NEAREST_CTE} SELECT path, n.ord AS stored_ord, count(*) AS n FROM asked JOIN near n USING (path) GROUP BY 1, 2"


def plausibility_verdict(spark, sf):
    return evidence(spark, sf).select(
        "record_id", "seq", knowledge.plausibility(F.col("value"), F.lit(5.0), F.lit(12.0)).alias("verdict"),
        knowledge.plausibility(F.col("value"), F.lit(5.0), F.lit(12.0), F.lit("cm")).alias("verdict_cm"))


_FIRST = r"try_cast(replace(regexp_extract(value, '([-+]?[0-9][0-9,]*\.?[0-9]*)', 1), ',', '') AS DOUBLE)"
PLAUSIBILITY = f"""WITH {c.EVIDENCE_CTE}, {q.normalized('x', 'evidence', 'record_id, seq', 'value')},
n AS (SELECT e.record_id, e.seq, {_FIRST} AS bare, coalesce(CASE WHEN x.kind = 'scalar' THEN x.n1 / 10 END, {_FIRST}) AS cm FROM evidence e LEFT JOIN x USING (record_id, seq))
SELECT record_id, seq, CASE WHEN bare IS NULL THEN 'unknown' WHEN bare BETWEEN 5 AND 12 THEN 'plausible' ELSE 'implausible' END AS verdict,
  CASE WHEN cm IS NULL THEN 'unknown' WHEN cm BETWEEN 5 AND 12 THEN 'plausible' ELSE 'implausible' END AS verdict_cm FROM n"""


def plausibility_report(spark, sf):
    e = evidence(spark, sf).filter("value IS NOT NULL")
    r = knowledge.plausibility_report(e, _suggested(spark, sf), _knowledge(spark), _ranges(spark))
    return r.select("record_id", "seq", "field", "value", "verdict", F.coalesce("source", F.lit("")).alias("source"))


PLAUSIBILITY_REPORT = f"""WITH {c.EVIDENCE_CTE}, {q.ALIAS_CTE}, {_NEAREST_CTE},
use AS (SELECT a.record_id, n.ord FROM asked a JOIN near n USING (path) JOIN k USING (ord) WHERE k.review_status = 'confirmed'),
al AS (SELECT e.record_id, e.seq, a.target FROM evidence e JOIN use u USING (record_id) JOIN aliases a ON a.key = {q.alias_key('e.field')}
  AND (NOT a.needs_length OR {q.one_axis('e.value')}) JOIN ranges r ON r.ord = u.ord AND r.field = a.target
  QUALIFY row_number() OVER (PARTITION BY e.record_id, e.seq ORDER BY a.alias_ord) = 1),
j AS (SELECT e.record_id, e.seq, e.field, e.value, {_FIRST} AS v, r.lo, r.hi, r.source_url FROM evidence e LEFT JOIN use u USING (record_id) LEFT JOIN al USING (record_id, seq)
  LEFT JOIN ranges r ON r.ord = u.ord AND r.field = coalesce(al.target, e.field) WHERE e.value IS NOT NULL)
SELECT record_id, seq, field, value, CASE WHEN v IS NULL OR lo IS NULL THEN 'unknown' WHEN v BETWEEN lo AND hi THEN 'plausible' ELSE 'implausible' END AS verdict,
  CASE WHEN v IS NULL OR lo IS NULL THEN '' ELSE source_url END AS source FROM j"""

_FINDING = """p_brand AS category, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN 'range' WHEN 1 THEN 'standard' WHEN 2 THEN 'term' ELSE 'range' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'SMALL' END END AS name,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS min, CAST(p_size + 10 AS DOUBLE) AS max,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'https://example.com/s' END AS source_url, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'term' END AS canonical_term"""


def admit_findings(spark, sf):
    part = c.read(spark, sf, "part")
    findings = part.selectExpr(*[x.strip() for x in _split_top(_FINDING)])
    fields = part.filter("p_size > 5").select(F.col("p_brand").alias("category"), F.col("p_type").alias("name")).distinct()
    out = knowledge.admit_findings(findings, fields)
    return out.select("category", "kind", "name", "ord", F.coalesce("min", F.lit(-1.0)).alias("min"), "max", "review_status")


def _split_top(text: str) -> list[str]:
    """Split a select list at its commas outside brackets and CASE blocks."""
    out, depth, cur = [], 0, ""
    for token in text.replace("(", " ( ").replace(")", " ) ").replace(",", " , ").split():
        depth += token in ("(", "CASE")
        depth -= token in (")", "END")
        if token == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += " " + token
    return [*out, cur]


ADMIT = f"""WITH f AS (SELECT {_FINDING} FROM part), ok AS (SELECT * FROM f WHERE source_url <> '' AND name <> ''),
fields AS (SELECT DISTINCT p_brand AS category, p_type AS name FROM part WHERE p_size > 5),
r AS (SELECT * FROM ok WHERE kind = 'range' AND min IS NOT NULL AND (category, name) IN (SELECT (category, name) FROM fields)),
u AS (SELECT * FROM (SELECT * FROM r UNION ALL SELECT * FROM ok WHERE kind = 'term' AND canonical_term <> '') QUALIFY row_number() OVER (PARTITION BY category, kind, name ORDER BY ord DESC) = 1)
SELECT category, kind, name, ord, coalesce(min, -1.0) AS min, max, 'pending_review' AS review_status FROM (SELECT * FROM u UNION ALL SELECT * FROM ok WHERE kind = 'standard')"""


def knowledge_upsert(spark, sf):
    part = c.read(spark, sf, "part")
    rows = part.select(
        F.array("p_brand", "p_type").alias("path"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("researched_at"),
        F.when(F.col("p_partkey") % 3 == 0, "confirmed").otherwise("pending_review").alias("review_status"), "p_partkey")
    current = rows.filter("p_partkey % 5 <> 0").groupBy("path").agg(F.max_by(F.struct("researched_at", "review_status"), "p_partkey").alias("r")).select("path", "r.*")
    new = rows.filter("p_partkey % 5 = 0 AND p_partkey % 2 = 0").drop("p_partkey")
    return stores.upsert_knowledge(current, new).select(t.path_text(F.col("path")).alias("path"), "researched_at", "review_status")


KNOWLEDGE_UPSERT = """WITH r AS (SELECT p_brand || ' > ' || p_type AS path, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS researched_at,
  CASE WHEN p_partkey % 3 = 0 THEN 'confirmed' ELSE 'pending_review' END AS review_status, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS fresh, p_partkey FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 2 = 0)
SELECT path, researched_at, review_status FROM r QUALIFY row_number() OVER (PARTITION BY path ORDER BY fresh DESC, researched_at DESC) = 1"""

# ---------------------------------------------------------------- template sheets: one workbook per part

_HR = "(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END)"
# k: 1-5 header labels, 6-10 body row, 11-12 section labels, 13-19 lookup, 20-34 instructions
_SHEET = "CASE WHEN k <= 12 THEN 'Template' WHEN k <= 19 THEN 'Lookup' ELSE 'Instructions' END"
_ROW = f"""CASE WHEN k <= 5 THEN {_HR} WHEN k <= 10 THEN {_HR} + 1 WHEN k <= 12 THEN {_HR} - 1 WHEN k <= 16 THEN k - 12 WHEN k <= 19 THEN k - 16 ELSE k - 19 END"""
_COL = "CASE WHEN k <= 5 THEN k WHEN k <= 10 THEN k - 5 WHEN k = 11 THEN 1 WHEN k = 12 THEN 3 WHEN k <= 16 THEN 1 WHEN k <= 19 THEN 28 ELSE 1 END"
_TEXT = f"""CASE k WHEN 1 THEN ' Name*' WHEN 2 THEN 'Brand (cond)*' WHEN 3 THEN CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'Size (opt)' END
  WHEN 4 THEN p_type || ' Grade' WHEN 5 THEN 'Floor Price' WHEN 11 THEN 'Product Information' WHEN 12 THEN 'Attributes'
  WHEN 13 THEN 'Brand' WHEN 14 THEN ' ' || p_brand || ' ' WHEN 15 THEN '' WHEN 16 THEN 'Acme' WHEN 17 THEN 'Finish' WHEN 18 THEN p_type WHEN 19 THEN 'Matt'
  WHEN 20 THEN 'This file was generated for:' WHEN 21 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Hardware' ELSE 'Hardware > ' || {c.NOUN} END
  WHEN 22 THEN 'category_id: cat_' || CAST(p_partkey AS STRING) WHEN 23 THEN 'product_type_id: cat_x' WHEN 24 THEN 'Pattern: [Brand] ' || {c.NOUN}
  WHEN 25 THEN 'General Instructions' WHEN 26 THEN 'Add up to ' || CAST(p_partkey % 9 + 1 AS STRING) || ',500 products here' WHEN 27 THEN 'Media: use a URL'
  WHEN 28 THEN 'Required Fields' WHEN 29 THEN '- Name' WHEN 30 THEN '-- Brand' WHEN 31 THEN 'Template Sections' WHEN 32 THEN 'Product Information' WHEN 33 THEN 'Attributes'
  WHEN 34 THEN 'product_type_id: cat_y' END"""
_FORMAT = "CASE k WHEN 8 THEN '0.00' WHEN 9 THEN CASE WHEN p_partkey % 2 = 0 THEN 'yyyy-mm-dd' ELSE '#,##0' END WHEN 10 THEN '0.####' ELSE 'General' END"
# Every ninth workbook has a single label, every tenth lacks a sheet.
_KEEP = """NOT (p_partkey % 9 = 0 AND k IN (2, 3, 4, 5, 11, 12)) AND NOT (p_partkey % 4 = 0 AND k IN (11, 12))
  AND NOT (p_partkey % 10 = 1 AND k BETWEEN 13 AND 19) AND NOT (p_partkey % 10 = 2 AND k BETWEEN 13 AND 34)"""


def _cells(spark, sf):
    part = c.spread(spark, c.read(spark, sf, "part"), "p_partkey").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(34))))
    return part.filter(_KEEP).select(
        F.col("p_partkey").alias("template_id"), F.expr(_SHEET).alias("sheet"), F.expr(_ROW).alias("row"), F.expr(_COL).alias("col"),
        F.expr(_TEXT).alias("text"), F.expr(_FORMAT).alias("number_format"), F.expr("k = 6").alias("locked"), F.expr("k = 10").alias("is_formula"))


def _files(spark, sf):
    return c.read(spark, sf, "part").select(
        F.col("p_partkey").alias("template_id"), F.concat(F.lit("zips/XX_Tools_&_Parts_"), "p_type", F.lit(".zip")).alias("archive"),
        F.concat(F.lit("Big_Things_-_"), F.expr(c.NOUN), F.lit("_"), "p_partkey", F.lit(".xlsx")).alias("filename"), (F.col("p_partkey") % 2 == 0).alias("protected"))


def _validations(spark, sf):
    p = c.spread(spark, c.read(spark, sf, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("template_id"))
    v = lambda o, lo, hi, kind, f: F.struct(
        F.lit(o).alias("ord"), F.lit(lo).alias("min_col"), F.lit(hi).alias("max_col"), F.lit(kind).alias("kind"), f.alias("formula1"))
    rows = F.array(
        v(0, 2, 4, "list", F.lit('"x,y"')), v(1, 2, 2, "list", F.lit("Lookup!$A$2:$A$9")), v(2, 3, 3, "whole", F.lit("1")),
        v(3, 3, 3, "list", F.when(F.col("template_id") % 3 == 0, F.lit("'Lookup'!$AB$2:$AB$4")).when(F.col("template_id") % 3 == 1, F.lit("Lookup!$C$2")).otherwise(F.lit("Other!$A$1"))),
        v(4, 4, 4, "list", F.when(F.col("template_id") % 2 == 0, F.lit('"a, b,,c d"'))))
    return p.select("template_id", F.explode(rows).alias("v")).select("template_id", "v.*")


_CELL_CTE = f"""
cells AS (SELECT template_id, sheet, "row", col, trim(text) AS text, number_format, locked, is_formula, p_partkey, k FROM (SELECT p_partkey AS template_id, {_SHEET} AS sheet, {_ROW} AS "row", {_COL} AS col,
  {_TEXT} AS text, {_FORMAT} AS number_format, k = 6 AS locked, k = 10 AS is_formula, p_partkey, k FROM (SELECT *, unnest(range(1, 35)) AS k FROM part) WHERE {_KEEP})),
cnt AS (SELECT template_id, "row", count(*) AS n FROM cells WHERE sheet = 'Template' AND "row" <= 6 AND coalesce(text, '') <> '' GROUP BY 1, 2),
hdr AS (SELECT template_id, "row" AS header_row FROM (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY n DESC, "row") = 1) WHERE n > 1),
hc AS (SELECT c.template_id, c.col, h.header_row, c.text FROM cells c JOIN hdr h USING (template_id) WHERE c.sheet = 'Template' AND c."row" = h.header_row AND coalesce(c.text, '') <> ''),
names AS (SELECT *, trim(regexp_replace(trim(rtrim(text, '*')), '(?i)\\((opt|cond)\\)', '', 'g')) AS name, ends_with(text, '*') AS required, contains(lower(text), '(cond)') AS conditional FROM hc),
look AS (SELECT h.template_id, h.col, h.text AS name, coalesce((SELECT string_agg(v.text, '|' ORDER BY v."row") FROM cells v WHERE v.template_id = h.template_id AND v.col = h.col
  AND v.sheet = 'Lookup' AND v."row" > 1 AND coalesce(v.text, '') <> ''), '') AS vals FROM cells h WHERE h.sheet = 'Lookup' AND h."row" = 1 AND coalesce(h.text, '') <> ''),
dv AS (SELECT p_partkey AS template_id, 2 AS col, 'Lookup!$A$2:$A$9' AS f FROM part UNION ALL
  SELECT p_partkey, 3, CASE p_partkey % 3 WHEN 0 THEN '''Lookup''!$AB$2:$AB$4' WHEN 1 THEN 'Lookup!$C$2' ELSE 'Other!$A$1' END FROM part UNION ALL
  SELECT p_partkey, 4, CASE WHEN p_partkey % 2 = 0 THEN '"a, b,,c d"' ELSE '"x,y"' END FROM part),
types AS (SELECT n.template_id, n.col, dv.f, CASE WHEN dv.f IS NOT NULL THEN 'dropdown' WHEN regexp_matches(b.number_format, '[0#]') AND NOT regexp_matches(lower(b.number_format), 'yy|dd|hh|ss') AND b.number_format <> 'General' THEN 'numeric' ELSE 'string' END AS type,
  coalesce(b.locked, false) AS locked, coalesce(b.is_formula, false) AS is_formula FROM names n LEFT JOIN cells b ON b.template_id = n.template_id AND b.sheet = 'Template' AND b."row" = n.header_row + 1 AND b.col = n.col
  LEFT JOIN dv ON dv.template_id = n.template_id AND dv.col = n.col),
vocab AS (SELECT t.template_id, t.col, CASE WHEN t.f LIKE '"%' THEN 'inline' WHEN t.f LIKE '%Lookup%' THEN 'lookup:' || coalesce(l.name, 'None') ELSE 'reference' END AS dropdown_source,
  CASE WHEN t.f = '"x,y"' THEN 'x|y' WHEN t.f LIKE '"%' THEN 'a|b|c d' ELSE coalesce(l.vals, '') END AS vocabulary FROM types t
  LEFT JOIN look l ON l.template_id = t.template_id AND l.col = CASE WHEN t.f LIKE '%$AB$%' THEN 28 WHEN t.f LIKE '%$C$%' THEN 3 WHEN t.f LIKE '%Lookup!$A$%' THEN 1 END WHERE t.type = 'dropdown'),
files AS (SELECT p_partkey AS template_id, 'XX_Tools_&_Parts_' || p_type || '.zip' AS archive, 'Big_Things_-_' || {c.NOUN} || '_' || p_partkey || '.xlsx' AS filename, p_partkey % 2 = 0 AS protected FROM part),
fails AS (SELECT template_id, archive || '::' || filename AS source, CASE WHEN template_id % 10 = 1 THEN 'missing required sheet(s): Lookup' WHEN template_id % 10 = 2 THEN 'missing required sheet(s): Lookup, Instructions'
  ELSE 'could not locate a field-name row in the Template sheet' END AS reason FROM files WHERE template_id % 10 IN (1, 2) OR template_id NOT IN (SELECT template_id FROM hdr))"""
_W = f"WITH {_CELL_CTE}"


def template_header_row(spark, sf):
    return sheets.header_rows(_cells(spark, sf))


def template_sections(spark, sf):
    cells = _cells(spark, sf)
    s = sheets.sections(cells, sheets.header_rows(cells))
    return s.select("template_id", "col", F.coalesce("section", F.lit("")).alias("section"))


TEMPLATE_SECTIONS = f"""{_W} SELECT n.template_id, n.col, coalesce((SELECT s.text FROM cells s WHERE s.template_id = n.template_id AND s.sheet = 'Template' AND s."row" = n.header_row - 1
  AND s.col <= n.col AND coalesce(s.text, '') <> '' ORDER BY s.col DESC LIMIT 1), '') AS section FROM names n WHERE n.header_row > 1"""


def template_types(spark, sf):
    cells = _cells(spark, sf)
    return sheets.columns(cells, _validations(spark, sf), sheets.header_rows(cells)).select(
        "template_id", "col", "name", *[F.col(x).cast("int").alias(x) for x in ("required", "conditional", "locked", "is_formula")], "type")


TEMPLATE_TYPES = f"""{_W} SELECT template_id, col, name, CAST(required AS INTEGER) AS required, CAST(conditional AS INTEGER) AS conditional, CAST(locked AS INTEGER) AS locked,
  CAST(is_formula AS INTEGER) AS is_formula, type FROM names JOIN types USING (template_id, col)"""


def template_vocabulary(spark, sf):
    cells = _cells(spark, sf)
    types = sheets.field_types(cells, _validations(spark, sf), sheets.header_rows(cells))
    return sheets.field_vocabulary(types, sheets.lookups(cells)).select("template_id", "col", "dropdown_source", F.array_join("vocabulary", "|").alias("vocabulary"))


TEMPLATE_VOCABULARY = f"{_W} SELECT template_id, col, dropdown_source, vocabulary FROM vocab"


def template_instructions(spark, sf):
    i = F.col("i")
    join = lambda x: F.array_join(i[x], "|").alias(x)
    return sheets.instructions(_cells(spark, sf)).select(
        "template_id", i["breadcrumb"].alias("breadcrumb"), i["naming_convention"].alias("naming_convention"), i["row_limit"].alias("row_limit"),
        join("media_options"), join("required_fields"), join("sections"), F.size(i["raw_lines"]).alias("n_lines"),
        F.concat_ws(",", F.try_element_at(i["category_ids"], F.lit("category_id")), F.try_element_at(i["category_ids"], F.lit("product_type_id"))).alias("ids"))


TEMPLATE_INSTRUCTIONS = f"""SELECT p_partkey AS template_id, CASE WHEN p_partkey % 5 = 0 THEN 'Hardware' ELSE 'Hardware > ' || {c.NOUN} END AS breadcrumb,
  'Pattern: [Brand] ' || {c.NOUN} AS naming_convention, CAST((p_partkey % 9 + 1) * 1000 + 500 AS INTEGER) AS row_limit, 'Media: use a URL' AS media_options, 'Name|Brand' AS required_fields,
  'Product Information|Attributes|product_type_id: cat_y' AS sections, 15 AS n_lines, 'cat_' || p_partkey || ',cat_y' AS ids FROM part WHERE p_partkey % 10 <> 2"""


def template_failures(spark, sf):
    return sheets.template_failures(_cells(spark, sf), _files(spark, sf))


TEMPLATE_FAILURES = f"{_W} SELECT template_id, source, reason FROM fails"


def template_totals(spark, sf):
    files = _files(spark, sf)
    return sheets.parse_totals(files, sheets.template_failures(_cells(spark, sf), files))


TEMPLATE_TOTALS = f"{_W} SELECT count(*) AS found, count(*) FILTER (template_id NOT IN (SELECT template_id FROM fails)) AS parsed, count(*) FILTER (template_id IN (SELECT template_id FROM fails)) AS failed FROM files"


def parsed_fields(spark, sf):
    _, fields, _ = sheets.parse_templates(_cells(spark, sf), _validations(spark, sf), _files(spark, sf), archive_prefix="XX_")
    return fields.select(
        "template_id", "field_ord", "name", "col", "type", F.col("locked").cast("int").alias("locked"), F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce("dropdown_source", F.lit("")).alias("dropdown_source"), F.array_join("vocabulary", "|").alias("vocabulary"))


PARSED_FIELDS = f"""{_W}, sec AS ({TEMPLATE_SECTIONS.split(_W)[1]})
SELECT n.template_id, CAST(row_number() OVER (PARTITION BY n.template_id ORDER BY n.col) - 1 AS INTEGER) AS field_ord, n.name, chr(CAST(64 + n.col AS INTEGER)) AS col, t.type,
  CAST(t.locked AND f.protected AS INTEGER) AS locked, coalesce(s.section, '') AS section, coalesce(v.dropdown_source, '') AS dropdown_source, coalesce(v.vocabulary, '') AS vocabulary
FROM names n JOIN types t USING (template_id, col) JOIN files f USING (template_id) LEFT JOIN vocab v USING (template_id, col) LEFT JOIN sec s USING (template_id, col)
WHERE n.template_id NOT IN (SELECT template_id FROM fails)"""


def template_index(spark, sf):
    templates, fields, _ = sheets.parse_templates(_cells(spark, sf), _validations(spark, sf), _files(spark, sf), archive_prefix="XX_")
    return stores.template_index(templates, fields).select("path", "file", "field_count", "writable_count", "product_type_id")


TEMPLATE_INDEX = f"""{_W}, n AS (SELECT template_id, count(*) AS field_count, count(*) FILTER (NOT (t.locked AND f.protected) AND NOT is_formula) AS writable_count
  FROM names JOIN types t USING (template_id, col) JOIN files f USING (template_id) GROUP BY 1),
p AS (SELECT template_id, CASE WHEN template_id % 5 = 0 THEN 'Hardware' ELSE 'Hardware > ' || {c.NOUN} END AS path, 'zips/' || archive || '/' || filename AS file FROM files JOIN part ON p_partkey = template_id
  WHERE template_id NOT IN (SELECT template_id FROM fails))
SELECT path, file, field_count, writable_count, 'cat_y' AS product_type_id FROM p JOIN n USING (template_id) QUALIFY row_number() OVER (PARTITION BY path ORDER BY file DESC) = 1"""


def _parsed(spark, sf):
    return sheets.parse_templates(_cells(spark, sf), _validations(spark, sf), _files(spark, sf), archive_prefix="XX_")


def writable_fields(spark, sf):
    fields = _parsed(spark, sf)[1]
    need = match.required_writable(fields).select("template_id", "name", F.lit(1).alias("needed"))
    return match.writable(fields).join(need, ["template_id", "name"], "left").select("template_id", "name", F.coalesce("needed", F.lit(0)).alias("needed"))


WRITABLE = f"""{_W} SELECT n.template_id, n.name, CAST(n.required AS INTEGER) AS needed FROM names n JOIN types t USING (template_id, col) JOIN files f USING (template_id)
  WHERE n.template_id NOT IN (SELECT template_id FROM fails) AND NOT (t.locked AND f.protected) AND NOT t.is_formula AND n.name <> 'Floor Price'"""


def category_words(spark, sf):
    return classify.category_words(_parsed(spark, sf)[0])


CATEGORY_WORDS = f"""{_W} SELECT template_id, unnest(list_distinct(['hardware', {c.NOUN}])) AS word
  FROM files JOIN part ON p_partkey = template_id WHERE template_id NOT IN (SELECT template_id FROM fails)"""

# ---------------------------------------------------------------- packs: one per part

_PACK = "'pack' || CAST(p_partkey AS STRING)"
_HEADER = """CASE p_partkey % 6 WHEN 0 THEN '{broken' WHEN 1 THEN '{"version":"1.0","producer":{"program":1}}' ELSE '{"version":"1.0","producer":{"program":1},"product_count":1}' END"""
_LINES = """'{"record_id":"P' || CAST(p_partkey AS STRING) || '","field":"Name","value":"' || p_name || '","source_uri":"https://example.com/","method":"scrape","confidence":0.9,"absence":false,"ts":1.0}' || chr(10) || chr(10) ||
  CASE p_partkey % 5 WHEN 0 THEN '{oops' WHEN 1 THEN '{"record_id":"P","field":"Brand","value":"x","source_uri":"","absence":false}'
  WHEN 2 THEN '{"record_id":"P","field":"Brand","value":null,"absence":true}' WHEN 3 THEN '{"record_id":"P","field":"Brand","value":null}' ELSE '{"record_id":"P","field":"Brand","value":"x","absence":true}' END || chr(10)"""


def _packed(spark, sf):
    return c.spread(spark, c.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")


def _pack_parts(spark, sf):
    part = _packed(spark, sf)
    piece = lambda path, content, keep: F.when(F.expr(keep), F.struct(F.lit(path).alias("path"), F.expr(content).alias("content")))
    rows = F.array_compact(F.array(
        piece("datapackage.json", _HEADER, "p_partkey % 11 <> 0"), piece("evidence.jsonl", _LINES, "p_partkey % 13 <> 0"),
        piece("manifest-sha256.txt", "'listed'", "true"), piece("media/a.webp", "p_brand", "p_partkey % 2 = 0")))
    return part.select(F.expr(_PACK).alias("pack"), F.explode(rows).alias("r")).select("pack", "r.path", F.col("r.content").cast("binary").alias("content"))


def _listed(spark, sf):
    part = _packed(spark, sf)
    rows = F.array(
        F.struct(F.lit("datapackage.json").alias("path"), F.sha2(F.expr(_HEADER).cast("binary"), 256).alias("sha256")),
        F.struct(F.lit("evidence.jsonl").alias("path"), F.sha2(F.expr(f"CASE WHEN p_partkey % 7 = 0 THEN 'changed' ELSE {_LINES} END").cast("binary"), 256).alias("sha256")),
        F.struct(F.lit("media/a.webp").alias("path"), F.sha2(F.col("p_brand").cast("binary"), 256).alias("sha256")))
    return part.select(F.expr(_PACK).alias("pack"), F.explode(rows).alias("r")).select("pack", "r.path", "r.sha256")


def manifest_audit(spark, sf):
    return audit.audit_packs(_pack_parts(spark, sf), _listed(spark, sf))


_SOUND = "p_partkey % 11 <> 0 AND p_partkey % 13 <> 0"
_READ = f"{_SOUND} AND p_partkey % 6 <> 0"
_AUDIT = f"""
SELECT {_PACK} AS pack, 'missing required file(s): ' || CASE WHEN p_partkey % 11 = 0 AND p_partkey % 13 = 0 THEN 'datapackage.json, evidence.jsonl' WHEN p_partkey % 11 = 0 THEN 'datapackage.json' ELSE 'evidence.jsonl' END AS error FROM part WHERE NOT ({_SOUND})
UNION ALL SELECT {_PACK}, 'datapackage.json is not valid JSON' FROM part WHERE {_SOUND} AND p_partkey % 6 = 0
UNION ALL SELECT {_PACK}, 'datapackage.json missing required key: ''product_count''' FROM part WHERE {_READ} AND p_partkey % 6 = 1
UNION ALL SELECT {_PACK}, 'manifest references missing file: media/a.webp' FROM part WHERE {_READ} AND p_partkey % 2 <> 0
UNION ALL SELECT {_PACK}, 'checksum mismatch for evidence.jsonl: manifest says ' || substr(sha256('changed'), 1, 12) || '…, actual is ' || substr(sha256({_LINES}), 1, 12) || '…' FROM part WHERE {_READ} AND p_partkey % 7 = 0
UNION ALL SELECT {_PACK}, 'evidence.jsonl line 1: ' || CASE p_partkey % 5 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'P.Brand = ''x'' has no source'
  WHEN 3 THEN 'P.Brand has neither a value nor a stated absence'
  ELSE 'P.Brand is stated as absent but has the value ''x''' END FROM part WHERE {_READ} AND p_partkey % 5 <> 2"""


def audit_summary(spark, sf):
    parts = _pack_parts(spark, sf)
    s = audit.audit_summary(parts, audit.audit_packs(parts, _listed(spark, sf)))
    return s.select("pack", F.col("ok").cast("int").alias("ok"), "n_errors")


AUDIT_SUMMARY = f"""WITH e AS ({_AUDIT}) SELECT p.pack, CAST(count(e.pack) = 0 AS INTEGER) AS ok, count(e.pack) AS n_errors
  FROM (SELECT {_PACK} AS pack FROM part) p LEFT JOIN e ON e.pack = p.pack GROUP BY 1"""


def pack_header(spark, sf):
    li = c.read(spark, sf, "lineitem")
    ev = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("pack"), F.col("l_partkey").cast("string").alias("record_id"))
    media = li.filter("l_suppkey % 3 <> 0").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("pack"), F.concat("l_returnflag", "l_linestatus", F.lit(".webp")).alias("name"))
    h = audit.pack_header(ev, media)
    first = audit.pack_resources(media).groupBy("pack").agg(F.min("path").alias("first_media"))
    return h.join(first, "pack", "left").withColumn("first_media", F.coalesce("first_media", F.lit("")))


PACK_HEADER = """SELECT 'S' || l_suppkey AS pack, '1.0' AS version, count(DISTINCT l_partkey) AS product_count,
  CASE WHEN l_suppkey % 3 <> 0 THEN count(DISTINCT l_returnflag || l_linestatus) ELSE 0 END AS media_count, 'no-evidence-no-value' AS provenance_policy,
  CASE WHEN l_suppkey % 3 <> 0 THEN 'media/' || min(l_returnflag || l_linestatus || '.webp') ELSE '' END AS first_media FROM lineitem GROUP BY l_suppkey"""


def pack_manifest(spark, sf):
    return audit.manifest(_pack_parts(spark, sf))


PACK_MANIFEST = f"""SELECT {_PACK} AS pack, 'datapackage.json' AS path, sha256({_HEADER}) AS sha256 FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT {_PACK}, 'evidence.jsonl', sha256({_LINES}) FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT {_PACK}, 'media/a.webp', sha256(p_brand) FROM part WHERE p_partkey % 2 = 0"""

# ---------------------------------------------------------------- stores of JSON documents: one per brand


def _store(spark, docs):
    """One JSON document per brand, each in a file of its own."""
    path = scratch_path(spark, "store")
    docs.repartition("p_brand").write.partitionBy("p_brand").option("ignoreNullFields", "false").json(path)
    return path


def template_store(spark, sf):
    """Templates written as documents, read as a store, and one of them asked for by its path."""
    part = c.read(spark, sf, "part")
    field = F.struct(F.col("p_type").alias("name"), F.lit("A").alias("column"), F.lit("string").alias("type"), F.max(F.col("p_size") > 25).alias("required"))
    by_type = part.groupBy("p_brand", "p_type").agg(field.alias("f"))
    docs = by_type.groupBy("p_brand").agg(F.sort_array(F.collect_list("f")).alias("fields")).withColumn("category_path", F.array(F.lit("Brands"), "p_brand")).withColumn("filename", F.lit("x.xlsx"))
    found, fields = stores.read_templates(spark, _store(spark, docs))
    asked = stores.template_for(found, ["Brands", "Brand#11"]).select("template_id", F.lit(1).alias("asked"))
    return fields.join(found.select("template_id", "template_ord"), "template_id").join(asked, "template_id", "left").select(
        F.col("template_ord").alias("path"), F.col("field_ord").cast("int").alias("field_ord"), "name", F.col("required").cast("int").alias("required"), F.coalesce("asked", F.lit(0)).alias("asked"))


TEMPLATE_STORE = """WITH f AS (SELECT p_brand, p_type AS name, max(p_size > 25) AS required FROM part GROUP BY 1, 2)
SELECT 'Brands > ' || p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY name) - 1 AS INTEGER) AS field_ord, name, CAST(required AS INTEGER) AS required,
  CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END AS asked FROM f"""


def knowledge_store(spark, sf):
    """Knowledge documents, some without a status or references, read as a store."""
    part = c.read(spark, sf, "part")
    by_type = part.groupBy("p_brand", "p_type").agg(F.struct(
        F.min("p_size").cast("double").alias("min"), F.max("p_size").cast("double").alias("max"), F.lit("mm").alias("unit"), F.lit("https://example.com/k").alias("source_url")).alias("r"))
    docs = by_type.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "r"))).alias("plausible_ranges")).withColumn("category_path", F.array(F.lit("Brands"), "p_brand"))
    known, ranges = stores.read_knowledge(spark, _store(spark, docs.withColumn("review_status", F.when(F.col("p_brand") < "Brand#3", "confirmed"))))
    return ranges.join(known.select("ord", "review_status", F.size("industry_references").alias("n_references")), "ord").select(
        F.col("ord").alias("path"), "field", "min", "max", "unit", "review_status", "n_references")


KNOWLEDGE_STORE = """SELECT 'Brands > ' || p_brand AS path, p_type AS field, CAST(min(p_size) AS DOUBLE) AS min, CAST(max(p_size) AS DOUBLE) AS max, 'mm' AS unit,
  CASE WHEN p_brand < 'Brand#3' THEN 'confirmed' ELSE 'pending_review' END AS review_status, 0 AS n_references FROM part GROUP BY p_brand, p_type"""


def template_paths(spark, sf):
    """Category paths of workbooks that state none: from archive and file names, and file-safe names of them."""
    files = _files(spark, sf)
    path = sheets.category_path(F.lit(None).cast("string"), F.col("archive"), F.col("filename"), "XX_")
    return files.select("template_id", t.path_text(path).alias("path"), t.file_slug(F.concat(F.col("archive"), F.lit(": "), F.col("filename"))).alias("safe"), t.file_slug(F.when(F.col("template_id") % 2 == 0, "").otherwise("a?b")).alias("empty"))


TEMPLATE_PATHS = f"""SELECT p_partkey AS template_id, 'Tools & Parts ' || p_type || ' > Big Things > ' || {c.NOUN} || ' ' || p_partkey AS path,
  'zips_XX_Tools_&_Parts_' || replace(p_type, '.', '_') || '_zip_ Big_Things_-_' || {c.NOUN} || '_' || p_partkey || '_xlsx' AS safe, CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE 'a_b' END AS empty FROM part"""

QUERIES = {
    "knowledge_prefix": (knowledge_prefix, KNOWLEDGE_PREFIX), "plausibility_verdict": (plausibility_verdict, PLAUSIBILITY),
    "plausibility_report": (plausibility_report, PLAUSIBILITY_REPORT), "admit_findings": (admit_findings, ADMIT),
    "knowledge_upsert": (knowledge_upsert, KNOWLEDGE_UPSERT), "template_header_row": (template_header_row, f"{_W} SELECT template_id, header_row FROM hdr"),
    "template_sections": (template_sections, TEMPLATE_SECTIONS), "template_types": (template_types, TEMPLATE_TYPES),
    "template_vocabulary": (template_vocabulary, TEMPLATE_VOCABULARY), "template_instructions": (template_instructions, TEMPLATE_INSTRUCTIONS),
    "template_failures": (template_failures, TEMPLATE_FAILURES), "template_totals": (template_totals, TEMPLATE_TOTALS),
    "parsed_fields": (parsed_fields, PARSED_FIELDS), "template_index": (template_index, TEMPLATE_INDEX),
    "writable_fields": (writable_fields, WRITABLE), "category_words": (category_words, CATEGORY_WORDS),
    "template_store": (template_store, TEMPLATE_STORE), "knowledge_store": (knowledge_store, KNOWLEDGE_STORE), "template_paths": (template_paths, TEMPLATE_PATHS),
    "manifest_audit": (manifest_audit, _AUDIT), "audit_summary": (audit_summary, AUDIT_SUMMARY), "pack_header": (pack_header, PACK_HEADER),
    "pack_manifest": (pack_manifest, PACK_MANIFEST),
}
