"""Finished rows: cells with their blank reasons, row-limited sheets, read-back checks, wide tables and media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..functions.measures import from_mm, size_mm
from ..session import settle
from .numbering import number_rows

# Rows of a sheet without a stated limit, reasons of cells, section of media columns.
DEFAULT_ROW_LIMIT = 500
BUCKETS = ("written", "needs_input", "invalid_dropdown", "unresolved_numeric", "never_populate", "variant_candidate")
MEDIA_SECTION = "Media"


# ---------------------------------------------------------------- cells

def target_unit(fields: DataFrame) -> DataFrame:
    """(template_id, name, unit): the unit a field is stored in, when ``<name> Unit`` allows exactly one."""
    companion = fields.groupBy("template_id", F.col("name").alias("unit_name")).agg(
        F.min_by("vocabulary", "field_ord").alias("units")
    )
    return (
        fields.select("template_id", "name", F.concat("name", F.lit(" Unit")).alias("unit_name")).distinct()
        .join(companion.filter("size(units) = 1"), ["template_id", "unit_name"])
        .select("template_id", "name", F.col("units")[0].alias("unit"))
    )


def cell_values(population: DataFrame, fields: DataFrame) -> DataFrame:
    """What goes into each cell, or why it stays blank: one row per row and writable or reserved field.

    ``population`` has (record_id, [variant_no,] template_id, name, status, value).  System and formula columns are
    never touched and never reported.  Every value leaves as text; a number is converted to the field's own unit.
    """
    keys = ["record_id", "variant_no", "template_id"]
    if "variant_no" not in population.columns:
        population = population.withColumn("variant_no", F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    form = settle(
        fields.join(target_unit(fields), ["template_id", "name"], "left")
        .filter(~flag("locked") & ~flag("is_formula"))
        .select("template_id", "field_ord", "name", "type", "vocabulary", "unit",
                t.never_populate(F.col("name")).alias("reserved"))
    )
    known = population.select(*keys, "name", "status", "value").withColumn("seen", F.lit(1))
    # Reserved fields are not in a population; their rows are added so that every cell is accounted for.
    reserved = known.select(*keys).distinct().join(form.filter("reserved"), "template_id").select(
        *keys, "name", F.lit("needs_input").alias("status"), F.lit(None).cast("string").alias("value"),
    )
    rows = known.drop("seen").unionByName(reserved).join(form, ["template_id", "name"])
    mm = size_mm(F.col("value"))
    number = F.when(F.col("unit").isNull(), mm).otherwise(from_mm(mm, F.col("unit")))
    filled = (F.col("status") == "populated") & F.col("value").isNotNull()
    has_vocabulary = F.coalesce(F.size("vocabulary"), F.lit(0)) > 0
    bucket = (
        F.when(F.col("reserved"), "never_populate")
        .when(~filled & (F.col("status") == "variant_candidate"), "variant_candidate")
        .when(~filled, "needs_input")
        .when((F.col("type") == "numeric") & F.col("number").isNull(), "unresolved_numeric")
        .when((F.col("type") == "dropdown") & has_vocabulary & ~F.array_contains("vocabulary", F.col("value")), "invalid_dropdown")
        .otherwise("written")
    )
    return (
        rows.withColumn("number", F.when(filled & (F.col("type") == "numeric"), number))
        .withColumn("bucket", bucket)
        .select(
            *keys, "field_ord", "name", "type", "bucket",
            F.when(
                F.col("bucket") == "written",
                F.when(F.col("type") == "numeric", F.col("number").cast("string")).otherwise(F.col("value")),
            ).alias("cell"),
        )
    )


def fill_stats(cells: DataFrame) -> DataFrame:
    """Per template column: rows per bucket and the share that was written."""
    counted = cells.groupBy("template_id", "name").pivot("bucket", list(BUCKETS)).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(b) for b in BUCKETS[1:]), F.col(BUCKETS[0]))
    return counted.withColumn("fill_rate", F.col("written") / total)


# ---------------------------------------------------------------- sheets

def sheet_parts(rows: DataFrame, templates: DataFrame, base: str = "products") -> DataFrame:
    """Assign every row its sheet: rows of a category in record order, at most the category's row limit per part.

    ``rows`` has (template_id, record_id, variant_no); a category may hold any share of all rows.  ``templates`` has
    (template_id, category_path, row_limit).
    """
    named = settle(
        templates.select(
            "template_id", t.slug(F.array_join("category_path", "_")).alias("category_slug"),
            F.when(F.coalesce("row_limit", F.lit(0)) > 0, F.col("row_limit")).otherwise(DEFAULT_ROW_LIMIT)
            .cast("bigint").alias("row_limit"),
        )
    )
    numbered = number_rows(
        rows.select("template_id", "record_id", "variant_no"), ["template_id"], ["record_id", "variant_no"]
    )
    placed = numbered.join(named, "template_id").withColumn(
        "part", F.floor((F.col("row_no") - 1) / F.col("row_limit")).cast("bigint") + 1
    )
    totals = numbered.groupBy("template_id").agg(F.count("*").alias("n"))
    name = F.concat(
        F.lit(f"{base}__"), "category_slug",
        F.when(F.col("n") > F.col("row_limit"), F.concat(F.lit("_part"), F.col("part").cast("string"))).otherwise(""),
    )
    return placed.join(settle(totals), "template_id").select(
        "template_id", "category_slug", "part", name.alias("sheet"), "record_id", "variant_no", "row_no",
        (F.col("row_no") - (F.col("part") - 1) * F.col("row_limit") - 1).alias("sheet_row"),
    )


def sheet_cells(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Written cells with the sheet and row they belong to."""
    return cells.filter("bucket = 'written'").join(
        parts.select("record_id", "variant_no", "template_id", "category_slug", "part", "sheet", "row_no", "sheet_row"),
        ["record_id", "variant_no", "template_id"],
    )


def verify_sheet(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows present on one side only, with the side; duplicates count."""
    names = expected.columns
    tagged = expected.select(*names, F.lit(1).alias("_d")).unionAll(actual.select(*names, F.lit(-1).alias("_d")))
    return (
        tagged.groupBy(*names).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
        .withColumn("side", F.when(F.col("_d") > 0, "missing").otherwise("unexpected"))
        .withColumn("copies", F.abs("_d")).drop("_d")
    )


def verify_structure(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Template columns whose type, required, locked or position changed, or that are gone; formula columns may blank."""
    keep = ["template_id", "name", "type", "required", "locked", "col"]
    mine = expected.filter(~F.coalesce(F.col("is_formula"), F.lit(False))).select(*keep)
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) for c in keep]
    return mine.alias("e").join(actual.select(*keep).alias("a"), on=_all(same), how="left_anti")


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def write_failures(mismatches: DataFrame) -> DataFrame:
    """One row per failed (category, part), per template where that is given; the other parts stand."""
    by = [c for c in ("template_id", "category_slug", "part") if c in mismatches.columns]
    return mismatches.groupBy(*by).agg(
        F.count("*").alias("mismatches"), F.lit("read-back differs from what was written").alias("error")
    )


# ---------------------------------------------------------------- wide table and media

def sku_wide(evidence: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per record, one column per observed field (sorted).

    First value wins, absences stay blank.  Without ``fields`` Spark collects the field names first; their number is
    checked against ``spark.sql.pivotMaxValues``.  The records' images are a table of their own (:func:`sku_images`).
    """
    kept = evidence.filter("value IS NOT NULL")
    first = kept.groupBy("record_id", "field").agg(F.min_by("value", "seq").alias("value"))
    wide = first.groupBy("record_id").pivot("field", fields).agg(F.first("value"))
    return evidence.select("record_id").distinct().join(wide, "record_id", "left")


def sku_images(media: DataFrame) -> DataFrame:
    """(record_id, image_no, name): one row per image, numbered from 1 in name order, however many a record has."""
    return number_rows(media.select("record_id", "name").distinct(), ["record_id"], ["name"], "image_no")


def write_sku_csv(wide: DataFrame, path: str, images: DataFrame | None = None) -> None:
    """The wide table as CSV; the images joined into one cell here, where a row is a line of a file."""
    if images is not None:
        listed = images.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("image_no", "name"))).alias("i"))
        joined = F.array_join(F.transform("i", lambda x: x["name"]), "; ")
        wide = wide.join(listed.select("record_id", joined.alias("images")), "record_id", "left").withColumn("images", F.coalesce("images", F.lit("")))
    wide.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def media_refs_by_record(refs: DataFrame, chunk: int = 1000) -> DataFrame:
    """Media references grouped by record, in order; a long list continues in the next ``chunk_no``.

    ``refs`` has (record_id, seq, url, media_type) with seq unique per record, so a chunk never exceeds ``chunk``.
    """
    chunked = refs.withColumn("chunk_no", F.floor(F.col("seq") / chunk).cast("bigint"))
    listed = F.array_sort(F.collect_list(F.struct("seq", "url", "media_type")))
    return chunked.groupBy("record_id", "chunk_no").agg(
        F.transform(listed, lambda r: F.struct(r["url"], r["media_type"])).alias("refs")
    )


def referenced_media(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """(template_id, record_id, name) of files named in media cells; direct URLs are not files."""
    columns = settle(fields.filter(F.col("section") == MEDIA_SECTION).select("template_id", "name"))
    pieces = F.filter(F.transform(F.split("cell", ","), t.strip), lambda p: (p != "") & ~urls.is_web_url(p))
    return cells.filter("cell IS NOT NULL").join(columns, ["template_id", "name"]).select(
        "template_id", "record_id", F.explode(pieces).alias("file")
    )


def reconcile_media(referenced: DataFrame, supplied: DataFrame, *keys: str) -> DataFrame:
    """Files named but not supplied, and files supplied but never named, per package (``keys``)."""
    columns = [*keys, "file"]
    named, given = referenced.select(*columns).distinct(), supplied.select(*columns).distinct()
    missing = named.join(given, columns, "left_anti").withColumn("problem", F.lit("missing"))
    spare = given.join(named, columns, "left_anti").withColumn("problem", F.lit("unreferenced"))
    return missing.unionByName(spare)


# ---------------------------------------------------------------- reports

def run_report(
    captures: DataFrame | None, outcomes: DataFrame, parts: DataFrame, *, variants: DataFrame | None = None, failures: DataFrame | None = None,
    fill: DataFrame | None = None, media: DataFrame | None = None,
) -> DataFrame:
    """(section, label, n): everything a run has to say, one row per line of the report.

    ``outcome`` records per status, ``sheet`` rows per sheet, ``capture`` candidates per status and ``image`` captured
    pages with and without an image (if ``captures`` has ``image``), ``variant`` records per expanded field,
    ``write_failure`` mismatches per category and part, ``written`` cells per column, ``media`` files per problem.
    """
    def section(name: str, rows: DataFrame, label: Column, n: Column) -> DataFrame:
        return rows.groupBy(label.alias("label")).agg(n.cast("bigint").alias("n")).select(F.lit(name).alias("section"), "label", "n")

    one = F.count("*")
    sections = [section("outcome", outcomes, F.col("status"), one), section("sheet", parts, F.col("sheet"), one)]
    if captures is not None:
        sections.append(section("capture", captures, F.col("status"), one))
        if "image" in captures.columns:
            sections.append(section("image", captures.filter("status = 'captured'"), F.when(F.col("image"), "with image").otherwise("without image"), one))
    if variants is not None:
        sections.append(section("variant", variants, F.col("expanded_field"), one))
    if failures is not None:
        sections.append(section("write_failure", failures, F.concat_ws(" part ", "category_slug", F.col("part").cast("string")), F.sum("mismatches")))
    if fill is not None:
        sections.append(section("written", fill, F.concat_ws(".", "template_id", "name"), F.sum("written")))
    if media is not None:
        sections.append(section("media", media, F.col("problem"), one))
    report = sections[0]
    for other in sections[1:]:
        report = report.unionByName(other)
    return report
