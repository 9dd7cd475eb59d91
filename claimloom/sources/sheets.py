"""Template sheets as a table of cells, turned into templates, fields and failures.

``cells`` has (template_id, sheet, row, col, text, number_format, locked, is_formula), ``validations`` has
(template_id, ord, min_col, max_col, kind, formula1) and ``files`` has (template_id, archive, filename, protected).
A sheet is a bounded thing, so lists collected per template are bounded as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.binding import let
from ..session import cut_lineage

HEADER_SCAN = 6
# Sheets every template needs, headings that end a block of instructions, reason of a missing header.
REQUIRED_SHEETS = ("Template", "Lookup", "Instructions")
HEADINGS = (
    "general instructions", "template sections", "required fields", "product naming convention",
    "categorization ids (do not modify):",
)
NO_HEADER = "could not locate a field-name row in the Template sheet"


def _sheet(cells: DataFrame, name: str) -> DataFrame:
    return cells.filter((F.col("sheet") == name) & ~t.is_blank(F.col("text"))).withColumn("text", t.strip(F.col("text")))


def column_letter(n: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters."""
    letter = lambda k: F.char((F.lit(65) + k).cast("int"))
    zero = (n - 1).cast("int")
    second = F.floor(zero / 26) - 1
    third = F.floor(second / 26) - 1
    return F.concat(
        F.when(n > 702, letter(third)).otherwise(""), F.when(n > 26, letter(second % 26)).otherwise(""), letter(zero % 26)
    )


def header_rows(cells: DataFrame, scan: int = HEADER_SCAN) -> DataFrame:
    """(template_id, header_row): the row with most labels among the first rows; one label or none is no header."""
    labels = _sheet(cells, "Template")
    if "kind" in cells.columns:  # a number is no label
        labels = labels.filter(F.coalesce("kind", F.lit("text")) == "text")
    counts = labels.filter(F.col("row") <= scan).groupBy("template_id", "row").agg(F.count("*").alias("n"))
    best = counts.groupBy("template_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "row")).alias("b"))
    return best.filter("b.n < -1").select("template_id", F.col("b.row").alias("header_row"))


def clean_name(c: Column) -> Column:
    """Struct (name, required, conditional) of a header label; a closing ``*`` is looked for before markers go."""
    raw = t.strip(c)
    name = t.strip(F.rtrim(raw, F.lit("*")))
    return F.struct(
        t.strip(F.regexp_replace(name, r"(?i)\((?:opt|cond)\)", "")).alias("name"),
        F.endswith(raw, F.lit("*")).alias("required"),
        F.contains(F.lower(raw), F.lit("(cond)")).alias("conditional"),
    )


def lookups(cells: DataFrame) -> DataFrame:
    """(template_id, col, name, values): one row per lookup column, values in sheet order."""
    found = _sheet(cells, "Lookup").groupBy("template_id", "col").agg(
        F.max(F.when(F.col("row") == 1, F.col("text"))).alias("name"),
        F.array_sort(F.collect_list(F.when(F.col("row") > 1, F.struct("row", "text")))).alias("v"),
    )
    return found.filter("name IS NOT NULL").select(
        "template_id", "col", "name", F.transform("v", lambda x: x["text"]).alias("values")
    )


def is_numeric_format(c: Column) -> Column:
    fmt = F.coalesce(c, F.lit(""))
    return ~fmt.isin("", "General", "@") & fmt.rlike("[0#]") & ~F.lower(fmt).rlike("yy|dd|hh|ss|am/pm")


def _placed(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """``rows`` of templates with a header row, and that row; one shuffle by template.

    The header rows come in by union and a window over one template's rows, not by a join: of tables with a row or
    more per template, Spark would broadcast the one whose size it takes for small.
    """
    marked = rows.withColumn("_row", F.lit(True)).unionByName(headers.select("template_id", "header_row"), allowMissingColumns=True)
    own = Window.partitionBy("template_id")
    return marked.withColumn("header_row", F.max("header_row").over(own)).filter("_row AND header_row IS NOT NULL").drop("_row")


def _template_rows(cells: DataFrame) -> DataFrame:
    return cells.filter("sheet = 'Template'").select(
        "template_id", "row", "col", F.when(~t.is_blank(F.col("text")), t.strip(F.col("text"))).alias("text"),
        F.struct("number_format", "locked", "is_formula").alias("body"),
    )


def header_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(template_id, col, header_row, name, required, conditional) of every labelled header cell."""
    return (
        _placed(_sheet(cells, "Template").select("template_id", "row", "col", "text"), headers).filter("row = header_row")
        .select("template_id", "col", "header_row", clean_name(F.col("text")).alias("n"))
        .select("template_id", "col", "header_row", "n.*")
    )


def columns(cells: DataFrame, validations: DataFrame, headers: DataFrame) -> DataFrame:
    """Header cells with the type, lock and formula flags of their column and its validation, the last one standing.

    Cells, validations and header rows meet in one shuffle by template.
    """
    rules = validations.filter("kind = 'list' AND formula1 IS NOT NULL").select(
        "template_id", F.explode(F.sequence("min_col", "max_col")).alias("col"), F.struct("ord", "formula1").alias("rule")
    )
    placed = _placed(_template_rows(cells).unionByName(rules, allowMissingColumns=True), headers)
    found = placed.filter("rule IS NOT NULL OR row IN (header_row, header_row + 1)").groupBy("template_id", "col").agg(
        F.max("header_row").alias("header_row"),
        F.max(F.when(F.col("row") == F.col("header_row"), F.col("text"))).alias("label"),
        F.max(F.when(F.col("row") == F.col("header_row") + 1, F.col("body"))).alias("body"), F.max("rule")["formula1"].alias("formula1"),
    )
    kind = (
        F.when(F.col("formula1").isNotNull(), "dropdown")
        .when(is_numeric_format(F.col("body.number_format")), "numeric").otherwise("string")
    )
    flag = lambda c: F.coalesce(F.col(f"body.{c}"), F.lit(False)).alias(c)
    return found.filter("label IS NOT NULL").withColumn("n", clean_name(F.col("label"))).select(
        "template_id", "col", "header_row", "n.*", kind.alias("type"), flag("locked"), flag("is_formula"), "formula1"
    )


def field_types(cells: DataFrame, validations: DataFrame, headers: DataFrame) -> DataFrame:
    """(template_id, col, type, locked, is_formula, formula1) from the row below the header and the validations."""
    return columns(cells, validations, headers).select(
        "template_id", "col", "type", "locked", "is_formula", "formula1"
    )


def _with_vocabulary(fields: DataFrame, lookup_columns: DataFrame) -> DataFrame:
    f = t.strip(F.coalesce("formula1", F.lit("")))
    reference = r"^'?([^'!]+)'?!\$?([A-Za-z]+)\$?\d+(?::\$?[A-Za-z]+\$?\d+)?$"
    inline = F.startswith(f, F.lit('"')) & F.endswith(f, F.lit('"'))
    words = F.filter(F.transform(F.split(F.substring(f, F.lit(2), F.length(f) - 2), ","), t.strip), lambda w: w != "")
    by_letter = lookup_columns.select(
        "template_id", column_letter(F.col("col")).alias("letters"), F.struct("name", "values").alias("lookup")
    )
    empty = F.array().cast("array<string>")
    is_dropdown, is_lookup = F.col("type") == "dropdown", F.col("letters").isNotNull()
    letters = F.when(
        is_dropdown & ~inline & (F.regexp_extract(f, reference, 1) == "Lookup"), F.regexp_extract(f, reference, 2)
    )
    # A lookup column reaches the fields that name it by union and a window over the two of them, as in _placed.
    both = fields.withColumn("letters", letters).withColumn("_row", F.lit(True)).unionByName(by_letter, allowMissingColumns=True)
    own = Window.partitionBy("template_id", "letters")
    return (
        both.withColumn("lookup", F.first("lookup", ignorenulls=True).over(own)).filter("_row")
        .withColumn(
            "dropdown_source",
            F.when(is_dropdown, F.when(inline, "inline")
                   .when(is_lookup, F.concat(F.lit("lookup:"), F.coalesce("lookup.name", F.lit("None"))))
                   .otherwise("reference")),
        )
        .withColumn(
            "vocabulary",
            F.when(is_dropdown & inline, words).when(is_lookup, F.coalesce("lookup.values", empty)).otherwise(empty),
        )
        .drop("letters", "lookup", "_row")
    )


def field_vocabulary(types: DataFrame, lookup_columns: DataFrame) -> DataFrame:
    """(template_id, col, dropdown_source, vocabulary) of dropdown columns: inline, a lookup column, or unresolved."""
    return _with_vocabulary(types.filter("type = 'dropdown'"), lookup_columns).select(
        "template_id", "col", "dropdown_source", "vocabulary"
    )


def sections(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(template_id, col, section): the label row above the header, carried to the right."""
    right = Window.partitionBy("template_id").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _placed(_sheet(cells, "Template").select("template_id", "row", "col", "text"), headers).filter("row IN (header_row - 1, header_row)")
    by_column = rows.groupBy("template_id", "col").agg(
        F.max(F.when(F.col("row") < F.col("header_row"), F.col("text"))).alias("label"),
        F.bool_or((F.col("row") == F.col("header_row")) & (F.col("header_row") > 1)).alias("wanted"),
    )
    return (
        by_column.withColumn("section", F.last("label", ignorenulls=True).over(right))
        .filter("wanted").select("template_id", "col", "section")
    )


def _first_at(array: Column, test) -> Column:
    """0-based position of the first element that passes, null when none does."""
    at = F.array_position(F.transform(array, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))
    return (F.nullif(at, F.lit(0)) - 1).cast("int")


def _block(lines: Column, heading: str) -> Column:
    stops = lambda x: F.lower(x).isin(*HEADINGS) | F.startswith(F.lower(x), F.lit("pattern:"))
    empty = F.array().cast("array<string>")

    def after(start: Column) -> Column:
        rest = F.slice(lines, F.coalesce(start, F.lit(0)) + 2, F.lit(1 << 30))
        cut = let(
            rest, lambda r: F.slice(r, F.lit(1), F.coalesce(_first_at(r, stops), F.size(r)))
        )
        return F.when(start.isNull(), empty).otherwise(cut)

    return let(_first_at(lines, lambda x: F.lower(x) == heading), after)


def instruction_struct(lines: Column) -> Column:
    """Breadcrumb, ids, naming line, row limit, media lines, required block, section block and lines of an array of lines."""
    def last_of_each(pairs: Column) -> Column:
        return F.filter(
            pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.lit(1 << 30)), lambda q: q["key"] == p["key"])
        )

    def read(b: Column) -> Column:
        ln, text = b["lines"], b["text"]
        pairs = F.transform(
            F.regexp_extract_all(text, F.lit(r"([a-z_]+_id:\s*cat_[A-Za-z0-9_-]+)")),
            lambda p: F.struct(
                F.substring_index(p, ":", 1).alias("key"), t.strip(F.regexp_replace(p, "^[^:]*:", "")).alias("value")
            ),
        )
        after = F.get(ln, _first_at(ln, lambda x: F.contains(F.lower(x), F.lit("generated for"))) + 1)
        arrow = F.get(ln, _first_at(ln, lambda x: F.contains(x, F.lit(" > "))))
        limit = F.regexp_extract(text, r"(?i)up to\s+([0-9,]+)\s+products", 1)
        required = F.transform(_block(ln, "required fields"), lambda x: t.strip(F.ltrim(x, F.lit("- "))))
        return F.struct(
            F.coalesce(after, arrow).alias("breadcrumb"),
            F.map_from_entries(let(pairs, last_of_each)).alias("category_ids"),
            F.get(ln, _first_at(ln, lambda x: F.startswith(F.lower(x), F.lit("pattern:")))).alias("naming_convention"),
            F.replace(limit, F.lit(","), F.lit("")).try_cast("int").alias("row_limit"),
            F.filter(ln, lambda x: F.lower(x).rlike("media|url")).alias("media_options"),
            F.filter(required, lambda x: x != "").alias("required_fields"),
            _block(ln, "template sections").alias("sections"),
            ln.alias("raw_lines"),
        )

    return let(lines, lambda ln: let(F.struct(ln.alias("lines"), F.array_join(ln, "\n").alias("text")), read))


def instructions(cells: DataFrame) -> DataFrame:
    """(template_id, i): what the instruction sheet of each template says."""
    lines = _sheet(cells, "Instructions").groupBy("template_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda x: x["text"]).alias("lines")
    )
    return lines.select("template_id", instruction_struct(F.col("lines")).alias("i"))


def archive_category(archive: Column, prefix: str = "") -> Column:
    """Category named by an archive file; ``prefix`` is dropped from the front."""
    stem = F.regexp_replace(F.regexp_replace(archive, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    plain = F.when(F.startswith(stem, F.lit(prefix)), F.substring(stem, F.lit(len(prefix) + 1), F.length(stem))).otherwise(stem)
    return t.strip(F.replace(plain, F.lit("_"), F.lit(" ")))


def category_path(breadcrumb: Column, archive: Column, filename: Column, prefix: str = "") -> Column:
    """Breadcrumb parts, else the archive's category followed by the parts of the file name."""
    stem = F.regexp_replace(filename, r"(?i)\.xlsx$", "")
    parts = F.transform(F.split(stem, "_-_"), lambda p: t.strip(F.replace(p, F.lit("_"), F.lit(" "))))
    named = F.concat(F.array(archive_category(archive, prefix)), parts)
    return F.when(F.coalesce(breadcrumb, F.lit("")) != "", F.transform(F.split(breadcrumb, ">"), t.strip)).otherwise(named)


def template_failures(cells: DataFrame, files: DataFrame, scan: int = HEADER_SCAN) -> DataFrame:
    """(template_id, source, reason) of every file that cannot become a template; the others go on."""
    wanted = files.select("template_id", F.explode(F.array(*[F.lit(s) for s in REQUIRED_SHEETS])).alias("sheet"))
    absent = wanted.join(cells.select("template_id", "sheet").distinct(), ["template_id", "sheet"], "left_anti")
    rank = F.array_position(F.array(*[F.lit(s) for s in REQUIRED_SHEETS]), F.col("sheet"))
    incomplete = absent.groupBy("template_id").agg(
        F.concat(
            F.lit("missing required sheet(s): "),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "sheet"))), lambda x: x["sheet"]), ", "),
        ).alias("reason")
    )
    headless = (
        files.select("template_id").join(incomplete, "template_id", "left_anti")
        .join(header_rows(cells, scan), "template_id", "left_anti").withColumn("reason", F.lit(NO_HEADER))
    )
    source = F.concat(F.regexp_replace("archive", r"^.*/", ""), F.lit("::"), "filename")
    return incomplete.unionByName(headless).join(files, "template_id").select("template_id", source.alias("source"), "reason")


def parse_templates(
    cells: DataFrame, validations: DataFrame, files: DataFrame, scan: int = HEADER_SCAN, archive_prefix: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, template_fields, failures).  Every workbook is read once; the narrow result is written."""
    from .workbooks import read_workbooks

    books = cut_lineage(read_workbooks(cells, validations, files, scan, archive_prefix))
    source = F.concat(F.regexp_replace("archive", r"^.*/", ""), F.lit("::"), "filename")
    failures = books.filter("reason IS NOT NULL").select("template_id", source.alias("source"), "reason")
    sound = books.filter("reason IS NULL")
    templates = sound.select(
        "template_id", t.path_text(F.col("category_path")).alias("template_ord"), "zip_category", "filename",
        F.concat_ws("/", "archive", "filename").alias("file"), "category_path", F.col("i.category_ids").alias("category_ids"), "lookups",
        F.col("i").alias("instructions"), F.col("i.row_limit").alias("row_limit"), F.col("i.naming_convention").alias("naming_convention"),
        F.col("i.breadcrumb").alias("breadcrumb"), F.try_element_at("lookups", F.lit("Brand")).alias("brands"),
    )
    fields = sound.select("template_id", F.explode("fields").alias("f")).select("template_id", "f.*")
    return templates, fields, failures


def parse_totals(files: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: files found, parsed and failed."""
    marked = files.select("template_id").join(
        failures.select("template_id", F.lit(1).alias("bad")).distinct(), "template_id", "left"
    )
    return marked.agg(
        F.count("*").alias("found"), F.count_if(F.col("bad").isNull()).alias("parsed"),
        F.count_if(F.col("bad").isNotNull()).alias("failed"),
    )
