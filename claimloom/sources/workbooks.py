"""Whole workbooks: cells to templates in one pass over each workbook, and templates back to cells.

Reading gathers a workbook into one array of cells and folds it where it stands: header, columns, dropdowns, lookups
and instructions come from expressions over that array, so cells, validations and files are each read once.  Of the
``Template`` sheet only the rows that can hold labels or the row below them are gathered, however many rows of
products follow.  Writing is the inverse: every template states its header row, section labels, dropdown rules,
lookups and instructions as cells, and what is read from them again is compared with the template.

``cells`` may have a ``kind`` (``text``, ``number``, ...); without it every cell is text.  Only text is a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.binding import let
from ..operators.publish import verify_sheet
from ..session import cut_lineage, settle
from .sheets import (
    HEADER_SCAN, NO_HEADER, REQUIRED_SHEETS, archive_category, category_path, clean_name, column_letter, instruction_struct, is_numeric_format,
)

SECTION_ROW, HEADER_ROW, DATA_ROW = 1, 2, 3
#: What is compared of every column.
COMPARED = ("type", "required", "locked", "col", "section", "vocabulary")

_WORDS = "array<string>"
_CELL = "struct<sheet:string,row:int,col:int,text:string,kind:string,number_format:string,locked:boolean,is_formula:boolean>"


# ---------------------------------------------------------------- cells to templates

def gather(cells: DataFrame, validations: DataFrame, files: DataFrame, scan: int = HEADER_SCAN) -> DataFrame:
    """One row per file: its sheets, its cells as one array (by sheet, row and column) and its list rules in order."""
    cells = _with_defaults(cells, kind="string")
    kind = F.coalesce("kind", F.lit("text"))
    cell = F.struct(
        "sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), t.strip(F.coalesce("text", F.lit(""))).alias("text"), kind.alias("kind"),
        "number_format", F.coalesce("locked", F.lit(False)).alias("locked"), F.coalesce("is_formula", F.lit(False)).alias("is_formula"))
    needed = (F.col("sheet") != "Template") | (F.col("row") <= scan + 1)
    books = cells.groupBy("template_id").agg(F.collect_set("sheet").alias("sheets"), F.sort_array(F.collect_list(F.when(needed, cell))).alias("cells"))
    rules = validations.filter("kind = 'list' AND formula1 IS NOT NULL").groupBy("template_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "min_col", "max_col", "formula1"))).alias("rules"))
    return files.join(books, "template_id", "left").join(rules, "template_id", "left")


def _header_row(labels: Column, scan: int) -> Column:
    """The row with most labels, the earlier of two; null if it has one label or none."""
    counts = F.transform(F.sequence(F.lit(1), F.lit(scan)), lambda r: F.struct((-F.size(F.filter(labels, lambda c: c["row"] == r))).alias("n"), r.alias("row")))
    return let(F.array_min(counts), lambda best: F.when(best["n"] < -1, best["row"]))


def _lookup_columns(cells: Column) -> Column:
    """Array of (letters, name, values), by column."""
    filled = F.filter(cells, lambda c: (c["sheet"] == "Lookup") & (c["text"] != ""))

    def read(all_: Column) -> Column:
        names = F.filter(all_, lambda c: (c["row"] == 1) & (c["kind"] == "text"))
        below = lambda n: F.transform(F.filter(all_, lambda c: (c["col"] == n["col"]) & (c["row"] > 1)), lambda c: c["text"])
        return F.transform(names, lambda n: F.struct(column_letter(n["col"]).alias("letters"), n["text"].alias("name"), below(n).alias("values")))

    return let(filled, read)


def _dropdown(formula: Column, lookups: Column) -> Column:
    """Struct (source, words) of a list rule: an inline list, a lookup column, or a reference that leads nowhere."""
    pattern = r"^'?([^'!]+)'?!\$?([A-Za-z]+)\$?\d+(?::\$?[A-Za-z]+\$?\d+)?$"
    none = F.array().cast(_WORDS)

    def read(f: Column) -> Column:
        inner = F.filter(F.transform(F.split(F.substring(f, F.lit(2), F.length(f) - 2), ","), t.strip), lambda w: w != "")
        column = F.get(F.filter(lookups, lambda x: x["letters"] == F.regexp_extract(f, pattern, 2)), F.lit(0))
        named = let(F.array(column), lambda c: F.struct(
            F.concat(F.lit("lookup:"), F.coalesce(c[0]["name"], F.lit("None"))).alias("source"), F.coalesce(c[0]["values"], none).alias("words")))
        return (F.when(F.startswith(f, F.lit('"')) & F.endswith(f, F.lit('"')), F.struct(F.lit("inline").alias("source"), inner.alias("words")))
                .when(F.regexp_extract(f, pattern, 1) == "Lookup", named).otherwise(F.struct(F.lit("reference").alias("source"), none.alias("words"))))

    return let(t.strip(formula), read)


def _columns(b: Column, protected: Column) -> Column:
    """Array of field structs of a workbook with a header row, by column."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    at = lambda offset: F.filter(b["template"], lambda c: c["row"] == b["header_row"] + offset)

    def field(p: Column, h: Column, i: Column) -> Column:
        below = F.get(F.filter(p["body"], lambda c: c["col"] == h["col"]), F.lit(0))
        rule = last(F.filter(b["rules"], lambda r: (r["min_col"] <= h["col"]) & (h["col"] <= r["max_col"])))["formula1"]
        section = last(F.filter(p["above"], lambda c: (c["col"] <= h["col"])))["text"]
        parts = F.struct(clean_name(h["text"]).alias("n"), F.array(below).alias("below"), rule.alias("rule"))

        def build(x: Column) -> Column:
            cell = x["below"][0]
            list_ = F.when(x["rule"].isNotNull(), _dropdown(x["rule"], b["lookups"]))
            kind = F.when(x["rule"].isNotNull(), "dropdown").when(is_numeric_format(cell["number_format"]), "numeric").otherwise("string")
            return let(list_, lambda d: F.struct(
                i.alias("field_ord"), x["n"]["name"].alias("name"), column_letter(h["col"]).alias("col"), kind.alias("type"), x["n"]["required"].alias("required"),
                x["n"]["conditional"].alias("conditional"), (F.coalesce(cell["locked"], F.lit(False)) & protected).alias("locked"),
                F.coalesce(cell["is_formula"], F.lit(False)).alias("is_formula"), section.alias("section"), d["source"].alias("dropdown_source"),
                F.coalesce(d["words"], F.array().cast(_WORDS)).alias("vocabulary")))

        return let(parts, build)

    is_label = lambda c: (c["kind"] == "text") & (c["text"] != "")
    rows = F.struct(F.filter(at(0), is_label).alias("heads"), at(1).alias("body"), F.filter(at(-1), is_label).alias("above"))
    return let(rows, lambda p: F.transform(p["heads"], lambda h, i: field(p, h, i)))


def read_workbooks(cells: DataFrame, validations: DataFrame, files: DataFrame, scan: int = HEADER_SCAN, archive_prefix: str = "") -> DataFrame:
    """One row per file: ``reason`` it cannot become a template (null if it can), its path, instructions, lookups and fields."""
    books = gather(cells, validations, files, scan)
    none = F.array().cast(f"array<{_CELL}>")
    no_rules = F.array().cast("array<struct<ord:int,min_col:int,max_col:int,formula1:string>>")
    known = F.coalesce("cells", none)
    missing = F.array_except(F.array(*[F.lit(s) for s in REQUIRED_SHEETS]), F.coalesce("sheets", F.array().cast(_WORDS)))
    protected = F.coalesce("protected", F.lit(False))

    def read(b: Column) -> Column:
        labels = F.filter(b["template"], lambda c: (c["kind"] == "text") & (c["text"] != ""))
        whole = let(_header_row(labels, scan), lambda row: F.struct(b["template"].alias("template"), b["lookups"].alias("lookups"), b["rules"].alias("rules"), row.alias("header_row")))
        return let(whole, lambda w: F.struct(w["header_row"].alias("header_row"), w["lookups"].alias("lookups"), _columns(w, protected).alias("fields")))

    parts = F.struct(F.filter(known, lambda c: c["sheet"] == "Template").alias("template"), _lookup_columns(known).alias("lookups"), F.coalesce("rules", no_rules).alias("rules"))
    lines = F.transform(F.filter(known, lambda c: (c["sheet"] == "Instructions") & (c["text"] != "")), lambda c: c["text"])
    read_ = books.select(*files.columns, missing.alias("_missing"), let(parts, read).alias("_b"), instruction_struct(lines).alias("i"))
    reason = F.when(F.size("_missing") > 0, F.concat(F.lit("missing required sheet(s): "), F.array_join("_missing", ", "))).when(F.col("_b.header_row").isNull(), F.lit(NO_HEADER))
    # Of several lookup columns of one name the last counts.
    by_name = let(F.col("_b.lookups"), lambda all_: F.map_from_entries(F.transform(
        F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.lit(1 << 30)), lambda y: y["name"] == x["name"])), lambda x: F.struct(x["name"], x["values"]))))
    return read_.select(
        *files.columns, reason.alias("reason"), category_path(F.col("i.breadcrumb"), F.col("archive"), F.col("filename"), archive_prefix).alias("category_path"),
        archive_category(F.col("archive"), archive_prefix).alias("zip_category"), "i", by_name.alias("lookups"), F.col("_b.fields").alias("fields"))


# ---------------------------------------------------------------- templates to cells

def _cell(sheet: str, row: Column, col: Column, text: Column, number_format: Column | None = None, locked: Column | None = None, formula: Column | None = None) -> Column:
    return F.struct(
        F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"), text.cast("string").alias("text"), F.lit("text").alias("kind"),
        (F.lit("General") if number_format is None else number_format).alias("number_format"), (F.lit(False) if locked is None else locked).alias("locked"),
        (F.lit(False) if formula is None else formula).alias("is_formula"))


def column_number(letters: Column) -> Column:
    """A -> 1, AA -> 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def _with_defaults(df: DataFrame, **kinds: str) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items() if c not in df.columns])


def complete_fields(fields: DataFrame) -> DataFrame:
    """Fields with every column a workbook states; without ``col`` they stand side by side in their order."""
    out = _with_defaults(fields, conditional="boolean", section="string", dropdown_source="string")
    if "col" in out.columns:
        return out
    # Fields of one template: a bounded window.
    return out.withColumn("col", column_letter(F.row_number().over(Window.partitionBy("template_id").orderBy("field_ord"))))


def _instruction_lines() -> Column:
    """Lines that state a template's path, naming convention and row limit."""
    return F.array_compact(F.array(
        F.lit("This file was generated for:"), t.path_text(F.col("category_path")), F.col("naming_convention"),
        F.when(F.col("row_limit").isNotNull(), F.concat(F.lit("Add up to "), F.col("row_limit").cast("string"), F.lit(" products")))))


def template_workbooks(templates: DataFrame, fields: DataFrame) -> DataFrame:
    """(template_id, protected, cells, rules): every template as the cells and dropdown rules of an empty workbook.

    ``templates`` has template_id, category_path, naming_convention, row_limit and perhaps ``instructions`` (its own
    lines are used then); ``fields`` is as parsed.  Dropdown words go to a lookup column, or inline where they did
    before.  Section labels stand over the first of their columns; a column without a section cannot follow one with.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    fields, templates = complete_fields(fields), _with_defaults(templates, naming_convention="string", row_limit="int")
    source = F.col("dropdown_source")
    words = F.coalesce("vocabulary", F.array().cast(_WORDS))
    listed = (F.when(F.col("type") != "dropdown", F.lit(None)).when((F.size(words) == 0) & ~F.coalesce(F.startswith(source, F.lit("lookup:")), F.lit(False)), F.lit("reference"))
              .when(F.coalesce(source, F.lit("reference")) == "reference", F.concat(F.lit("lookup:"), F.col("name"))).otherwise(source))
    shape = fields.groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct(
        column_number(F.col("col")).alias("n"), "name", "type", flag("required"), flag("conditional"), flag("locked"), flag("is_formula"), "section",
        listed.alias("source"), words.alias("words")))).alias("shape"))
    lines = _instruction_lines()
    if "instructions" in templates.columns:
        lines = F.coalesce(F.col("instructions.raw_lines"), lines)

    def build(b: Column) -> Column:
        fs, looks = b["shape"], b["looks"]
        header = F.transform(fs, lambda f: _cell("Template", F.lit(HEADER_ROW), f["n"], F.concat(
            f["name"], F.when(f["conditional"], " (cond)").otherwise(""), F.when(f["required"], "*").otherwise(""))))
        starts = F.filter(fs, lambda f, i: f["section"].isNotNull() & ~F.coalesce(F.get(fs, i - 1)["section"] == f["section"], F.lit(False)))
        labels = F.transform(starts, lambda f: _cell("Template", F.lit(SECTION_ROW), f["n"], f["section"]))
        body = F.transform(fs, lambda f: _cell("Template", F.lit(DATA_ROW), f["n"], F.lit(""), F.when(f["type"] == "numeric", "0.####").otherwise("General"), f["locked"], f["is_formula"]))
        names = F.transform(looks, lambda x, j: _cell("Lookup", F.lit(1), j + 1, x["name"]))
        values = F.flatten(F.transform(looks, lambda x, j: F.transform(x["words"], lambda w, k: _cell("Lookup", k + 2, j + 1, w))))
        blank = F.array(_cell("Lookup", F.lit(1), F.lit(1), F.lit("")), _cell("Instructions", F.lit(1), F.lit(1), F.lit("")))
        text = F.transform(b["lines"], lambda x, j: _cell("Instructions", j + 1, F.lit(1), x))
        none = F.lit(None).cast("string")

        def formula(f: Column) -> Column:
            place = F.array_position(F.transform(looks, lambda x: x["name"]), F.substring(f["source"], F.lit(8), F.length(f["source"])))
            return let(F.struct(column_letter(place).alias("l"), f["source"].alias("s")), lambda p: F.when(p["s"] == "inline", F.concat(F.lit('"'), F.array_join(f["words"], ","), F.lit('"')))
                       .when(p["s"] == "reference", F.lit("Elsewhere!$A$1"))
                       .otherwise(F.concat(F.lit("Lookup!$"), p["l"], F.lit("$2:$"), p["l"], F.lit("$"), (F.size(f["words"]) + 1).cast("string"))))

        rules = F.transform(F.filter(fs, lambda f: f["source"].isNotNull()), lambda f: F.struct(
            f["n"].alias("ord"), f["n"].alias("min_col"), f["n"].alias("max_col"), F.lit("list").alias("kind"), F.coalesce(formula(f), none).alias("formula1")))
        return F.struct(F.exists(fs, lambda f: f["locked"]).alias("protected"), F.concat(labels, header, body, names, values, blank, text).alias("cells"), rules.alias("rules"))

    looks = F.array_distinct(F.transform(F.filter("shape", lambda f: F.coalesce(F.startswith(f["source"], F.lit("lookup:")), F.lit(False))), lambda f: F.struct(
        F.substring(f["source"], F.lit(8), F.length(f["source"])).alias("name"), f["words"].alias("words"))))
    bound = F.struct(F.col("shape"), looks.alias("looks"), lines.alias("lines"))
    return templates.join(shape, "template_id").select("template_id", let(bound, build).alias("b")).select("template_id", "b.*")


def book_id() -> Column:
    """The workbook of a row with template_id and sheet."""
    return F.concat_ws("/", "template_id", "sheet")


def sheet_workbooks(written: DataFrame, parts: DataFrame, templates: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, validations, files) of one workbook per sheet: its template's structure and its rows of products.

    ``written`` has (sheet, template_id, name, type, cell, sheet_row), ``parts`` a row per (template_id, sheet).  The
    workbook's ``template_id`` in all three tables is :func:`book_id`: sheets of two categories may share a name.
    """
    # One row per template, written once: every sheet of a template starts from the same cells.
    empty = settle(template_workbooks(templates, fields))
    books = parts.select("template_id", "sheet").distinct().join(empty, "template_id").withColumn("book", book_id())
    names = ["sheet", "row", "col", "text", "kind", "number_format", "locked", "is_formula"]
    structure = books.select("book", F.explode("cells").alias("c")).select(F.col("book").alias("template_id"), *[F.col(f"c.{n}").alias(n) for n in names])
    # The first row of products carries the formats already: its empty cells give way to values.
    place = complete_fields(fields).select("template_id", "name", column_number(F.col("col")).alias("col"))
    values = written.join(place, ["template_id", "name"]).select(
        book_id().alias("template_id"), F.lit("Template").alias("sheet"), (F.col("sheet_row") + DATA_ROW).cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        F.col("cell").alias("text"), F.when(F.col("type") == "numeric", "number").otherwise("text").alias("kind"))
    form = structure.filter((F.col("sheet") == "Template") & (F.col("row") == DATA_ROW))
    first = values.filter(F.col("row") == DATA_ROW)
    key = ["template_id", "sheet", "row", "col"]
    merged = form.drop("text", "kind").join(first, key, "left").select(
        *key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kind", F.lit("text")).alias("kind"), "number_format", "locked", "is_formula").select("template_id", *names)
    rest = values.filter(F.col("row") > DATA_ROW).select(
        "template_id", "sheet", "row", "col", "text", "kind", F.lit("General").alias("number_format"), F.lit(False).alias("locked"), F.lit(False).alias("is_formula"))
    other = structure.filter((F.col("sheet") != "Template") | (F.col("row") < DATA_ROW))
    validations = books.select(F.col("book").alias("template_id"), F.explode("rules").alias("r")).select("template_id", "r.*")
    files = books.select(F.col("book").alias("template_id"), F.lit("sheets").alias("archive"), F.concat("sheet", F.lit(".xlsx")).alias("filename"), "protected")
    return other.unionByName(merged).unionByName(rest), validations, files


def sheet_values(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """(template_id, row, name, text) of the filled product cells of workbooks, by the columns they were read to have."""
    place = fields.select("template_id", "name", column_number(F.col("col")).cast("int").alias("col"))
    return cells.filter((F.col("sheet") == "Template") & (F.col("row") >= DATA_ROW) & (F.col("text") != "")).join(place, ["template_id", "col"]).select(
        "template_id", "row", "name", "text")


def compare_structure(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(template_id, name, problem): columns that are gone, new, or changed, with what changed."""
    sides = [df.select("template_id", "name", *[F.col(c).alias(f"{side}_{c}") for c in COMPARED], F.lit(True).alias(f"in_{side}")) for df, side in ((expected, "e"), (actual, "a"))]
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")), c) for c in COMPARED])), ",")
    problem = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").otherwise(changed)
    return sides[0].join(sides[1], ["template_id", "name"], "full_outer").select("template_id", "name", problem.alias("problem")).filter("problem <> ''")


def write_workbooks(cells: DataFrame, validations: DataFrame, files: DataFrame, parts: DataFrame, path: str) -> None:
    """Cells with their category, template and part, rules and files: three tables.

    A workbook lies whole and in order in one file, beside others: there are as many files as tasks, however many
    sheets there are, and a reader finds a workbook by the columns that its rows are sorted by.
    """
    placing = parts.select(book_id().alias("template_id"), "category_slug", F.col("template_id").alias("template"), "part").distinct()
    placed = cells.join(placing, "template_id").repartition("template_id").sortWithinPartitions("category_slug", "template", "part", "sheet", "row", "col")
    placed.write.mode("overwrite").parquet(f"{path}/cells")
    validations.write.mode("overwrite").parquet(f"{path}/validations")
    files.write.mode("overwrite").parquet(f"{path}/files")


def stored_workbooks(spark: SparkSession, path: str, kinds: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, validations, files) as written; ``kinds`` are tables with their columns."""
    return tuple(spark.read.schema(df.schema).parquet(f"{path}/{name}").select(*df.columns) for name, df in zip(("cells", "validations", "files"), kinds))


def check_workbooks(expected: DataFrame, fields: DataFrame, parts: DataFrame, stored: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(template_id, sheet, category_slug, part, name, problem): what stored workbooks say differently.

    The workbooks are read by the parser of templates.  Every column's structure is compared by a full outer join on
    (workbook, name), every value of ``expected`` (the written cells) with what stands in its place.
    """
    cells, validations, files = stored
    books = cut_lineage(read_workbooks(cells, validations, files))
    read = books.filter("reason IS NULL").select("template_id", F.explode("fields").alias("f")).select("template_id", "f.*")
    sheets = cut_lineage(parts.select("template_id", "sheet", "category_slug", "part").distinct())
    own = sheets.withColumn("book", book_id()).join(complete_fields(fields), "template_id").drop("template_id").withColumnRenamed("book", "template_id").withColumn(
        "vocabulary", F.coalesce("vocabulary", F.array().cast(_WORDS)))
    structure = compare_structure(own, read)
    values = expected.select(book_id().alias("template_id"), (F.col("sheet_row") + DATA_ROW).cast("int").alias("row"), "name", F.col("cell").alias("text")).filter("text <> ''")
    differ = verify_sheet(values, sheet_values(cells, read)).select("template_id", "name", F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" "), "side").alias("problem"))
    named = sheets.withColumn("book", book_id())
    return structure.unionByName(differ).withColumnRenamed("template_id", "book").join(named, "book").drop("book")
