"""Workbooks read in one pass, and written and read back."""

import re

import pytest
from pyspark.sql import functions as F

from claimloom.plans.resolve import publish, resolve
from claimloom.sources import sheets, workbooks
from contract import queries_store as store

from tests.test_match import make_evidence, make_templates

CELLS = "template_id string, sheet string, row int, col int, text string, kind string, number_format string, locked boolean, is_formula boolean"
RULES = "template_id string, ord int, min_col int, max_col int, kind string, formula1 string"
FILES = "template_id string, archive string, filename string, protected boolean"


def book(spark, cells, rules=(), protected=False):
    rows = [("b", *c, *("text", "General", False, False)[len(c) - 4 :]) for c in cells]
    return (spark.createDataFrame(rows, CELLS), spark.createDataFrame([("b", *r) for r in rules], RULES), spark.createDataFrame([("b", "z/Cat.zip", "A_-_B.xlsx", protected)], FILES))


REST = [("Lookup", 1, 1, "Brand"), ("Lookup", 2, 1, "Acme"), ("Lookup", 4, 1, " Zeta "), ("Instructions", 1, 1, "generated for"), ("Instructions", 2, 1, "A > B")]


def test_numbers_are_no_labels(spark):
    """Row 1 holds more cells than the header, but they are numbers."""
    cells = [("Template", 1, c, str(c), "number", "General", False, False) for c in range(1, 6)] + [("Template", 2, c, x) for c, x in ((1, "Name*"), (2, "Brand (cond)"), (4, "Size"))]
    cells += [("Template", 3, 4, "", "text", "0.00", True, False)] + REST
    found = workbooks.read_workbooks(*book(spark, cells, [(0, 2, 2, "list", "Lookup!$A$2:$A$9")], True)).first()
    assert found["reason"] is None and found["category_path"] == ["A", "B"]
    got = [(f["name"], f["col"], f["type"], f["required"], f["conditional"], f["locked"], f["dropdown_source"], f["vocabulary"]) for f in found["fields"]]
    assert got == [("Name", "A", "string", True, False, False, None, []), ("Brand", "B", "dropdown", False, True, False, "lookup:Brand", ["Acme", "Zeta"]), ("Size", "D", "numeric", False, False, True, None, [])]
    table = book(spark, cells)[0]
    assert sheets.header_rows(table).first()["header_row"] == 2
    assert sheets.header_rows(table.drop("kind")).first()["header_row"] == 1


def test_bad_workbooks_are_reported(spark):
    one = workbooks.read_workbooks(*book(spark, [("Template", 1, 1, "only"), *REST])).first()
    assert one["reason"] == sheets.NO_HEADER
    cells, rules, files = book(spark, [("Template", 1, 1, "a"), ("Template", 1, 2, "b")])
    assert workbooks.read_workbooks(cells, rules, files).first()["reason"] == "missing required sheet(s): Lookup, Instructions"
    assert workbooks.read_workbooks(cells.limit(0), rules.limit(0), files).first()["reason"] == "missing required sheet(s): Template, Lookup, Instructions"


def test_each_table_is_read_once(spark):
    sf = "/root/testdata/sf0.001"
    plan = workbooks.read_workbooks(store._cells(spark, sf), store._validations(spark, sf), store._files(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == 3


SPEC = {"Cat > Widget": [("Name", "r", "A"), ("Brand", "r", "A", "dropdown", ["Acme", "B, C"]), ("Size", "r", "B", "numeric"), ("Color", "", "B", "dropdown", []), ("Code", "lf", "C")],
        "Cat > Gadget": [("Name", "r", "A"), ("Kind", "", "B", "dropdown", ["x"]), ("Size", "", "B", "numeric")]}


def test_templates_round_trip(spark):
    t, f = make_templates(spark, SPEC)
    parts = t.select("template_id", F.lit("s").alias("sheet"), F.lit("slug").alias("category_slug"), F.lit(1).alias("part"))
    nothing = spark.createDataFrame([], "template_id string, sheet string, name string, type string, cell string, sheet_row long")
    books = workbooks.sheet_workbooks(nothing, parts, t, f)
    assert workbooks.check_workbooks(nothing, f, parts, books).collect() == []
    back = workbooks.read_workbooks(*books).collect()
    assert {tuple(r["category_path"]) for r in back} == {("Cat", "Widget"), ("Cat", "Gadget")}
    by = {x["name"]: x for r in back for x in r["fields"] if r["template_id"] == "t0/s"}
    assert by["Brand"]["vocabulary"] == ["Acme", "B, C"] and by["Color"]["dropdown_source"] == "reference" and by["Code"]["locked"] and by["Code"]["is_formula"]
    cells, rules, files = books
    other = cells.withColumn("text", F.when(F.col("text") == "Size*", "Length*").otherwise(F.col("text")))
    got = {(r["name"], r["problem"]) for r in workbooks.check_workbooks(nothing, f, parts, (other, rules.filter("template_id <> 't0/s' OR min_col <> 2"), files)).collect()}
    assert got == {("Size", "missing"), ("Length", "unexpected"), ("Brand", "type,vocabulary")}


def test_sheets_of_equal_names_keep_apart(spark, tmp_path):
    t, f = make_templates(spark, {"A > B": SPEC["Cat > Gadget"], "A - B": SPEC["Cat > Gadget"]})
    t = t.withColumn("row_limit", F.lit(None).cast("int"))
    evidence = make_evidence(spark, {f"r{i}": [("Name", f"n{i}"), ("Kind", "x"), ("Size", f"{i + 1} mm")] for i in range(4)})
    filled = resolve(evidence, t, f, forced_template="t0").population
    both = filled.withColumn("template_id", F.when(F.col("record_id") < "r2", "t1").otherwise(F.col("template_id")))
    assert publish(both, t, f, str(tmp_path / "out")).collect() == []
    back = spark.read.parquet(str(tmp_path / "out" / "cells"))
    assert back.select("category_slug").distinct().count() == 1 and back.select("template_id").distinct().count() == 2
    assert {r["text"] for r in back.filter("template_id = 't1/products__A_B' AND sheet = 'Template' AND row > 2 AND col = 1").collect()} == {"n0", "n1"}


def test_column_numbers(evaluate):
    assert evaluate(workbooks.column_number, ["A", "Z", "AA", "AB", "ZZ", "AAA"]) == [1, 26, 27, 28, 702, 703]


@pytest.mark.parametrize("name", ["template_types", "template_vocabulary", "template_sections"])
def test_sheets_of_one_row_per_template_are_never_broadcast(spark, name):
    """A table with rows for every template is joined by no broadcast, however small Spark takes it to be."""
    from contract import queries_store

    plan = queries_store.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" in plan


def test_vocabulary_of_named_missing_and_inline_lookups(spark):
    cells = spark.createDataFrame(
        [("a", "Template", 1, c, x, "General", False, False) for c, x in ((1, "Name*"), (2, "Brand"), (3, "Size"), (4, "Kind"))]
        + [("a", "Template", 2, 3, "", "0.0", True, False), ("a", "Lookup", 1, 27, "Brand", None, None, None), ("a", "Lookup", 3, 27, "y", None, None, None), ("a", "Lookup", 2, 27, "x", None, None, None)],
        "template_id string, sheet string, row int, col int, text string, number_format string, locked boolean, is_formula boolean")
    rules = spark.createDataFrame(
        [("a", 0, 2, 4, "list", '"p, q"'), ("a", 1, 2, 2, "list", "Lookup!$AA$2:$AA$9"), ("a", 2, 4, 4, "list", "Lookup!$C$2")],
        "template_id string, ord int, min_col int, max_col int, kind string, formula1 string")
    columns = sheets.columns(cells, rules, sheets.header_rows(cells))
    assert {(r.col, r.name, r.required, r.type, r.locked) for r in columns.collect()} == {
        (1, "Name", True, "string", False), (2, "Brand", False, "dropdown", False), (3, "Size", False, "dropdown", True), (4, "Kind", False, "dropdown", False)}
    found = sheets.field_vocabulary(columns, sheets.lookups(cells)).collect()
    assert {(r.col, r.dropdown_source, tuple(r.vocabulary)) for r in found} == {(2, "lookup:Brand", ("x", "y")), (3, "inline", ("p", "q")), (4, "lookup:None", ())}
