import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import measures as m
from claimloom.functions import text as t
from claimloom.functions import urls


def test_normalize_value(evaluate):
    cases = {
        "9.5 mm": ("scalar", [9.5], 0.9), "1 in": ("scalar", [25.4], 0.9), '0.5"': ("scalar", [12.7], 0.9),
        "1,5 cm": ("scalar", [15.0], 0.9), "300 x 600 mm": ("dims", [300.0, 600.0], 0.9), "42": ("text", None, 0.3),
        "1,234": ("text", None, 0.3), "Aluminium": ("text", None, 0.9), "": ("text", None, 0.3),
        "1,234 mm": ("text", None, 0.3), "10 x 20": ("text", None, 0.3), "1.234.567 mm": ("scalar", [1234567.0], 0.9),
        "1.234,5 mm": ("scalar", [1234.5], 0.9), "1,234.5 mm": ("scalar", [1234.5], 0.9), "-5 x 3 mm": ("text", None, 0.9),
        "5 kg": ("text", None, 0.9), "10×20×30 CM": ("dims", [100.0, 200.0, 300.0], 0.9), " 2 Metres ": ("scalar", [2000.0], 0.9),
        "3 x 1,234 mm": ("text", None, 0.3),
    }
    got = evaluate(m.normalize_value, list(cases))
    assert {k: (r["kind"], r["nums"], r["confidence"]) for k, r in zip(cases, got)} == cases


def test_format_value(evaluate):
    values = ["1,5 cm", "300 x 600 mm", "0.25 in", "plain", "12000 m"]
    assert evaluate(lambda c: m.format_value(m.normalize_value(c)), values) == [
        "15 mm", "300 x 600 mm", "6.35 mm", "plain", "12000000 mm"]


def test_option_list(evaluate):
    cases = {
        "2.4/2.5/2.7/3 Meters": ["2.4 Meters", "2.5 Meters", "2.7 Meters", "3.0 Meters"],
        "8/10/12 mm / Customizable": ["8.0 mm", "10.0 mm", "12.0 mm"], "8/10/12mm / Customized.": ["8.0 mm", "10.0 mm", "12.0 mm"],
        "10 mm": None, "300 x 600 mm": None, "304, 316 Stainless Steel": None, "8/1,234 mm": None, "8/10": None, "": None,
    }
    assert dict(zip(cases, evaluate(m.option_list, list(cases)))) == cases


def test_conversions(spark):
    row = spark.range(1).select(
        m.from_mm(F.lit(2500.0), F.lit("m")).alias("a"), m.from_mm(F.lit(2500.0), F.lit("furlong")).alias("b")).first()
    assert (row.a, row.b) == (2.5, None)


def test_canonical(evaluate):
    cases = {
        "<Diameter (mm)>": "diameter", "<Length (meters)>": "length", "Diameter(mm)": "diameter", "Dimensions (1)": "dimensions (1)",
        "title": "name", "Cost": "price", " Wall_Thickness-x ": "wall thickness x", "Color Name": "color name",
    }
    assert dict(zip(cases, evaluate(t.canonical, list(cases)))) == cases


def test_single_axis_length(evaluate):
    cases = {"8/10/12mm": True, "300 x 600 mm": False, "max 10 mm": False, "12 m": False, "10 inside": True, "10": False, None: False}
    assert dict(zip(cases, evaluate(m.single_axis_length, list(cases)))) == cases


def test_candidate_attribute(evaluate):
    got = evaluate(lambda c: t.candidate_attribute(F.lit("x"), c), ["https://a.b/c", " www.a.b", "a@b.co", "a@b", "text", None, "see https://a.b"])
    assert got == [False, False, False, True, True, True, True]
    assert evaluate(lambda c: t.candidate_attribute(t.canonical(c), F.lit("v")), ["Suggested_Category", "Size"]) == [False, True]


def test_words(evaluate):
    assert sorted(evaluate(t.word_set, ["The White PVC a x-ray, for PVC"])[0]) == ["pvc", "ray", "white"]
    assert evaluate(t.vocabulary_text, ["  Aluminum--Colour GREY greyish"]) == ["aluminium color gray greyish"]
    assert evaluate(t.naming_literals, ["Pattern: [Brand] steel [Size] bar"])[0].split() == ["steel", "bar"]
    assert evaluate(t.slug, ["A & B > C", "!!"]) == ["A_B_C", "category"]
    assert evaluate(t.file_slug, ["A/B (x)", "/"]) == ["A_B (x)", "_"]
    assert evaluate(t.path_array, ["a >  b > "]) == [["a", "b"]]
    assert evaluate(m.first_number, ["a 1,234.5 b", "none", "-3"]) == [1234.5, None, -3.0]


def test_record_id(spark):
    rows = [("S1", "http://h/a/b"), (None, "http://h/a/b/?q=1"), ("", "http://h"), (None, "http://h/a/b;v=1#f")]
    got = spark.createDataFrame(rows, "s string, u string").select(urls.record_id(F.col("s"), F.col("u"))).collect()
    assert [r[0] for r in got] == ["S1", "b", "h", "b"]


def test_absolute_url_matches_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["http://x.com/a/b/c?x=1#f", "https://x.com", "http://x.com/dir/"]
    refs = ["/The", "../images/x.jpg", "img.png", "?p=2", "//cdn.com/a", "http://y.com/z/../w", "#top", "./a/./b/../c?d=e#g", "", "a;b",
            "../../../x", "..", ".", " /trim "]
    df = spark.createDataFrame([(b, h) for b in bases for h in refs], "b string, h string")
    for r in df.select("b", "h", urls.absolute_url(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.h.strip()), r


def _parse(s):
    """Brute force for numbers with either separator: (value, ambiguous)."""
    try:
        if "." in s and "," in s:
            return (float(s.replace(",", "")) if s.rfind(".") > s.rfind(",") else float(s.replace(".", "").replace(",", "."))), False
        head, *tail = s.split(",")
        if len(tail) == 1 and len(tail[0]) in (1, 2):
            return float(f"{head}.{tail[0]}"), False
        if tail:
            return float(s.replace(",", "")), len(tail) == 1 and len(tail[0]) == 3
        return float(s.replace(".", "") if s.count(".") > 1 else s), False
    except ValueError:
        return None, False


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.from_regex(r"[0-9][0-9.,]{0,8}", fullmatch=True), min_size=200, max_size=300))
def test_parse_number_brute_force(evaluate, values):
    for v, got in zip(values, evaluate(m.parse_number, values)):
        value, ambiguous = _parse(v)
        assert got["ambiguous"] == ambiguous, v
        assert (got["v"] is None) == (value is None) and (value is None or math.isclose(got["v"], value)), v


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789., xX/mcin\"m-", max_size=14), min_size=200, max_size=300))
def test_values_never_guess(evaluate, values):
    for v, got in zip(values, evaluate(m.normalize_value, values)):
        if got["kind"] == "text":
            assert got["text"] == v.strip() and got["nums"] is None and got["unit"] is None
        else:
            assert got["unit"] == "mm" and re.search(r'(mm|cm|m|in|")\s*$', v, re.I)
    for v, got in zip(values, evaluate(m.option_list, values)):
        assert got is None or (len(got) >= 2 and len(got) == len([p for p in v.split("/") if p.strip()]))
