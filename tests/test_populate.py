from pyspark.sql import functions as F

from claimloom.operators import match as m
from claimloom.operators import populate as p
from claimloom.operators import publish as pub
from claimloom.plans.resolve import publish, resolve
from tests.test_match import SIBLINGS, TRIMS, make_evidence, make_templates


LADDER = [
    ("PVC", ["Aluminum", "PVC", "Brass"], "PVC", "exact", []), ("pvc", ["Aluminum", "PVC"], "PVC", "case_insensitive", []),
    ("  Stainless-Steel  ", ["Stainless Steel", "PVC"], "Stainless Steel", "normalized", []), ("Aluminium", ["Aluminum"], "Aluminum", "normalized", []),
    ("Colour", ["Color"], "Color", "normalized", []), ("Gray", ["Grey"], "Grey", "normalized", []),
    ("Aluminum Alloy", ["Aluminium", "PVC"], "Aluminium", "whole_word_containment", []), ("Alumnium", ["Aluminium"], None, "no_match", []),
    ("PVC", ["PVC", "PVC"], None, "exact_ambiguous", ["PVC"]),
    ("Silver/Golden/Bronze", ["Silver", "Gold", "Bronze", "Black"], None, "whole_word_containment_ambiguous", ["Silver", "Bronze"]),
    ("", ["A"], None, "no_match", []), (None, ["A"], None, "no_match", []), ("A", [], None, "no_match", []),
]


def test_vocabulary_ladder(spark):
    df = spark.createDataFrame([(i, v, vocab) for i, (v, vocab, *_) in enumerate(LADDER)], "i int, v string, l array<string>")
    got = df.select("i", p.match_vocabulary(F.col("v"), F.col("l")).alias("m")).orderBy("i").collect()
    assert [(r["m"]["term"], r["m"]["method"], r["m"]["terms"]) for r in got] == [tuple(x[2:]) for x in LADDER]


SPEC = {"Cat > Widget": [
    ("Brand", "r", "A", "dropdown", ["Acme", "Zeta"]), ("Size", "r", "A", "numeric"), ("Color", "r", "A", "dropdown", ["Silver", "Gold", "Bronze", "Black"]),
    ("Length", "", "A", "numeric"), ("Length Unit", "", "A", "dropdown", ["m"]), ("Notes", "", "A", "string"), ("Floor Price", "", "A", "numeric"), ("Code", "rlf", "A")]}


def fill(spark, items, spec=SPEC, variants=False):
    t, f = make_templates(spark, spec)
    t = t.withColumn("row_limit", F.lit(2))
    ev = make_evidence(spark, {"r": items})
    r = resolve(ev, t, f, forced_template="t0", variants=variants)
    return r, t, f


def test_statuses_and_readiness(spark):
    r, _, f = fill(spark, [("Manufacturer", "acme"), ("Height", "8/10/12mm"), ("Color", "Silver/Golden/Bronze"), ("Length", "2.5 m"), ("Notes", "n"), ("Floor Price", "1 mm")])
    got = {x["name"]: (x["status"], x["value"], x["reason"], x["candidates"]) for x in r.population.collect()}
    assert got == {
        "Brand": ("populated", "Acme", "case_insensitive", []), "Size": ("variant_candidate", None, "multi_option_numeric", ["8.0 mm", "10.0 mm", "12.0 mm"]),
        "Color": ("variant_candidate", None, "whole_word_containment_ambiguous", ["Silver", "Bronze"]), "Length": ("populated", "2.5 m", None, []),
        "Length Unit": ("needs_input", None, "no_evidence", []), "Notes": ("populated", "n", None, [])}
    s = r.summary.first()
    assert (s["status"], s["missing_required"], s["populated_count"], s["needs_input_count"]) == ("incomplete", ["Size", "Color"], 3, 3)
    cells = {x["name"]: (x["bucket"], x["cell"]) for x in pub.cell_values(r.population, f).collect()}
    assert cells == {"Brand": ("written", "Acme"), "Size": ("variant_candidate", None), "Color": ("variant_candidate", None), "Length": ("written", "2.5"),
                     "Length Unit": ("needs_input", None), "Notes": ("written", "n"), "Floor Price": ("never_populate", None)}


def test_first_value_wins_across_direct_and_alias(spark):
    r, *_ = fill(spark, [("Manufacturer", "Zeta"), ("Brand", "Acme"), ("Dimensions", "300 x 600 mm"), ("Size", "300 x 600 mm")])
    got = {x["name"]: (x["status"], x["value"], x["reason"]) for x in r.population.collect()}
    assert got["Brand"] == ("populated", "Zeta", "exact") and got["Size"] == ("needs_input", None, "not_one_confirmed_number")


def test_largest_axis_expands_and_the_other_stays(spark):
    r, *_ = fill(spark, [("Brand", "Acme"), ("Height", "8/10/12mm"), ("Color", "Silver/Golden/Bronze")])
    axis = p.variant_axis(r.population).first()
    assert (axis["expanded_field"], axis["option_count"], axis["other_variant_fields"]) == ("Size", 3, ["Color"])
    rows = p.expand_variants(r.population)
    sizes = {x["variant_no"]: (x["value"], x["reason"]) for x in rows.filter("name = 'Size'").collect()}
    assert sizes == {0: ("8.0 mm", "variant_expansion"), 1: ("10.0 mm", "variant_expansion"), 2: ("12.0 mm", "variant_expansion")}
    assert {x["status"] for x in rows.filter("name = 'Color'").collect()} == {"variant_candidate"}


def test_colors_become_rows_ready_for_review(spark):
    r, *_ = fill(spark, [("Brand", "Acme"), ("Size", "5 mm"), ("Color", "Silver/Gold/Black")], variants=True)
    assert sorted((x["variant_no"], x["status"]) for x in r.summary.collect()) == [(i, "ready_for_review") for i in range(3)]


def test_sheets_split_write_and_read_back(spark, tmp_path):
    t, f = make_templates(spark, SPEC)
    t = t.withColumn("row_limit", F.lit(2))
    ev = make_evidence(spark, {f"r{i}": [("Brand", "Acme"), ("Size", f"{i + 1} mm")] for i in range(5)})
    r = resolve(ev, t, f, forced_template="t0")
    cells = pub.cell_values(r.population, f)
    parts = pub.sheet_parts(cells.select("template_id", "record_id", "variant_no").distinct(), t)
    got = sorted((x["record_id"], x["sheet"]) for x in parts.collect())
    assert got == [("r0", "products__Cat_Widget_part1"), ("r1", "products__Cat_Widget_part1"), ("r2", "products__Cat_Widget_part2"),
                   ("r3", "products__Cat_Widget_part2"), ("r4", "products__Cat_Widget_part3")]
    assert publish(r.population, t, f, str(tmp_path / "out")).count() == 0
    one = pub.sheet_parts(cells.select("template_id", "record_id", "variant_no").distinct(), t.withColumn("row_limit", F.lit(9)))
    assert {x["sheet"] for x in one.collect()} == {"products__Cat_Widget"}
    stats = {x["name"]: (x["written"], x["fill_rate"]) for x in pub.fill_stats(cells).collect()}
    assert stats["Brand"] == (5, 1.0) and stats["Floor Price"] == (0, 0.0)


def test_read_back_differences_fail_their_part_only(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y")]
    want = spark.createDataFrame(rows, "category_slug string, part long, cell string")
    have = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "category_slug string, part long, cell string")
    diff = pub.verify_sheet(want, have)
    assert sorted((r["part"], r["cell"], r["side"], r["copies"]) for r in diff.collect()) == [(1, "x", "missing", 1), (2, "z", "unexpected", 1)]
    assert sorted(r["part"] for r in pub.write_failures(diff.filter("part = 2")).collect()) == [2]


def test_structure_check(spark):
    _, f = make_templates(spark, SPEC)
    f = f.withColumn("col", F.concat(F.lit("C"), "field_ord"))
    assert pub.verify_structure(f, f).count() == 0
    changed = f.withColumn("type", F.when(F.col("name") == "Brand", "string").otherwise(F.col("type"))).filter("name <> 'Notes'")
    assert sorted(r["name"] for r in pub.verify_structure(f, changed).collect()) == ["Brand", "Notes"]


def test_flagship_page(spark):
    """Eight specification pairs of a real trim page against five sibling templates."""
    fields = [("Brand", "r", "A", "dropdown", ["Acme"]), ("Material", "r", "A", "dropdown", ["Aluminum", "Stainless Steel", "PVC"]),
              ("Color", "r", "A", "dropdown", ["Silver", "Gold", "Black"]), ("Length", "r", "A", "numeric"), ("Size", "r", "A", "numeric"),
              ("Size Unit", "r", "A", "dropdown", ["mm"]), ("Length Unit", "r", "A", "dropdown", ["m"]),
              ("Selling Unit", "r", "Pricing & Inventory"), ("Quantity per Selling Unit", "r", "Pricing & Inventory")]
    leaves = ("Corner Profile", "Edge Trim", "Expansion Profile", "Movement Joint", "Transition Profile")
    t, f = make_templates(spark, {f"{TRIMS} > {leaf}": fields for leaf in leaves})
    ev = make_evidence(spark, {"page": [
        ("Material", "Aluminum Alloy"), ("Finish", "Polished"), ("Color", "Silver/Gold/Bronze/Black Titanium"), ("Height", "8/10/12mm / Customized."),
        ("Thickness", "0.5 mm"), ("Length", "2.4/2.5/2.7/3 Meters"), ("Packing", "box"), ("Applications", "tile trim for walls")]})
    r = resolve(ev, t, f)
    o = r.outcomes.first()
    assert (o["status"], o["template_id"], o["tie_word"], o["confidence"]) == ("matched", "t1", "trim", 0.5)
    got = {x["name"]: (x["status"], x["reason"]) for x in r.population.collect()}
    assert got["Material"] == ("populated", "whole_word_containment") and got["Color"] == ("variant_candidate", "whole_word_containment_ambiguous")
    assert got["Length"] == got["Size"] == ("variant_candidate", "multi_option_numeric")
    s = r.summary.first()
    assert (s["populated_count"], s["status"]) == (1, "incomplete")
    assert s["missing_required"] == ["Brand", "Color", "Length", "Size", "Size Unit", "Length Unit", "Selling Unit", "Quantity per Selling Unit"]


def test_media(spark):
    cells = spark.createDataFrame([("t0", "r", "Cover Image", "a.webp, b.webp,https://x/y.jpg"), ("t0", "r", "Name", "c.webp")], "template_id string, record_id string, name string, cell string")
    form = spark.createDataFrame([("t0", "Cover Image", "Media"), ("t0", "Name", "Meta")], "template_id string, name string, section string")
    named = pub.referenced_media(cells, form)
    given = spark.createDataFrame([("b.webp",), ("d.webp",)], "file string")
    got = {(r["file"], r["problem"]) for r in pub.reconcile_media(named, given).collect()}
    assert got == {("a.webp", "missing"), ("d.webp", "unreferenced")}


def test_sku_wide_keeps_blanks_and_every_image(spark, tmp_path):
    ev = make_evidence(spark, {"P1": [("Material", "PVC"), ("Color", "Red"), ("Color", "Blue")], "P2": [("Material", "Brass"), ("Length", None, True)], "P3": [("Grade", None, True)]})
    media = spark.createDataFrame([("P1", f"P1_{i}.webp") for i in range(5)] + [("P2", "P2_0.webp")], "record_id string, name string")
    rows = pub.sku_wide(ev).collect()
    assert {r["record_id"]: (r["Material"], r["Color"]) for r in rows} == {"P1": ("PVC", "Red"), "P2": ("Brass", None), "P3": (None, None)}
    assert "Length" not in rows[0].asDict()
    images = pub.sku_images(media)
    assert sorted(map(tuple, images.select("record_id", "image_no", "name").collect())) == [*(("P1", i + 1, f"P1_{i}.webp") for i in range(5)), ("P2", 1, "P2_0.webp")]
    pub.write_sku_csv(pub.sku_wide(ev), str(tmp_path / "csv"), images)
    written = {r["record_id"]: r["images"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert written["P1"] == "; ".join(f"P1_{i}.webp" for i in range(5)) and written["P2"] == "P2_0.webp"


def test_numbering_is_exact_for_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50))).alias("g"), F.hash("id").alias("o"), "id")
    from claimloom.operators.numbering import number_rows

    seen: dict = {}
    for r in sorted(number_rows(df, ["g"], ["o", "id"]).collect(), key=lambda r: (r["g"], r["o"], r["id"])):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["row_no"] == seen[r["g"]]
    assert seen["hot"] == 2000


def test_sibling_names_are_used(spark):
    assert len(SIBLINGS) == 3 and m.MIN_RECALL == m.MIN_PRECISION
