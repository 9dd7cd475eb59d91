from pyspark.sql import functions as F

from claimloom.operators import match as m
from claimloom.operators import populate as p
from claimloom.session import cut_lineage

TRIMS = "Finishes > Accessories > Edge Trims & Profiles"


def make_templates(spark, specs):
    """specs: {path: [(name, flags, section, type, vocabulary)] or [names]}, in order."""
    trows, frows = [], []
    for i, (path, fields) in enumerate(specs.items()):
        trows.append((f"t{i}", i, path.split(" > ")))
        for n, f in enumerate(fields):
            name, flags, section, kind, vocab = (f, "", "Attributes", "string", []) if isinstance(f, str) else (*f, *("", "Attributes", "string", [])[len(f) - 1:])
            frows.append((f"t{i}", n, name, kind, "r" in flags, "l" in flags, "f" in flags, section, vocab))
    t = spark.createDataFrame(trows, "template_id string, template_ord int, category_path array<string>")
    f = spark.createDataFrame(frows, "template_id string, field_ord int, name string, type string, required boolean, locked boolean, "
                                     "is_formula boolean, section string, vocabulary array<string>")
    return t, f


def make_evidence(spark, records):
    rows = [(rid, s, *(x if isinstance(x, tuple) else (x, "v"))) for rid, items in records.items() for s, x in enumerate(items)]
    rows = [(*r, False) if len(r) == 4 else r for r in rows]
    return spark.createDataFrame(rows, "record_id string, seq long, field string, value string, absence boolean")


def decide(spark, specs, records):
    t, f = make_templates(spark, specs)
    index = m.index_templates(t, f)
    ev = make_evidence(spark, records)
    out = {r["record_id"]: r for r in m.outcomes(ev, index).collect()}
    assert set(out) == set(records)
    return out, index, ev


def req(*names):
    return [(n, "r") for n in names]


def test_recall_gate_rejects_a_wide_template(spark):
    out, index, ev = decide(spark, {"Wrong": req("A", "B", "C", "X", "Y", "Z", "W", "V"), "Correct": req("A", "B")},
                            {"r": ["A", "B", "C", "D"]})
    assert (out["r"]["status"], out["r"]["template_id"], out["r"]["confidence"]) == ("matched", "t1", 0.5)
    scored = m.score_records(ev, index)
    top = m.top_candidates(scored, m.outcomes(ev, index), index).orderBy("rank").collect()
    assert [(r["template_id"], r["score"]) for r in top] == [("t1", 0.5), ("t0", 0.75)]  # accepted first
    assert [(r["required_present"], r["required_missing"]) for r in top] == [(["A", "B"], []), (["A", "B", "C"], ["X", "Y", "Z", "W", "V"])]
    # The accepted template comes first even where k leaves no room for others; gates are counted by template.
    assert [r["template_id"] for r in m.top_candidates(scored, m.outcomes(ev, index), index, 1).collect()] == ["t1"]
    assert {tuple(r) for r in m.gate_counts(scored).collect()} == {("t0", 0, 1), ("t1", 1, 0)}


def test_candidates_are_found_by_signature(spark):
    """No plan of the candidate list makes a row per record and template before the list is taken apart."""
    t, f = make_templates(spark, {f"P > {i}": req("A", "B") + [f"N{i}"] for i in range(20)})
    index = m.index_templates(t, f)
    ev = make_evidence(spark, {f"r{i}": ["A", "B"] for i in range(50)})
    top = m.top_candidates(m.score_records(ev, index), cut_lineage(m.outcomes(ev, index)), index)
    rows = top.collect()
    assert len(rows) == 50 * 8 and {r["template_id"] for r in rows if r["rank"] == 1} == {"t0"}
    assert len({r["template_id"] for r in rows}) == 8
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Window" not in plan


def test_no_match_reports_best_precision(spark):
    out, *_ = decide(spark, {"Wrong": req("A", "B", "C", "X", "Y", "Z", "W", "V"), "Free": ["F", "G"]},
                     {"r": ["A", "B", "C", "D"], "none": [("Q", "1")], "free": ["F", "G"]})
    assert (out["r"]["status"], out["r"]["confidence"]) == ("no_template_match", 0.75)
    assert (out["none"]["status"], out["none"]["confidence"]) == ("no_template_match", 0.0)
    # Without required fields there is no recall to miss: precision alone decides.
    assert (out["free"]["status"], out["free"]["template_id"], out["free"]["confidence"]) == ("matched", "t1", 1.0)


def test_decorated_names_and_denominator(spark):
    _, index, ev = decide(spark, {"T": ["Diameter", "Length", "Grade", "Brand"]}, {
        "a": ["<Diameter (mm)>", "<Length (meters)>", "<Grade>", "<%C>"],
        "b": [("Diameter", "1 mm"), "Grade", ("image", "https://x/y.png"), ("suggested_category", "X")],
        "c": [("Brand", "a"), ("Manufacturer", "b")]})
    got = {r["record_id"]: r["precision"] for r in m.score_templates(ev, index).collect()}
    assert got == {"a": 0.75, "b": 1.0, "c": 1.0}


def test_commercial_and_locked_fields_are_no_recall_gap(spark):
    _, index, ev = decide(spark, {"T": [("Grade", "r"), ("Material", "r"), ("Selling Unit", "r", "Pricing & Inventory"), ("Code", "rl"), ("Floor Price", "r")]},
                          {"r": ["Grade"]})
    row = m.score_templates(ev, index).first()
    assert (row["n_required"], row["n_covered"], row["recall"]) == (2, 1, 0.5)


BARS = {f"Steel > Bars > {s}": ["Diameter", "Length", "Grade", "Material"] for s in ("8mm", "10mm", "12mm")}


def test_size_breaks_a_tie_or_leaves_it(spark):
    base = [("Grade", "Fe500"), ("Length", "12 m"), ("Material", "TMT Steel")]
    out, *_ = decide(spark, BARS, {
        "one": [*base, ("Diameter", "12 mm")], "two": [*base, ("Diameter", "8 mm"), ("Other", "12 mm")], "bare": [*base, ("Diameter", "12")],
        "inch": [*base, ("Diameter", "1.2 cm")]})
    assert (out["one"]["template_id"], out["one"]["tie_method"]) == ("t2", "size")
    assert out["inch"]["template_id"] == "t2"
    assert out["two"]["status"] == out["bare"]["status"] == "category_ambiguous"
    assert out["bare"]["reason"] == "unresolved tie among 3 candidates at precision 1.000"


SIBLINGS = {f"{TRIMS} > {leaf}": ["Material", "Applications", "Color"] for leaf in ("Corner Profile", "Edge Trim", "Expansion Profile")}


def test_word_breaks_a_tie_only_alone(spark):
    cases = {
        "used for a corner installation": ("t0", "corner"), "corner and expansion joints": (None, None), "general purposes": (None, None),
        "tile trim": ("t1", "trim"), "trims and profile": (None, None), "pre-Corner_x": (None, None), "Ecorner": (None, None),
        "pre-CORNER": ("t0", "corner"), "corner expansion corner": (None, None)}
    out, *_ = decide(spark, SIBLINGS, {text: [("Material", "x"), ("Applications", text), ("Color", "y")] for text in cases})
    for text, (winner, word) in cases.items():
        r = out[text]
        assert (r["template_id"], r["tie_word"], r["tie_field"]) == (winner, word, "applications" if winner else None), text


def test_aliases_need_the_target_and_the_guard(spark):
    _, index, ev = decide(spark, {"Bar": ["Diameter"], "Trim": ["Size"], "Shout": ["DIAMETER"]}, {
        "a": [("Size", "12 mm")], "b": [("Dimensions", "300 x 600 mm")], "c": [("Dimensions", "12 mm")], "d": [("Height", "8/10/12mm")],
        "e": [("Height", "300 x 600 mm")]})
    got = {(r["record_id"], r["template_id"]) for r in m.score_templates(ev, index).collect()}
    assert got == {("a", "t0"), ("a", "t1"), ("c", "t0"), ("d", "t1")}


def test_absence_and_blank_count_in_matching_but_never_fill(spark):
    out, index, ev = decide(spark, {"T": [("Grade", "r"), "Brand"]}, {"r": [("Grade", None, True), ("Brand", "  "), ("Brand", "Acme")]})
    assert (out["r"]["status"], out["r"]["confidence"]) == ("matched", 1.0)
    pop = {r["name"]: r for r in p.populate(ev, m.outcomes(ev, index), index).collect()}
    assert (pop["Grade"]["status"], pop["Grade"]["reason"], pop["Brand"]["value"]) == ("needs_input", "no_evidence", "Acme")


def test_row_order_and_partitions_change_nothing(spark):
    records = {f"r{i}": [("Material", f"m{i}"), ("Applications", ["corner", "edge trim", "x"][i % 3]), ("Color", "c"), ("Color", "d")] for i in range(30)}
    t, f = make_templates(spark, SIBLINGS)
    index = m.index_templates(t, f)
    ev = make_evidence(spark, records)
    a = sorted(map(str, m.outcomes(ev, index).collect()))
    b = sorted(map(str, m.outcomes(ev.orderBy(F.desc("seq")).repartition(7), index).collect()))
    assert a == b


def test_forced_category(spark):
    ev = make_evidence(spark, {"a": ["x"], "b": ["y"]})
    rows = m.force_category(ev.select("record_id").distinct(), "t9").collect()
    assert {(r["record_id"], r["template_id"], r["confidence"]) for r in rows} == {("a", "t9", 1.0), ("b", "t9", 1.0)}


def test_matched_and_required_by_signature_equal_brute_force(spark):
    """Signatures against a plain nested loop, with a third of all records sharing one name set."""
    import random

    rnd = random.Random(7)
    names = list("ABCDEFGH")
    specs = {f"C > {i}": [(n, "r" if rnd.random() < .5 else "") for n in rnd.sample(names, rnd.randint(2, 6))] for i in range(6)}
    records = {f"r{i}": (["A", "B", "C"] if i % 3 == 0 else rnd.sample([*names, "Z1", "Z2"], rnd.randint(1, 6))) for i in range(60)}
    _, index, ev = decide(spark, specs, records)
    got = {(r["record_id"], r["template_id"]): (r["matched"], r["n_fields"], r["n_covered"], r["n_required"]) for r in m.score_templates(ev, index).collect()}
    want = {}
    for rid, fields in records.items():
        for i, form in enumerate(specs.values()):
            hit = {n for n, _ in form} & set(fields)
            need = {n for n, fl in form if fl}
            if hit:
                want[(rid, f"t{i}")] = (len(hit), len(fields), len(hit & need), len(need))
    assert got == want
