import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, documents, knowledge as kn
from claimloom.plans.resolve import evidence_from_doc_pages
from claimloom.sources import evidence as ev
from claimloom.sources import sheets, stores
from claimloom.streaming import staging

ROW = "record_id string, seq long, field string, value string, source_uri string, method string, confidence double, absence boolean, ts double"


def evidence(spark, *rows):
    return spark.createDataFrame([(r, i, f, v, s, "scrape", 0.9, a, 1.0) for i, (r, f, v, s, a) in enumerate(rows)], ROW)


GOOD = [("TIL-1", "Brand", "Acme", "http://x", False), ("TIL-2", "Grade", None, None, True)]
BAD = [("A", "x", "v", None, False), ("B", "x", "v", "http://x", True), ("C", "x", None, "http://x", False), ("D", "x", "v", "", False)]


def test_evidence_rule(spark):
    good, bad = ev.quarantine(evidence(spark, *GOOD, *BAD))
    assert sorted(r["record_id"] for r in good.collect()) == ["TIL-1", "TIL-2"]
    assert {r["record_id"]: len(r["problems"]) for r in bad.collect()} == {"A": 1, "B": 1, "C": 1, "D": 1}
    assert ev.validated(evidence(spark, *GOOD)).count() == 2
    with pytest.raises(Exception, match="has no source"):
        ev.validated(evidence(spark, *BAD[:1])).count()


def test_evidence_round_trip(spark, tmp_path):
    df = evidence(spark, *GOOD)
    ev.write_evidence(df, str(tmp_path / "e"))
    back = ev.read_evidence(spark, str(tmp_path / "e")).drop("_corrupt_record").select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "raw.jsonl").write_text('{"record_id":"r","field":"a","value":"1"}\n\n{bad\n{"record_id":"r","field":"a","value":"2"}\n')
    raw = ev.read_evidence(spark, str(tmp_path / "raw.jsonl")).cache()
    assert raw.filter("_corrupt_record IS NOT NULL").count() == 1
    assert raw.filter("record_id = 'r'").groupBy("field").agg(F.min_by("value", "seq").alias("v")).first()["v"] == "1"


def test_packs(spark):
    header = json.dumps({"version": "1.0", "producer": {}, "product_count": 1}).encode()
    line = json.dumps({"record_id": "r", "field": "f", "value": "v", "source_uri": "u", "absence": False}).encode()
    bad_line = json.dumps({"record_id": "r", "field": "f", "value": "v"}).encode()
    packs = {
        "good": {"datapackage.json": header, "evidence.jsonl": line + b"\n"}, "tampered": {"datapackage.json": header, "evidence.jsonl": line},
        "rule": {"datapackage.json": header, "evidence.jsonl": line + b"\n\n" + bad_line + b"\n{oops"}, "gone": {"evidence.jsonl": line}, "lost": {"datapackage.json": header, "evidence.jsonl": line},
    }
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = [(p, path, sha(b)) for p, parts in packs.items() for path, b in parts.items()]
    listed.append(("lost", "media/x.webp", sha(b"x")))
    packs["tampered"]["evidence.jsonl"] = line + b" "
    parts = spark.createDataFrame([(p, path, bytearray(b)) for p, x in packs.items() for path, b in {**x, "manifest-sha256.txt": b"m"}.items()], "pack string, path string, content binary")
    errors = audit.audit_packs(parts, spark.createDataFrame(listed, "pack string, path string, sha256 string"))
    got = {}
    for r in errors.collect():
        got.setdefault(r["pack"], []).append(r["error"])
    assert set(got) == {"tampered", "rule", "gone", "lost"}
    assert got["tampered"][0].startswith("checksum mismatch for evidence.jsonl") and got["gone"] == ["missing required file(s): datapackage.json"]
    assert got["lost"] == ["manifest references missing file: media/x.webp"]
    assert sorted(got["rule"])[0].startswith("evidence.jsonl line 1: r.f = 'v' has no source") and sorted(got["rule"])[1] == "evidence.jsonl line 2: invalid JSON"
    summary = {r["pack"]: r["ok"] for r in audit.audit_summary(parts, errors).collect()}
    assert summary["good"] and not summary["rule"]
    made = {(r["pack"], r["path"]): r["sha256"] for r in audit.manifest(parts).collect()}
    assert made[("good", "evidence.jsonl")] == sha(line + b"\n") and ("good", "manifest-sha256.txt") not in made


def test_documents(spark):
    pages = spark.createDataFrame([("d/a.b.pdf", 1, " clean text ", True), ("d/a.b.pdf", 2, "(cid:12)(cid:9) x", False), ("d/a.b.pdf", 3, "�" * 3 + "a" * 97, False), ("d/a.b.pdf", 4, "  ", True),
                                   ("d/a.b.pdf", 5, "  ", False), ("d/a.b.pdf", 6, "--- ... - ab", True), ("d/a.b.pdf", 7, "�" * 2 + "a" * 98, False)], "file string, page int, text string, fonts_missing boolean")
    images = spark.createDataFrame([("d/a.b.pdf", 2, 0, 5, "png", 16, 16), ("d/a.b.pdf", 2, 1, 6, "jpg", 200, 200), ("d/a.b.pdf", 2, 2, 6, "jpg", 200, 200), ("d/a.b.pdf", 2, 3, 7, "png", 64, 64)],
                                   "file string, page int, ord int, xref int, ext string, width int, height int")
    assert sorted(r["page"] for r in documents.ocr_pages(pages).collect()) == [2, 3, 4, 6]
    got = sorted((r["record_id"], r["field"], r["value"], r["source_uri"]) for r in evidence_from_doc_pages(pages, images).filter("record_id <> 'a.b-p7'").collect())
    assert got == [("a.b-p1", "text", "clean text", "pdf://d/a.b.pdf#page=1"), ("a.b-p2", "image_0", "media/a.b_p2_img0.jpg", "pdf://d/a.b.pdf#page=2"),
                   ("a.b-p2", "image_1", "media/a.b_p2_img1.png", "pdf://d/a.b.pdf#page=2")]


def test_knowledge(spark):
    stored = spark.createDataFrame([(["S", "B", "12mm"], 0, "confirmed"), (["S"], 1, "pending_review"), (["S", "B", "8mm"], 2, "confirmed"), (["P", "V"], 3, "pending_review")], "path array<string>, ord int, review_status string")
    ranges = spark.createDataFrame([(0, "Diameter", 6.0, 40.0, "mm", "http://s"), (0, "Length", 6.0, 18.0, "m", "http://s"), (3, "Wall", 1.0, 2.0, "mm", "http://p")],
                                   "ord int, field string, min double, max double, unit string, source_url string")
    asked = spark.createDataFrame([(["S", "B"],), (["S", "B", "12mm"],), (["S", "X"],), (["Z"],), (["S", "B", "12mm", "x"],), (["P"],)], "path array<string>")
    got = {" > ".join(r["path"]): r["stored_ord"] for r in kn.nearest_knowledge(asked, stored).collect()}
    assert got == {"S > B": 0, "S > B > 12mm": 0, "S > X": 1, "S > B > 12mm > x": 0, "P": 3}
    rows = evidence(spark, *[("r", f, v, "u", False) for f, v in (("Diameter", "12"), ("Size", "999 mm"), ("Grade", "5"), ("Length", "12000 mm"), ("Diameter", "none"))], ("q", "Diameter", "12", "u", False), ("p", "Wall", "9", "u", False))
    sugg = spark.createDataFrame([("r", ["S", "B"]), ("q", ["S", "X"]), ("p", ["P"])], "record_id string, path array<string>")
    verdicts = lambda **o: {(r["record_id"], r["field"], r["value"]): (r["verdict"], r["source"]) for r in kn.plausibility_report(rows, sugg, stored, ranges, **o).collect()}
    plain, aware = verdicts(), verdicts(unit_aware=True)
    assert plain[("r", "Diameter", "12")] == ("plausible", "http://s") and plain[("r", "Size", "999 mm")] == ("implausible", "http://s")
    assert plain[("r", "Grade", "5")] == plain[("r", "Diameter", "none")] == plain[("q", "Diameter", "12")] == plain[("p", "Wall", "9")] == ("unknown", None)
    assert plain[("r", "Length", "12000 mm")][0] == "implausible" and aware[("r", "Length", "12000 mm")][0] == "plausible"


def test_findings(spark):
    cols = "category string, ord int, kind string, name string, min double, max double, canonical_term string, source_url string"
    rows = [("c", 0, "range", "Diameter", 1.0, 2.0, None, "u"), ("c", 1, "range", "Diameter", 3.0, 4.0, None, "u"), ("c", 2, "range", "Ghost", 1.0, 2.0, None, "u"), ("c", 3, "range", "Length", None, 2.0, None, "u"),
            ("c", 4, "standard", "IS 1", None, None, None, ""), ("c", 5, "standard", "IS 2", None, None, None, "u"), ("c", 6, "term", "dia", None, None, "Diameter", "u"), ("c", 7, "term", "len", None, None, None, "u")]
    fields = spark.createDataFrame([("c", "Diameter"), ("c", "Length")], "category string, name string")
    got = {(r["kind"], r["name"], r["min"], r["review_status"]) for r in kn.admit_findings(spark.createDataFrame(rows, cols), fields).collect()}
    assert got == {("range", "Diameter", 3.0, "pending_review"), ("standard", "IS 2", None, "pending_review"), ("term", "dia", None, "pending_review")}


def test_json_stores(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))

    field = {"name": "Brand", "column": "A", "type": "dropdown", "required": True, "locked": False, "is_formula": False, "vocabulary": ["x", "y"]}
    put("t/a.json", {"category_path": ["A", "B"], "filename": "a.xlsx", "zip_category": "A", "category_ids": {"product_type_id": "p1"}, "fields": [field, {**field, "name": "Code", "locked": True}], "instructions": {"row_limit": 7}, "lookups": {"Brand": ["x"]}})
    put("t/b.json", "{broken")
    put("t/index.json", {"A > B": {}})
    templates, fields = stores.read_templates(spark, str(tmp_path / "t"))
    t = templates.first()
    assert (templates.count(), t["row_limit"], t["brands"], t["template_ord"]) == (1, 7, ["x"], "A > B")
    assert [(r["field_ord"], r["name"], r["vocabulary"]) for r in fields.orderBy("field_ord").collect()] == [(0, "Brand", ["x", "y"]), (1, "Code", ["x", "y"])]
    assert stores.template_for(templates, ["A", "B"]).count() == stores.template_for(templates, "A > B").count() == 1
    with pytest.raises(Exception, match="no schema stored"):
        stores.template_for(templates, "A > Z").collect()
    i = stores.template_index(templates, fields).first()
    assert (i["path"], i["product_type_id"], i["field_count"], i["writable_count"]) == ("A > B", "p1", 2, 1)
    put("k/x.json", {"category_path": ["A"], "plausible_ranges": {"Size": {"min": 1, "max": 2, "unit": "mm", "source_url": "u"}}, "researched_at": "2026"})
    put("k/index.json", {})
    k, r = stores.read_knowledge(spark, str(tmp_path / "k"))
    row = k.first()
    assert (row["review_status"], row["industry_references"], row["ord"]) == ("pending_review", [], "A") and r.first()["max"] == 2.0
    new = k.withColumn("review_status", F.lit("confirmed"))
    assert [x["review_status"] for x in stores.upsert_knowledge(k, new).collect()] == ["confirmed"]


def test_template_sheets(spark):
    cells, rows = [], [("Product Information", None, "Attributes"), ("Brand*", "Material (cond)*", "Length (opt)"), (None, None, None)]
    for tid in (1, 2, 3):
        for r, values in enumerate(rows, 1):
            for c, v in enumerate(values, 1):
                if not (tid == 2 and v and r == 2 and c > 1) and not (tid == 2 and r == 1):
                    cells.append((tid, "Template", r, c, v, "0.00" if (r, c) == (3, 3) else "General", (r, c) == (3, 1), False))
        cells += [(tid, "Lookup", 1, 1, "Brand", "General", False, False), (tid, "Lookup", 2, 1, " Acme ", "General", False, False), (tid, "Lookup", 3, 1, "Zeta", "General", False, False)]
        if tid != 3:
            cells += [(tid, "Instructions", i, 1, x, "General", False, False) for i, x in enumerate(["Generated for:", "Cat", "up to 1,000 products", "Required Fields", "- Brand", "Pattern: [Brand] x"], 1)]
    cells = spark.createDataFrame(cells, "template_id int, sheet string, row int, col int, text string, number_format string, locked boolean, is_formula boolean")
    files = spark.createDataFrame([(i, "z/XX_A_B.zip", f"f{i}.xlsx", True) for i in (1, 2, 3)], "template_id int, archive string, filename string, protected boolean")
    rules = spark.createDataFrame([(1, 0, 1, 1, "list", "Lookup!$A$2:$A$3"), (1, 1, 2, 2, "list", '"PVC, Steel"')], "template_id int, ord int, min_col int, max_col int, kind string, formula1 string")
    t, f, bad = sheets.parse_templates(cells, rules, files, archive_prefix="XX_")
    assert {r["source"]: r["reason"] for r in bad.collect()} == {"XX_A_B.zip::f2.xlsx": sheets.NO_HEADER, "XX_A_B.zip::f3.xlsx": "missing required sheet(s): Instructions"}
    assert sheets.parse_totals(files, bad).first().asDict() == {"found": 3, "parsed": 1, "failed": 2}
    got = [(r["name"], r["col"], r["type"], r["required"], r["conditional"], r["locked"], r["section"], r["dropdown_source"], r["vocabulary"]) for r in f.orderBy("field_ord").collect()]
    assert got == [("Brand", "A", "dropdown", True, False, True, "Product Information", "lookup:Brand", ["Acme", "Zeta"]),
                   ("Material", "B", "dropdown", True, True, False, "Product Information", "inline", ["PVC", "Steel"]),
                   ("Length", "C", "numeric", False, False, False, "Attributes", None, [])]
    row = t.first()
    assert (row["category_path"], row["zip_category"], row["row_limit"], row["instructions"]["required_fields"], row["lookups"]) == (["Cat"], "A B", 1000, ["Brand"], {"Brand": ["Acme", "Zeta"]})
    path = spark.range(1).select(sheets.category_path(F.lit(None).cast("string"), F.lit("z/XX_A_B.zip"), F.lit("C_D_-_E.xlsx"), "XX_")).first()[0]
    assert path == ["A B", "C D", "E"]
    letters = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (16384,)], "n int").select(sheets.column_letter(F.col("n"))).collect()
    assert [r[0] for r in letters] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_staging_survives_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "job string, record_id string, capture long, seq long, field string, value string"

    def add(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        q = staging.stage_stream(spark.readStream.schema(schema).parquet(src), out, ck)
        q.awaitTermination()
        assert q.exception() is None

    assert staging.list_staged(spark, out).count() == 0
    add(("j", "r1", 1, 0, "a", "1"), ("j", "r2", 1, 0, "a", "3"))
    run()
    add(("j", "r1", 1, 1, "b", "2"))  # the same capture goes on in another batch
    run()
    assert staging.finalize(spark, out).filter("record_id = 'r1'").count() == 2
    first = sorted(map(tuple, staging.finalize(spark, out).collect()))
    run()  # nothing new: nothing repeated
    assert sorted(map(tuple, staging.finalize(spark, out).collect())) == first == sorted(map(tuple, staging.finalize(spark, out).collect()))
    add(("j", "r1", 2, 0, "a", "9"), ("j", "r3", 1, 0, "a", "4"))  # r1 captured again, r3 new
    run()
    assert sorted(map(tuple, staging.finalize(spark, out).collect())) == [("j", "r1", 2, 0, "a", "9"), ("j", "r2", 1, 0, "a", "3"), ("j", "r3", 1, 0, "a", "4")]
    assert sorted(r["record_id"] for r in staging.list_staged(spark, out).collect()) == ["r1", "r2", "r3"]
    staging._write_batch(out)(spark.read.schema(schema).parquet(src).filter("record_id = 'r2'"), 0)  # a replayed batch replaces itself
    assert staging.finalize(spark, out).filter("record_id = 'r2'").count() == 1
