"""Places of lines, running counts of hot groups, depth of markup and sitemaps, stored packs."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, capture, numbering, pages
from claimloom.sources import evidence as ev
from claimloom.sources import sitemaps


@pytest.mark.parametrize("split", [200, 1000, 1 << 20])
def test_evidence_is_numbered_by_its_lines(spark, tmp_path, split):
    rows = [{"record_id": f"r{i % 7}", "field": "f", "value": "x" * (i % 50), "absence": False} for i in range(300)]
    for name, part in (("b.jsonl", rows[100:]), ("a.jsonl", rows[:100])):
        (tmp_path / name).write_text("\n\n".join(json.dumps(r) for r in part) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = ev.read_evidence(spark, str(tmp_path)).select("seq", "record_id", "value").orderBy("seq").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in got] == [(i, r["record_id"], r["value"]) for i, r in enumerate(rows)]


def test_running_count_of_a_hot_group(spark):
    rows = [("hot", i, i % 3 == 0) for i in range(3000)] + [(f"j{k}", i, True) for k in range(20) for i in range(5)] + [(None, 0, None)]
    df = spark.createDataFrame(rows, "job string, ord int, flag boolean")
    counted = numbering.count_before(df, ["job"], ["ord"], F.col("flag"), "n")
    want = {(j, o): (o + 2) // 3 if j == "hot" else o for j, o, _ in rows if j}
    assert {(r["job"], r["ord"]): r["n"] for r in counted.filter("job IS NOT NULL").collect()} == want
    assert spark.read.schema(counted.schema) is not None and counted.count() == len([r for r in rows if r[0]])


def test_a_job_of_any_size_stops_at_its_limit(spark):
    candidates = spark.createDataFrame([("hot", i, f"u{i}", i % 2 == 0) for i in range(2000)], "job string, ord long, url string, allowed boolean")
    seen = spark.createDataFrame([(f"u{i}", True, True, 1, f"r{i}") for i in range(2000)], "url string, fetched boolean, has_fields boolean, n_rows int, record_id string")
    plan = capture.capture_plan(candidates, seen, 30)
    got = {r["ord"]: r["status"] for r in plan.collect()}
    assert [o for o, s in got.items() if s == "captured"] and sorted(o for o, s in got.items() if s == "captured") == list(range(0, 60, 2))
    assert got[1] == "blocked" and {got[o] for o in range(60, 2000)} == {"limit_reached"}
    assert all("_slice" in w for w in re.findall(r"windowspecdefinition\(([^)]*)ROWS", plan._jdf.queryExecution().optimizedPlan().toString()) if "ord" in w)


def nested(depth, inner):
    for i in range(depth):
        inner = f'[{{"@type":"Thing"}},{inner}]' if i % 2 else f'{{"@type":"Product","name":"owner {i}","@graph":{inner}}}'
    return f'<script type="application/ld+json">{inner}</script>'


def test_markup_of_any_depth(spark):
    rows = [(f"p{d}", nested(d, '{"@type":"Product","name":"deep"}')) for d in (0, 1, 7, 8, 9, 16, 17, 25, 40, 90)]
    rows += [("owner", nested(20, '{"@type":"Thing"}')), ("none", nested(30, "{}").replace("Product", "Thing")), ("plain", "<p>no markup</p>"), ("bad", '<script type="application/ld+json">{</script>')]
    got = {r["page_id"]: r["name"] for r in pages.jsonld_products(spark.createDataFrame(rows, "page_id string, html string")).collect()}
    # A graph is walked before its owner, so the innermost product comes first; without one the innermost owner does.
    assert got == {**{f"p{d}": "deep" for d in (0, 1, 7, 8, 9, 16, 17, 25, 40, 90)}, "owner": "owner 0"}


def test_sitemaps_of_any_depth(spark):
    loc = "<loc>http://a/1</loc>"
    wrap = lambda n: "<urlset>" + "<e>" * n + loc + "</e>" * n + "</urlset>"
    docs = {"flat": wrap(0), "12": wrap(12), "60": wrap(60), "crossed": "<urlset>" + "<a><b>" * 10 + loc + "</a></b>" * 10 + "</urlset>", "open": wrap(12)[:-9], "two": wrap(12) + wrap(12),
            "text": wrap(12) + "tail", "amp": wrap(12).replace("/1", "/1?a&b"), "empty": "", "cdata": wrap(12).replace("http://a/1", "<![CDATA[http://a/1]]>")}
    maps = spark.createDataFrame([*docs.items(), ("null", None)], "url string, xml string")
    good = {r["url"]: r["locs"] for r in sitemaps.sitemap_locations(maps).collect() if r["locs"]}
    assert good == {k: ["http://a/1"] for k in ("flat", "12", "60", "cdata")}
    assert {r["url"] for r in sitemaps.sitemap_dead_letters(maps).collect()} == {*docs, "null"} - set(good)


def test_stored_packs_are_audited(spark, tmp_path):
    line = json.dumps({"record_id": "r", "field": "f", "value": "v", "source_uri": "u", "absence": False})
    files = {"a/datapackage.json": json.dumps({"version": "1.0", "producer": {}, "product_count": 1}), "a/evidence.jsonl": line + "\n\n" + line.replace('"u"', '""') + "\n", "a/manifest-sha256.txt": "m",
             "a/media/x/y.webp": "image", "b/evidence.jsonl": line}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    parts = audit.read_packs(spark, str(tmp_path))
    assert {(r["pack"], r["path"]): bytes(r["content"]).decode() for r in parts.collect()} == {tuple(k.split("/", 1)): v for k, v in files.items()}
    listed = spark.createDataFrame([("a", "media/x/y.webp", hashlib.sha256(b"image").hexdigest()), ("a", "evidence.jsonl", "0" * 64)], "pack string, path string, sha256 string")
    got = sorted(tuple(r) for r in audit.audit_packs(parts, listed).collect())
    assert [(p, e[:37]) for p, e in got] == [("a", "checksum mismatch for evidence.jsonl:"), ("a", "evidence.jsonl line 1: r.f = 'v' has "), ("b", "missing required file(s): datapackage")]


def test_contents_are_read_once_and_never_move(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "evidence.jsonl").write_text("{}")
    facts = audit.pack_facts(audit.read_packs(spark, str(tmp_path)))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Exchange" not in plan
    errors = audit.audit_packs(audit.read_packs(spark, str(tmp_path)), spark.createDataFrame([], "pack string, path string, sha256 string"))
    assert "binaryFile" not in errors._jdf.queryExecution().executedPlan().toString()  # nothing but the narrow facts


def test_packs_come_from_one_snapshot(spark, tmp_path):
    from claimloom.streaming import staging

    rows = [("j", f"r{i}", c, s, f"f{s}", f"v{c}") for i in range(5) for c in ((1, 2) if i % 2 else (1,)) for s in range(3)]
    media = [("j", f"r{i}", c, 0, f"http://m/{i}-{c}.gif", "gif") for i in range(5) for c in (1, 2)]
    spark.createDataFrame(rows, "job string, record_id string, capture long, seq long, field string, value string").write.parquet(str(tmp_path / "e" / "batch_id=0"))
    spark.createDataFrame(media, "job string, record_id string, capture long, seq long, url string, media_type string").write.parquet(str(tmp_path / "m" / "batch_id=0"))
    first, second = (staging.finalize_pack(spark, str(tmp_path / "e"), str(tmp_path / "m"), part_rows=4) for _ in range(2))
    assert sorted(map(tuple, first.manifest.collect())) == sorted(map(tuple, second.manifest.collect())) and first.manifest.count() == 1 + 4
    text = {r["path"]: bytes(r["content"]).decode() for r in first.parts.collect()}
    lines = [json.loads(x) for name in sorted(text, key=lambda n: (n != "evidence.jsonl", n)) if name.startswith("evidence") for x in text[name].splitlines()]
    assert [(x["record_id"], x["seq"], x["value"]) for x in lines] == [(f"r{i}", s, f"v{2 if i % 2 else 1}") for i in range(5) for s in range(3)]
    assert json.loads(text["datapackage.json"]) | {"producer": 0} == {"version": "1.0", "producer": 0, "product_count": 5, "media_count": 5, "provenance_policy": "no-evidence-no-value"}
    assert {(r["record_id"], r["refs"][0]["url"]) for r in first.media.collect()} == {(f"r{i}", f"http://m/{i}-{2 if i % 2 else 1}.gif") for i in range(5)}
    assert audit.audit_packs(first.parts.unionByName(first.manifest.groupBy("pack").agg(F.lit("manifest-sha256.txt").alias("path"), F.lit(b"").alias("content"))), first.manifest).filter("NOT error LIKE '%source%'").collect() == []
