"""Work of registered queries that must be dealt to all cores and done once per row."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from claimloom.operators import match, pages
from claimloom.sources import sitemaps, workbooks
from contract import catalogue, queries_core, queries_store, queries_web

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_deep_markup_is_dealt_to_all_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pages, "jsonld_products", lambda df: seen.append(df) or df.select("page_id", F.lit("").alias("name"), F.lit("").alias("sku")))
    queries_web.page_jsonld_deep(spark, SF)
    assert "REPARTITION_BY_NUM" in plan_of(seen[0])


def test_sitemaps_are_dealt_to_all_cores_and_read_once(spark):
    plan = plan_of(queries_web.sitemap_dead_letters(spark, SF))
    assert len(re.findall("FileScan", plan)) == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("make", [queries_store._pack_parts, queries_store._listed])
def test_packs_are_dealt_to_all_cores(spark, make):
    assert "REPARTITION_BY_NUM" in plan_of(make(spark, SF))


def test_sitemaps_of_any_depth_and_kind_of_damage(spark):
    deep = lambda n, end="</e>": "<urlset>" + "<e>" * n + "<loc>u</loc>" + end * n + "</urlset>"
    maps = {
        "flat": deep(0), "deep": deep(13), "deeper": deep(40), "wrong": deep(3, "</f>"), "deep wrong": deep(40, "</f>"), "cut": "<urlset><loc>u</loc>",
        "empty element": "<urlset><a x='1'/><loc>u</loc></urlset>", "two ends": deep(2) + "</e>", "text before": "x" + deep(1), "entity": "<urlset><loc>a&b</loc></urlset>",
        "cdata": "<urlset><loc><![CDATA[u]]></loc></urlset>", "blank": "  "}
    rows = sitemaps.read_sitemaps(spark.createDataFrame(list(maps.items()), "url string, xml string")).collect()
    assert {r.url: list(r.locs) for r in rows if r.sound} == {k: ["u"] for k in ("flat", "deep", "deeper", "empty element", "cdata")}
    assert all(not r.locs for r in rows if not r.sound)


def test_many_sheets_lie_in_few_files_each_in_one(spark, tmp_path):
    books = spark.range(60).select(F.concat_ws("/", F.lit("t"), F.concat(F.lit("s"), "id")).alias("template_id"))
    cells = books.select("template_id", F.lit("Template").alias("sheet"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("row"), F.lit(1).alias("col"), F.lit("x").alias("text"))
    parts = spark.range(60).select(F.lit("t").alias("template_id"), F.concat(F.lit("s"), "id").alias("sheet"), F.lit("c").alias("category_slug"), F.col("id").alias("part"))
    workbooks.write_workbooks(cells, books, books, parts, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == 240 and {"category_slug", "template", "part"} <= set(stored.columns)
    assert len(list((tmp_path / "cells").rglob("*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert stored.select("template_id", F.input_file_name().alias("file")).distinct().count() == 60


def test_steps_of_a_part_do_not_pass_through_the_branches_of_other_steps(spark):
    plan = plan_of(catalogue.evidence(spark, SF))
    assert not re.search(r"\bk#\d+", plan) and "REPARTITION_BY_NUM" in plan


def test_sheets_are_numbered_once_for_all_who_ask(spark):
    assert queries_core.parts(spark, SF) is queries_core.parts(spark, SF)


def test_outcomes_compare_names_and_aggregate_values_once(spark, monkeypatch):
    seen, first = [], match._first_values
    monkeypatch.setattr(match, "_first_values", lambda evidence: seen.append(1) or first(evidence))
    match.outcomes(queries_core.evidence(spark, SF), queries_core.index(spark))
    assert len(seen) == 1


def test_names_seen_a_second_time_only_where_the_first_look_fails(spark):
    rows = queries_core.populate._routed(queries_core.evidence(spark, SF), queries_core.matched(spark, SF), queries_core.index(spark))
    assert re.search(r"CASE WHEN isnull\(field_canon", plan_of(rows))


def test_summary_of_a_page_is_read_once_whatever_is_chosen_from_it(spark):
    page = spark.createDataFrame([("u", "<h1>x</h1>")], "url string, html string")
    summary = pages.page_summary(F.col("html"), F.col("url"))
    looks = lambda c: page.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("<title(?=")
    assert looks(F.struct(pages.best_metadata(summary))) == looks(F.struct(summary))


def test_names_with_odd_ends(evaluate):
    from claimloom.functions import text as t

    names = ["Size (mm)", "Size (MM) \u2028", "(mm)", "Size (mm) x", "Size (mm", " <Dia (in)> ", "title", "Title\n", "titles", "cost", " _cost", "", None, "a)", "Price (usd)"]
    assert evaluate(t.canonical, names) == ["size", "size", "", "size (mm) x", "size (mm", "dia", "name", "name", "titles", "price", "price", "", None, "a)", "price (usd)"]


def test_values_are_looked_up_once_in_a_list_that_templates_share(spark):
    fields = queries_core.index(spark).fields.filter("type = 'dropdown'")
    lists = queries_core._vocabularies(spark)
    owners = lists.select(F.explode("owners").alias("o")).select("o.*")
    assert lists.count() == lists.select("canon", "vocabulary").distinct().count() < fields.count()
    assert sorted(map(tuple, owners.collect())) == sorted(map(tuple, fields.select("template_id", "name").collect()))


def test_regular_pages_are_walked_without_the_parser_and_others_alike(monkeypatch):
    from claimloom.operators import image_walk as walk

    def parsed(html):
        parser = walk._ImageWalk()
        parser.feed(html)
        return parser.images

    regular = [
        "", "text", '<div class="product"><p>a<br><img src="a.jpg"></p><img data-src=\'b.jpg\' width="5"/></div><img src="c.jpg">', '<!DOCTYPE html><!-- <img> --><IMG SRC="d" src="e">',
        '<script>var t="<td></td><img src=no>";</script><title>t</title><UL ID=gallery><li><img src="f" alt="a > b"><li></ul></b><img src="g">', '<div class="a"><span/></p></div><img>']
    odd = [
        '<div class="a&amp;b"><img src="a">', '<img src="a"class="b"><img src=b/>', "<div><img src='a", "a < b <img src=c>", "<!--><img src=d>-->", "<script><!-- <img src=e> </script>",
        "<textarea><img src=f></textarea>", "<script>x", "</div x><img src=g>", "<div class = product><img src=h>", '<title>a <b class="p"><img src=i></title>', "<br class='x'></></ p><img src=j>"]
    assert all(walk._regular_images(h) == parsed(h) for h in regular)
    assert all(walk._regular_images(h) is None and walk._images(h) == parsed(h) for h in odd)


def test_values_of_product_markup_are_taken_out_once(spark):
    markup = spark.createDataFrame([('{"@type":"Product","sku":1.50}',)], "j string").select(F.parse_json("j").alias("v"))
    looks = lambda c, path: markup.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count(path)
    v = F.col("v")
    assert looks(pages._scalar(v, "$.sku"), "$.sku") == looks(pages._string(v, "$.name"), "$.name") == 1
    assert looks(pages._nodes(v, 0), "@graph") == 1


def test_broken_markup_without_a_product_is_not_parsed_and_escapes_are_known(spark):
    script = '<script type="application/ld+json">%s</script>'
    page = spark.createDataFrame([(script % "{broken" + script % '{"@type":"Pro\\u0064uct","name":"a"}',)], "html string")
    parsed = pages._parsed_markup(F.col("html"), pages._may_state_product)
    row = page.select(F.size(parsed).alias("n"), pages.product_struct(F.col("html"))["name"].alias("name")).first()
    assert (row["n"], row["name"]) == (1, "a")
