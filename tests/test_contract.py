"""Registered queries against their SQL on the smallest tables, and the shape of the plans they run."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from contract import compare, queries_core, queries_web, registry
from claimloom.operators import match

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


def test_every_query_has_sql():
    assert all(sql for _, sql in registry.ALL.values()) and set(registry.ALL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_query_equals_sql(spark, con, name):
    ok, note = compare.compare(spark, con, *registry.ALL[name], SF)
    assert ok, note


def test_readback_compares_every_cell(spark):
    """The two queries together hold what a comparison in plain Python finds, measured columns included."""
    written = [tuple(r) for r in queries_core.cells(spark, SF).filter("bucket = 'written'").select("record_id", "variant_no", "name", "cell").collect()]
    want = {(*r, "missing") for r in written if int(r[0][1:]) % 17 == 0 or int(r[0][1:]) % 23 == 0}
    want |= {(*r[:3], r[3] + "!", "unexpected") for r in written if int(r[0][1:]) % 17 and int(r[0][1:]) % 23 == 0}
    measured = queries_core.readback_diff_measured(spark, SF).count()
    assert measured == sum(r[2] in queries_core._MEASURED for r in want) > 0
    assert measured + queries_core.readback_diff(spark, SF).count() == len(want)
    assert sum(r["mismatches"] for r in queries_core.write_failures_all(spark, SF).collect()) == len(want)
    print("cells", len(want), "measured", measured, "write_failures", sum(r["mismatches"] for r in queries_core.write_failures(spark, SF).collect()))


def test_entry_has_one_outcome_per_record(spark):
    df = entry.entry(spark)
    assert df.count() == df.select("record_id").distinct().count() == 200


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans_have_no_cartesian_product(spark):
    for df in (match.top_tier(queries_core.evidence(spark, SF), queries_core.index(spark)), queries_core.populate_fields(spark, SF),
               queries_web.robots_filter(spark, SF), queries_web.classify_rank(spark, SF)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_page_extraction_never_shuffles_and_reads_only_its_columns(spark):
    from claimloom.operators import pages

    raw = spark.read.parquet(f"{SF}/pages.parquet")
    for f in (pages.jsonld_products, pages.page_metadata, pages.spec_pairs, pages.same_host_links, pages.media_refs):
        text = plan(f(raw))
        assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan(pages.spec_pairs(raw))
