"""From extracted pages to evidence rows, under one rule: no value without a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..functions.binding import let
from ..functions.measures import format_value, normalize_value
from ..session import cut_lineage, settle
from .classify import MIN_SCORE, suggest
from .numbering import number_rows
from .pages import (
    MAX_JSON_DEPTH, PRODUCT_FIELDS, best_metadata, page_summary, product_struct, spec_pair_array,
)

# How far each source is trusted.
SPEC_TABLE, SPEC_TABLE_UNCLEAR, STRUCTURED, LOOSE, VOCABULARY = 0.95, 0.4, 0.9, 0.6, 0.7

def _row(field: Column, value: Column, confidence: Column) -> Column:
    return F.struct(
        field.cast("string").alias("field"), value.cast("string").alias("value"),
        confidence.cast("double").alias("confidence"),
    )


def _structured_rows(product: Column, confidence: float) -> Column:
    rows = F.array(*[_row(F.lit(k), product[k], F.lit(confidence)) for k in PRODUCT_FIELDS])
    return F.filter(rows, lambda r: ~t.is_blank(r["value"]))


def _spec_rows(pairs: Column) -> Column:
    read = F.transform(
        pairs, lambda p: F.struct(t.clean_key(p["key"]).alias("field"), normalize_value(p["value"]).alias("spec"))
    )
    rows = F.transform(
        read,
        lambda r: _row(
            r["field"], format_value(r["spec"]),
            F.when(r["spec"]["confidence"] >= 0.5, SPEC_TABLE).otherwise(SPEC_TABLE_UNCLEAR),
        ),
    )
    return F.filter(rows, lambda r: (r["field"] != "") & ~t.is_blank(r["value"]))


def _metadata_rows(product: Column, meta: Column) -> Column:
    rows = F.array(*[
        _row(F.lit(k), F.when(product[k].isNull(), meta[k]), F.lit(LOOSE)) for k in ("name", "description")
    ])
    return F.filter(rows, lambda r: F.coalesce(r["value"], F.lit("")) != "")


def to_evidence(wide: DataFrame, structured: bool = True) -> DataFrame:
    """Wide product fields (record_id, source_uri, one column per field) to one evidence row per non-blank field."""
    names = [c for c in wide.columns if c not in ("record_id", "source_uri")]
    rows = F.filter(
        F.array(*[_row(F.lit(n), F.col(n), F.lit(STRUCTURED if structured else LOOSE)) for n in names]),
        lambda r: ~t.is_blank(r["value"]),
    )
    return _explode(wide.select("record_id", "source_uri", rows.alias("rows")))


def _explode(df: DataFrame, *carried: str) -> DataFrame:
    return df.select("record_id", "source_uri", *carried, F.posexplode("rows").alias("seq", "r")).select(
        *carried, "record_id", F.col("seq").cast("bigint").alias("seq"), "r.field", "r.value", "source_uri",
        F.lit("scrape").alias("method"), "r.confidence", F.lit(False).alias("absence"),
        F.unix_micros(F.current_timestamp()).cast("double").alias("ts_us"),
    ).select(
        *carried, "record_id", "seq", "field", "value", "source_uri", "method", "confidence", "absence",
        (F.col("ts_us") / 1e6).alias("ts"),
    )


def spec_evidence(pairs: DataFrame) -> DataFrame:
    """(page_id, seq, key, value) pairs to rows with clean names, millimetres and a confidence."""
    read = pairs.select(
        "page_id", "seq", t.clean_key(F.col("key")).alias("field"), normalize_value(F.col("value")).alias("spec")
    )
    return read.select(
        "page_id", "seq", "field", format_value(F.col("spec")).alias("value"),
        F.when(F.col("spec.confidence") >= 0.5, SPEC_TABLE).otherwise(SPEC_TABLE_UNCLEAR).alias("confidence"),
    ).filter((F.col("field") != "") & ~t.is_blank(F.col("value")))


def metadata_evidence(pages: DataFrame, max_depth: int = MAX_JSON_DEPTH) -> DataFrame:
    """(page_id, field, value, confidence): name and description from page metadata, only where product markup states none.

    One projection over the page: nothing is joined or moved.
    """
    product = F.coalesce(product_struct(F.col("html"), max_depth), F.lit(None).cast("struct<" + ",".join(f"{k}:string" for k in PRODUCT_FIELDS) + ">"))
    both = F.struct(product.alias("product"), best_metadata(page_summary(F.col("html"), F.col("url"))).alias("meta"))
    return pages.select("page_id", F.explode(let(both, lambda b: _metadata_rows(b["product"], b["meta"]))).alias("r")).select(
        "page_id", "r.field", "r.value", "r.confidence")


def suggested_category(docs: DataFrame, templates: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, field, value, confidence): at most one suggested category per text."""
    return suggest(docs, templates, min_score).select(
        "doc_id", F.lit("suggested_category").alias("field"), t.path_text(F.col("path")).alias("value"),
        F.col("score").alias("confidence"),
    )


def _brand_rules(templates: DataFrame) -> DataFrame:
    """Per category path the brands in order, each with the pattern that finds it as a whole word."""
    edge = lambda c, ahead: F.when(
        c.rlike(f"[{t.WORD}]"), F.lit(f"(?!{'[' + t.WORD + ']'})" if ahead else f"(?<![{t.WORD}])")
    ).otherwise(F.lit(f"(?=[{t.WORD}])" if ahead else f"(?<=[{t.WORD}])"))
    rule = lambda b: F.struct(
        b.alias("brand"), F.lower(b).alias("lower"),
        F.concat(
            F.lit("(?iu)"), edge(F.substring(b, 1, 1), False), F.lit("\\Q"), b, F.lit("\\E"),
            edge(F.substring(b, -1, 1), True),
        ).alias("pattern"),
    )
    brands = F.filter(F.transform("brands", t.strip), lambda b: b != "")
    return templates.select(t.path_text(F.col("category_path")).alias("path"), F.transform(brands, rule).alias("rules"))


def brand_from_vocabulary(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, brand): the first listed brand of the suggested category found in the text as a whole word.

    ``texts`` has (doc_id, text, path); ``templates`` has (category_path, brands).  A path that is no template
    (a shared family) or has no brand list yields nothing.  Containment is tested before the pattern is.
    """
    rules = settle(_brand_rules(templates).filter("size(rules) > 0"))
    lowered = F.lower(F.col("text"))
    hits = F.filter("rules", lambda r: F.contains(lowered, r["lower"]) & F.rlike(F.col("text"), r["pattern"]))
    return (
        texts.join(rules, "path")
        .select("doc_id", F.get(hits, F.lit(0))["brand"].alias("brand"))
        .filter("brand IS NOT NULL")
    )


def _product_pages(pages: DataFrame, max_depth: int) -> DataFrame:
    """(page_id, source_uri, record_id, rows, text) of the pages that state a product.

    The gate is a generator: what it lets through is computed once, and metadata is read from product pages only.
    """
    def rows(product: Column) -> Column:
        return F.struct(
            product.alias("product"), _structured_rows(product, STRUCTURED).alias("own"),
            _spec_rows(spec_pair_array(F.col("html"))).alias("spec"),
        )

    def gate(p: Column) -> Column:
        return F.when((F.size(p["own"]) > 0) | (F.size(p["spec"]) > 0), F.array(p))

    found = pages.filter(F.coalesce("html", F.lit("")) != "").select(
        "page_id", "url", "html", F.explode(let(let(product_struct(F.col("html"), max_depth), rows), gate)).alias("p")
    )
    product = F.col("p.product")
    either = lambda k: F.coalesce(product[k], F.col("meta")[k])
    return found.withColumn("meta", best_metadata(page_summary(F.col("html"), F.col("url")))).select(
        "page_id", F.col("url").alias("source_uri"), urls.record_id(product["sku"], F.col("url")).alias("record_id"),
        F.concat("p.own", "p.spec", _metadata_rows(product, F.col("meta"))).alias("rows"),
        F.concat_ws(" ", either("name"), either("description")).alias("text"),
    )


def assemble_evidence(
    pages: DataFrame, templates: DataFrame, min_score: float = MIN_SCORE, max_depth: int = MAX_JSON_DEPTH
) -> DataFrame:
    """Pages to evidence.  Only product markup or a specification table makes a page a product.

    ``templates`` has category_path, naming_convention, breadcrumb and brands.  The HTML is read once; the narrow
    result is written, because the suggestion needs a shuffle and reading every page twice would cost far more.
    """
    narrow = cut_lineage(_product_pages(pages, max_depth))
    docs = narrow.filter(~t.is_blank(F.col("text"))).select(F.col("page_id").alias("doc_id"), "text")
    suggestion = cut_lineage(suggested_category(docs, templates, min_score))
    brandless = narrow.filter(~F.exists("rows", lambda r: F.lower(t.strip(r["field"])) == "brand")).select(
        F.col("page_id").alias("doc_id"), "text"
    )
    brand = brand_from_vocabulary(
        brandless.join(suggestion.select("doc_id", F.col("value").alias("path")), "doc_id"), templates
    )
    added = narrow.join(
        suggestion.select(F.col("doc_id").alias("page_id"), _row(F.col("field"), F.col("value"), F.col("confidence")).alias("s")),
        "page_id", "left",
    ).join(
        brand.select(F.col("doc_id").alias("page_id"), _row(F.lit("Brand"), F.col("brand"), F.lit(VOCABULARY)).alias("b")),
        "page_id", "left",
    )
    found = _explode(
        added.select(
            "page_id", "record_id", "source_uri", F.concat("rows", F.array_compact(F.array("s", "b"))).alias("rows")
        ), "page_id",
    )
    # Several pages may state one record; its rows get one order, by page address and place on the page.
    numbered = number_rows(found, ["record_id"], ["source_uri", "page_id", "seq"])
    return numbered.withColumn("seq", F.col("row_no") - 1).select(*[c for c in found.columns if c != "page_id"])
