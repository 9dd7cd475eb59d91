"""Registered queries over pages, documents and texts, given or derived from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as t
from claimloom.functions.text import STOP_WORDS
from claimloom.operators import assemble, capture, classify, documents, pages
from claimloom.session import scratch_path
from claimloom.sources import sitemaps
from claimloom.streaming import staging

from . import catalogue as c
from . import sql as q


# ---------------------------------------------------------------- product pages written from the parts

_K = "p_partkey"
_JSON = """
concat('{"@type":', CASE p_partkey % 3 WHEN 0 THEN '"Product"' WHEN 1 THEN '["Thing","http://schema.org/Product"]' ELSE '"https://schema.org/Product"' END,
 ',"name":" ', p_name, ' "', CASE WHEN p_partkey % 5 <> 0 THEN concat(',"sku":', p_partkey) ELSE ',"sku":" "' END,
 CASE p_partkey % 3 WHEN 0 THEN ',"image":"a.jpg"' WHEN 1 THEN ',"image":["b.jpg","c.jpg"]' ELSE ',"image":[{"contentUrl":"d.jpg"}]' END,
 CASE WHEN p_partkey % 2 = 0 THEN concat(',"description":"a ', p_name, ' of type ', p_type, '"') ELSE '' END,
 CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat(',"brand":"', p_brand, '"') WHEN 2 THEN concat(',"brand":{"name":" ', p_brand, '"}') ELSE concat(',"brand":[{"name":"', p_brand, '"}]') END,
 CASE WHEN p_partkey % 2 = 0 THEN concat(',"offers":{"price":', CAST(p_retailprice AS DECIMAL(12,2)), '}') ELSE concat(',"offers":[{"priceSpecification":{"price":"', CAST(p_retailprice AS DECIMAL(12,2)), ' "}}]') END, '}')"""
_LD = f"""
CASE WHEN p_partkey % 4 = 3 THEN '' ELSE concat('<!-- <script type="application/ld+json">{{"@type":"Product","name":"hidden"}}</script> -->',
 '<script type="application/ld+json">{{broken</script><script type=''application/ld+json''>',
 CASE p_partkey % 4 WHEN 0 THEN {_JSON} WHEN 1 THEN concat('[{{"@type":"Organization","name":"org"}},', {_JSON}, ']')
  ELSE concat('{{"@context":"x","@graph":[{{"@type":"WebSite"}},[', {_JSON}, ']]}}') END, '</script>') END"""
_TABLE = """
CASE WHEN p_partkey % 3 = 1 THEN '' ELSE concat('<table class="x"><tr><th>Material:</th><td>', CASE WHEN p_partkey % 2 = 0 THEN 'PVC' ELSE 'Steel &amp; <b>PVC</b>' END, '</td></tr>',
 '<tr><td>one</td><td>two</td><td>three</td></tr><tr><td>Height</td><td>', p_size, CASE p_partkey % 4 WHEN 0 THEN ' cm' WHEN 1 THEN ' mm' WHEN 2 THEN '' ELSE ' x 2 mm' END,
 '</td></tr><tr><td></td><td>empty</td></tr><tr><td> Finish  &quot;Type&quot; </td><td>', p_type, '</td></tr></table>') END"""
_DL = """CASE WHEN p_partkey % 6 = 0 THEN '<dl><dt>Length</dt><dd>2,5 m</dd><dd>42</dd><dt></dt><dd>none</dd></dl>' ELSE '' END"""
_HTML = f"""
concat('<!DOCTYPE html><html><head><title>', p_name, ' | Shop</title><script>var t="<table><tr><td>no</td><td>no</td></tr></table>";</script>',
 CASE WHEN p_partkey % 2 = 1 THEN concat('<meta property="og:title" content="', p_name, ' &quot;x&quot;">') ELSE '' END,
 CASE WHEN p_partkey % 3 = 0 THEN '<meta content=" plain words " name="description">' ELSE '' END,
 CASE WHEN p_partkey % 4 = 0 THEN '<meta property="og:image" content="../img/og.jpg">' WHEN p_partkey % 4 = 3 THEN '<meta name="twitter:image" content="/img/tw.jpg">' ELSE '' END,
 {_LD}, '</head><body><h1>The <em>', p_name, '</em></h1>', {_TABLE}, {_DL},
 CASE WHEN p_partkey % 5 = 0 THEN '<video src="/v/clip.mp4"><source src="clip.webm"></video>' ELSE '' END,
 CASE WHEN p_partkey % 7 = 0 THEN '<a href="anim.gif?x=1">gif</a><img data-src="/v/clip.mp4"><img data-src="spin.GIF">' ELSE '' END,
 '<div class="wrap product-view"><p><img src="g', p_partkey, '.jpg"><img src="logo.png"><img src="small.jpg" width="50"><img src="g', p_partkey, '.jpg" height="100">',
 CASE WHEN p_partkey % 2 = 0 THEN '<img data-src="second.jpg" width="auto">' ELSE '' END, '</p></div><div class="nav"><img src="nav.jpg"></div>',
 '<a href="/cat/p-', p_partkey + 1, '.html#top">next</a><a href="p-', p_partkey + 1, '.html">again</a><a href="mailto:a@b.c">m</a><a href="http://other.example.com/">o</a></body></html>')"""
_URL = "concat('https://shop', p_partkey % 7, '.example.com/cat/p-', p_partkey, '.html?ref=1')"


def product_pages(spark, sf):
    part = c.spread(spark, c.read(spark, sf, "part").select(_K, "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), _K)
    return part.select(
        F.col(_K).alias("page_id"), F.expr(_URL).alias("url"), F.expr(_HTML).alias("html")
    )


_SITE = "'https://shop' || p_partkey % 7 || '.example.com'"
_PAGE_CTE = f"""
pg AS (SELECT *, p_partkey AS page_id, {_SITE} AS site, {_SITE} || '/cat/p-' || p_partkey || '.html?ref=1' AS url,
  CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS j_name, CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS j_sku,
  CASE WHEN p_partkey % 4 <> 3 THEN CASE p_partkey % 3 WHEN 0 THEN 'a.jpg' WHEN 1 THEN 'b.jpg' ELSE 'd.jpg' END END AS j_image,
  CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 2 = 0 THEN 'a ' || p_name || ' of type ' || p_type END AS j_description,
  CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 THEN p_brand END AS j_brand,
  CASE WHEN p_partkey % 4 <> 3 THEN CASE WHEN p_partkey % 2 = 0 THEN CAST(p_retailprice AS VARCHAR) ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END END AS j_price,
  CASE WHEN p_partkey % 2 = 1 THEN p_name || ' "x"' ELSE 'The' || p_name END AS m_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'plain words' END AS m_description,
  CASE WHEN p_partkey % 4 = 0 THEN {_SITE} || '/img/og.jpg' WHEN p_partkey % 4 = 3 THEN {_SITE} || '/img/tw.jpg' END AS m_image FROM part),
pairs AS (SELECT page_id, n, key, value FROM (
  SELECT page_id, 0 AS n, 'Material:' AS key, CASE WHEN p_partkey % 2 = 0 THEN 'PVC' ELSE 'Steel & PVC' END AS value FROM pg WHERE p_partkey % 3 <> 1
  UNION ALL SELECT page_id, 1, 'Height', p_size || CASE p_partkey % 4 WHEN 0 THEN ' cm' WHEN 1 THEN ' mm' WHEN 2 THEN '' ELSE ' x 2 mm' END FROM pg WHERE p_partkey % 3 <> 1
  UNION ALL SELECT page_id, 2, 'Finish  "Type"', p_type FROM pg WHERE p_partkey % 3 <> 1
  UNION ALL SELECT page_id, 3, 'Length', '2,5 m' FROM pg WHERE p_partkey % 6 = 0 UNION ALL SELECT page_id, 4, 'Length', '42' FROM pg WHERE p_partkey % 6 = 0))"""


def _blank(*names):
    return [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]


def page_jsonld(spark, sf):
    return pages.jsonld_products(product_pages(spark, sf)).select("page_id", *_blank(*pages.PRODUCT_FIELDS))


PAGE_JSONLD = f"""WITH {_PAGE_CTE} SELECT page_id, {', '.join(f"coalesce(j_{f}, '') AS {f}" for f in pages.PRODUCT_FIELDS)} FROM pg WHERE p_partkey % 4 <> 3"""


def page_jsonld_deep(spark, sf):
    """Products nested up to 40 lists and graphs deep, beside a second product that stands less deep but later."""
    part = c.spread(spark, c.read(spark, sf, "part").select(_K, "p_name"), _K)
    depth = F.col(_K) % 38 + 3
    inner = F.concat(F.lit('{"@type":"Product","sku":"S'), _K, F.lit('","name":" '), "p_name", F.lit('"}'))
    opened = F.concat(F.repeat(F.lit('[{"@graph":'), (depth / 2).cast("int")), F.when(depth % 2 == 1, "[").otherwise(""))
    closed = F.concat(F.when(depth % 2 == 1, "]").otherwise(""), F.repeat(F.lit("}]"), (depth / 2).cast("int")))
    nested = F.concat(opened, F.when(F.col(_K) % 5 == 0, F.lit('{"@type":"Thing"}')).otherwise(inner), closed)
    html = F.concat(F.lit('<script type="application/ld+json">['), nested, F.lit(',{"@type":"Product","name":"second"}]</script>'))
    return pages.jsonld_products(part.select(F.concat(F.lit("p"), _K).alias("page_id"), html.alias("html"))).select("page_id", "name", *_blank("sku"))


PAGE_JSONLD_DEEP = """SELECT 'p' || p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN 'second' ELSE p_name END AS name,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'S' || p_partkey END AS sku FROM part"""


def page_extract(spark, sf):
    """Everything of a page in one projection."""
    e = pages.extract_pages(product_pages(spark, sf))
    return e.select("page_id", F.coalesce("product.name", F.lit("")).alias("product"), F.size("pairs").alias("n_pairs"), F.col("meta.name").alias("meta_name"), F.size("media").alias("n_media"),
                    F.coalesce(F.get("media", F.lit(0))["media_type"], F.lit("")).alias("first_media"))


PAGE_EXTRACT = f"""WITH {_PAGE_CTE} SELECT page_id, coalesce(j_name, '') AS product, CAST((SELECT count(*) FROM pairs p WHERE p.page_id = pg.page_id) AS INTEGER) AS n_pairs, m_name AS meta_name,
  CAST((CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END) + (CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END) AS INTEGER) AS n_media,
  CASE WHEN p_partkey % 5 = 0 THEN 'video' WHEN p_partkey % 7 = 0 THEN 'gif' ELSE '' END AS first_media FROM pg"""


def page_spec_pairs(spark, sf):
    return pages.spec_pairs(product_pages(spark, sf))


PAGE_SPEC = f"WITH {_PAGE_CTE} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS seq, key, value FROM pairs"


def spec_evidence(spark, sf):
    return assemble.spec_evidence(pages.spec_pairs(product_pages(spark, sf)))


_SPEC_CTE = rf"""{q.normalized('sn', 'pairs', 'page_id, n', 'value')},
spec AS (SELECT p.page_id, p.n, trim(rtrim(trim(regexp_replace(key, '\s+', ' ', 'g')), ':')) AS field, s.formatted AS value,
  CASE WHEN s.conf >= 0.5 THEN 0.95 ELSE 0.4 END AS confidence FROM pairs p JOIN sn s USING (page_id, n))"""
SPEC_EVIDENCE = f"""WITH {_PAGE_CTE}, {_SPEC_CTE} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS seq, field, value, confidence FROM spec"""


def product_metadata(spark, sf):
    return pages.metadata_fields(pages.page_metadata(product_pages(spark, sf))).select("page_id", *_blank("name", "description", "image"))


PRODUCT_METADATA = f"""WITH {_PAGE_CTE} SELECT page_id, m_name AS name, coalesce(m_description, '') AS description, coalesce(m_image, '') AS image FROM pg"""


def metadata_evidence(spark, sf):
    return assemble.metadata_evidence(product_pages(spark, sf))


METADATA_EVIDENCE = f"""WITH {_PAGE_CTE} SELECT page_id, 'name' AS field, m_name AS value, 0.6 AS confidence FROM pg WHERE j_name IS NULL
  UNION ALL SELECT page_id, 'description', m_description, 0.6 FROM pg WHERE j_description IS NULL AND m_description IS NOT NULL"""


def page_media(spark, sf):
    return pages.media_refs(product_pages(spark, sf))


PAGE_MEDIA = f"""WITH {_PAGE_CTE}, m AS (
  SELECT page_id, 0 AS n, site || '/v/clip.mp4' AS url, 'video' AS media_type FROM pg WHERE p_partkey % 5 = 0
  UNION ALL SELECT page_id, 1, site || '/cat/clip.webm', 'video' FROM pg WHERE p_partkey % 5 = 0
  UNION ALL SELECT page_id, 2, site || '/cat/anim.gif?x=1', 'gif' FROM pg WHERE p_partkey % 7 = 0
  UNION ALL SELECT page_id, 3, site || '/cat/spin.GIF', 'gif' FROM pg WHERE p_partkey % 7 = 0)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS seq, url, media_type FROM m"""


def gallery_images(spark, sf):
    return pages.gallery_images(product_pages(spark, sf)).select("page_id", "seq", "url")


# Images before those of the gallery: two where the page shows an animation.
GALLERY = f"""WITH {_PAGE_CTE}, s AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END AS n FROM pg)
SELECT page_id, CAST(n AS BIGINT) AS seq, site || '/cat/g' || p_partkey || '.jpg' AS url FROM s
  UNION ALL SELECT page_id, CAST(n + 4 AS BIGINT), site || '/cat/second.jpg' FROM s WHERE p_partkey % 2 = 0"""


def product_image(spark, sf):
    return pages.product_image_url(product_pages(spark, sf))


PRODUCT_IMAGE = f"""WITH {_PAGE_CTE} SELECT page_id, coalesce(j_image, m_image, site || '/cat/g' || p_partkey || '.jpg') AS image_url FROM pg"""


def product_links(spark, sf):
    return pages.same_host_links(product_pages(spark, sf))


PRODUCT_LINKS = f"""WITH {_PAGE_CTE} SELECT page_id, CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS seq, site || '/cat/p-' || (p_partkey + 1) || '.html' AS url FROM pg
  UNION ALL SELECT page_id, CAST(0 AS BIGINT), site || '/cat/anim.gif?x=1' FROM pg WHERE p_partkey % 7 = 0"""

# ---------------------------------------------------------------- classification

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _words(x: str) -> str:
    return f"list_filter(list_distinct(string_split_regex(lower({x}), '[^a-z0-9]+')), lambda w: len(w) > 1 AND w NOT IN ({_STOP}))"


def classify_cte(docs: str, categories: str) -> str:
    """CTEs ranked, top, suggestion over ``docs`` (doc_id, text) and ``categories`` (template_id, path, naming)."""
    literals = r"regexp_replace(regexp_replace(coalesce(naming, ''), '\[[^\]]*\]', ' ', 'g'), '(?i)pattern:', ' ', 'g')"
    level = lambda i: f"split_part(path, ' > ', {i})"
    same = lambda i: f"count(DISTINCT {level(i)}) = 1 AND min({level(i)}) <> ''"
    prefix = "''"
    for i in (4, 3, 2, 1):
        rest = prefix if i == 4 else f"(CASE WHEN {same(i + 1)} THEN ' > ' || min({level(i + 1)}) || {prefix} ELSE '' END)"
        prefix = rest
    prefix = f"(CASE WHEN {same(1)} THEN min({level(1)}) || {prefix} ELSE '' END)"
    return f"""
cw AS (SELECT template_id, path, unnest({_words(f"replace(path, ' > ', ' ') || ' ' || {literals}")}) AS word FROM ({categories})),
dl AS (SELECT doc_id, {_words('text')} AS words FROM ({docs})),
dw AS (SELECT doc_id, len(words) AS n_words, unnest(words) AS word FROM dl),
ranked AS (SELECT doc_id, template_id, path, n_words, count(*) AS matched, list_sort(list(word)) AS terms FROM dw JOIN cw USING (word) GROUP BY 1, 2, 3, 4),
top AS (SELECT * FROM ranked QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY matched DESC) = 1),
suggestion AS (SELECT doc_id, CASE WHEN count(*) = 1 THEN min(path) ELSE {prefix} END AS path, max(matched) / max(n_words) AS score,
  array_to_string(list_sort(list_distinct(flatten(list(terms)))), '|') AS terms, count(*) AS tied_count FROM top GROUP BY 1)"""


TEXT_CATEGORIES = [
    ("c1", "Texts > English > Thon", "Pattern: [x] er re es st", "thon|Er St|ing"), ("c2", "Texts > English > Thre", "er re es ou", "Thre|est"),
    ("c3", "Texts > French > Que", "Pattern: que ou eau", "eau|que"), ("c4", "Texts > French > Ment", "en de la on", ""),
    ("c5", "Texts > German > Der", "der sch ich ung", "der"), ("c6", "Texts > Spanish", "las los ci", "los|las"),
]
_TC_VALUES = "VALUES " + ", ".join(f"('{a}', {i}, '{b}', '{n}', '{br}')" for i, (a, b, n, br) in enumerate(TEXT_CATEGORIES))
_TC_SQL = f"SELECT template_id, path, naming, brands FROM ({_TC_VALUES}) AS v(template_id, ord, path, naming, brands)"


def text_categories(spark):
    v = spark.sql(f"SELECT * FROM {_TC_VALUES} AS v(template_id, template_ord, path, naming_convention, brand_text)")
    return v.select(
        "template_id", "template_ord", t.path_array(F.col("path")).alias("category_path"), "naming_convention",
        F.lit(None).cast("string").alias("breadcrumb"), F.filter(F.split("brand_text", r"\|"), lambda b: b != "").alias("brands"))


def _docs(spark, sf):
    return c.read(spark, sf, "documents").select("doc_id", "text")


def classify_rank(spark, sf):
    return classify.rank_categories(_docs(spark, sf), text_categories(spark)).select(
        "doc_id", "template_id", "matched", F.round("score", 4).alias("score"), F.array_join("terms", "|").alias("terms"))


_DOC_CLASSIFY = classify_cte("SELECT doc_id, text FROM documents", _TC_SQL)
CLASSIFY_RANK = f"WITH {_DOC_CLASSIFY} SELECT doc_id, template_id, matched, round(score, 4) AS score, terms FROM (SELECT doc_id, template_id, matched, matched / n_words AS score, array_to_string(terms, '|') AS terms FROM ranked)"


def classify_top(spark, sf):
    tc = text_categories(spark)
    return classify.top_suggestion(classify.rank_categories(_docs(spark, sf), tc), tc).select(
        "doc_id", t.path_text(F.col("path")).alias("path"), F.round("score", 4).alias("score"), F.array_join("terms", "|").alias("terms"), "tied_count")


CLASSIFY_TOP = f"WITH {_DOC_CLASSIFY} SELECT doc_id, path, round(score, 4) AS score, terms, tied_count FROM suggestion"


def suggested_category(spark, sf):
    return assemble.suggested_category(_docs(spark, sf), text_categories(spark)).select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence"))


SUGGESTED = f"WITH {_DOC_CLASSIFY} SELECT doc_id, 'suggested_category' AS field, path AS value, round(score, 4) AS confidence FROM suggestion WHERE score >= 0.03 AND path <> ''"


def brand_in_text(spark, sf):
    tc, docs = text_categories(spark), _docs(spark, sf)
    paths = assemble.suggested_category(docs, tc).select("doc_id", F.col("value").alias("path"))
    return assemble.brand_from_vocabulary(docs.join(paths, "doc_id"), tc)


BRAND = f"""WITH {_DOC_CLASSIFY}, b AS (SELECT path, unnest(string_split(brands, '|')) AS brand, generate_subscripts(string_split(brands, '|'), 1) AS ord FROM ({_TC_SQL}) WHERE brands <> ''),
h AS (SELECT s.doc_id, b.brand, b.ord FROM suggestion s JOIN documents d USING (doc_id) JOIN b USING (path)
  WHERE score >= 0.03 AND regexp_matches(d.text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || b.brand || '([^\\p{{L}}\\p{{N}}_]|$)'))
SELECT doc_id, arg_min(brand, ord) AS brand FROM h GROUP BY 1"""


def assembled_evidence(spark, sf):
    tc = c.templates(spark).withColumn("brands", F.split(F.lit("Brand#1|Steel|" + "|".join(n for n in ("bolt", "widget", "gear"))), r"\|"))
    return assemble.assemble_evidence(product_pages(spark, sf), tc).select(
        "record_id", "source_uri", "field", "value", "method", F.round("confidence", 4).alias("confidence"))


ASSEMBLED = f"""WITH {c.TEMPLATE_CTE}, {_PAGE_CTE}, {_SPEC_CTE},
kept AS (SELECT * FROM pg WHERE p_partkey % 4 <> 3 OR p_partkey % 3 <> 1 OR p_partkey % 6 = 0),
body AS (SELECT *, coalesce(j_name, m_name) AS n_, coalesce(j_description, m_description) AS d_ FROM kept),
{classify_cte("SELECT page_id AS doc_id, n_ || CASE WHEN d_ IS NULL THEN '' ELSE ' ' || d_ END AS text FROM body", "SELECT template_id, path, naming_convention AS naming FROM templates")},
ok AS (SELECT * FROM suggestion WHERE score >= 0.03 AND path <> ''),
brands AS (SELECT k.page_id, b.brand, b.ord FROM body k JOIN ok s ON s.doc_id = k.page_id JOIN templates t ON t.path = s.path,
  (VALUES ('Brand#1', 0), ('Steel', 1), ('bolt', 2), ('widget', 3), ('gear', 4)) AS b(brand, ord)
  WHERE k.j_brand IS NULL AND regexp_matches(n_ || ' ' || coalesce(d_, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || b.brand || '([^\\p{{L}}\\p{{N}}_]|$)')),
rows_ AS (
  {' UNION ALL '.join(f"SELECT page_id, '{f}' AS field, j_{f} AS value, 0.9 AS confidence FROM kept WHERE j_{f} IS NOT NULL" for f in pages.PRODUCT_FIELDS)}
  UNION ALL SELECT s.page_id, field, value, confidence FROM spec s JOIN kept USING (page_id)
  UNION ALL SELECT page_id, 'name', m_name, 0.6 FROM kept WHERE j_name IS NULL
  UNION ALL SELECT page_id, 'description', m_description, 0.6 FROM kept WHERE j_description IS NULL AND m_description IS NOT NULL
  UNION ALL SELECT doc_id, 'suggested_category', path, score FROM ok
  UNION ALL SELECT page_id, 'Brand', arg_min(brand, ord), 0.7 FROM brands GROUP BY 1)
SELECT coalesce(k.j_sku, 'p-' || k.p_partkey || '.html') AS record_id, k.url AS source_uri, r.field, r.value, 'scrape' AS method, round(r.confidence, 4) AS confidence
FROM rows_ r JOIN kept k USING (page_id)"""

# ---------------------------------------------------------------- the given pages


def _pages(spark, sf):
    return c.read(spark, sf, "pages")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def page_links_same_host(spark, sf):
    return pages.same_host_links(_pages(spark, sf))


PAGE_LINKS = rf"""
WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages),
e AS (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS n FROM h),
r AS (SELECT page_id, n, url AS base, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(href, '&amp;', '&') AS u FROM e WHERE href LIKE '/%'),
d AS (SELECT page_id, regexp_replace(u, '#.*$', '') AS url, min(n) AS n FROM r WHERE regexp_replace(u, '#.*$', '') <> regexp_replace(base, '#.*$', '') GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS seq, url FROM d"""


def page_metadata(spark, sf):
    m = pages.page_metadata(_pages(spark, sf))
    return m.select("page_id", F.size("meta").alias("n"), *[F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit("")).alias(k) for k in ("title", "h1")])


def _plain(x: str) -> str:
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{ch}')"
    return f"trim({x})"


PAGE_METADATA = rf"""
SELECT page_id, CAST((CASE WHEN t <> '' THEN 1 ELSE 0 END) + (CASE WHEN h <> '' THEN 1 ELSE 0 END) AS INTEGER) AS n, t AS title, h AS h1 FROM (
SELECT page_id, {_plain(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS t, {_plain(r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h FROM pages)"""

_AGENT = "loombot/1.0"
_ROBOTS = {
    0: "User-agent: *\\nDisallow: /en/\\nAllow: /en/6\\nCrawl-delay: 5",
    1: "User-agent: otherbot\\nDisallow: /\\n\\nUser-agent: *\\nDisallow:",
    2: "# note\\nUser-Agent: LOOMBOT\\nUser-agent: x\\nAllow: /fr/\\nDisallow: /  # rest\\n\\nDisallow: /never\\nUser-agent: *\\nDisallow: /fr\\nSitemap: https://example.com/map.xml",
}


def _robots(spark, sf):
    from claimloom.functions import urls

    hosts = _pages(spark, sf).select(urls.host(F.col("url")).alias("host")).distinct().filter("length(host) % 4 <> 3")
    txt = F.when(F.length("host") % 4 == 0, _ROBOTS[0].replace("\\n", "\n")).when(F.length("host") % 4 == 1, _ROBOTS[1].replace("\\n", "\n")).otherwise(_ROBOTS[2].replace("\\n", "\r\n"))
    return hosts.select("host", txt.alias("txt"))


def robots_filter(spark, sf):
    p = _pages(spark, sf).select("page_id", "url")
    return capture.robots_allowed(p, _robots(spark, sf), _AGENT).select("page_id", F.col("allowed").cast("int").alias("allowed"))


ROBOTS_FILTER = rf"""
SELECT page_id, CAST(CASE length({_HOST}) % 4 WHEN 0 THEN NOT starts_with(p, '/en/') WHEN 1 THEN true WHEN 2 THEN starts_with(p, '/fr/') ELSE true END AS INTEGER) AS allowed
FROM (SELECT *, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS p FROM pages)"""


def robots_sitemaps(spark, sf):
    return capture.robots_sitemaps(_robots(spark, sf)).select("host", "url")


ROBOTS_SITEMAPS = f"SELECT DISTINCT {_HOST} AS host, 'https://example.com/map.xml' AS url FROM pages WHERE length({_HOST}) % 4 = 2"


def _nested_sitemaps(spark, sf):
    """One sitemap per order, its location up to 15 elements deep; some are cut short, some close tags in the wrong order."""
    o, n = c.spread(spark, c.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey"), F.col("o_orderkey") % 12
    deep = F.concat(F.repeat(F.lit("<x:e a='1'>"), n.cast("int")), F.lit("<loc>http://s.example.com/"), "o_orderkey", F.lit("</loc>"),
                    F.when(F.col("o_orderkey") % 10 == 3, "</x:f>").otherwise(F.repeat(F.lit("</x:e>"), n.cast("int"))))
    xml = F.concat(F.lit("<?xml version='1.0'?><urlset><url>"), deep, F.lit("</url>"), F.when(F.col("o_orderkey") % 10 == 4, "").otherwise("</urlset>"))
    return o.select(F.col("o_orderkey").cast("string").alias("url"), xml.alias("xml"))


def sitemap_dead_letters(spark, sf):
    """Every sitemap is read once: it is broken, or it lists something."""
    read = sitemaps.read_sitemaps(_nested_sitemaps(spark, sf)).filter("NOT sound OR size(locs) > 0")
    return read.select("url", F.when(F.col("sound"), F.array_join("locs", "|")).otherwise("broken").alias("said"))


SITEMAP_DEAD_LETTERS = """SELECT CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_orderkey % 10 IN (3, 4) THEN 'broken' ELSE 'http://s.example.com/' || o_orderkey END AS said FROM orders"""


def sitemap_urls(spark, sf):
    from claimloom.functions import urls

    p = _pages(spark, sf).select("page_id", "url", urls.host(F.col("url")).alias("site"))
    doc = F.concat(F.lit("https://"), "site", F.lit("/sm-"), F.col("page_id").cast("string"), F.lit(".xml"))
    root = F.concat(F.lit("https://"), "site", F.lit("/index-"), F.col("page_id").cast("string"), F.lit(".xml"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    locs = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url><url><loc>https://example.com/all</loc></url>"))
    leaf = F.concat(F.lit(head + '<urlset xmlns="http://x">'), locs, F.when(F.col("page_id") % 13 == 0, "").otherwise("</urlset>"))
    index = F.concat(F.lit(head + '<s:sitemapindex xmlns:s="http://x"><s:sitemap><s:loc>'), doc, F.lit("</s:loc></s:sitemap></s:sitemapindex>"))
    maps = p.select(doc.alias("url"), leaf.alias("xml")).union(p.filter("page_id % 2 = 1").select(root, index))
    entry = p.select("site", F.col("page_id").alias("ord"), F.when(F.col("page_id") % 2 == 1, root).otherwise(doc).alias("url"))
    return sitemaps.sitemap_urls(entry, maps).select("site", "url", F.col("first_seen.ord").alias("ord"))


SITEMAP_URLS = f"""
WITH l AS (SELECT {_HOST} AS site, page_id, url FROM pages WHERE page_id % 13 <> 0
  UNION ALL SELECT {_HOST}, page_id, 'https://example.com/all' FROM pages WHERE page_id % 13 <> 0)
SELECT site, url, min(page_id) AS ord FROM l GROUP BY 1, 2"""


def job_candidates(spark, sf):
    p = _pages(spark, sf)
    probes = p.select(F.col("page_id").alias("job"), "url", (F.length("html") % 5 == 0).alias("has_evidence"))
    links = pages.same_host_links(p).select(F.col("page_id").alias("job"), "seq", "url")
    return capture.job_candidates(probes, links, 4)


JOB_CANDIDATES = f"""
{PAGE_LINKS.rsplit('SELECT page_id, CAST', 1)[0]}, k AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS seq, url FROM d)
SELECT page_id AS job, CAST(0 AS BIGINT) AS ord, url FROM pages WHERE length(html) % 5 = 0
UNION ALL SELECT k.page_id, k.seq, k.url FROM k JOIN pages p USING (page_id) WHERE length(p.html) % 5 <> 0 AND k.seq < 4"""


def capture_plan(spark, sf):
    """Jobs of up to 100 pages each: robots first, then what each page holds, until 20 are captured."""
    p = _pages(spark, sf)
    cand = capture.robots_allowed(
        p.select(F.floor(F.col("page_id") / 100).alias("job"), F.col("page_id").alias("ord"), "url"), _robots(spark, sf), _AGENT)
    probe = p.select(
        "page_id", "url", (F.col("page_id") % 11 != 0).alias("fetched"), (F.length("html") % 4 != 0).alias("has_fields"),
        (F.length("html") % 9).alias("n_rows"), F.concat(F.lit("R"), F.col("page_id").cast("string")).alias("record_id"))
    # Several given pages may share a URL; a fetch returns one page per URL.
    one = probe.groupBy("url").agg(F.min_by(F.struct("fetched", "has_fields", "n_rows", "record_id"), "page_id").alias("f")).select("url", "f.*")
    return capture.capture_plan(cand, one, 20).select("job", "ord", "url", "status", *_blank("reason", "record_id"))


CAPTURE_PLAN = rf"""
WITH one AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
a AS ({ROBOTS_FILTER}),
s AS (SELECT CAST(floor(p.page_id / 100) AS BIGINT) AS job, p.page_id AS ord, p.url, 'R' || o.page_id AS record_id,
  CASE WHEN a.allowed = 0 THEN 'blocked' WHEN o.page_id % 11 = 0 OR length(o.html) % 4 = 0 OR length(o.html) % 9 = 0 THEN 'skipped' ELSE 'captured' END AS status,
  CASE WHEN a.allowed = 0 THEN 'disallowed by robots.txt' WHEN o.page_id % 11 = 0 THEN 'page could not be fetched'
    WHEN length(o.html) % 4 = 0 THEN 'no usable evidence on page' WHEN length(o.html) % 9 = 0 THEN 'no evidence rows assembled' ELSE '' END AS reason
  FROM pages p JOIN a USING (page_id) JOIN one o ON o.url = p.url),
w AS (SELECT *, coalesce(sum(CAST(status = 'captured' AS INTEGER)) OVER (PARTITION BY job ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM s)
SELECT job, ord, url, CASE WHEN taken >= 20 THEN 'limit_reached' ELSE status END AS status, CASE WHEN taken >= 20 THEN 'the job''s limit of captured pages was reached' ELSE reason END AS reason,
  CASE WHEN status = 'captured' AND taken < 20 THEN record_id ELSE '' END AS record_id FROM w"""


def links_not_followed(spark, sf):
    p = _pages(spark, sf)
    probes = p.select(F.col("page_id").alias("job"), "url", (F.length("html") % 5 == 0).alias("has_evidence"))
    links = pages.same_host_links(p).select(F.col("page_id").alias("job"), "seq", "url")
    return capture.links_not_followed(probes, links, 4)


NOT_FOLLOWED = f"""
{PAGE_LINKS.rsplit('SELECT page_id, CAST', 1)[0]}, k AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS seq, url FROM d)
SELECT k.page_id AS job, k.seq AS ord, k.url, 'not_followed' AS status FROM k JOIN pages p USING (page_id) WHERE length(p.html) % 5 <> 0 AND k.seq >= 4"""


# ---------------------------------------------------------------- documents


def doc_pages(spark, sf):
    d = F.col("doc_id")
    text = (
        F.when(d % 11 == 0, F.concat(F.lit("(cid:12)"), F.col("text"))).when(d % 13 == 0, F.concat(F.repeat(F.lit("�"), 40), F.col("text")))
        .when(d % 17 == 0, F.lit(" \n ")).when(d % 19 == 0, F.lit("... --- ... ab")).otherwise(F.col("text")))
    return c.read(spark, sf, "documents").select(
        F.concat("source", F.lit(".pdf")).alias("file"), d.alias("page"), text.alias("text"), (d % 2 == 0).alias("fonts_missing"))


_DOC_CTE = r"""
dp AS (SELECT source || '.pdf' AS file, doc_id AS page, doc_id % 2 = 0 AS fonts_missing, CASE WHEN doc_id % 11 = 0 THEN '(cid:12)' || text
  WHEN doc_id % 13 = 0 THEN repeat('�', 40) || text WHEN doc_id % 17 = 0 THEN chr(32) || chr(10) || ' ' WHEN doc_id % 19 = 0 THEN '... --- ... ab' ELSE text END AS text FROM documents),
ds AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM dp),
dg AS (SELECT *, (regexp_matches(text, '\(cid:[0-9]+\)') OR (length(text) > 0 AND (length(text) - length(replace(text, '�', ''))) / length(text) > 0.02)
  OR (fonts_missing AND (body = '' OR length(regexp_replace(body, '[^\p{L}\p{N}]', '', 'g')) / length(body) < 0.2))) AS garbled FROM ds)"""


def garbled_flag(spark, sf):
    return doc_pages(spark, sf).select(
        "file", "page", documents.garbled_flag(F.col("text"), F.col("fonts_missing")).cast("int").alias("garbled"))


GARBLED = f"WITH {_DOC_CTE} SELECT file, page, CAST(garbled AS INTEGER) AS garbled FROM dg"


def ocr_pages(spark, sf):
    return documents.ocr_pages(doc_pages(spark, sf))


OCR_PAGES = f"WITH {_DOC_CTE} SELECT file, page FROM dg WHERE garbled"


def _images(spark, sf):
    d = F.col("doc_id")
    return c.read(spark, sf, "documents").select(
        F.concat("source", F.lit(".pdf")).alias("file"), d.alias("page"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"), "doc_id"
    ).select("file", "page", "ord", ((d + F.col("ord")) % 3).alias("xref"), F.lit("png").alias("ext"),
             (40 + (d * 7 + F.col("ord") * 13) % 60).alias("width"), (50 + (d * 3 + F.col("ord") * 29) % 80).alias("height"))


_IMAGE_CTE = """
im AS (SELECT source || '.pdf' AS file, doc_id AS page, o AS ord, (doc_id + o) % 3 AS xref, 40 + (doc_id * 7 + o * 13) % 60 AS width, 50 + (doc_id * 3 + o * 29) % 80 AS height
  FROM documents, (SELECT unnest(range(0, 5)) AS o)),
io AS (SELECT * FROM im QUALIFY row_number() OVER (PARTITION BY file, page, xref ORDER BY ord) = 1),
iu AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, page ORDER BY ord) - 1 AS INTEGER) AS idx FROM io WHERE width >= 64 AND height >= 64)"""


def image_filter(spark, sf):
    return documents.usable_images(_images(spark, sf)).withColumnRenamed("index", "idx").select("file", "page", "idx", "xref", "width", "height")


IMAGE_FILTER = f"WITH {_IMAGE_CTE} SELECT file, page, idx, xref, width, height FROM iu"


def doc_text_evidence(spark, sf):
    return documents.doc_evidence(doc_pages(spark, sf), documents.usable_images(_images(spark, sf))).select(
        "record_id", "seq", "field", "value", "source_uri", "method", "confidence")


DOC_EVIDENCE = f"""WITH {_DOC_CTE}, {_IMAGE_CTE}
SELECT replace(file, '.pdf', '') || '-p' || page AS record_id, CAST(0 AS BIGINT) AS seq, 'text' AS field, body AS value, 'pdf://' || file || '#page=' || page AS source_uri,
  'pdf' AS method, 0.9 AS confidence FROM dg WHERE NOT garbled AND body <> ''
UNION ALL SELECT replace(file, '.pdf', '') || '-p' || page, CAST(idx + 1 AS BIGINT), 'image_' || idx, 'media/' || replace(file, '.pdf', '') || '_p' || page || '_img' || idx || '.png',
  'pdf://' || file || '#page=' || page, 'pdf', 0.9 FROM iu"""

# ---------------------------------------------------------------- streaming


def _staged(spark, sf):
    """Evidence staged as a stream of several files and batches, started twice: the folder of what is staged.

    The two rows of a part's first capture come in different files; every third part is captured again, in two files.
    """
    root = scratch_path(spark, "staged")
    part = c.read(spark, sf, "part").select(F.col("p_brand").alias("job"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"),
                                            "p_name", "p_type", (F.col("p_partkey") % 3 == 0).alias("again"))
    row = lambda n, field, value: part.select("job", "record_id", F.lit(n).cast("bigint").alias("capture"), F.lit(0 if field == "name" else 1).cast("bigint").alias("seq"), F.lit(field).alias("field"), F.expr(value).alias("value"), "again")
    files = [row(1, "name", "p_name"), row(1, "finish", "p_type"), row(2, "name", "concat(p_name, ' new')").filter("again"), row(2, "color", "'red'").filter("again")]
    for one in files:
        one.drop("again").coalesce(1).write.mode("append").parquet(f"{root}/source")
    rows = spark.readStream.schema(files[0].drop("again").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
    for _ in range(2):
        staging.stage_stream(rows, f"{root}/data", f"{root}/checkpoint").awaitTermination()
    return root


def staged_capture(spark, sf):
    return staging.finalize(spark, f"{_staged(spark, sf)}/data")


STAGED = """WITH r AS (SELECT p_brand AS job, 'P' || p_partkey AS record_id, p_partkey % 3 = 0 AS again, p_name, p_type FROM part)
SELECT job, record_id, CASE WHEN again THEN 2 ELSE 1 END::BIGINT AS capture, 0::BIGINT AS seq, 'name' AS field, p_name || CASE WHEN again THEN ' new' ELSE '' END AS value FROM r
UNION ALL SELECT job, record_id, 1, 1, 'finish', p_type FROM r WHERE NOT again UNION ALL SELECT job, record_id, 2, 1, 'color', 'red' FROM r WHERE again"""

def final_pack(spark, sf):
    """Manifests of the packs that two finalisings of the same staged rows give, in parts of 40 rows."""
    root = _staged(spark, sf)
    runs = [staging.finalize_pack(spark, f"{root}/data", part_rows=40).manifest for _ in range(2)]
    return runs[0].unionByName(runs[1]).groupBy("pack", "path", "sha256").agg(F.count("*").alias("runs"))


FINAL_PACK = """WITH r AS (SELECT p_brand AS job, 'P' || p_partkey AS record_id, p_partkey % 3 = 0 AS again, p_name, p_type FROM part),
l AS (SELECT job, record_id, 0 AS seq, 'name' AS field, p_name || CASE WHEN again THEN ' new' ELSE '' END AS value FROM r
  UNION ALL SELECT job, record_id, 1, 'finish', p_type FROM r WHERE NOT again UNION ALL SELECT job, record_id, 1, 'color', 'red' FROM r WHERE again),
n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY record_id, seq) - 1 AS n, '{"record_id":' || to_json(record_id) || ',"seq":' || seq || ',"field":' || to_json(field) || ',"value":' || to_json(value) || '}' AS line FROM l),
p AS (SELECT job AS pack, CASE WHEN n // 40 = 0 THEN 'evidence.jsonl' ELSE 'evidence-' || lpad(CAST(n // 40 AS VARCHAR), 5, '0') || '.jsonl' END AS path, string_agg(line, chr(10) ORDER BY n) || chr(10) AS content FROM n GROUP BY job, n // 40
  UNION ALL SELECT job, 'datapackage.json', '{"version":"1.0","producer":{"program":"staging"},"product_count":' || count(*) || ',"media_count":0,"provenance_policy":"no-evidence-no-value"}' FROM r GROUP BY job)
SELECT pack, path, sha256(content) AS sha256, 2::BIGINT AS runs FROM p"""

QUERIES = {
    "page_jsonld": (page_jsonld, PAGE_JSONLD), "page_jsonld_deep": (page_jsonld_deep, PAGE_JSONLD_DEEP), "page_extract": (page_extract, PAGE_EXTRACT), "sitemap_dead_letters": (sitemap_dead_letters, SITEMAP_DEAD_LETTERS), "page_spec_pairs": (page_spec_pairs, PAGE_SPEC), "spec_evidence": (spec_evidence, SPEC_EVIDENCE),
    "product_metadata": (product_metadata, PRODUCT_METADATA), "metadata_evidence": (metadata_evidence, METADATA_EVIDENCE),
    "page_media": (page_media, PAGE_MEDIA), "gallery_images": (gallery_images, GALLERY), "product_image": (product_image, PRODUCT_IMAGE),
    "product_links": (product_links, PRODUCT_LINKS), "classify_rank": (classify_rank, CLASSIFY_RANK), "classify_family_prefix": (classify_top, CLASSIFY_TOP),
    "suggested_category": (suggested_category, SUGGESTED), "brand_in_text": (brand_in_text, BRAND), "assembled_evidence": (assembled_evidence, ASSEMBLED),
    "page_links_same_host": (page_links_same_host, PAGE_LINKS), "page_metadata": (page_metadata, PAGE_METADATA),
    "robots_filter": (robots_filter, ROBOTS_FILTER), "robots_sitemaps": (robots_sitemaps, ROBOTS_SITEMAPS), "sitemap_urls": (sitemap_urls, SITEMAP_URLS),
    "job_candidates": (job_candidates, JOB_CANDIDATES), "capture_plan": (capture_plan, CAPTURE_PLAN), "links_not_followed": (links_not_followed, NOT_FOLLOWED),
    "garbled_flag": (garbled_flag, GARBLED), "ocr_pages": (ocr_pages, OCR_PAGES), "image_filter": (image_filter, IMAGE_FILTER),
    "doc_text_evidence": (doc_text_evidence, DOC_EVIDENCE), "staged_capture": (staged_capture, STAGED), "final_pack": (final_pack, FINAL_PACK),
}
