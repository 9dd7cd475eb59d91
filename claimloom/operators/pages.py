"""Everything read from one HTML page.  Each function is a projection: no page ever leaves its row, nothing shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as m
from ..functions import urls
from ..functions.binding import let
from ..functions.text import blank_to_null, strip
from ..session import cut_lineage
from .image_walk import walk_images

PRODUCT_FIELDS = ("name", "sku", "image", "description", "brand", "price")
# Summary tags read, least size of a gallery image.
METADATA_KEYS = ("og:title", "og:description", "og:image", "twitter:image", "meta_description", "title", "h1")
MIN_GALLERY_PX = 100
MAX_JSON_DEPTH = 8


# ---------------------------------------------------------------- product markup (JSON-LD)

def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _string(v: Column, path: str) -> Column:
    """Trimmed text at the path, only if it is a JSON string."""
    return let(_get(v, path, "variant"), lambda inner: F.when(_is_text(inner), blank_to_null(inner.cast("string"))))


def _scalar(v: Column, path: str) -> Column:
    """Trimmed text of a JSON string, number or boolean; a fractional literal keeps its point (``10.0``)."""
    def read(b: Column) -> Column:
        kind, text = b["kind"], b["text"]
        fractional = kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT)") & ~F.contains(text, F.lit("."))
        return F.when(kind == "BOOLEAN", F.initcap(text)).when(fractional, F.concat(text, F.lit(".0"))).otherwise(text)

    parts = lambda inner: F.struct(F.schema_of_variant(inner).alias("kind"), inner.cast("string").alias("text"))
    return blank_to_null(let(let(_get(v, path, "variant"), parts), read))


def product_text(v: Column, key: str) -> Column:
    """Name, SKU or description of a product node; a SKU may be a number."""
    return _scalar(v, "$.sku") if key == "sku" else _string(v, f"$.{key}")


def _first(v: Column, key: str) -> Column:
    """The value under a key, or its first item when it is a list."""
    return F.coalesce(_get(v, f"$.{key}[0]", "variant"), _get(v, f"$.{key}", "variant"))


def product_image(v: Column) -> Column:
    def read(image: Column) -> Column:
        url, content = _get(image, "$.url", "variant"), _get(image, "$.contentUrl", "variant")
        chosen = let(url, lambda known: F.when(F.coalesce(known.cast("string"), F.lit("")) != "", known).otherwise(content))
        nested = let(chosen, lambda known: F.when(_is_text(known), F.nullif(known.cast("string"), F.lit(""))))
        return F.when(_is_text(image), blank_to_null(image.cast("string"))).otherwise(nested)

    return let(_first(v, "image"), read)


def product_brand(v: Column) -> Column:
    return let(
        _first(v, "brand"),
        lambda b: F.when(_is_text(b), blank_to_null(b.cast("string"))).otherwise(_string(b, "$.name")),
    )


def product_price(v: Column) -> Column:
    def read(offer: Column) -> Column:
        missing = let(_get(offer, "$.price", "variant"), lambda direct: direct.isNull() | (F.schema_of_variant(direct) == "VOID"))
        return F.when(missing, _scalar(offer, "$.priceSpecification.price")).otherwise(_scalar(offer, "$.price"))

    return let(_first(v, "offers"), read)


def _is_product(v: Column) -> Column:
    named = lambda n: F.substring_index(n, "/", -1) == "Product"
    several = lambda kind: F.exists(_get(kind, "$", "array<string>"), named)
    found = let(
        _get(v, '$["@type"]', "variant"),
        lambda kind: F.when(kind.isNull(), False).when(_is_text(kind), named(kind.cast("string"))).otherwise(several(kind)),
    )
    return F.coalesce(found, F.lit(False))


def _nodes(v: Column, depth: int) -> Column:
    """Product nodes below ``v`` in document order; lists and ``@graph`` are walked, a graph before its owner."""
    empty = F.array().cast("array<variant>")

    def walk(b: Column) -> Column:
        own = F.when(b["listed"].isNull() & _is_product(v), F.array(v)).otherwise(empty)
        if depth == 0:
            return own
        below = F.coalesce(b["listed"], F.when(b["graph"].isNotNull(), F.array(b["graph"])))
        return F.when(below.isNull(), own).otherwise(F.concat(F.flatten(F.transform(below, lambda k: _nodes(k, depth - 1))), own))

    return let(F.struct(_get(v, "$", "array<variant>").alias("listed"), _get(v, '$["@graph"]', "variant").alias("graph")), walk)


def _deeper(v: Column, depth: int) -> Column:
    """Does ``v`` nest lists or graphs below ``depth`` levels?"""
    listed = _get(v, "$", "array<variant>")
    graph = _get(v, '$["@graph"]', "variant")
    below = F.coalesce(listed, F.when(graph.isNotNull(), F.array(graph)))
    return below.isNotNull() if depth == 0 else F.coalesce(F.exists(below, lambda k: _deeper(k, depth - 1)), F.lit(False))


def _may_state_product(text: Column) -> Column:
    """False for JSON without the word that makes a node a product, not even written with escapes."""
    return F.contains(text, F.lit("Product")) | F.contains(text, F.lit("\\"))


def _parsed_markup(html: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Product markup of a page that parses, of the ``wanted`` texts only: broken JSON costs an exception."""
    kind = rf"""(?is)^<script(?=[\s/>])[^>]*?\btype\s*=\s*["']?application/ld\+json["'\s/>]"""
    inner = rf"(?is)^<script{m.ATTRS}>(.*?)</script\s*>$"
    texts = F.transform(F.filter(m.scripts(html), lambda s: s.rlike(kind)), lambda s: F.regexp_extract(s, inner, 1))
    texts = texts if wanted is None else F.filter(texts, wanted)
    return F.filter(F.transform(texts, F.try_parse_json), lambda v: v.isNotNull())


def _product(v: Column) -> Column:
    return F.struct(
        product_text(v, "name").alias("name"), product_text(v, "sku").alias("sku"), product_image(v).alias("image"),
        product_text(v, "description").alias("description"), product_brand(v).alias("brand"),
        product_price(v).alias("price"),
    )


def _states_something(p: Column) -> Column:
    return F.coalesce(*[p[k] for k in PRODUCT_FIELDS]).isNotNull()


def _first_product(parsed: Column, max_depth: int) -> Column:
    nodes = F.flatten(F.transform(parsed, lambda v: _nodes(v, max_depth)))
    return F.get(F.filter(F.transform(nodes, _product), _states_something), F.lit(0))


def product_struct(html: Column, max_depth: int = MAX_JSON_DEPTH) -> Column:
    """Fields of the first product node of a page, ``max_depth`` lists or graphs deep; null when it has none."""
    return F.when(F.contains(html, F.lit("ld+json")), _first_product(_parsed_markup(html, _may_state_product), max_depth))


def _cut_nodes(v: Column, key: Column, depth: int) -> Column:
    """Array of (key, v, goes_on) below ``v``: product nodes, and at ``depth`` levels what is still to be opened.

    Keys sort in document order, a graph before its owner.
    """
    listed = _get(v, "$", "array<variant>")
    graph = _get(v, '$["@graph"]', "variant")
    below = F.coalesce(listed, F.when(graph.isNotNull(), F.array(graph)))
    node = lambda suffix, goes_on: F.struct(F.concat(key, F.lit(suffix)).alias("key"), v.alias("v"), F.lit(goes_on).alias("goes_on"))
    none = F.filter(F.array(node("", False)), lambda _: F.lit(False))
    own = F.when(listed.isNull() & _is_product(v), F.array(node("~", False))).otherwise(none)
    if depth == 0:
        return F.when(below.isNotNull(), F.array(node("", True))).otherwise(own)
    kids = F.flatten(F.transform(below, lambda k, i: _cut_nodes(k, F.concat(key, F.lit("."), F.lpad(F.hex(i), 8, "0")), depth - 1)))
    return F.concat(F.coalesce(kids, none), own)


def _deep_products(markup: DataFrame, step: int) -> DataFrame:
    """(page_id, p) of the first product of pages with (page_id, parsed): ``step`` levels a round until nothing is left to open."""
    unopened = markup.select("page_id", F.posexplode("parsed").alias("n", "v")).select("page_id", F.lpad(F.hex("n"), 8, "0").alias("key"), "v")
    found = None
    while True:
        rows = cut_lineage(unopened.select("page_id", F.inline(_cut_nodes(F.col("v"), F.col("key"), step))))
        here = rows.filter("NOT goes_on").select("page_id", "key", _product(F.col("v")).alias("p")).filter(_states_something(F.col("p")))
        found = here if found is None else found.unionByName(here)
        unopened = rows.filter("goes_on").select("page_id", "key", "v")
        if unopened.isEmpty():
            return found.groupBy("page_id").agg(F.min_by("p", "key").alias("p"))


def jsonld_products(pages: DataFrame, max_depth: int = MAX_JSON_DEPTH) -> DataFrame:
    """(page_id, name, sku, image, description, brand, price) of the first product node that states any of them.

    Lists and graphs are walked in the row, ``max_depth`` levels down.  The markup of pages that nest deeper is opened
    by as many levels a round, until no node is left: any depth that parses is read.  Every page is read once.
    """
    def read(parsed: Column) -> Column:
        deep = F.exists(parsed, lambda v: _deeper(v, max_depth))
        return F.struct(F.when(~deep, _first_product(parsed, max_depth)).alias("p"), F.when(deep, parsed).alias("parsed"))

    seen = cut_lineage(pages.filter(F.contains("html", F.lit("ld+json"))).select("page_id", let(_parsed_markup(F.col("html"), _may_state_product), read).alias("b")).select("page_id", "b.*"))
    shallow, deep = seen.filter("p IS NOT NULL").select("page_id", "p"), seen.filter("parsed IS NOT NULL").select("page_id", "parsed")
    both = shallow if deep.isEmpty() else shallow.unionByName(_deep_products(deep, max_depth))
    return both.select("page_id", "p.*")


def jsonld_dead_letters(pages: DataFrame, max_depth: int = MAX_JSON_DEPTH) -> DataFrame:
    """(page_id, reason) of pages that :func:`product_struct`, which stays in the row, does not read to their full depth."""
    deep = F.exists(_parsed_markup(F.col("html")), lambda v: _deeper(v, max_depth))
    return pages.filter(F.contains("html", F.lit("ld+json"))).filter(deep).select(
        "page_id", F.lit(f"product markup is nested deeper than {max_depth} levels").alias("reason"))


# ---------------------------------------------------------------- page metadata

def page_summary(html: Column, url: Column) -> Column:
    """The summary tags of a page as a struct, one field per tag."""
    def read(b: Column) -> Column:
        found = b["tags"]

        def content(attr: str, key: str) -> Column:
            return blank_to_null(F.get(F.filter(found, lambda tag: tag[attr] == key), F.lit(0))["content"])

        def image(attr: str, key: str) -> Column:
            return let(content(attr, key), lambda v: F.when(v.isNotNull(), urls.resolve(b["base"], v)))

        return F.struct(
            content("property", "og:title").alias("og:title"),
            content("property", "og:description").alias("og:description"),
            image("property", "og:image").alias("og:image"),
            image("name", "twitter:image").alias("twitter:image"),
            content("name", "description").alias("meta_description"),
            m.first_text(b["source"], "title").alias("title"),
            m.first_text(b["source"], "h1").alias("h1"),
        )

    def tag_parts(tag: Column) -> Column:
        return F.struct(
            m.attribute(tag, "property").alias("property"), m.attribute(tag, "name").alias("name"),
            m.attribute(tag, "content").alias("content"),
        )

    parts = let(
        m.visible(html),
        lambda source: F.struct(
            source.alias("source"), F.transform(m.tags(source, "meta"), tag_parts).alias("tags"),
            urls.url_base(url).alias("base"),
        ),
    )
    return let(parts, read)


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, meta): the page's summary tags as a map; a missing tag is missing from the map."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(k) for k in METADATA_KEYS]), F.array(*[F.col(f"s.`{k}`") for k in METADATA_KEYS])
    )
    return pages.select("page_id", page_summary(F.col("html"), F.col("url")).alias("s")).select(
        "page_id", F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("meta")
    )


def best_metadata(s: Column) -> Column:
    """Struct (name, description, image) chosen from a metadata struct or map by trust in each tag."""
    def choose(known: Column) -> Column:
        pick = lambda *keys: F.coalesce(*[known[k] for k in keys])
        return F.struct(
            pick("og:title", "h1", "title").alias("name"),
            pick("og:description", "meta_description").alias("description"),
            pick("og:image", "twitter:image").alias("image"),
        )

    # Bound: a summary that is still an expression would be read again for every tag that is asked for.
    return let(s, choose)


def metadata_fields(meta: DataFrame) -> DataFrame:
    """(page_id, name, description, image) from :func:`page_metadata`."""
    pick = lambda *keys: F.coalesce(*[F.try_element_at("meta", F.lit(k)) for k in keys])
    return meta.select(
        "page_id", pick("og:title", "h1", "title").alias("name"),
        pick("og:description", "meta_description").alias("description"), pick("og:image", "twitter:image").alias("image"),
    )


# ---------------------------------------------------------------- specification pairs

def spec_pair_array(html: Column) -> Column:
    """Specification pairs of a page as an array of (key, value)."""
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    none = F.array().cast("array<struct<key:string,value:string>>")

    def row(body: Column) -> Column:
        return let(
            m.blocks(body, "t[hd]", "t[hd]|tr"),
            lambda cells: F.when(F.size(cells) == 2, pair(m.inner_text(cells[0]), m.inner_text(cells[1]))),
        )

    def item(s: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(s, r"(?i)^<(d[td])[\s>/]", 1)).alias("tag"),
            m.inner_text(F.regexp_extract(s, rf"(?is)^{m.ATTRS}>(.*?)(?:</d[tdl]\b|\z)", 1)).alias("text"),
        )

    def definitions(body: Column) -> Column:
        items = F.filter(F.transform(F.split(body, r"(?i)(?=<d[td][\s>/])", -1), item), lambda x: x["tag"] != "")

        def values(known: Column) -> Column:
            def value(x: Column, i: Column) -> Column:
                terms = F.filter(F.slice(known, F.lit(1), i), lambda y: y["tag"] == "dt")
                return F.when(x["tag"] == "dd", pair(F.try_element_at(terms, F.lit(-1))["text"], x["text"]))

            return F.transform(known, value)

        return let(items, values)

    def read(source: Column) -> Column:
        tables = F.when(source.rlike("(?i)<table[\\s>]"), F.transform(m.blocks(source, "tr", "tr|table"), row))
        lists = F.when(
            source.rlike("(?i)<dl[\\s>]"), F.flatten(F.transform(m.blocks(source, "dl", "dl"), definitions))
        )
        both = F.concat(F.coalesce(tables, none), F.coalesce(lists, none))
        return F.filter(both, lambda p: (p["key"] != "") & (p["value"] != ""))

    # Pages without a table or a list are passed over before any markup is taken apart.
    return F.when(html.rlike("(?i)<(?:table|dl)[\\s>]"), let(m.visible(html), read)).otherwise(none)


def spec_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, seq, key, value) of two-cell table rows, then of definition lists."""
    return pages.select("page_id", F.posexplode(spec_pair_array(F.col("html"))).alias("seq", "p")).select(
        "page_id", F.col("seq").cast("bigint").alias("seq"), "p.key", "p.value"
    )


# ---------------------------------------------------------------- links and media

def link_array(html: Column, url: Column) -> Column:
    """Same-host links of a page as an array."""
    hrefs = F.transform(m.tags(m.visible(html), "a"), lambda tag: m.attribute(tag, "href"))

    def targets(base: Column) -> Column:
        seen = F.transform(
            F.filter(hrefs, lambda h: ~urls.skipped_link(h)), lambda h: urls.without_fragment(urls.resolve(base, h))
        )
        return F.array_distinct(
            F.filter(seen, lambda u: (urls.host(u) == base["host"]) & (u != base["page"]))
        )

    return let(urls.url_base(url), targets)


def same_host_links(pages: DataFrame) -> DataFrame:
    """(page_id, seq, url) of links to other pages of the same host, each once, in order of first appearance."""
    return pages.select("page_id", F.posexplode(link_array(F.col("html"), F.col("url"))).alias("seq", "url")).select(
        "page_id", F.col("seq").cast("bigint").alias("seq"), "url"
    )


def media_array(html: Column, url: Column) -> Column:
    """Media references of a page as an array of (url, media_type)."""
    none = F.array().cast("array<struct<url:string,media_type:string>>")
    present = lambda u: F.coalesce(u, F.lit("")) != ""

    def video_sources(block: Column) -> Column:
        own = F.concat(F.lit("<video"), F.regexp_extract(block, rf"(?s)^({m.ATTRS}>)", 1))
        nested = m.tags(F.regexp_extract(block, r"(?is)^(.*?)(?:</video\b|\z)", 1), "source")
        return F.transform(F.concat(F.array(own), nested), lambda tag: m.attribute(tag, "src"))

    def still(tag: Column) -> Column:
        return F.coalesce(*[F.nullif(m.attribute(tag, a), F.lit("")) for a in ("src", "href", "data-src")])

    def read(b: Column) -> Column:
        ref = lambda u, kind: F.struct(urls.resolve(b["base"], u).alias("url"), F.lit(kind).alias("media_type"))
        blocks = m.after_first(F.split(b["source"], r"(?i)<video(?=[\s>/])", -1))
        videos = F.filter(F.flatten(F.transform(blocks, video_sources)), present)
        gif_tags = F.filter(m.tags(b["source"], "img|a|source"), lambda tag: F.contains(F.lower(tag), F.lit(".gif")))
        gifs = F.filter(F.transform(gif_tags, still), lambda u: u.rlike(r"(?is)\.gif(?:[?#].*)?$"))
        found = F.concat(F.transform(videos, lambda u: ref(u, "video")), F.transform(gifs, lambda u: ref(u, "gif")))
        return let(found, once)

    def once(found: Column) -> Column:
        return let(
            F.transform(found, lambda r: r["url"]),
            lambda seen: F.filter(found, lambda r, i: F.array_position(seen, r["url"]) == i + 1),
        )

    parts = F.struct(m.visible(html).alias("source"), urls.url_base(url).alias("base"))
    return F.when(html.rlike(r"(?i)<video|\.gif"), let(parts, read)).otherwise(none)


def media_refs(pages: DataFrame) -> DataFrame:
    """(page_id, seq, url, media_type) of videos and animated images; the first mention of a URL decides its type."""
    return pages.select("page_id", F.posexplode(media_array(F.col("html"), F.col("url"))).alias("seq", "r")).select(
        "page_id", F.col("seq").cast("bigint").alias("seq"), "r.url", "r.media_type"
    )


# ---------------------------------------------------------------- gallery images

def gallery_images(pages: DataFrame, min_px: int = MIN_GALLERY_PX) -> DataFrame:
    """(page_id, seq, url) of likely product images.

    An image qualifies inside an element whose class or id mentions product or gallery, unless its address looks
    like decoration or it states a size below ``min_px``.  Finding ancestors needs a walk over the tags, the one
    step done in Python; pages without images or such elements are kept out of it.
    """
    wanted = pages.filter(
        F.col("html").rlike("(?i)<img[\\s/>]") & F.col("html").rlike("(?i)product|gallery")
    ).select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    found = wanted.mapInPandas(
        walk_images, f"page_id {kind}, url string, seq bigint, src string, width string, height string, around string"
    )
    small = lambda c: F.coalesce(strip(F.col(c)).try_cast("int") < min_px, F.lit(False))
    kept = found.filter(
        F.col("around").rlike("(?i)product|gallery")
        & (strip(F.col("src")) != "")
        # Words of an address that speak of decoration.
        & ~F.col("src").rlike("(?i)logo|icon|sprite|favicon|avatar|spinner|placeholder")
        & ~small("width") & ~small("height")
    )
    return (
        kept.select("page_id", "seq", urls.absolute_url(F.col("url"), F.col("src")).alias("url"))
        .groupBy("page_id", "url").agg(F.min("seq").alias("seq")).select("page_id", "seq", "url")
    )


def product_image_url(pages: DataFrame, min_px: int = MIN_GALLERY_PX, max_depth: int = MAX_JSON_DEPTH) -> DataFrame:
    """(page_id, image_url): product markup first, then metadata, then the first gallery image.

    Every page is read once.  Markup and metadata are looked at in the row; only pages that both leave open keep
    their HTML for the walk over the tags.
    """
    html, url = F.col("html"), F.col("url")
    stated = F.coalesce(product_struct(html, max_depth)["image"], best_metadata(page_summary(html, url))["image"])
    read = cut_lineage(pages.select("page_id", "url", let(stated, lambda i: F.struct(i.alias("image_url"), F.when(i.isNull(), html).alias("html"))).alias("b")).select("page_id", "url", "b.*"))
    found = read.filter("image_url IS NOT NULL").select("page_id", "image_url")
    left = read.filter("html IS NOT NULL").select("page_id", "url", "html")
    if left.isEmpty():
        return found
    return found.unionByName(gallery_images(left, min_px).groupBy("page_id").agg(F.min_by("url", "seq").alias("image_url")))


def extract_pages(pages: DataFrame, max_depth: int = MAX_JSON_DEPTH) -> DataFrame:
    """One narrow row per page: product struct, specification pairs, metadata struct, media references.

    The HTML is read once and does not travel further.  A page without HTML yields nothing.
    """
    html, url = F.col("html"), F.col("url")
    return pages.filter(F.coalesce(html, F.lit("")) != "").select(
        "page_id", "url", product_struct(html, max_depth).alias("product"), spec_pair_array(html).alias("pairs"),
        best_metadata(page_summary(html, url)).alias("meta"), media_array(html, url).alias("media"),
    )
