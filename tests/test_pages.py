from pyspark.sql import functions as F

from claimloom.operators import assemble as a
from claimloom.operators import capture as cap
from claimloom.operators import classify as k
from claimloom.operators import pages as p
from claimloom.plans.resolve import evidence_from_pages
from claimloom.sources import sitemaps

URL = "https://shop.example.com/cat/item-9.html?x=1"


def page(spark, *htmls, url=URL):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("page_id", *[c for c in df.columns if c == "seq"]).collect()]


LD = '<script type="application/ld+json">%s</script>'


def test_product_markup_shapes(spark):
    shapes = [
        '{"@type":"Product","name":" Trim ","sku":1234,"image":"u.png","brand":"Acme","offers":{"price":2.350},"description":"d"}',
        '[{"@type":"Thing"},{"@type":["x","http://schema.org/Product"],"image":[{"url":"u.png"}],"brand":[{"name":"Acme"}],"offers":[{"priceSpecification":{"price":10.0}}]}]',
        '{"@type":"Product","name":"outer","@graph":[[{"@type":"Product","name":"inner"}]]}',
        '{"@type":"Product"}', '{"@type":"Products","name":"no"}', '{"@type":"Product","name":7,"brand":{"name":" "},"sku":true}',
    ]
    got = {r["page_id"]: tuple(r)[1:] for r in p.jsonld_products(page(spark, *[LD % s for s in shapes])).collect()}
    assert got == {0: ("Trim", "1234", "u.png", "d", "Acme", "2.35"), 1: (None, None, "u.png", None, "Acme", "10.0"),
                   2: ("inner", None, None, None, None, None), 5: (None, "True", None, None, None, None)}


def test_first_product_with_any_field_wins_and_bad_json_is_skipped(spark):
    html = "<!--" + LD % '{"@type":"Product","name":"hidden"}' + "-->" + LD % "{bad" + LD % '{"@type":"Product"}' + LD % '{"@type":"Product","name":"b"}'
    assert rows(p.jsonld_products(page(spark, html, "<p>none</p>"))) == [("b", None, None, None, None, None)]


def test_metadata(spark):
    html = ('<title> T &amp; <!-- c -->shop </title><meta property="og:title" content="OG &quot;x&quot;"><meta name=description content=" d ">'
            "<meta content='../images/x.jpg' property='og:image'><meta name='twitter:image' content='/t.png'><h1> Big <b>head</b></h1>")
    d = page(spark, html, "<title></title><h1>only</h1>")
    assert rows(p.page_metadata(d)) == [({"og:title": 'OG "x"', "og:image": "https://shop.example.com/images/x.jpg", "twitter:image": "https://shop.example.com/t.png",
                                          "meta_description": "d", "title": "T & shop", "h1": "Bighead"},), ({"h1": "only"},)]
    assert rows(p.metadata_fields(p.page_metadata(d))) == [('OG "x"', "d", "https://shop.example.com/images/x.jpg"), ("only", None, None)]


def test_spec_pairs(spark):
    html = ("<script>var t='<table><tr><td>no</td><td>no</td></tr></table>'</script><table><tr><th>Material:</th><td>Aluminum <b>Alloy</b></td></tr>"
            "<tr><td>a</td><td>b</td><td>c</td></tr><TR><TD>Height<TD>10 cm</TR><tr><td></td><td>x</td></tr></table><dl><dt>Len</dt><dd>2.5 m</dd><dd>42</dd><dt></dt><dd>zz</dd></dl>")
    assert rows(p.spec_pairs(page(spark, html, "<div><span>k</span><span>v</span></div>"))) == [
        (0, "Material:", "Aluminum Alloy"), (1, "Height", "10 cm"), (2, "Len", "2.5 m"), (3, "Len", "42")]


def test_links(spark):
    html = ('<a href="/p/1">x</a><a href="mailto:a@b">m</a><a href="tel:1">t</a><a href="JavaScript:x()">j</a><a href=\'b.html#f\'>y</a><a class=z href=b.html>y</a>'
            '<a href="http://other.com/">o</a><a href="#t">t</a><a href="?x=1#me">self</a><a href="?x=2">q</a>')
    assert [u for _, u in rows(p.same_host_links(page(spark, html)))] == [
        "https://shop.example.com/p/1", "https://shop.example.com/cat/b.html", "https://shop.example.com/cat/item-9.html?x=2"]


def test_media(spark):
    html = '<video src="/v.mp4"><source src="v2.webm"></video><img data-src="g.GIF?x=1"><img src="p.jpg"><a href="v.gif#a">a</a><img src="/v.mp4"><source src="s.gif">'
    got = [(u.rsplit("/", 1)[-1], t) for _, u, t in rows(p.media_refs(page(spark, html)))]
    assert got == [("v.mp4", "video"), ("v2.webm", "video"), ("g.GIF?x=1", "gif"), ("v.gif#a", "gif"), ("s.gif", "gif")]


def test_gallery(spark):
    html = ('<div id="Gallery"><p><img src="a.jpg"><img src="logo.png"><img src="s.jpg" width="20"><img data-src="b.jpg" height="100"></p><br><img src="a.jpg"></div>'
            '<img src="nav.jpg"><ul class="x product-list"><li><img src="c.jpg" width="auto"></ul><img src="after.jpg">')
    got = {u.rsplit("/", 1)[-1] for _, u in rows(p.gallery_images(page(spark, html)))}
    assert got == {"a.jpg", "b.jpg", "c.jpg"}
    d = page(spark, html)
    best = p.product_image_url(d).first()
    assert best["image_url"] == "https://shop.example.com/cat/a.jpg"


def categories(spark):
    t = spark.createDataFrame([
        ("a", 0, ["Floor", "Skirting", "PVC Skirting"], None, None, ["Acme", "PVC Co."]), ("b", 1, ["Floor", "Trims", "Corner Trim"], "Pattern: [Brand] tile", None, []),
        ("c", 2, ["Floor", "Trims", "Edge Trim"], "tile", None, ["Acme"])],
        "template_id string, template_ord int, category_path array<string>, naming_convention string, breadcrumb string, brands array<string>")
    return t


def test_classification(spark):
    docs = spark.createDataFrame([(0, "White PVC skirting board for floor edges"), (1, "aluminium tile trim profile"), (2, "banana yoghurt recipe"), (3, "of the a")],
                                 "doc_id int, text string")
    t = categories(spark)
    top = {r["doc_id"]: (r["path"], round(r["score"], 3), r["terms"], r["tied_count"]) for r in k.top_suggestion(k.rank_categories(docs, t), t).collect()}
    assert top == {0: (["Floor", "Skirting", "PVC Skirting"], 0.5, ["floor", "pvc", "skirting"], 1), 1: (["Floor", "Trims"], 0.5, ["tile", "trim"], 2)}
    assert {r["doc_id"] for r in k.suggest(docs, t, 0.6).collect()} == set()


def test_assembly(spark):
    meta = '<title>PVC skirting by acme</title><meta name="description" content="floor">'
    table = "<table><tr><td>Size : </td><td>1 in</td></tr><tr><td>Odd</td><td>42</td></tr></table>"
    d = page(spark, meta + table, meta, LD % '{"@type":"Product","name":"Corner tile trim","sku":"S1"}', table + LD % '{"@type":"Product","brand":"Own","name":"x"}', url="http://h/p/a/")
    got = {}
    for r in evidence_from_pages(d, categories(spark)).orderBy("seq").collect():
        got.setdefault(r["record_id"], []).append((r["field"], r["value"], round(r["confidence"], 2)))
    assert got["S1"] == [("name", "Corner tile trim", 0.9), ("sku", "S1", 0.9), ("suggested_category", "Floor > Trims > Corner Trim", 1.0)]
    assert sorted(got["a"]) == sorted([
        ("Size", "25.4 mm", 0.95), ("Odd", "42", 0.4), ("name", "PVC skirting by acme", 0.6), ("description", "floor", 0.6),
        ("suggested_category", "Floor > Skirting > PVC Skirting", 0.75), ("Brand", "Acme", 0.7),
        ("name", "x", 0.9), ("brand", "Own", 0.9), ("Size", "25.4 mm", 0.95), ("Odd", "42", 0.4)])
    assert set(got) == {"S1", "a"}  # the page with metadata alone is no product


def test_brand_edges(spark):
    t = spark.createDataFrame([(["A"], ["C++", "Co.", "India"])], "category_path array<string>, brands array<string>")
    docs = spark.createDataFrame([(0, "made with C++x", "A"), (1, "indian steel", "A"), (2, "from INDIA.", "A"), (3, "India", "A > B")], "doc_id int, text string, path string")
    assert {r["doc_id"]: r["brand"] for r in a.brand_from_vocabulary(docs, t).collect()} == {0: "C++", 2: "India"}


def test_robots(spark):
    robots = spark.createDataFrame([
        ("a", "User-agent: *\nDisallow: /products/\nSitemap: https://a/s.xml"), ("b", "User-agent: other\nDisallow: /\n\nUser-agent: loom\nUser-agent: x\nAllow: /ok\nDisallow: /\n\nUser-agent: *\nDisallow:"),
        ("c", "User-agent: *\n\nDisallow: /"), ("d", "User-agent: *\nDisallow: /a%20b")], "host string, txt string")
    cases = {"http://a/products/1": False, "http://a/about": True, "http://b/ok/1": True, "http://b/x": False, "http://c/x": True, "http://none/x": True, "http://d/a b/c": False, "http://b": False}
    d = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r["url"]: r["allowed"] for r in cap.robots_allowed(d, robots, "Loom/1.0").collect()} == cases
    assert [(r["host"], r["url"]) for r in cap.robots_sitemaps(robots).collect()] == [("a", "https://a/s.xml")]


def test_sitemaps(spark):
    ns = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">%s</urlset>'
    maps = spark.createDataFrame([
        ("s1", ns % "<url><loc> http://h/1?a=1&amp;b=2 </loc></url><url><loc/></url>"), ("s2", ns % "<url><loc>http://h/2</loc></url><url><loc>http://h/1?a=1&amp;b=2</loc></url>"),
        ("i", "<x:sitemapindex xmlns:x='u'><x:sitemap><x:loc>s2</x:loc></x:sitemap><x:sitemap><x:loc>gone</x:loc></x:sitemap></x:sitemapindex>"), ("bad", "<urlset><url><loc>http://h/3</loc>"), ("text", "not found")], "url string, xml string")
    entry = spark.createDataFrame([("h", 0, "s1"), ("h", 1, "i"), ("h", 2, "bad"), ("h", 3, "text"), ("h", 4, "none")], "site string, ord int, url string")
    got = sorted((tuple(r["first_seen"]), r["url"]) for r in sitemaps.sitemap_urls(entry, maps).collect())
    assert [u for _, u in got] == ["http://h/1?a=1&b=2", "http://h/2"]


def test_capture_plan(spark):
    cand = spark.createDataFrame([("j", i, f"u{i}", i != 0) for i in range(8)], "job string, ord int, url string, allowed boolean")
    probe = spark.createDataFrame([("u1", False, False, 0, None), ("u2", True, False, 0, None), ("u3", True, True, 0, None), ("u4", True, True, 2, "r4"), ("u5", True, True, 2, "r5"), ("u6", True, True, 2, "r6")],
                                  "url string, fetched boolean, has_fields boolean, n_rows int, record_id string")
    got = [(r["url"], r["status"], r["record_id"]) for r in cap.capture_plan(cand, probe, 2).orderBy("ord").collect()]
    assert got == [("u0", "blocked", None), ("u1", "skipped", None), ("u2", "skipped", None), ("u3", "skipped", None), ("u4", "captured", "r4"), ("u5", "captured", "r5"), ("u6", "limit_reached", None), ("u7", "limit_reached", None)]
    probes = spark.createDataFrame([("j", "p", True), ("k", "l", False)], "job string, url string, has_evidence boolean")
    links = spark.createDataFrame([("j", 0, "x"), ("k", 0, "a"), ("k", 1, "b"), ("k", 2, "c")], "job string, seq long, url string")
    assert sorted((r["job"], r["url"]) for r in cap.job_candidates(probes, links, 2).collect()) == [("j", "p"), ("k", "a"), ("k", "b")]
    assert [tuple(r) for r in cap.links_not_followed(probes, links, 2).collect()] == [("k", 2, "c", "not_followed")]


def test_page_source_reads_everything_in_one_row(spark):
    d = page(spark, "<title>t</title><table><tr><td>k</td><td>v</td></tr></table><img src='a.gif'>" + LD % '{"@type":"Product","name":"n"}', "", None)
    r = p.extract_pages(d).collect()
    assert len(r) == 1 and r[0]["product"]["name"] == "n" and r[0]["meta"]["name"] == "t"
    assert [tuple(x) for x in r[0]["pairs"]] == [("k", "v")] and r[0]["media"][0]["media_type"] == "gif"


def test_expression_is_evaluated_once(spark):
    from claimloom.functions.binding import let

    assert spark.range(1).select(let(F.lit(2), lambda x: x * x + x)).first()[0] == 6


def test_quotes_scripts_comments_and_depth(spark):
    html = ("""<script>var a="<!--";</script><meta property="og:title" content="Home > Tiles"><meta content="see name=description here" name="x">"""
            """<script type="application/ld+json">{"@type":"Product","name":"a <!-- b --> c"}</script><!-- <script type="application/ld+json">{"@type":"Product","name":"no"}</script> -->"""
            """<table><tr><td data-x="a>b">Material</td><td>PVC &check;</td></tr></table><a href="/x" title="a > b">l</a><video poster="a>b" src="v.mp4"></video><img alt="x > y" src="g.gif">""")
    d = page(spark, html, "", None)
    assert p.jsonld_products(d).first()["name"] == "a <!-- b --> c"
    meta = p.page_metadata(d).first()["meta"]
    assert meta["og:title"] == "Home > Tiles" and "meta_description" not in meta
    assert [(r["key"], r["value"]) for r in p.spec_pairs(d).collect()] == [("Material", "PVC \u2713")]
    assert [r["media_type"] for r in p.media_refs(d).orderBy("seq").collect()] == ["video", "gif"]
    deep = page(spark, LD % ("[" * 12 + '{"@type":"Product","name":"n"}' + "]" * 12), "", None)
    assert p.jsonld_products(deep).first()["name"] == "n" and p.jsonld_dead_letters(deep).count() == 1 and p.jsonld_dead_letters(d).count() == 0


def test_numbers_too_long_for_a_decimal_stay_text(evaluate):
    from claimloom.functions import measures

    long = "1" * 40
    assert evaluate(lambda c: measures.format_value(measures.normalize_value(c)), [f"{long} mm", "25 mm"])[0] == f"{long} mm"
    assert evaluate(measures.option_list, [f"{long}/2 mm"]) == [None]


def test_sitemaps_are_read_only_when_well_formed(spark):
    from claimloom.sources.sitemaps import sitemap_locations

    good = "<?xml version='1.0'?><urlset xmlns='x'><url><loc>https://a/x?a=1&#38;b=&quot;2&quot;</loc><lastmod/></url><url><loc><![CDATA[https://a/z?p=1&q=<]]></loc></url></urlset>"
    rows = [("good", good), ("bare", "<urlset><url><loc>https://a/y?a=1&b=2</loc></url></urlset>"), ("cut", "<urlset><url><loc>https://a/y</loc></url>"),
            ("crossed", "<urlset><url><loc>https://a/y</url></loc></urlset>"), ("none", None)]
    got = {r["url"]: r["locs"] for r in sitemap_locations(spark.createDataFrame(rows, "url string, xml string")).collect()}
    assert got == {"good": ['https://a/x?a=1&b="2"', "https://a/z?p=1&q=<"], "bare": [], "cut": [], "crossed": [], "none": []}


def test_rows_of_a_record_on_several_pages_have_one_order(spark):
    from claimloom.operators.assemble import assemble_evidence

    rows = [(i, f"https://a.example/{i}/index.html", LD % ('{"@type":"Product","name":"n%d","description":"d%d"}' % (i, i))) for i in range(4)]
    templates = spark.createDataFrame([("t1", ["Cat"], "x", "", ["Acme"])], "template_id string, category_path array<string>, naming_convention string, breadcrumb string, brands array<string>")
    for parts in (1, 3):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = assemble_evidence(pages, templates).orderBy("record_id", "seq").collect()
        assert [(r["seq"], r["value"]) for r in got if r["field"] in ("name", "description")] == [(2 * i + k, v) for i in range(4) for k, v in enumerate((f"n{i}", f"d{i}"))]
