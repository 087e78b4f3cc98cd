import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lodestead.config import lower_tier, resolve_config
from lodestead.operators import site, topics


def allowed(spark, robots, path, agent="lodestead"):
    urls = spark.createDataFrame([(f"https://m.example{path}",)], "url string")
    return site.robots_allowed(urls, site.rules_for(spark, robots, agent)).first().allowed


@pytest.mark.parametrize(
    ("robots", "path", "want"),
    [
        ("User-agent: *\nDisallow: /*.pdf$", "/manual.pdf", False), ("User-agent: *\nDisallow: /*.pdf$", "/manual.pdf.html", True),
        ("User-agent: *\nDisallow: /a/*/private", "/a/b/private", False), ("User-agent: *\nDisallow: /x\nAllow: /x", "/x", True),
        ("User-agent: *\nDisallow: /\nAllow: /docs", "/docs/a", True), ("User-agent: *\nDisallow: /a+b(c)", "/a+b(c)/x", False), ("User-agent: *\nDisallow: /a+b(c)", "/aab(c)", True),
        ("User-agent: *\nDisallow: /\n\nUser-agent: lodestead\nDisallow: /tmp", "/a", True), ("User-agent: *\nDisallow: /\n\nUser-agent: lode\nDisallow:", "/a", True),
        ("User-agent: a\nUser-agent: lodestead\nDisallow: /p", "/p", False), ("User-agent: *\nDisallow:", "/", True), ("", "/x", True), (None, "/x", True),
        ("User-agent: *\nDisallow: /s?q=", "/s?q=1", False), ("Disallow: /x", "/x", True),
    ],
)
def test_robots(spark, robots, path, want):
    assert allowed(spark, robots, path) is want


def test_robots_text():
    rules, sitemaps, agents = site.parse_robots("# c\nSitemap: https://x.example/s.xml\nUser-agent: A\nDisallow: /q # why\n")
    assert sitemaps == ["https://x.example/s.xml"] and agents == ["a"] and rules == [("a", 0, False, "/q", 2)]


def test_permission(spark):
    urls = spark.createDataFrame([("https://m.example/a",), ("https://other.example/a",), ("https://m.example/tmp/x",), ("nonsense",), (None,)], "url string")
    rules = site.rules_for(spark, "User-agent: *\nDisallow: /tmp")
    got = {r.url: r.permitted for r in site.fetch_permission(urls, rules, "https://m.example").collect()}
    assert got == {"https://m.example/a": True, "https://other.example/a": False, "https://m.example/tmp/x": False, "nonsense": False}


def test_outcome(spark):
    rows = [(1, 200, "x", False), (2, 304, None, True), (3, 404, "x", False), (4, 500, None, None), (5, None, "x", None), (6, 200, "y" * (2 * 1024 * 1024 + 1), False), (7, 200, None, None), (8, 204, "", False)]
    got = spark.createDataFrame(rows, "i int, status int, html string, not_modified boolean").select("i", site.fetch_outcome().alias("k")).collect()
    assert {r.i: r.k for r in got} == {1: "page", 2: "not-modified", 3: "gone", 4: "gone", 5: "gone", 6: "skip", 7: "gone", 8: "page"}
    types = spark.createDataFrame([("text/html; charset=x",), ("application/XHTML+xml",), ("image/png",), ("",), (None,)], "c string")
    assert [r.h for r in types.select(site.is_html_type("c").alias("h")).collect()] == [True, True, False, True, True]


XML = """<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc> /a?x=1&amp;y=2 </s:loc><s:lastmod>2024-01-01</s:lastmod><s:priority>0.8</s:priority></s:url>
<s:url><s:loc>/a?x=1&amp;y=2</s:loc></s:url><s:url><s:loc>javascript:x</s:loc></s:url><s:url><s:loc><![CDATA[ftp://x/y]]></s:loc></s:url><s:url><s:loc>https://other.example/b</s:loc><s:priority>no</s:priority></s:url></s:urlset>"""


def test_sitemap():
    entries, nested = site.parse_sitemap(XML, "https://m.example/sitemap.xml")
    assert entries == [{"url": "https://m.example/a?x=1&y=2", "lastmod": "2024-01-01", "priority": 0.8}, {"url": "https://other.example/b", "lastmod": None, "priority": None}] and nested == []
    with pytest.raises(ET.ParseError):
        site.parse_sitemap("<urlset><url>", "https://m.example/")


def sitemap_index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def url_set(*locs):
    return "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def test_sitemap_traversal(spark):
    docs = spark.createDataFrame(
        [
            ("https://m.example/s.xml", sitemap_index("/one.xml", "/two.xml", "/missing.xml", "/s.xml")), ("https://m.example/one.xml", url_set("/a", "/tmp/b", "https://x.example/c")),
            ("https://m.example/two.xml", url_set("/a", "/d", "/e")), ("https://m.example/bad.xml", "<"),
        ],
        "url string, xml string",
    )
    rules = site.rules_for(spark, "User-agent: *\nDisallow: /tmp")
    got = site.read_sitemaps(docs, "https://m.example/s.xml", rules, "https://m.example")
    assert sorted(r.url for r in got.collect()) == ["https://m.example/a", "https://m.example/d", "https://m.example/e"]
    assert site.read_sitemaps(docs, "https://m.example/s.xml", rules, "https://m.example", max_pages=2).count() == 2
    alone = site.read_sitemaps(docs, "https://m.example/bad.xml", rules, "https://m.example").collect()
    assert [(r.url, r.slug_title) for r in alone] == [("https://m.example/", "Home")]


ENTRY = "site string, url string, ord bigint, slug_title string, segments array<string>, category string, questions array<string>, priority double"


def entries(spark, *rows):
    return spark.createDataFrame([("m", f"https://m.example{u}", n, t, s, c, q, p) for n, (u, t, s, c, q, p) in enumerate(rows)], ENTRY)


SITE = (
    ("/index.html", "Home", [], None, None, 1.0), ("/pricing.html", "Pricing", [], None, None, 0.6), ("/about.html", "About", [], None, ["Who are you?"], None),
    ("/docs/api.html", "Api", ["docs"], None, ["How do I start?", "Who are you?"], 0.8), ("/docs/limits.html", "Limits", ["docs"], None, [], 0.8), ("/blog/v3-launch.html", "V3 Launch", ["blog"], None, None, 0.6),
)


def test_tree(spark):
    rows = {r.path: r for r in topics.category_tree(entries(spark, *SITE)).collect()}
    assert {p: (r.label, r.n_pages, r.parent) for p, r in rows.items()} == {"": ("Site", 3, None), "docs": ("Docs", 2, ""), "blog": ("Blog", 1, "")}
    assert rows[""].urls[0].endswith("/index.html")
    top = topics.top_categories(topics.category_tree(entries(spark, *SITE)), 2).orderBy("place").collect()
    assert [r.label for r in top] == ["Site", "Docs"]


def test_walk_goes_by_labels(spark):
    """docs-x comes after all that is below docs, though its path sorts before docs/y."""
    rows = [(f"/{p}/a.html", "A", p.split("/"), None, None, None) for p in ("docs-x", "docs/y", "docs", "Blog")]
    tree = topics.category_tree(entries(spark, *rows))
    assert [r.path for r in tree.orderBy("walk").collect()] == ["", "Blog", "docs", "docs/y", "docs-x"]
    assert [r.path for r in topics.top_categories(tree).orderBy("place").collect()] == ["Blog", "docs", "docs/y", "docs-x"]


def test_skipped_fetches_are_not_gone(spark):
    rows = [(1, None, None, "error"), (2, 200, None, "not-html"), (3, 200, None, "too-large"), (4, 404, None, None), (5, 200, "x", None), (6, 200, None, None), (7, 500, None, ""), (8, 304, None, "x")]
    df = spark.createDataFrame(rows, "i int, status int, html string, reason string").withColumn("not_modified", F.lit(False))
    got = {r.i: r.kind for r in df.select("i", site.outcome_of(df).alias("kind")).collect()}
    assert got == {1: "skip", 2: "skip", 3: "skip", 4: "gone", 5: "page", 6: "gone", 7: "gone", 8: "not-modified"}


def test_mounted_site(spark):
    e = entries(spark, ("/demo/index.html", "Demo", ["demo"], "Demo", None, None), ("/demo/pricing.html", "Pricing", ["demo"], "Demo", None, None), ("/demo/docs/api.html", "Api", ["demo", "docs"], None, None, None))
    assert {r.path for r in topics.category_tree(e).collect()} == {"", "docs"}
    assert "Home" in {r.title for r in topics.filed_pages(e).collect()}


def test_suggestions(spark):
    got = topics.suggestions(entries(spark, *SITE), 4).orderBy("place").collect()
    assert [r.text for r in got] == ["Who are you?", "How do I start?", "Home", "Api"]
    assert topics.suggestions(entries(spark, *SITE).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("titles", "want"),
    [
        (["Pricing — Orbitel", "Limits — Orbitel docs"], ["Pricing", "Limits"]), (["Orbitel | Pricing", "Orbitel | Limits"], ["Pricing", "Limits"]),
        (["Limits — Docs — Orbitel", "Orbitel", "A — Orbitel"], ["Limits — Docs", "Orbitel", "A"]), (["Pricing — Orbitel", "Limits"], ["Pricing — Orbitel", "Limits"]), (["A — B", "C — D"], ["A — B", "C — D"]),
    ],
)
def test_shortener(spark, titles, want):
    rows = entries(spark, *((f"/{n}.html", t, [], None, None, None) for n, t in enumerate(titles)))
    assert [r.title for r in topics.filed_pages(rows).orderBy("ord").collect()] == want


def test_pending_and_need(spark):
    m = spark.createDataFrame([("a", "One two", 0.1), ("b", "One", None), ("c", "One", 0.5), ("d", "x", None)], "url string, slug_title string, priority double")
    m = m.withColumn("description", F.lit(None).cast("string")).withColumn("summary", F.lit("")).withColumn("category", F.lit(None).cast("string")).withColumn("segments", F.lit(None).cast("array<string>"))
    left = site.pending_pages(m, m.where("url = 'd'"))
    assert [r.url for r in site.by_routing_need(left).orderBy("place").collect()] == ["c", "b", "a"]


def test_config():
    c = resolve_config({"max_pages": "99999", "enrich": "maybe", "debug": "", "enrich_pages": "0", "sitemap": "javascript:x", "max_tier": "STANDARD"}, "https://m.example/x/")
    assert (c.max_pages, c.enrich, c.debug, c.enrich_pages, c.sitemap, c.max_tier) == (5000, "idle", True, 0, "https://m.example/sitemap.xml", "standard") and len(c.warnings) == 3
    assert resolve_config({"max_pages": "x"}).max_pages == 500 and lower_tier("standard", "small") == "small"


def test_tiers(spark):
    from lodestead.operators.tiers import tier

    big, mb = 2 << 30, 1 << 20
    rows = [
        (0, None, None, None, big, big, 16, "standard"), (1, True, True, None, big, big, 16, "standard"), (2, True, False, "2g", big, big, 16, "standard"), (3, True, False, "4g", 100 * mb, big, 16, "standard"),
        (4, True, False, None, None, None, None, "standard"), (5, True, False, None, big, big, None, "standard"), (6, True, False, None, big, big, 4, "standard"), (7, True, False, None, big, big, 16, "small"),
        (8, True, False, None, big, 100 * mb, 16, "retrieval"), (9, True, False, None, big, big, 16, "retrieval"),
    ]
    df = spark.createDataFrame(rows, "i int, webgpu boolean, save_data boolean, effective_type string, max_buffer bigint, max_binding bigint, memory_gb int, ceiling string")
    got = {r.i: (r.t.tier, r.t.capped) for r in df.select("i", tier("ceiling").alias("t")).collect()}
    want = ["retrieval"] * 4 + ["small", "standard", "small", "small", "retrieval", "retrieval"]
    assert [got[i][0] for i in range(10)] == want and {i for i, x in got.items() if x[1]} == {7, 9}
