from pyspark.sql import functions as F

from lodestead.functions import chunking, html, text, urls
from lodestead.functions.hashing import base36, content_hash, content_hash_value

BLOCKS = "array<struct<type:string,level:int,text:string>>"


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def tokens(spark, t, keep=False):
    return one(spark, "t string", (t,), text.tokenize("t", keep).alias("x")).x


def test_tokens(spark):
    assert tokens(spark, "MRD-4400") == ["mrd-4400", "mrd", "4400"]
    assert tokens(spark, "v3.2.1") == ["v3.2.1", "v3", "2", "1", "3"]
    assert "v3" in tokens(spark, "version 3") and "v12" in tokens(spark, "ver 12") and "v2" in tokens(spark, "v 2")
    assert "v34" not in tokens(spark, "we have 34 people")
    assert tokens(spark, "the rate limits are per organisation") == ["rate", "limits", "per", "organisation"]
    assert "the" in tokens(spark, "the end", True)
    assert tokens(spark, "") == [] and tokens(spark, None) is None
    assert tokens(spark, "x" * 65) == []
    assert tokens(spark, "éaument") == ["aument"]


def blocks(*items):
    return [("heading", lv, t) if lv else ("text", None, t) for lv, t in items]


def test_headings_and_summary(spark):
    row = (blocks((2, "Limits"), (2, "limits "), (2, "Limits"), (2, "My page"), (2, "›"), (2, "How much?")), "My Page")
    r = one(spark, f"b {BLOCKS}, t string", row, text.headings_of("b", "t").alias("h"), text.question_headings("b").alias("q"))
    assert r.h == ["Limits", "How much?"] and r.q == ["How much?"]
    short = one(spark, f"b {BLOCKS}, t string", (blocks((0, "Yes."), (0, "No.")), "T"), text.summarize("b", "t").alias("s"))
    assert short.s == ""
    many = one(spark, f"b {BLOCKS}, t string", (blocks(*((2, f"A heading with number {i}") for i in range(60))), "T"), text.summarize("b", "t").alias("s"))
    assert 600 < len(many.s) <= 700
    assert one(spark, f"b {BLOCKS}, t string", (None, "T"), text.summarize("b", "t").alias("s")).s is None


def test_lead_sentences(spark):
    b = blocks((0, "Short. This is a sentence of some length. And a second one that counts too! " + "x" * 300), (1, "Not this heading at all, please."))
    r = one(spark, f"b {BLOCKS}", (b,), text.lead_sentences("b").alias("s")).s
    assert r[0] == "This is a sentence of some length." and len(r) == 3 and len(r[2]) == 200


def test_small_functions(spark):
    r = one(
        spark, "t string, p array<string>, q array<string>", ("  a  b ", ["A"], ["A", "B"]),
        text.squeezed("t").alias("s"), text.common_path("p", "q").alias("c"), text.compose("t", "q", F.lit("x")).alias("m"), text.clamp_level(F.lit(9)).alias("l"),
        text.clamp_text(F.lit("abc  def"), 5).alias("k"), text.slugify(F.lit(" Big  Cat ")).alias("g"), text.breadcrumb(F.lit(""), "q").alias("b"), text.blocks_from_text(F.lit("a\n\n\nb\n \n")).alias("f"),
    )
    assert (r.s, r.c, r.l, r.k, r.g, r.b) == ("a b", ["A"], 6, "abc…", "big-cat", "A › B")
    assert r.m.endswith(" › A › B\nx") and [x.text for x in r.f] == ["a", "b"]


def test_urls(spark):
    cases = {
        "/docs/quickstart.html": ("Quickstart", ["docs"]), "/blog/why-columnar.html": ("Why Columnar", ["blog"]), "/some_page_here": ("Some Page Here", []), "/docs/index.html": ("Docs", ["docs"]),
        "/docs/": ("Docs", []), "/": ("Home", []), "/a/b/c.html": ("C", ["a", "b"]), "/top.html": ("Top", []), "/release-v3.2.html": ("Release V3", []),
    }
    rows = spark.createDataFrame([(f"https://m.example{p}", p) for p in cases], "url string, p string")
    for r in rows.select("p", urls.slug_title("url").alias("t"), urls.url_segments("url").alias("s"), urls.is_index_url("url").alias("i")).collect():
        assert (r.t, r.s) == cases[r.p], r.p
        assert r.i == (r.p.endswith("/") or "index" in r.p)
    assert urls.canonical("https://a.example/x#errors") == "https://a.example/x"
    assert urls.canonical("https://a.example/p?utm_source=1", "/pricing.html") == "https://a.example/pricing.html"
    assert urls.canonical("https://a.example/?id=7") == "https://a.example/?id=7"
    assert urls.canonical("https://a.example/p", "https://b.example/x") == "https://a.example/p"
    assert urls.canonical("no url") == "no url" and urls.canonical(None) is None
    r = one(spark, "u string, b string", ("x/../y", "https://A.example:443/"), urls.absolute_url("u", "b").alias("a"), urls.url_origin("b").alias("o"))
    assert (r.a, r.o) == ("https://a.example/y", "https://a.example")


def test_hash(spark):
    assert [content_hash_value(t) for t in ("a", "b", "revenge")] == [7929297801672961, 8684336938537663, 4051478007546757]
    assert base36(content_hash_value("a")) == "262p94epp1d" and base36(0) == "0"
    r = one(spark, "a string, b string", ("a", None), content_hash("a").alias("x"), content_hash("b").alias("y"))
    assert r.x == "262p94epp1d" and r.y is None


def sentences(n):
    return " ".join(f"This is sentence number {i} about alpha and its behaviour." for i in range(n))


def as_dicts(*items):
    return [{"type": k, "level": lv, "text": t} for k, lv, t in blocks(*items)]


def test_chunks(spark):
    found = chunking.chunk_blocks(as_dicts((1, "A"), (0, sentences(12)), (2, "B"), (0, "Tiny.")))
    assert all(body != "Tiny." for _, body in found) and sum("Tiny." in body for _, body in found) == 1
    assert chunking.chunk_blocks(as_dicts((1, "A"), (2, "B"))) == []
    words = chunking.chunk_blocks(as_dicts((0, "word " * 400)))
    assert len(words) > 1 and all(len(b) <= 900 for _, b in words)
    siblings = chunking.chunk_blocks(as_dicts((2, "A"), (0, sentences(4)), (2, "B"), (0, "Tiny.")))
    assert [p for p, _ in siblings] == [["A"], ["B"]]
    solid = chunking.chunk_blocks(as_dicts((0, "x" * 5000)))
    assert all(len(b) <= 900 for _, b in solid)
    pages = spark.createDataFrame([("u", blocks((1, "A"), (0, "Some text."))), ("v", None), ("w", [])], f"url string, blocks {BLOCKS}")
    assert [(r.page_key, r.chunk_index, r.heading_path, r.body) for r in chunking.chunk_pages(pages).collect()] == [("u", 0, ["A"], "Some text.")]


PAGE = """<!doctype html><html lang="en"><head><title>Foo &amp; Bar</title><meta property="og:title" content="{og}">
<script type="application/ld+json">{ld}</script></head><body><header><p>top</p></header>
<nav class="breadcrumbs"><ol><li>Home<li>Guides<li>This</ol></nav><main><article><h1>foo</h1><p>one<p>two <b>x<br>y
<script>var t="</p>"</script><ul><li>a<li><p>b</p></ul><table><tr><td>c<td>d</table><aside><p>no</p></aside></article></main><footer>{foot}</footer></body></html>"""


def test_extraction(spark):
    empty = html.extract("", "https://a.example/thing.html")
    assert (empty["blocks"], empty["text"], empty["title"], empty["category"]) == ([], "", "Untitled", None)
    fill = lambda **k: PAGE.format(**({"og": "", "ld": "{}", "foot": "x"} | k))
    p = html.extract(fill(), "https://a.example/guides/t.html")
    assert p["title"] == "Foo & Bar" and p["lang"] == "en" and p["category"] == "Guides"
    assert [b["text"] for b in p["blocks"]] == ["one", "two xy", "a", "b", "c", "d"]
    assert html.extract(fill(foot="y"), "https://a.example/guides/t.html")["hash"] == p["hash"]
    assert html.extract(fill(og="OG"), "u")["title"] == "OG"
    ld = '{"@graph": [{"@type": "BreadcrumbList", "itemListElement": [{"name": "Root"}, {"item": {"name": "Up"}}, {"name": "Here"}]}]}'
    assert html.extract(fill(ld=ld), "u")["category"] == "Up"
    assert html.extract("<p>x", "https://a.example/guides/thing.html")["category"] == "Guides"
    assert html.extract("<p>x</p>" * 3 + "<div>" * 3000, "u")["text"] == "x\nx\nx"
    rows = spark.createDataFrame([(1, "https://a.example/x/y", "<p>hi"), (2, "https://a.example/", None), (3, None, "<p>")], "fetch_id bigint, url string, html string")
    got = html.extract_pages(rows).collect()
    assert [(r.fetch_id, r.text, r.category) for r in got] == [(1, "hi", "X")]
