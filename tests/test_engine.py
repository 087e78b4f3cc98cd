import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestead.plans.engine import Engine, Hooks, table_fetcher
from lodestead.plans.events import Events
from lodestead.plans.store import Store
from lodestead.streaming.ingest import merge_batch, start_ingest, fetched_stream

WORDS = "pricing team cost dollars month limits rate requests minute tokens rotate authentication sourdough".split()
ORIGIN = "https://m.example"


def embedder(texts):
    out = np.zeros((len(texts), len(WORDS)), np.float32)
    for row, t in zip(out, texts):
        for w in re.findall("[a-z]+", t.lower()):
            if w in WORDS:
                row[WORDS.index(w)] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def page(title, *sections):
    return f"<html><head><title>{title}</title></head><body><main>" + "".join(f"<h2>{h}</h2><p>{p}</p>" for h, p in sections) + "</main></body></html>"


PAGES = {
    "/pricing.html": page("Pricing", ("Team", "The team plan has a cost of forty dollars a month."), ("Business", "Larger plans are priced on request.")),
    "/limits.html": page("Limits", ("Rate", "The rate limits are sixty requests per minute.")),
    "/authentication.html": page("Authentication", ("Tokens", "You can rotate tokens at any time for authentication.")),
    "/missing.html": "",
}
SCHEMA = "url string, status int, html string, etag string, last_modified string, fetched_at bigint"


def served(spark, pages=PAGES, at=1):
    return spark.createDataFrame([(ORIGIN + p, 200, h, f'"{abs(hash(h))}"', None, at) for p, h in pages.items()], SCHEMA)


def sitemap(spark, pages=PAGES):
    xml = "<urlset>" + "".join(f"<url><loc>{p}</loc></url>" for p in pages) + "</urlset>"
    return spark.createDataFrame([(f"{ORIGIN}/sitemap.xml", xml)], "url string, xml string")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), ORIGIN, Hooks(table_fetcher(served(spark)), embedder, "fake", now=lambda: 1_000))
    assert e.prepare(sitemap(spark), f"{ORIGIN}/sitemap.xml") == 4
    return e


def test_ask_reads_what_it_needs(engine):
    r = engine.ask("team plan cost dollars")
    assert r.grounded and r.citations[0]["url"].endswith("/pricing.html") and r.fetched[-1] == f"{ORIGIN}/pricing.html" and len(r.fetched) <= 3
    assert all(c["dense"] >= 0.28 for c in r.citations) and r.citations[0]["title"] == "Pricing"
    again = engine.ask("team plan cost dollars")
    assert again.fetched == [] and again.grounded
    refused = engine.ask("sourdough")
    assert not refused.grounded and refused.citations == [] and len(refused.suggestions) <= 3
    assert engine.ask("   ").fetched == []


def test_backfill_goes_on_where_it_stopped(spark, engine, tmp_path):
    first = engine.enrich(2)
    assert first["indexed"] == 2
    rest = Engine(spark, str(tmp_path), ORIGIN, engine.hooks).enrich(10)
    assert (rest["indexed"], rest["skipped"], rest["remaining"]) == (1, 1 - first["skipped"], 0)
    assert engine.enrich(10) == {"indexed": 0, "skipped": 0, "remaining": 0}
    stats = engine.stats()
    assert stats["pages"] == 3 and stats["manifest"] == 4
    topics = engine.topics()
    assert topics["enriched"] == 3 and topics["total"] == 4
    summary = engine.store.table("manifest").where("url like '%limits%'").first()
    assert "Rate" in summary.summary


def test_revalidate(spark, engine):
    engine.enrich(10)
    changed = {**PAGES, "/limits.html": page("Limits", ("Rate", "The rate limits are ninety requests per minute."))}
    changed.pop("/authentication.html")
    engine.hooks.fetch = table_fetcher(served(spark, changed, at=2))
    assert engine.revalidate() == {"checked": 3, "changed": 1, "removed": 1}
    assert engine.stats()["pages"] == 2 and "ninety" in engine.store.table("chunks").where("url like '%limits%'").first().body
    assert engine.revalidate() == {"checked": 2, "changed": 0, "removed": 0}


def test_timeouts_leave_what_is_stored(spark, engine):
    from lodestead.sources.http import http_fetcher

    def times_out(request, timeout):
        raise TimeoutError

    engine.enrich(10)
    before = engine.stats()
    engine.hooks.fetch = http_fetcher(times_out, spacing=0)
    assert engine.revalidate() == {"checked": 3, "changed": 0, "removed": 0}
    assert engine.stats() == before
    late = engine.hooks.fetch(engine.store.table("pages").select("url")).withColumn("fetched_at", F.lit(10**15)).withColumn("fetch_id", F.lit(1))
    merge_batch(engine.store, late, embedder)
    assert engine.stats() == before


def test_prose_is_checked(engine):
    engine.hooks.generate = lambda messages: "Forty dollars [1]."
    assert engine.ask("team plan cost dollars").answer == "Forty dollars [1]."
    engine.hooks.generate = lambda messages: "It is 4711 dollars [1]."
    assert engine.ask("team plan cost dollars").answer is None

    def fails(messages):
        raise RuntimeError

    engine.hooks.generate = fails
    assert engine.ask("team plan cost dollars").grounded


def test_messages_hold_an_example(engine):
    heard = []
    engine.hooks.generate = lambda messages: heard.append(messages) or "Forty dollars [1]."
    engine.ask("team plan cost dollars")
    assert [r for r, _ in heard[0]] == ["system", "user", "assistant", "user"]
    assert heard[0][1][1].startswith("Sources:\n\n[1] ") and heard[0][3][1].endswith("Question: team plan cost dollars") and "forty" in heard[0][3][1]


def test_batches_of_answers(spark):
    from lodestead.operators import answers

    def write(messages):
        if "bad" in messages[-1][1]:
            raise RuntimeError
        return f"{len(messages)} turns"

    rows = spark.createDataFrame([("a", "good", [("t", ["h"], "body")]), ("b", "bad", [])], "query_id string, text string, citations array<struct<title:string,heading_path:array<string>,body:string>>")
    got = answers.generated(rows.select("query_id", answers.messages("text", "citations").alias("messages")), write)
    assert dict(map(tuple, got.collect())) == {"a": "4 turns", "b": None}


def test_events():
    e, heard = Events(), []
    off = e.on("x", lambda d: heard.append(("x", d["n"])))
    e.once("x", lambda d: heard.append(("once", d["n"])))
    e.on("x", lambda d: 1 / 0)
    away = e.on_any(lambda name, d: heard.append((name, "any")))
    e.emit("x", {"n": 1})
    away()
    e.emit("x", {"n": 2})
    off()
    e.emit("x", {"n": 3})
    assert heard == [("x", 1), ("once", 1), ("x", "any"), ("x", 2)]
    e.clear()
    e.emit("x", {"n": 4})
    assert len(heard) == 4


def test_one_enrichment_at_a_time(engine):
    import threading

    results, started = [], threading.Event()

    def listen(event, data):
        if event == "index:start":
            started.set()
        if event == "enrich:progress":
            engine.cancel_enrichment()

    engine.hooks.listeners.append(listen)
    first = threading.Thread(target=lambda: results.append(engine.enrich(10, batch=1)))
    first.start()
    started.wait(60)
    results.append(engine.enrich(10, batch=1))
    first.join()
    assert results[0] == results[1] and results[0]["remaining"] == 3 and engine.stats()["pages"] <= 1
    kept = engine.store.meta()["backfill"]
    assert kept["startedAt"] == 1_000 and kept["completedAt"] is None


def test_events_reach_all_listeners(engine):
    heard = []
    engine.hooks.listeners += [lambda e, d: 1 / 0, lambda e, d: heard.append(e)]
    engine.enrich(1)
    assert "enrich:progress" in heard


CHUNK = "id string, url string, chunk_index int, body string, vector array<float>"


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path), "one")
    assert not s.was_reset and s.stats() == {"pages": 0, "chunks": 0, "manifest": 0}
    rows = lambda n: spark.createDataFrame([(f"u#{i}", "u", i, "b", [1.0]) for i in range(n)], CHUNK)
    p = spark.createDataFrame([("u", "t")], "url string, title string")
    s.put_pages(p, rows(3))
    s.put_pages(p, rows(1))
    assert s.stats() == {"pages": 1, "chunks": 1, "manifest": 0}
    s.delete_pages(spark.createDataFrame([("unknown",)], "url string"))
    assert s.stats()["chunks"] == 1
    with pytest.raises(ValueError, match="vector"):
        s.put_pages(p, spark.createDataFrame([("u#0", "u", 0, "b", None)], CHUNK))
    s.put_manifest_entries(spark.createDataFrame([("u", "A"), ("v", "B")], "url string, slug_title string"))
    s.put_manifest_entries(spark.createDataFrame([("u", "C")], "url string, slug_title string"))
    assert {r.url: r.slug_title for r in s.table("manifest").collect()} == {"u": "C", "v": "B"}
    assert Store(spark, str(tmp_path), "one").stats()["pages"] == 1
    assert Store(spark, str(tmp_path), "two").was_reset
    s.delete_pages(p)
    assert s.stats() == {"pages": 0, "chunks": 0, "manifest": 2}
    s.clear()
    assert s.stats()["manifest"] == 0 and s.meta()["cacheKey"] == "one"


def test_upsert_writes_only_its_buckets(spark, tmp_path):
    from lodestead.operators import lexical

    s = Store(spark, str(tmp_path), "k", buckets=8)
    made = lambda us, word: (spark.createDataFrame([(u, "t") for u in us], "url string, title string"), spark.createDataFrame([(f"{u}#0", u, 0, f"{word} text of {u}", "b", [1.0]) for u in us], "id string, url string, chunk_index int, text string, body string, vector array<float>"))
    urls = [f"u{i}" for i in range(40)]
    s.put_pages(*made(urls, "first"))
    before = s.meta()["tables"]
    files = lambda: {str(p) for p in tmp_path.rglob("*.parquet")}
    old = files()
    s.put_pages(*made(["u3"], "second"))
    after, written = s.meta()["tables"], files() - old
    for name in ("pages", "chunks", "chunk_postings"):
        assert sum(before[name][b] != after[name][b] for b in before[name]) == 1
    assert len(written) == 3 and old <= files()  # readers may still hold the old version
    assert s.stats() == {"pages": 40, "chunks": 40, "manifest": 0}
    asked = spark.createDataFrame([("q", "second text"), ("r", "first u7"), ("n", "nowhere")], "query_id string, text string")
    want = lexical.bm25(s.table("chunks").select("id", "text"), asked, 5)
    key = lambda df: sorted((r.query_id, r.place, r.id, round(r.score, 9)) for r in df.collect())
    assert key(s.bm25("chunks", asked, 5)) == key(want) and ("r", 1, "u7#0") in {x[:3] for x in key(want)}
    s.grace = -1
    s.delete_pages(spark.createDataFrame([("u3",)], "url string"))
    assert s.stats()["chunks"] == 39 and not s.meta()["left"] and not old <= files()
    assert key(s.bm25("chunks", asked, 5)) == key(lexical.bm25(s.table("chunks").select("id", "text"), asked, 5))


def test_locks_are_kept_and_left_ones_taken_over(spark, tmp_path):
    s = Store(spark, str(tmp_path), "k")
    lock = s._path(f"{s.root}/_lock")
    s.fs.createNewFile(lock)
    with pytest.raises(RuntimeError, match="another writer"):
        s.set_meta(revalidatedAt=1)
    s.lock_age = -1
    s.set_meta(backfill={"completedAt": 5})
    s.set_meta(backfill={"startedAt": 4})
    assert s.meta()["backfill"] == {"startedAt": 4, "completedAt": 5} and not s.fs.exists(lock)


def test_stream(spark, tmp_path):
    schema = "fetch_id bigint, url string, status int, html string, not_modified boolean, etag string, last_modified string, fetched_at bigint, ingested_at timestamp"
    row = lambda i, u, s, h, at: (i, u, s, h, False, None, None, at, None)
    one = spark.createDataFrame([row(1, "https://m.example/a", 200, page("A", ("x", "first text")), 1), row(2, "https://m.example/b", 200, page("B", ("x", "other text")), 1), row(3, None, 200, "x", 1)], schema)
    two = spark.createDataFrame([row(4, "https://m.example/a", 200, page("A", ("x", "newer text")), 5), row(5, "https://m.example/b", 404, None, 5), row(6, "https://m.example/a", 200, page("A", ("x", "late text")), 3)], schema)
    store = Store(spark, str(tmp_path / "store"), "k")
    for n, batch in enumerate((one, two)):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = start_ingest(fetched_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ckpt"))
        q.awaitTermination(120)
        assert q.exception() is None
        assert store.stats()["pages"] == (2, 1)[n]
    assert [r.body for r in store.table("chunks").collect()] == ["newer text"]
    merge_batch(store, two)
    assert store.stats()["pages"] == 1
