"""The engine: prepare, ask, enrich, revalidate, topics and stats over a stored index.

Fetching, embedding and writing are hooks: a fetcher maps a table of urls with validators to fetched pages, an embedder
texts to vectors, a generator prompts to raw answers. What they need beyond Spark is theirs.
"""

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.embedding import Embedder, embed, embed_one, hashed_words
from lodestead.functions import chunking, html, text
from lodestead.functions.urls import slug_title, url_segments
from lodestead.operators import answers, fusion, index, site, topics
from lodestead.plans.events import Events
from lodestead.plans.store import Store
from lodestead.tables import site_of

#: urls(url, etag, last_modified) -> (url, status, html, not_modified, etag, last_modified, fetched_at)
Fetcher = Callable[[DataFrame], DataFrame]
#: messages (role, content) -> raw answer
Generator = Callable[[list[tuple[str, str]]], str]

#: Passages of an answer, pages fetched for a question, pages of a backfill, suggestions of a refusal.
PASSAGES, MAX_FETCH, BACKFILL, SUGGESTIONS = 6, 3, 25, 3


@dataclass
class Hooks:
    fetch: Fetcher
    embedder: Embedder = hashed_words
    embedder_id: str = "hashed-words-64"
    generate: Generator | None = None
    robots: str | None = None
    now: Callable[[], int] = lambda: int(time.time() * 1000)
    listeners: list[Callable[[str, dict], Any]] = field(default_factory=list)


@dataclass
class AskResult:
    query: str
    grounded: bool
    citations: list[dict]
    suggestions: list[dict]
    fetched: list[str]
    answer: str | None = None
    sources: list[dict] = field(default_factory=list)
    cited: list[int] = field(default_factory=list)


def page_rows(fetched: DataFrame) -> DataFrame:
    """Extracted pages of fetched rows whose outcome is a page and that hold any text."""
    usable = fetched.where(site.outcome_of(fetched) == "page")
    return html.extract_pages(usable, ("url", "fetched_at", "etag", "last_modified")).where(text.trimmed("text") != "")


def chunk_rows(pages: DataFrame, embedder: Embedder = hashed_words) -> DataFrame:
    """Chunks of extracted pages with the vectors of their texts."""
    chunks = chunking.chunk_pages(pages.select("url", "blocks")).withColumnRenamed("page_key", "url").join(pages.select("url", "title"), "url")
    rows = chunks.select(
        F.concat("url", F.lit("#"), "chunk_index").alias("id"), "url", "chunk_index", "heading_path", text.compose("title", "heading_path", "body").alias("text"), "body"
    )
    return embed(rows, "text", embedder)


def enriched_rows(pages: DataFrame, manifest: DataFrame, embedder: Embedder, now: int) -> DataFrame:
    """Manifest entries of pages that were read: title, description, summary, questions and category in place of the guess."""
    read = pages.select(
        "url", F.col("title").alias("slug_title"), "description", text.summarize("blocks", "title").alias("summary"),
        F.slice(text.question_headings("blocks"), 1, 10).alias("questions"), "category",
    )
    base = manifest.select("url", F.col("segments").alias("old_segments"), "lastmod", "priority")
    rows = read.join(base, "url", "left").withColumn("segments", F.coalesce("old_segments", url_segments("url"))).withColumn("enriched_at", F.lit(now).cast("bigint"))
    return embed(rows.withColumn("text", text.route_text()).drop("old_segments"), "text", embedder, 32).drop("text")


class Engine:
    def __init__(self, spark: SparkSession, folder: str, origin: str, hooks: Hooks, site_version: str | None = None):
        self.spark, self.hooks, self.origin = spark, hooks, origin
        key = spark.range(1).select(index.cache_key(F.lit(origin), F.lit(hooks.embedder_id), F.lit(site_version).cast("string"))).first()[0]
        self.store = Store(spark, folder, key)
        self.rules = site.rules_for(spark, hooks.robots).cache()
        self.events = Events()
        self._running: Future | None = None
        self._guard, self._cancelled = threading.Lock(), threading.Event()

    def notify(self, event: str, **data) -> None:
        """Tells the listeners of the hooks and of the engine; one that fails doesn't keep the others from hearing."""
        told = Events()
        for listen in list(self.hooks.listeners):
            told.on_any(listen)
        told.emit(event, data)
        self.events.emit(event, data)

    # prepare

    def prepare(self, sitemaps: DataFrame, start: str, max_pages: int = site.MAX_PAGES, max_age: int = site.MANIFEST_AGE) -> int:
        """The manifest from sitemap documents(url, xml), unless the stored one is fresh; gives its number of entries."""
        built = self.store.meta()["manifestBuiltAt"]
        stored = self.store.table("manifest")
        if built is not None and self.hooks.now() - built < max_age and not stored.isEmpty():
            return stored.count()
        entries = site.read_sitemaps(sitemaps, start, self.rules, self.origin, max_pages)
        rows = entries.select("url", "slug_title", "segments", "lastmod", "priority", text.route_text("slug_title", F.lit(None), F.lit(None), F.lit(None), "segments").alias("text"))
        self.store.put_manifest(embed(rows, "text", self.hooks.embedder, 32).drop("text"))
        self.store.set_meta(manifestBuiltAt=self.hooks.now())
        n = self.store.table("manifest").count()
        self.notify("index:done", pages=n)
        return n

    # reading pages

    def _read(self, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Fetches urls(url) that robots allow: (extracted pages, urls that gave none)."""
        stored = self.store.table("pages").select("url", "etag", "last_modified")
        allowed = site.fetch_permission(urls, self.rules, self.origin).where("permitted").select("url")
        fetched = self.hooks.fetch(allowed.join(stored, "url", "left"))
        pages = page_rows(fetched).cache()
        return pages, urls.select("url").distinct().join(pages.select("url"), "url", "left_anti")

    def _store_pages(self, pages: DataFrame) -> None:
        chunks = chunk_rows(pages, self.hooks.embedder).cache()
        counted = chunks.groupBy("url").agg(F.count("*").cast("int").alias("n_chunks"))
        self.store.put_pages(pages.join(counted, "url").drop("blocks", "text"), chunks)
        entries = enriched_rows(pages, self.store.table("manifest"), self.hooks.embedder, self.hooks.now())
        self.store.put_manifest_entries(entries)
        chunks.unpersist()

    def pending(self) -> DataFrame:
        manifest = self.store.table("manifest")
        return site.by_routing_need(site.pending_pages(manifest, self.store.table("pages"), self.store.table("skipped")))

    def enrich(self, budget: int = BACKFILL, batch: int = BACKFILL, cancelled: Callable[[], bool] = lambda: False) -> dict[str, int]:
        """Reads pending pages, the most in need first, until `budget` were read, none is left, or cancelled() says so.

        Pages that give no text are skipped for good and don't count against the budget. What is stored after each batch
        is where the next call goes on. A call during another one waits for that one's result; cancel_enrichment ends it
        after the batch in hand.
        """
        with self._guard:
            running, own = self._running, None
            if running is None:
                own = self._running = Future()
                self._cancelled.clear()
        if own is None:
            return running.result()
        try:
            own.set_result(self._enrich(budget, batch, lambda: self._cancelled.is_set() or cancelled()))
        except BaseException as e:
            own.set_exception(e)
        finally:
            with self._guard:
                self._running = None
        return own.result()

    def cancel_enrichment(self) -> None:
        self._cancelled.set()

    def _enrich(self, budget: int, batch: int, cancelled: Callable[[], bool]) -> dict[str, int]:
        indexed = skipped = 0
        self.store.set_meta(backfill={"startedAt": self.hooks.now(), "completedAt": None})
        self.notify("index:start", source="backfill", budget=budget)
        while indexed < budget and not cancelled():
            urls = self.pending().orderBy("place").limit(min(batch, budget - indexed)).select("url").cache()
            if urls.isEmpty():
                break
            pages, failed = self._read(urls)
            n, bad = pages.count(), failed.count()
            if n:
                self._store_pages(pages)
            if bad:
                self.store.add_skipped(failed)
            indexed, skipped = indexed + n, skipped + bad
            self.notify("enrich:progress", indexed=indexed, skipped=skipped)
            pages.unpersist()
            urls.unpersist()
        remaining = self.pending().count()
        if not remaining:
            self.store.set_meta(backfill={"completedAt": self.hooks.now()})
        self.notify("enrich:done", indexed=indexed, skipped=skipped, remaining=remaining, completed=not remaining, cancelled=cancelled())
        return {"indexed": indexed, "skipped": skipped, "remaining": remaining}

    def revalidate(self) -> dict[str, int]:
        """Fetches all stored pages again with their validators: changed ones are stored anew, those that are gone dropped."""
        stored = self.store.table("pages").cache()
        fetched = self.hooks.fetch(stored.select("url", "etag", "last_modified")).cache()
        pages = page_rows(fetched).cache()
        outcome = stored.join(fetched.select("url", site.outcome_of(fetched).alias("kind")), "url", "left").join(pages.select("url", F.col("hash").alias("new_hash")), "url", "left")
        outcome = outcome.select("url", index.revalidation("kind", "hash", "new_hash").alias("outcome")).cache()
        counts = {r.outcome: r.n for r in outcome.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        if counts.get("changed"):
            self._store_pages(pages.join(outcome.where("outcome = 'changed'"), "url", "left_semi"))
        if counts.get("removed"):
            self.store.delete_pages(outcome.where("outcome = 'removed'"))
        self.store.set_meta(revalidatedAt=self.hooks.now())
        return {"checked": sum(counts.values()), "changed": counts.get("changed", 0), "removed": counts.get("removed", 0)}

    # asking

    def _query(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([("q", query, embed_one(query, self.hooks.embedder))], "query_id string, text string, vector array<float>")

    def _hits(self, name: str, query: DataFrame, limit: int) -> DataFrame:
        rows = self.store.table(name)
        vectors = rows.select("id" if name == "chunks" else F.col("url").alias("id"), "vector").where("vector is not null")
        return fusion.hybrid(None, vectors, query, limit, ranked=lambda asked, depth: self.store.bm25(name, asked, depth), rows=query.collect())

    def _citations(self, query: DataFrame) -> list[dict]:
        hits = fusion.grounded(self._hits("chunks", query, PASSAGES))
        rows = hits.join(self.store.table("chunks").select("id", "url", "heading_path", "body"), "id").join(self.store.table("pages").select("url", "title"), "url", "left")
        title = F.coalesce("title", F.get("heading_path", F.lit(0)), "url")
        return [r.asDict() for r in rows.orderBy("place").select("id", "url", title.alias("title"), "heading_path", "body", "score", "dense").collect()]

    def ask(self, query: str, current_url: str | None = None, max_fetch: int = MAX_FETCH) -> AskResult:
        """Passages that answer a question, or suggestions where nothing is close enough.

        If no stored passage is grounded, the best routes are read one after the other, up to max_fetch pages, until one is.
        """
        query = query.strip()
        if not query:
            return AskResult(query, False, [], [], [])
        q = self._query(query).cache()
        fetched: list[str] = []

        def read(url: str) -> bool:
            one = self.spark.createDataFrame([(url,)], "url string")
            pages, _ = self._read(one)
            found = not pages.isEmpty()
            if found:
                self._store_pages(pages)
                fetched.append(url)
            pages.unpersist()
            return found

        if current_url and self.store.table("pages").where(F.col("url") == current_url).isEmpty():
            read(current_url)
            fetched.clear()
        citations = self._citations(q)
        if not citations and max_fetch > 0:
            routes = self._hits("manifest", q, 3 * max_fetch).orderBy("place").select("id").cache()
            unread = [r.id for r in routes.withColumnRenamed("id", "url").join(self.store.table("pages"), "url", "left_anti").select(F.col("url").alias("id")).collect()]
            order = {r.id: k for k, r in enumerate(routes.collect())}
            for url in sorted(unread, key=order.__getitem__):
                if len(fetched) >= max_fetch:
                    break
                if read(url):
                    citations = self._citations(q)
                    if citations:
                        break
        if not citations:
            return AskResult(query, False, [], self.suggest(q), fetched)
        return self._written(AskResult(query, True, citations, [], fetched))

    def suggest(self, query: DataFrame, limit: int = SUGGESTIONS) -> list[dict]:
        hits = self._hits("manifest", query, limit)
        titles = self.store.table("manifest").select(F.col("url").alias("id"), "slug_title")
        rows = hits.join(titles, "id", "left").orderBy("place").select(F.col("id").alias("url"), F.coalesce(F.nullif("slug_title", F.lit("")), "id").alias("title"))
        return [r.asDict() for r in rows.collect()]

    def _written(self, result: AskResult) -> AskResult:
        """The result with prose, if there is a generator and what it wrote holds; else the passages alone."""
        if self.hooks.generate is None:
            return result
        shape = "query string, citations array<struct<id:string,url:string,title:string,heading_path:array<string>,body:string,score:double,dense:double>>"
        rows = self.spark.createDataFrame([(result.query, [tuple(c[k] for k in ("id", "url", "title", "heading_path", "body", "score", "dense")) for c in result.citations])], shape)
        packed = rows.select(answers.messages("query", "citations").alias("messages"), answers.packed_sources("citations").alias("taken")).first()
        sources = [result.citations[i] for i in packed.taken]
        try:
            raw = self.hooks.generate([(m.role, m.content) for m in packed.messages])
        except Exception:  # noqa: BLE001
            return result
        judged = self.spark.createDataFrame([(raw, "\n".join(c["body"] for c in sources))], "raw string, bodies string")
        p = judged.select(answers.processed("raw", F.lit(len(sources))).alias("p"), "bodies").select("p.*", answers.unsupported_number("p.text", "bodies").alias("invented")).first()
        if not p.refused and not p.invented:
            result.answer, result.sources, result.cited = p.text, sources, list(p.cited)
        return result

    # overview

    def topics(self, limit: int = 6) -> dict:
        manifest = self.store.table("manifest")
        rows = manifest.select(F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), "url", F.coalesce("slug_title", slug_title("url")).alias("slug_title"), F.coalesce("segments", F.array().cast("array<string>")).alias("segments"), "category", "questions", "priority")
        from pyspark.sql import Window

        entries = rows.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("url")).cast("bigint"))
        counted = manifest.agg(F.count("*").alias("total"), F.count("enriched_at").alias("enriched")).first()
        return {
            "tree": [r.asDict() for r in topics.category_tree(entries).orderBy("site", "path").collect()],
            "suggestions": [r.asDict() for r in topics.suggestions(entries, limit).orderBy("site", "place").collect()],
            "total": counted.total, "enriched": counted.enriched,
        }

    def stats(self) -> dict[str, int]:
        return self.store.stats()


def table_fetcher(pages: DataFrame) -> Fetcher:
    """A fetcher that serves a table of fetched pages (url, status, html, etag, last_modified, fetched_at).

    A url that isn't there is a 404; one whose validators the request names is not modified.
    """
    def fetch(urls: DataFrame) -> DataFrame:
        asked = urls.select("url", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
        joined = asked.join(pages.select("url", "status", "html", "etag", "last_modified", "fetched_at"), "url", "left")
        same = F.coalesce(F.col("_etag") == F.col("etag"), F.col("_modified") == F.col("last_modified"), F.lit(False))
        return joined.select(
            "url", F.when(same, 304).otherwise(F.coalesce("status", F.lit(404))).alias("status"), F.when(~same, F.col("html")).alias("html"), same.alias("not_modified"),
            "etag", "last_modified", F.coalesce("fetched_at", F.lit(0).cast("bigint")).alias("fetched_at"),
        )

    return fetch
