"""Queries on the life of the index: newest pages, changes, deletions, revalidation, counters."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestead.catalogue.registry import Registry
from lodestead.operators import index
from lodestead.operators.site import fetch_outcome, unique_entries
from lodestead.tables import table

R = Registry()

_FETCHES = "fetches as (select distinct fetch_id, url, status, html is null as empty, not_modified, fetched_at from fetched_pages where url is not null)"
_PAGES = "pages as (select distinct page_id, url, title, hash, fetched_at from extracted_pages where url is not null)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").where("url is not null").select("page_id", "url", "title", "hash", "fetched_at").distinct()


@R.query(f"with {_PAGES} select url, page_id, hash from (select *, row_number() over (partition by url order by fetched_at desc nulls last, page_id desc) as n from pages) where n = 1")
def upsert_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page that stands for each url once all extractions are merged in order of fetching."""
    return index.newest(_pages(spark, d), ["url"], ["fetched_at", "page_id"]).select("url", "page_id", "hash")


@R.query(f"""with {_PAGES}, seen as (select *, lag(hash) over (partition by url order by fetched_at nulls first, page_id) as old, row_number() over (partition by url order by fetched_at nulls first, page_id) as n from pages)
select page_id, url, case when n = 1 then 'new' when hash is distinct from old then 'changed' else 'unchanged' end as kind from seen""")
def changed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whether the content hash of an extraction differs from that of the one before it."""
    w = Window.partitionBy("url").orderBy(F.asc_nulls_first("fetched_at"), "page_id")
    seen = _pages(spark, d).withColumn("old", F.lag("hash").over(w)).withColumn("n", F.row_number().over(w))
    kind = F.when(F.col("n") == 1, "new").when(~F.col("hash").eqNullSafe(F.col("old")), "changed").otherwise("unchanged")
    return seen.select("page_id", "url", kind.alias("kind"))


_OUTCOME = """case when status = 304 or coalesce(not_modified, false) then 'not-modified' when coalesce(status < 200 or status > 299, true) or empty then 'gone' else 'page' end"""


@R.query(f"""with {_FETCHES}, {_PAGES}, stored as (select url, hash, fetched_at from (select *, row_number() over (partition by url order by fetched_at nulls last, page_id) as n from pages) where n = 1),
newest_page as (select url, hash from (select *, row_number() over (partition by url order by fetched_at desc nulls last, page_id desc) as n from pages) where n = 1),
latest as (select url, {_OUTCOME} as kind from (select *, row_number() over (partition by url order by fetched_at desc nulls last, fetch_id desc) as n from fetches) where n = 1)
select case when l.kind is null or l.kind = 'not-modified' then 'unchanged' when l.kind = 'gone' then 'removed' when p.hash is distinct from s.hash then 'changed' else 'unchanged' end as outcome, count(*) as n
from stored s left join latest l using (url) left join newest_page p using (url) group by 1""")
def revalidate_counts(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the first stored extraction of each url at its latest fetch."""
    pages = _pages(spark, d)
    stored = index.oldest(pages, ["url"], ["fetched_at", "page_id"]).select("url", "hash")
    renewed = index.newest(pages, ["url"], ["fetched_at", "page_id"]).select("url", F.col("hash").alias("new_hash"))
    fetches = table(spark, d, "fetched_pages").where("url is not null").select("fetch_id", "url", "fetched_at", fetch_outcome().alias("kind")).distinct()
    latest = index.newest(fetches, ["url"], ["fetched_at", "fetch_id"]).select("url", "kind")
    outcome = index.revalidation("kind", "hash", "new_hash")
    return stored.join(latest, "url", "left").join(renewed, "url", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@R.query(f"""with {_FETCHES}, gone as (select distinct url from fetches where {_OUTCOME} = 'gone'), uchunks as (select distinct id, url, site from chunks)
select site, count(*) as n_left from uchunks c where not exists (select 1 from gone g where starts_with(c.id, g.url || '#')) group by 1""")
def delete_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are left per site once those of pages that are gone were removed, id by id."""
    fetches = table(spark, d, "fetched_pages").where("url is not null").select("url", fetch_outcome().alias("kind"))
    chunks = table(spark, d, "chunks").select("id", "url", "site").distinct()
    left = index.without_pages(chunks, fetches.where("kind = 'gone'").select("url"))
    return left.groupBy("site").agg(F.count("*").alias("n_left"))


@R.query("""select (select count(distinct url) from extracted_pages where url is not null) as pages, (select count(distinct id) from chunks where id is not null) as chunks,
(select count(distinct url) from manifest_entries where url is not null) as manifest""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    def n(name: str, key: str) -> DataFrame:
        return table(spark, d, name).agg(F.countDistinct(key).alias("n"))

    return n("extracted_pages", "url").select(F.col("n").alias("pages")).crossJoin(n("chunks", "id").select(F.col("n").alias("chunks"))).crossJoin(
        n("manifest_entries", "url").select(F.col("n").alias("manifest"))
    )


@R.query("""with entries as (select distinct url from manifest_entries where url is not null), r as (select distinct url from extracted_pages), s as (select distinct url from fetched_pages where status >= 400)
select count(*) as total, cast(coalesce(sum(cast(r.url is not null as int)), 0) as bigint) as indexed, cast(coalesce(sum(cast(r.url is null and s.url is not null as int)), 0) as bigint) as skipped,
cast(coalesce(sum(cast(r.url is null and s.url is null as int)), 0) as bigint) as remaining from entries e left join r on r.url = e.url left join s on s.url = e.url""")
def backfill_counts(spark: SparkSession, d: str) -> DataFrame:
    entries = unique_entries(table(spark, d, "manifest_entries")).select("url")
    read = table(spark, d, "extracted_pages").select("url").distinct().withColumn("r", F.lit(True))
    skipped = table(spark, d, "fetched_pages").where("status >= 400").select("url").distinct().withColumn("s", F.lit(True))
    joined = entries.join(read, "url", "left").join(skipped, "url", "left")

    def n(which):
        return F.coalesce(F.sum(which.cast("int")), F.lit(0)).cast("bigint")

    return joined.agg(
        F.count("*").alias("total"), n(F.col("r").isNotNull()).alias("indexed"), n(F.col("r").isNull() & F.col("s").isNotNull()).alias("skipped"),
        n(F.col("r").isNull() & F.col("s").isNull()).alias("remaining"),
    )


@R.query("select lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) as origin, 's1|' || lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) || '|hashed-words-64|c1|x1|e1|-' as cache_key from extracted_pages where url is not null group by all")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of the index of each origin."""
    from lodestead.functions.urls import url_origin

    origins = table(spark, d, "extracted_pages").where("url is not null").select(url_origin("url").alias("origin")).distinct()
    return origins.select("origin", index.cache_key("origin", F.lit("hashed-words-64")).alias("cache_key"))


QUERIES, SQL = R.queries, R.sql
