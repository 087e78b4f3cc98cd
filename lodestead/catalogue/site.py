"""Queries on site rules, URLs, the manifest and topics."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestead.catalogue import fragments as S
from lodestead.catalogue.registry import Registry
from lodestead.catalogue.retrieval import _ENTRIES
from lodestead.functions import urls
from lodestead.functions.text import route_text, routing_need
from lodestead.operators import site, topics
from lodestead.tables import site_of, table

R = Registry()

#: A robots.txt for the test pages.
ROBOTS = """# rules of the test
User-agent: otherbot
Disallow: /

User-agent: *
User-agent: lodestead
Disallow: /tmp/
Disallow: /docs/*.html$   # old pages
Allow: /docs/z
Disallow: /blog/b
Allow: /blog/b
Disallow: /pricing/*/
Disallow:
Sitemap: https://example.example/sitemap.xml
"""

_URLS = "urls as (select distinct url from fetched_pages where url is not null)"


def _fetched_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched_pages").where("url is not null").select("url").distinct()


def entries(spark: SparkSession, d: str) -> DataFrame:
    return site.unique_entries(table(spark, d, "manifest_entries"))


_PARTS = f"{_URLS}, pathed as (select url, {S.URL_PARTS} as path from urls), parted as (select url, list_filter(string_split(path, '/'), lambda p: p <> '') as parts from pathed)"
_STEM = r"regexp_replace(coalesce(parts[-1], ''), '(?i)\.[a-z0-9]+$', '')"
_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(src, '(?i)\.[a-z0-9]+$', ''), '[-_\s]+'), lambda w: w <> '')"


@R.query(f"""with {_PARTS}, src as (select url, parts, case when {_STEM} = '' or lower({_STEM}) = 'index' then coalesce(case when len(parts) > 1 then parts[-2] end, 'Home') else {_STEM} end as src from parted)
select url, case when len({_WORDS}) = 0 then 'Home' else array_to_string(list_transform({_WORDS}, lambda w: upper(w[1:1]) || w[2:]), ' ') end as slug_title,
array_to_string(list_slice(parts, 1, greatest(len(parts) - 1, 0)), '/') as segments from src""")
def describe_url(spark: SparkSession, d: str) -> DataFrame:
    return _fetched_urls(spark, d).select("url", urls.slug_title("url").alias("slug_title"), F.array_join(urls.url_segments("url"), "/").alias("segments"))


@R.query(rf"with {_URLS} select url, nullif(regexp_extract(lower(url), '^\s*(https?://[^/?#]+)', 1), '') as origin from urls")
def url_origin(spark: SparkSession, d: str) -> DataFrame:
    return _fetched_urls(spark, d).select("url", urls.url_origin("url").alias("origin"))


@R.query(rf"""with {_URLS} select url, regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) || case when regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1) like '/%' then '' else '/' end
|| regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1) as canonical from urls""")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return _fetched_urls(spark, d).select("url", urls.canonical_url("url", F.lit(None).cast("string")).alias("canonical"))


_NORMAL = r"""regexp_extract(lower({0}), '^(https?://[^/?#]+)', 1) || case when regexp_extract({0}, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1) like '/%' then '' else '/' end || regexp_extract({0}, '^[a-zA-Z]+://[^/?#]+([^#]*)', 1)"""


@R.query(rf"""with f as (select distinct fetch_id, url, nullif(regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1), '') as declared from fetched_pages where url is not null),
o as (select *, regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) as origin from f),
r as (select *, case when declared like '/%' then origin || declared else declared end as resolved from o)
select fetch_id, declared, case when regexp_extract(lower(resolved), '^(https?://[^/?#]+)', 1) = origin then {_NORMAL.format("resolved")} else {_NORMAL.format("url")} end as canonical from r""")
def declared_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The URL to index each fetched page under, with the one that it declares."""
    declared = F.nullif(F.regexp_extract("html", r'rel="canonical" href="([^"]*)"', 1), F.lit(""))
    rows = table(spark, d, "fetched_pages").where("url is not null").select("fetch_id", "url", declared.alias("declared")).distinct()
    return rows.select("fetch_id", "declared", urls.canonical_url("url", "declared").alias("canonical"))


@R.query(rf"with {_URLS}, pathed as (select url, {S.URL_PARTS} as path from urls) select url, path like '%/' or regexp_matches(path, '(?i)/index\.[a-z0-9]+$') as is_index from pathed")
def index_url_flag(spark: SparkSession, d: str) -> DataFrame:
    return _fetched_urls(spark, d).select("url", urls.is_index_url("url").alias("is_index"))


_RULES = [r for r in site.parse_robots(ROBOTS)[0] if r[0] == site.AGENT]
_RULE_ROWS = ", ".join(f"({str(a).lower()}, '{p}', {n})" for _, _, a, p, n in _RULES)
_ALLOWED = rf"""rules as (select *, '^' || replace(regexp_replace(case when pattern like '%$' then pattern[:-2] else pattern end, '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*')
 || case when pattern like '%$' then '$' else '' end as regex from (values {_RULE_ROWS}) t(allow, pattern, length)),
pathed as (select url, {S.URL_PARTS} || regexp_extract(url, '(\?[^#]*)', 1) as path from urls),
hits as (select url, allow, length, row_number() over (partition by url order by length desc, allow desc) as n from pathed join rules on regexp_matches(path, regex)),
decided as (select u.url, coalesce(h.allow, true) as allowed from urls u left join hits h on h.url = u.url and h.n = 1)"""


@R.query(f"with {_URLS}, {_ALLOWED} select url, allowed from decided")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    return site.robots_allowed(_fetched_urls(spark, d), site.rules_for(spark, ROBOTS))


@R.query(rf"with {_URLS}, {_ALLOWED}, most as (select regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) as origin, count(*) as n from urls group by 1 order by n desc, origin limit 1) select url, allowed and regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) = origin as permitted from decided cross join most")
def fetch_permission(spark: SparkSession, d: str) -> DataFrame:
    """Permission for the origin with most urls."""
    rows = _fetched_urls(spark, d)
    top = rows.groupBy(urls.url_origin("url").alias("origin")).count().orderBy(F.desc("count"), "origin").first()
    return site.fetch_permission(rows, site.rules_for(spark, ROBOTS), top.origin if top else "")


@R.query("""select distinct fetch_id, case when status = 304 or coalesce(not_modified, false) then 'not-modified' when coalesce(status < 200 or status > 299, true) or html is null then 'gone'
when octet_length(encode(html)) > 2097152 then 'skip' else 'page' end as kind from fetched_pages""")
def fetch_outcome(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetched_pages").select("fetch_id", site.fetch_outcome().alias("kind")).distinct()


_REASON = "case when octet_length(encode(html)) > 2097152 then 'too-large' when status >= 500 then 'error' when html is null and status between 200 and 299 then 'not-html' end"


@R.query(f"""select distinct fetch_id, {_REASON} as reason, case when status = 304 or coalesce(not_modified, false) then 'not-modified' when {_REASON} is not null then 'skip'
when coalesce(status < 200 or status > 299, true) or html is null then 'gone' else 'page' end as kind from fetched_pages""")
def fetch_outcome_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of fetches whose fetcher said why there is no page: those are skipped, whatever the status, and delete nothing."""
    status = F.col("status")
    reason = F.when(~site.within_size("html"), "too-large").when(status >= 500, "error").when(F.col("html").isNull() & status.between(200, 299), "not-html")
    rows = table(spark, d, "fetched_pages").withColumn("reason", reason)
    return rows.select("fetch_id", "reason", site.outcome_of(rows).alias("kind")).distinct()


@R.query("""with f as (select distinct fetch_id, url, status, not_modified, etag, last_modified, fetched_at from fetched_pages where url is not null)
select fetch_id, lag(etag) over w as if_none_match, lag(last_modified) over w as if_modified_since from f window w as (partition by url order by fetched_at, fetch_id)""")
def conditional_requests(spark: SparkSession, d: str) -> DataFrame:
    """The validators that a fetch of a url sends: those of the fetch before it."""
    rows = table(spark, d, "fetched_pages").where("url is not null").select("fetch_id", "url", "status", "not_modified", "etag", "last_modified", "fetched_at").distinct()
    w = Window.partitionBy("url").orderBy("fetched_at", "fetch_id")
    return rows.select("fetch_id", F.lag("etag").over(w).alias("if_none_match"), F.lag("last_modified").over(w).alias("if_modified_since"))


@R.query(f"with {_ENTRIES} select id as url, text as route_text, cast(len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) as int) as need from routes")
def route_texts(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("url", route_text().alias("route_text"), routing_need(route_text()).alias("need"))


_READ = "read as (select distinct url from extracted_pages where url is not null), skipped as (select distinct url from fetched_pages where status >= 400 and url is not null)"
_PENDING = f"{_ENTRIES}, {_READ}, pending as (select e.* from entries e where url not in (select url from read) and url not in (select url from skipped))"


def _pending(spark: SparkSession, d: str) -> DataFrame:
    read = table(spark, d, "extracted_pages").where("url is not null").select("url")
    skipped = table(spark, d, "fetched_pages").where("status >= 400 and url is not null").select("url")
    return site.pending_pages(entries(spark, d), read, skipped)


@R.query(f"with {_PENDING} select url, slug_title from pending")
def pending_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("url", "slug_title")


@R.query(rf"""with {_PENDING}, needs as (select p.url, p.priority, cast(len(list_distinct(list_filter(regexp_split_to_array(lower(r.text), '[^a-z0-9]+'), lambda w: w <> ''))) as int) as need from pending p join routes r on r.id = p.url)
select url, need, cast(row_number() over (partition by coalesce(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') order by need, coalesce(priority, 0) desc, url) as int) as place from needs""")
def routing_need_order(spark: SparkSession, d: str) -> DataFrame:
    pending = _pending(spark, d).withColumn("site", F.coalesce(site_of(F.col("url")), F.lit("")))
    return site.by_routing_need(pending, "site").select("url", "need", "place")


@R.query(f"with {_ENTRIES} select url, slug_title, priority from entries order by coalesce(priority, 0) desc, url limit 500")
def manifest_dedup_capped(spark: SparkSession, d: str) -> DataFrame:
    """At most 500 entries, as a manifest holds, the most important first."""
    return entries(spark, d).orderBy(F.desc(F.coalesce("priority", F.lit(0.0))), "url").limit(site.MAX_PAGES).select("url", "slug_title", "priority")


@R.query(f"""with {_ENTRIES} select e.url, coalesce(p.title, e.slug_title) as title, coalesce(p.description, e.description) as description, coalesce(p.category, e.category) as category, p.url is not null as enriched
from entries e left join (select url, min(title) as title, min(nullif(description, '')) as description, min(nullif(category, '')) as category from extracted_pages where url is not null group by 1) p on p.url = e.url""")
def enriched_entries(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries with what the page that was read says in place of the guess from its url."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    pages = table(spark, d, "extracted_pages").where("url is not null").groupBy("url").agg(
        F.min("title").alias("p_title"), F.min(blank("description")).alias("p_description"), F.min(blank("category")).alias("p_category")
    ).withColumn("read", F.lit(True))
    joined = entries(spark, d).join(pages, "url", "left")
    return joined.select(
        "url", F.coalesce("p_title", "slug_title").alias("title"), F.coalesce("p_description", "description").alias("description"),
        F.coalesce("p_category", "category").alias("category"), F.coalesce("read", F.lit(False)).alias("enriched"),
    )


def topic_entries(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries per site as the topic operators take them, in order of url."""
    rows = entries(spark, d).select(
        F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), "url", F.coalesce("slug_title", F.lit("")).alias("slug_title"),
        F.coalesce("segments", F.array().cast("array<string>")).alias("segments"), "category", "questions", "priority",
    )
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("url")).cast("bigint"))


def _cap(x: str, empty: str) -> str:
    words = rf"list_filter(regexp_split_to_array({x}, '[-_\s]+'), lambda w: w <> '')"
    return f"case when len({words}) = 0 then '{empty}' else array_to_string(list_transform({words}, lambda w: upper(w[1:1]) || w[2:]), ' ') end"


_PARTS_OF = r"list_filter(list_transform(regexp_split_to_array(slug_title, '\s+[—–|·]\s+|\s+-\s+'), lambda p: trim(p)), lambda p: p <> '')"
_FILED = rf"""{_ENTRIES}, te as (select coalesce(nullif(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), '') as site, url, coalesce(slug_title, '') as slug_title,
 coalesce(segments, []) as segments, category, questions, coalesce(priority, 0) as priority from entries),
teo as (select *, row_number() over (partition by site order by url) as ord from te),
sz as (select site, min(len(segments)) as shortest, count(*) as n from teo group by 1),
sg as (select site, unnest(range(0, len(segments))) as pos, unnest(segments) as s from teo),
br as (select g.site, min(pos) as breaks from (select site, pos, min(s) <> max(s) as d, count(*) as m from sg group by 1, 2) g join sz using (site) where d or m < n group by 1),
sh as (select sz.site, case when n < 2 then 0 else least(shortest, coalesce(breaks, shortest)) end as shared from sz left join br using (site)),
mp as (select site, {_PARTS_OF} as parts from teo where len({_PARTS_OF}) > 1),
ld as (select site, 'tail' as side, lower(regexp_split_to_array(parts[-1], '\s+')[1]) as lead from mp union all select site, 'head', lower(regexp_split_to_array(parts[1], '\s+')[1]) from mp),
nm as (select site, max(side) as side from (select site, side, max(c) as most from (select site, side, lead, count(*) as c from ld where lead <> '' group by all) group by 1, 2) join (select site, count(*) as n from mp group by 1) using (site) where n >= 2 and most * 2 > n group by 1),
fs as (select site, segments as first_segments from teo where ord = 1),
jn as (select teo.*, shared, coalesce(side, 'none') as side, list_transform(list_slice(first_segments, 1, shared), lambda x: {_cap("x", "Site")}) as mount,
  list_slice(segments, shared + 1, len(segments)) as below, regexp_replace(lower({S.trimmed("category")}), '{S.RUNS}', '-', 'g') as slug, {_PARTS_OF} as parts
  from teo join sh using (site) left join nm using (site) join fs using (site)),
filed as (select site, url, ord, priority, questions, case when len(below) > 0 then below when category is null or category = '' then [] when list_contains(mount, {_cap("slug", "Site")}) then [] else [slug] end as path,
  case when list_contains(mount, slug_title) and (({S.URL_PARTS}) like '%/' or regexp_matches({S.URL_PARTS}, '(?i)/index\.[a-z0-9]+$')) then 'Home' else coalesce(nullif(case when len(parts) < 2 then trim(slug_title)
   when side = 'tail' then array_to_string(list_slice(parts, 1, len(parts) - 1), ' — ') when side = 'head' then array_to_string(list_slice(parts, 2, len(parts)), ' — ') else trim(slug_title) end, ''), trim(slug_title)) end as title from jn),
nodes as (select distinct site, list_slice(path, 1, k) as path from (select site, path, unnest(range(0, len(path) + 1)) as k from filed)),
own as (select site, path, count(*) as n_pages, string_agg(url, ' ' order by priority desc, ord) as urls from filed group by 1, 2),
tree as (select n.site, array_to_string(n.path, '/') as path, case when len(n.path) > 0 then array_to_string(list_slice(n.path, 1, len(n.path) - 1), '/') end as parent,
  case when len(n.path) > 0 then {_cap("n.path[-1]", "Site")} else 'Site' end as label, cast(len(n.path) as int) as depth,
  cast(row_number() over (partition by n.site order by list_transform(n.path, lambda s: struct_pack(l := lower({_cap("s", "Site")}), s := s))) - 1 as int) as walk, cast(coalesce(o.n_pages, 0) as int) as n_pages, coalesce(o.urls, '') as urls
  from nodes n left join own o on o.site = n.site and o.path = n.path)"""


@R.query(f"with {_FILED} select * from tree")
def category_tree(spark: SparkSession, d: str) -> DataFrame:
    return topics.category_tree(topic_entries(spark, d)).withColumn("urls", F.array_join("urls", " "))


_TOPS = "tops as (select site, path, label, n_pages, row_number() over (partition by site order by n_pages desc, walk) as place from tree where n_pages > 0)"


@R.query(f"with {_FILED}, {_TOPS} select site, path, label, n_pages, cast(place as int) as place from tops where place <= 6")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return topics.top_categories(topics.category_tree(topic_entries(spark, d))).select("site", "path", "label", "n_pages", "place")


@R.query(f"with {_FILED} select site, url, array_to_string(path, '/') as path, title from filed")
def title_shortener(spark: SparkSession, d: str) -> DataFrame:
    return topics.filed_pages(topic_entries(spark, d)).select("site", "url", F.array_join("path", "/").alias("path"), "title")


@R.query(f"""with {_FILED}, {_TOPS}, asked as (select site, url, text, 0 as phase, k as a, ord as b from (select site, url, ord, unnest(range(0, len(questions))) as k, unnest(questions) as text from filed) where k < 3 and text <> ''),
pl as (select site, array_to_string(path, '/') as path, url, title, row_number() over (partition by site, path order by priority desc, ord) as n from filed),
named as (select pl.site, pl.url, pl.title as text, 1 as phase, pl.n as a, t.place as b from pl join tops t on t.site = pl.site and t.path = pl.path and t.place <= 12 where pl.n <= 4),
firsts as (select *, row_number() over (partition by site, lower(text) order by phase, a, b, url) as r from (select * from asked union all select * from named)),
placed as (select *, row_number() over (partition by site order by phase, a, b, url) as place from firsts where r = 1)
select p.site, cast(p.place as int) as place, p.text, p.url, case when len(f.path) > 0 then {_cap("f.path[-1]", "Site")} else 'Site' end as category from placed p join filed f on f.site = p.site and f.url = p.url where p.place <= 6""")
def suggest_questions(spark: SparkSession, d: str) -> DataFrame:
    return topics.suggestions(topic_entries(spark, d))


@R.query(f"with {_ENTRIES} select count(*) as total, count(enriched_at) as enriched from entries")
def topic_counters(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).agg(F.count("*").alias("total"), F.count("enriched_at").alias("enriched"))


QUERIES, SQL = R.queries, R.sql
