"""Site rules and the routing manifest: robots, fetch outcomes, sitemaps, pending pages, routing order."""

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestead.functions.text import col, route_text, routing_need
from lodestead.functions.urls import canonical_url, normal_url, slug_title, url_origin, url_path_query, url_segments

AGENT = "lodestead"
#: Body size, sitemap depth, pages of a manifest, age of a manifest in milliseconds.
MAX_BYTES, MAX_DEPTH, MAX_PAGES, MANIFEST_AGE = 2 * 1024 * 1024, 3, 500, 7 * 24 * 60 * 60 * 1000

RULES_SCHEMA = "agent string, ord int, allow boolean, pattern string, length int"


def parse_robots(text: str | None) -> tuple[list[tuple[str, int, bool, str, int]], list[str], list[str]]:
    """(rules, sitemaps, agents) of a robots.txt; an empty value is no rule; agents may have none."""
    rules, sitemaps, agents = [], [], []
    group: list[str] = []
    ruled = False
    for line in re.split(r"\r?\n", text or ""):
        field, colon, value = line.split("#", 1)[0].strip().partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "sitemap" and value:
            sitemaps.append(value)
        elif field == "user-agent":
            group = [value.lower()] if ruled else [*group, value.lower()]
            ruled = False
            agents += [a for a in group if a not in agents]
        elif field in ("allow", "disallow") and group:
            ruled = True
            if value:
                rules += [(a, len(rules) + k, field == "allow", value, len(value)) for k, a in enumerate(group)]
    return rules, sitemaps, agents


def rules_for(spark: SparkSession, text: str | None, agent: str = AGENT) -> DataFrame:
    """The rules of the group that holds for an agent: its own, else that of the longest prefix, else *."""
    rules, _, agents = parse_robots(text)
    agent = agent.lower()
    prefixes = sorted((a for a in agents if a != "*" and agent.startswith(a)), key=len)
    chosen = agent if agent in agents else prefixes[-1] if prefixes else "*"
    return spark.createDataFrame([r for r in rules if r[0] == chosen], RULES_SCHEMA)


def rule_regex(pattern: Column | str) -> Column:
    """A path pattern as a regular expression: * is anything, a final $ the end, the rest literal."""
    anchored = F.endswith(col(pattern), F.lit("$"))
    body = F.when(anchored, F.substring(col(pattern), F.lit(1), F.length(col(pattern)) - 1)).otherwise(col(pattern))
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(escaped, r"\*", ".*"), F.when(anchored, F.lit("$")).otherwise(""))


def robots_allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct urls with `allowed`: the longest matching rule decides, allow wins ties, no match allows.

    The rules of one robots.txt are few and are broadcast as a list into the plan, so a url meets them in its own task.
    """
    pages = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    found = rules.select(F.struct("length", "allow", rule_regex("pattern").alias("regex")).alias("r")).agg(F.collect_list("r").alias("rules"))
    path = url_path_query("url")
    joined = pages.crossJoin(F.broadcast(found))
    hit = F.filter("rules", lambda r: F.rlike(path, r["regex"]))
    best = F.array_max(F.transform(hit, lambda r: F.struct(r["length"], r["allow"])))
    return joined.select("url", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def fetch_permission(urls: DataFrame, rules: DataFrame, origin: str) -> DataFrame:
    """Distinct urls with `permitted`: of the origin and allowed by robots."""
    return robots_allowed(urls, rules).select("url", (F.coalesce(url_origin("url") == F.lit(origin), F.lit(False)) & F.col("allowed")).alias("permitted"))


def is_html_type(content_type: Column | str) -> Column:
    c = col(content_type)
    return c.isNull() | (c == "") | c.rlike("(?i)text/html|application/xhtml")


def within_size(html: Column | str, most: int = MAX_BYTES) -> Column:
    return F.coalesce(F.octet_length(col(html)) <= most, F.lit(True))


def fetch_outcome(status: Column | str = "status", html: Column | str = "html", not_modified: Column | str = "not_modified", reason: Column | str | None = None) -> Column:
    """not-modified, skip (too large, or the fetch gives a reason such as a timeout or another type), page, or gone (any other status, or no body).

    A page that was skipped says nothing about what is stored, so only gone may delete it.
    """
    s = col(status)
    skipped = F.lit(False) if reason is None else F.coalesce(col(reason) != "", F.lit(False))
    return (
        F.when((s == 304) | F.coalesce(col(not_modified), F.lit(False)), "not-modified")
        .when(skipped, "skip")
        .when(F.coalesce((s < 200) | (s > 299), F.lit(True)) | col(html).isNull(), "gone")
        .when(~within_size(html), "skip")
        .otherwise("page")
    )


def outcome_of(fetched: DataFrame) -> Column:
    """fetch_outcome of a table of fetched pages, with its `reason` where it has that column."""
    return fetch_outcome(reason="reason" if "reason" in fetched.columns else None)


def parse_sitemap(xml: str, base: str) -> tuple[list[dict], list[str]]:
    """(entries, nested sitemaps) of a sitemap document in any namespace; raises ET.ParseError if it isn't well-formed."""

    def local(e: ET.Element) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def text(e: ET.Element, name: str) -> str | None:
        return next((("".join(c.itertext())).strip() or None for c in e if local(c) == name), None)

    def number(value: str | None) -> float | None:
        try:
            n = float(value) if value is not None else None
        except ValueError:
            return None
        return n if n is not None and n == n and abs(n) != float("inf") else None

    root = ET.fromstring(xml.strip())
    entries, seen, nested = [], set(), []
    for e in root.iter():
        loc = text(e, "loc") if local(e) in ("url", "sitemap") else None
        url = normal_url(loc, base) if loc else None
        if url and local(e) == "sitemap":
            nested.append(url)
        elif url and url not in seen:
            seen.add(url)
            entries.append({"url": url, "lastmod": text(e, "lastmod"), "priority": number(text(e, "priority"))})
    return entries, nested


_SITEMAP = T.StructType([
    T.StructField("entries", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("lastmod", T.StringType()), T.StructField("priority", T.DoubleType())]))),
    T.StructField("nested", T.ArrayType(T.StringType())),
])


@F.pandas_udf(_SITEMAP)
def sitemap_content(xml: pd.Series, base: pd.Series) -> pd.DataFrame:
    """entries and nested of each sitemap; both null where the document is missing or malformed."""
    rows = []
    for x, b in zip(xml, base):
        try:
            rows.append(parse_sitemap(x, b) if x is not None else (None, None))
        except ET.ParseError:
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["entries", "nested"])


def read_sitemaps(documents: DataFrame, start: str, rules: DataFrame, origin: str, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Manifest entries reached from a sitemap over documents(url, xml), breadth first: (url, lastmod, priority, slug_title, segments).

    Nested sitemaps are followed to max_depth; what is missing or malformed is skipped; entries of other origins and
    those that robots forbid never enter. The first max_pages in order of level, document and position stay. Without any
    entry the start page's origin is the only one.
    """
    spark = documents.sparkSession
    parsed = documents.select("url", sitemap_content("xml", "url").alias("s")).select("url", "s.entries", "s.nested").cache()
    frontier = spark.createDataFrame([(start, 0)], "url string, doc int")
    seen = frontier.select("url")
    found = None
    for level in range(max_depth + 1):
        here = frontier.join(parsed, "url")
        entries = here.select(F.lit(level).alias("level"), "doc", F.posexplode("entries").alias("pos", "e")).select("level", "doc", "pos", "e.*")
        found = entries if found is None else found.unionByName(entries)
        nested = here.select("doc", F.posexplode("nested").alias("pos", "url")).join(seen, "url", "left_anti")
        nested = nested.groupBy("url").agg(F.min(F.struct("doc", "pos")).alias("at"))
        frontier = nested.withColumn("doc", F.row_number().over(Window.orderBy("at"))).select("url", "doc")
        if level == max_depth or frontier.isEmpty():
            break
        seen = seen.union(frontier.select("url"))
    first = Window.partitionBy("url").orderBy("level", "doc", "pos")
    unique = found.withColumn("n", F.row_number().over(first)).where("n = 1").where(url_origin("url") == F.lit(origin))
    allowed = robots_allowed(unique, rules).where("allowed").select("url")
    kept = unique.join(allowed, "url", "left_semi").orderBy("level", "doc", "pos").limit(max_pages)
    out = kept.select("url", "lastmod", "priority", slug_title("url").alias("slug_title"), url_segments("url").alias("segments"))
    return out if not out.isEmpty() else fallback_manifest(spark, origin + "/")


def fallback_manifest(spark: SparkSession, url: str) -> DataFrame:
    """A manifest of the one page."""
    one = spark.createDataFrame([(url,)], "url string")
    return one.select(
        canonical_url("url", F.lit(None).cast("string")).alias("url"), F.lit(None).cast("string").alias("lastmod"), F.lit(None).cast("double").alias("priority"),
        slug_title("url").alias("slug_title"), url_segments("url").alias("segments"),
    )


def unique_entries(manifest: DataFrame) -> DataFrame:
    """Manifest rows without repeats: of rows that share a url the one enriched last, then the least of the others."""
    order = [F.desc_nulls_last("enriched_at"), F.asc_nulls_last("lastmod"), F.asc_nulls_last("priority"), F.asc_nulls_last("description"), F.asc_nulls_last("summary")]
    return manifest.where("url is not null").withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("_n = 1").drop("_n")


def pending_pages(manifest: DataFrame, read: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Entries whose url was neither read nor skipped."""
    out = manifest.join(read.select("url").distinct(), "url", "left_anti")
    return out if skipped is None else out.join(skipped.select("url").distinct(), "url", "left_anti")


def by_routing_need(manifest: DataFrame, per: str | None = None) -> DataFrame:
    """Entries with `need` and `place`: those that offer the fewest distinct words first, then by priority, then by url.

    per: a column, such as the site, within whose values the places are counted; without it the manifest is that of one
    site, and so small that one task orders it.
    """
    ranked = manifest.withColumn("need", routing_need(route_text()))
    window = (Window.partitionBy(per) if per else Window).orderBy("need", F.desc(F.coalesce("priority", F.lit(0.0))), "url")
    return ranked.withColumn("place", F.row_number().over(window))


def manifest_is_fresh(built_at: Column | str, now: Column | str, age: int = MANIFEST_AGE) -> Column:
    return F.coalesce(col(now) - col(built_at) < age, F.lit(False))
