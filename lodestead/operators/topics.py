"""Topics of a site: category tree, top categories, title shortening, suggested questions. All per site."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions.text import capitalised_words, col, first_word, slugify, split_title, trimmed
from lodestead.functions.urls import is_index_url


def shared_depth(entries: DataFrame) -> DataFrame:
    """(site, shared): leading segments that all pages of a site have in common; 0 with fewer than two pages."""
    sizes = entries.groupBy("site").agg(F.min(F.size("segments")).alias("shortest"), F.count("*").alias("n"))
    at = entries.select("site", F.posexplode("segments").alias("pos", "segment"))
    same = at.groupBy("site", "pos").agg(F.min("segment").alias("low"), F.max("segment").alias("high"), F.count("*").alias("m"))
    same = same.join(sizes, "site").where((F.col("low") != F.col("high")) | (F.col("m") < F.col("n"))).groupBy("site").agg(F.min("pos").alias("breaks"))
    joined = sizes.join(same, "site", "left")
    return joined.select("site", F.when(F.col("n") < 2, 0).otherwise(F.least("shortest", F.coalesce("breaks", "shortest"))).alias("shared"))


def title_sides(titles: DataFrame) -> DataFrame:
    """(site, side): which end of the site's titles is the site's name: tail, head or none.

    An end is the name if the first word of that end is the same in more than half of at least two titles of several parts.
    """
    multi = titles.select("site", split_title("title").alias("parts")).where("size(parts) > 1")
    leads = multi.select("site", F.explode(F.array(
        F.struct(F.lit("tail").alias("side"), first_word(F.element_at("parts", -1)).alias("lead")),
        F.struct(F.lit("head").alias("side"), first_word(F.element_at("parts", 1)).alias("lead")),
    )).alias("e")).select("site", "e.*")
    counts = leads.groupBy("site", "side", "lead").agg(F.count("*").alias("c"))
    most = counts.where("lead != ''").groupBy("site", "side").agg(F.max("c").alias("most"))
    totals = multi.groupBy("site").agg(F.count("*").alias("n"))
    named = most.join(totals, "site").where((F.col("n") >= 2) & (F.col("most") * 2 > F.col("n"))).groupBy("site").agg(F.max("side").alias("side"))
    return titles.select("site").distinct().join(named, "site", "left").select("site", F.coalesce("side", F.lit("none")).alias("side"))


def shortened(title: Column | str, side: Column | str) -> Column:
    """A title without the part that names the site; a title that would be left empty stays whole."""
    parts = split_title(title)
    kept = (
        F.when(F.size(parts) < 2, trimmed(title))
        .when(col(side) == "tail", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " — "))
        .when(col(side) == "head", F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), " — "))
        .otherwise(trimmed(title))
    )
    return F.when(kept == "", trimmed(title)).otherwise(kept)


def filed_pages(entries: DataFrame) -> DataFrame:
    """(site, url, ord, path, title, priority): each page with its category path and its title as shown.

    entries (site, url, ord, slug_title, segments, category, priority). The path is that of the segments below what all
    pages share; without any, the slug of the breadcrumb category, unless that names the place the site is mounted at.
    """
    depth = shared_depth(entries)
    first = entries.groupBy("site").agg(F.min_by("segments", "ord").alias("first_segments"))
    sides = title_sides(entries.select("site", F.col("slug_title").alias("title")))
    rows = entries.join(depth, "site").join(first, "site").join(sides, "site")
    mount = F.transform(F.slice("first_segments", F.lit(1), F.col("shared")), lambda s: capitalised_words(s, "Site"))
    below = F.slice("segments", F.col("shared") + 1, F.greatest(F.size("segments") - F.col("shared"), F.lit(0)))
    slug = slugify("category")
    category = F.when(F.col("category").isNull() | (F.col("category") == ""), F.array().cast("array<string>")).when(
        F.array_contains(mount, capitalised_words(slug, "Site")), F.array().cast("array<string>")
    ).otherwise(F.array(slug))
    title = F.when(F.array_contains(mount, F.col("slug_title")) & is_index_url("url"), "Home").otherwise(shortened("slug_title", "side"))
    return rows.select("site", "url", "ord", F.when(F.size(below) > 0, below).otherwise(category).alias("path"), title.alias("title"), F.coalesce("priority", F.lit(0.0)).alias("priority"))


def category_tree(entries: DataFrame) -> DataFrame:
    """(site, path, parent, label, depth, walk, n_pages, urls) as flat rows, the root with path ''.

    Directories above a page are nodes too, with 0 pages of their own. urls: the node's pages by priority, then order.
    walk: the node's place from 0 where the site is walked from its root, children by label, parents before children.
    """
    pages = filed_pages(entries)
    here = pages.select("site", "path", F.struct((-F.col("priority")).alias("p"), "ord", "url").alias("page"))
    above = here.select("site", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("path"))
    nodes = above.distinct()
    own = here.groupBy("site", "path").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    joined = nodes.join(own, ["site", "path"], "left")
    last = F.get("path", F.size("path") - 1)
    walk = F.row_number().over(Window.partitionBy("site").orderBy(F.transform("path", lambda s: F.struct(F.lower(capitalised_words(s, "Site")), s))))
    return joined.withColumn("walk", walk - 1).select(
        "site", F.array_join("path", "/").alias("path"),
        F.when(F.size("path") > 0, F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "/")).alias("parent"),
        F.when(F.size("path") > 0, capitalised_words(last, "Site")).otherwise("Site").alias("label"),
        F.size("path").alias("depth"), "walk", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"),
        F.transform(F.coalesce("pages", F.array().cast("array<struct<p:double,ord:bigint,url:string>>")), lambda p: p["url"]).alias("urls"),
    )


def top_categories(tree: DataFrame, limit: int = 6) -> DataFrame:
    """The site's categories with most pages of their own, ties in order of the walk: root first, children by label, parents before children."""
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n_pages"), "walk"))
    return tree.where("n_pages > 0").withColumn("place", place).where(F.col("place") <= limit)


def suggestions(entries: DataFrame, limit: int = 6, depth: int = 3, categories: int = 12, per_category: int = 4) -> DataFrame:
    """(site, place, text, url, category): things to ask, from entries with `questions`.

    The first question of each page in order, then the second, to `depth`; behind them page titles, one of each top
    category in turn. A text that was there in any case of letters is not repeated.
    """
    pages = filed_pages(entries).withColumn("path_key", F.array_join("path", "/"))
    labels = pages.select("site", "url", F.when(F.size("path") > 0, capitalised_words(F.get("path", F.size("path") - 1), "Site")).otherwise("Site").alias("category"))
    asked = entries.select("site", "url", "ord", F.posexplode("questions").alias("k", "text")).where((F.col("k") < depth) & (F.col("text") != ""))
    asked = asked.select("site", "url", "text", F.struct(F.lit(0).alias("phase"), F.col("k").cast("bigint").alias("a"), F.col("ord").alias("b")).alias("at"))
    tops = top_categories(category_tree(entries), categories).select("site", F.col("path").alias("path_key"), "place")
    n = F.row_number().over(Window.partitionBy("site", "path_key").orderBy(F.desc("priority"), "ord"))
    named = pages.withColumn("n", n).where(F.col("n") <= per_category).join(tops, ["site", "path_key"])
    named = named.select("site", "url", F.col("title").alias("text"), F.struct(F.lit(1).alias("phase"), F.col("n").cast("bigint").alias("a"), F.col("place").cast("bigint").alias("b")).alias("at"))
    all_of = asked.unionByName(named)
    once = all_of.withColumn("r", F.row_number().over(Window.partitionBy("site", F.lower("text")).orderBy("at", "url"))).where("r = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("at", "url"))).where(F.col("place") <= limit)
    return placed.join(labels, ["site", "url"], "left").select("site", "place", "text", "url", F.coalesce("category", F.lit("Site")).alias("category"))
