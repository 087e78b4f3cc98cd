"""Problem 2: lines repeated across one site's documents, by distributed PrefixSpan over line identifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.tables import persisted, site_of

#: A line is repeated on at least this many pages of its site, and on at least this share of them.
MIN_PAGES = 5
MIN_SHARE = 0.1
#: Salts over which the pages of one site are spread when they meet the site's repeated lines.
SALTS = 32
#: Stands in a skeleton for lines that aren't frequent.
GAP = 0


def line_key(line):
    """64-bit identifier of a line: its letters in order, in lower case; null where it has none."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


def page_sequences(pages: DataFrame) -> DataFrame:
    """(page_id, site, keys): per page the identifiers of its lines in order, null for a line without letters.

    Byte-identical repeated rows count once. A null text or page_id is no page; a null or unparsable url puts the
    page into the site ''.
    """
    keys = F.transform(F.split("text", "\n", -1), line_key)
    return (
        pages.where(F.col("text").isNotNull() & F.col("page_id").isNotNull())
        .select("page_id", F.coalesce(site_of(F.col("url")), F.lit("")).alias("site"), keys.alias("keys"))
        .distinct()
    )


def frequent_lines(sequences: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """PrefixSpan's first level: (site, key, support, site_pages) of the single lines that are frequent on their site.

    Support counts distinct page_ids. Both counts are aggregated before the shuffle and spread over (site, key, page),
    so a site with a third of all pages makes no large task.
    """
    per_site = sequences.groupBy("site").agg(F.countDistinct("page_id").alias("site_pages"))
    lines = sequences.select("site", "page_id", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    support = lines.groupBy("site", "key").agg(F.countDistinct("page_id").alias("support")).where(F.col("support") >= min_pages)
    return support.join(per_site, "site").where(F.col("support") >= min_share * F.col("site_pages") - 1e-9)


def with_site_lines(sequences: DataFrame, frequent: DataFrame) -> DataFrame:
    """sequences plus `frequent_keys`, the frequent lines of the page's site.

    A site has at most (1 / min_share) times its mean number of lines of them, so the array is small; pages of one site
    are salted over SALTS tasks, which the session's skew join splits further where they are large.
    """
    per_site = frequent.groupBy("site").agg(F.collect_set("key").alias("frequent_keys"))
    salted = per_site.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sequences.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"]).drop("salt")


def page_skeletons(sequences: DataFrame, frequent: DataFrame) -> DataFrame:
    """(site, page_id, at, keys): the frequent lines of each page in order, with their positions.

    GAP stands, once, for all lines between two of them that aren't frequent; lines without letters are passed over. A
    page without frequent lines has no row. Only this skeleton matters to the mining, and many pages share one.
    """
    line = F.transform("keys", lambda k, i: F.struct(F.when(F.array_contains("frequent_keys", k), k).alias("key"), i.alias("no"), k.isNull().alias("blank")))
    rows = with_site_lines(sequences, frequent).select("site", "page_id", F.filter(line, lambda x: ~x["blank"]).alias("line"))
    rows = rows.withColumn("line", F.filter("line", lambda x, i: x["key"].isNotNull() | ((i > 0) & F.get("line", i - 1)["key"].isNotNull())))
    rows = rows.where(F.size("line") > 0)
    return rows.select("site", "page_id", F.transform("line", lambda x: x["no"]).alias("at"), F.transform("line", lambda x: F.coalesce(x["key"], F.lit(GAP))).alias("keys"))


def prefix_span(
    sequences: DataFrame,
    frequent: DataFrame,
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
    max_length: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Frequent sequences of consecutive lines per site, and the lines they cover.

    patterns (site, pattern array<bigint>, length, support); occurrences (page_id, line_no): the lines of all occurrences
    of patterns that no further line extends, which hold those of the others. The database is projected level by level:
    at each place of a skeleton stands the pattern of the level that begins there, if it is frequent; it grows by the
    next line, where the pattern from the second line on is frequent as well, and stays if enough pages have it.
    Skeletons that many pages share are counted once with their number of pages, and supports are aggregated before they
    are shuffled, so a site with a third of all pages makes no large task. A page_id with several texts counts with each
    in the support of longer sequences. Lines between which only letterless lines lie are consecutive; a line that isn't
    frequent interrupts. max_length None: until no pattern grows. Every level is written to the shared folder.
    """
    per_site = frequent.select("site", "site_pages").distinct()
    pages = persisted(page_skeletons(sequences, frequent).withColumn("skeleton", F.xxhash64("site", "keys")).withColumn("check", F.hash("keys", "site")), "p2-pages")
    level = pages.groupBy("site", "skeleton", "check", "keys").agg(F.count("*").alias("n_pages"))
    here = F.transform("keys", lambda k: F.when(k != GAP, k))
    level = persisted(level.withColumn("pattern", here).withColumn("reach", F.transform(here, lambda k: F.when(k.isNotNull(), 1).otherwise(0))), "p2-level1")
    known = frequent.select("site", F.col("key").alias("id"), F.array("key").alias("pattern"), "support")
    patterns, done = known.select("site", "pattern", F.lit(1).alias("length"), "support"), []
    length = 1
    while max_length is None or length < max_length:
        following = F.transform("pattern", lambda p, i: F.when(F.get("pattern", i + 1).isNotNull() & p.isNotNull(), F.struct(p.alias("before"), F.get("keys", i + length).alias("next"))))
        grown = level.withColumn("pair", F.transform(following, lambda x: F.when(x["next"] != GAP, x)))
        pairs = grown.select("site", "n_pages", F.explode(F.array_distinct("pair")).alias("x")).where("x is not null")
        counted = pairs.groupBy("site", "x").agg(F.sum("n_pages").alias("support")).where(F.col("support") >= min_pages).join(per_site, "site")
        counted = counted.where(F.col("support") >= min_share * F.col("site_pages") - 1e-9).select("site", F.col("x.before").alias("id"), F.col("x.next").alias("next"), "support")
        counted = persisted(counted.join(known.select("site", "id", "pattern"), ["site", "id"]), f"p2-counted{length + 1}")
        if counted.isEmpty():
            break
        length += 1
        known = counted.select("site", F.xxhash64("id", "next").alias("id"), F.concat("pattern", F.array("next")).alias("pattern"), "support")
        patterns = patterns.unionByName(known.select("site", "pattern", F.lit(length).alias("length"), "support"))
        ids = known.groupBy("site").agg(F.collect_set("id").alias("ids"))
        salted = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        active = grown.where(F.exists("pair", lambda x: x.isNotNull())).withColumn("salt", F.pmod("skeleton", F.lit(SALTS)).cast("int"))
        active = active.join(salted, ["site", "salt"])
        own = F.transform("pair", lambda x: F.when(x.isNotNull(), F.xxhash64(x["before"], x["next"])))
        active = active.withColumn("pattern", F.transform(own, lambda p: F.when(F.array_contains("ids", p), p)))
        active = active.where(F.exists("pattern", lambda p: p.isNotNull()))
        active = active.withColumn("reach", F.transform("reach", lambda r, i: F.when(F.get("pattern", i).isNotNull(), length).otherwise(r)))
        done.append(level)
        level = persisted(active.select(*level.columns), f"p2-level{length}")
    # a place's reach is that of the last level in which it is
    found = level
    for other in done:
        found = found.unionByName(other)
    found = found.groupBy("site", "skeleton", "check").agg(F.max_by("reach", F.array_max("reach")).alias("reach"))
    # what begins within the sequence before it and ends with it adds nothing
    spans = F.transform("reach", lambda r, i: F.when((r > 0) & ((i == 0) | (r >= F.get("reach", i - 1))), F.sequence(i, i + r - 1)))
    covered = found.select("site", "skeleton", "check", F.array_distinct(F.flatten(F.filter(spans, lambda x: x.isNotNull()))).alias("covered"))
    lines = pages.join(covered, ["site", "skeleton", "check"]).select("page_id", F.explode(F.transform("covered", lambda j: F.get("at", j))).alias("line_no"))
    return patterns, lines.distinct()


def mined(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """prefix_span of pages(page_id, url, text)."""
    sequences = persisted(page_sequences(pages), "p2-sequences")
    frequent = persisted(frequent_lines(sequences, min_pages, min_share), "p2-frequent")
    return prefix_span(sequences, frequent, min_pages, min_share, max_length)


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_length: int | None = None) -> DataFrame:
    """(page_id, line_no): the lines of every occurrence of a frequent sequence, single lines included.

    Lines come from the longest sequences mined there (max_length None: of any length); all lines of a frequent sequence
    are frequent themselves, so a shorter limit changes which sequence covers a line and no line.
    """
    return mined(pages, min_pages, min_share, max_length)[1]


def without_repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_length: int | None = None) -> DataFrame:
    """pages with `clean_text` and `removed_lines` (their positions); a page without repeated lines keeps its text.

    Null text stays null. Clashing column names of pages are kept under their own names, the new ones are replaced.
    """
    found = repeated_lines(pages, min_pages, min_share, max_length).groupBy("page_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))
    joined = pages.drop("removed_lines", "clean_text").join(found, "page_id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("removed_lines", i))
    return joined.withColumn(
        "clean_text", F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    ).withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
