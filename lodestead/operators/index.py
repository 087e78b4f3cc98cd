"""Maintenance of the index as set operations: newest rows, merges, deletions, revalidation, cache keys."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions.text import col

#: Versions of what decides the meaning of stored rows.
SCHEMA_VERSION, CHUNKER_VERSION, EXTRACTOR_VERSION, ENRICHMENT_VERSION = 1, 1, 1, 1


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order of columns; nulls come first."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def oldest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order of columns; nulls come last."""
    w = Window.partitionBy(*keys).orderBy(*(F.asc_nulls_last(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new in place of those of the same keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_pages(chunks: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """chunks without those of the pages in urls(url): an id is its page's url, # and a number."""
    page = F.regexp_extract("id", r"(?s)^(.*)#[^#]*$", 1)
    gone = urls.select(F.col(url_col).alias("_page")).distinct()
    return chunks.withColumn("_page", page).join(gone, "_page", "left_anti").drop("_page")


def revalidation(kind: Column | str, old_hash: Column | str, new_hash: Column | str) -> Column:
    """unchanged, changed or removed: what a conditional fetch means for a stored page. A fetch that was skipped changes nothing."""
    return (
        F.when(col(kind) == "gone", "removed").when((col(kind) == "page") & ~col(old_hash).eqNullSafe(col(new_hash)), "changed").otherwise("unchanged")
    )


def cache_key(origin: Column | str, embedder: Column | str, site_version: Column | None = None) -> Column:
    version = F.lit("-") if site_version is None else F.coalesce(site_version, F.lit("-"))
    return F.concat_ws(
        "|", F.lit(f"s{SCHEMA_VERSION}"), col(origin), col(embedder), F.lit(f"c{CHUNKER_VERSION}"), F.lit(f"x{EXTRACTOR_VERSION}"), F.lit(f"e{ENRICHMENT_VERSION}"), version
    )
