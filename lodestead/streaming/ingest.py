"""Ingest of fetched pages as a stream: each micro-batch is extracted, chunked, embedded and merged into the store."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestead.embedding import Embedder, hashed_words
from lodestead.functions import html
from lodestead.functions.text import trimmed
from lodestead.operators import index, site
from lodestead.plans.engine import chunk_rows
from lodestead.plans.store import Store

FETCHED_SCHEMA = "fetch_id bigint, url string, status int, html string, not_modified boolean, etag string, last_modified string, fetched_at bigint, ingested_at timestamp"


def fetched_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of fetched pages as they arrive in a folder."""
    return spark.readStream.schema(FETCHED_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def merge_batch(store: Store, fetched: DataFrame, embedder: Embedder = hashed_words) -> None:
    """Merges fetched pages: the newest fetch of each url counts, unless the store holds a newer one.

    Merging the same batch again changes nothing, so a batch that is replayed after a failure does no harm.
    """
    from pyspark.sql import functions as F

    latest = index.newest(fetched.where("url is not null"), ["url"], ["fetched_at", "fetch_id"]).withColumn("kind", site.outcome_of(fetched))
    known = store.table("pages").select("url", F.col("fetched_at").alias("_at"), F.col("hash").alias("_hash"))
    latest = latest.join(known, "url", "left").where("_at is null or fetched_at > _at").cache()
    pages = html.extract_pages(latest.where("kind = 'page'"), ("url", "fetched_at", "etag", "last_modified", "_hash")).where(trimmed("text") != "")
    changed = pages.where(~F.col("hash").eqNullSafe(F.col("_hash"))).drop("_hash").cache()
    if not changed.isEmpty():
        chunks = chunk_rows(changed, embedder)
        counted = chunks.groupBy("url").agg(F.count("*").cast("int").alias("n_chunks"))
        store.put_pages(changed.join(counted, "url", "left").drop("blocks", "text"), chunks)
    gone = latest.where("kind = 'gone' and _at is not null").select("url")
    if not gone.isEmpty():
        store.delete_pages(gone)
    changed.unpersist()
    latest.unpersist()


def start_ingest(stream: DataFrame, store: Store, checkpoint: str, embedder: Embedder = hashed_words, **trigger) -> StreamingQuery:
    """Starts the ingest; trigger as for DataStreamWriter.trigger, by default all that is there."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: merge_batch(store, batch, embedder))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
