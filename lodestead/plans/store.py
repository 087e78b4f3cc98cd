"""The stored index in a folder per cache key: pages, chunks with vectors, manifest, postings of both, meta.

Every table is cut into buckets by the hash of the page's url. A write makes a new version of the buckets that it touches
and then moves the pointer file, so readers see the old rows or the new ones, and an upsert costs what its buckets hold.
What a pointer has left is deleted once it is older than `grace`, so that readers who still hold it can finish. One writer
at a time, which a lock file guards; a lock that is older than `lock_age` was left by a writer that died. Paths are those
of the cluster's shared file system, reached through Hadoop's file system of the session.
"""

import hashlib
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.functions.text import route_text
from lodestead.operators import lexical

#: Buckets of a new index; a few thousand for sites of many million pages.
BUCKETS = 16
#: Seconds for which left versions stay, and after which a lock counts as left behind.
GRACE, LOCK_AGE = 3600.0, 3600.0

_POSTINGS = "term string, id string, url string, tf bigint, dl bigint"
SCHEMAS = {
    "pages": "url string, title string, description string, category string, hash string, etag string, last_modified string, fetched_at bigint, n_chunks int",
    "chunks": "id string, url string, chunk_index int, heading_path array<string>, text string, body string, vector array<float>",
    "manifest": "url string, slug_title string, segments array<string>, lastmod string, priority double, vector array<float>, description string, "
    "summary string, questions array<string>, category string, enriched_at bigint",
    "skipped": "url string",
    "chunk_postings": _POSTINGS,
    "manifest_postings": _POSTINGS,
}


class Store:
    def __init__(self, spark: SparkSession, folder: str, cache_key: str, buckets: int = BUCKETS, grace: float = GRACE, lock_age: float = LOCK_AGE):
        """Opens the index of a cache key. was_reset: there is no index of this key, but one of another."""
        self.spark, self.key, self.grace, self.lock_age = spark, cache_key, grace, lock_age
        self.root = f"{folder.rstrip('/')}/{hashlib.sha256(cache_key.encode()).hexdigest()[:20]}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(folder))
        others = [s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if s.isDirectory()]
        existed = self.root.rsplit("/", 1)[1] in others
        self.was_reset = bool(others) and not existed
        if not existed:
            self.fs.mkdirs(self._path(self.root))
            self._write_meta({
                "cacheKey": cache_key, "buckets": buckets, "tables": {}, "lengths": {}, "left": [], "manifestBuiltAt": None, "revalidatedAt": None,
                "backfill": {"startedAt": None, "completedAt": None},
            })
        self.buckets = self.meta()["buckets"]
        self._read: dict[str, tuple[list[str], DataFrame]] = {}

    # meta

    def _write_meta(self, meta: dict) -> None:
        """The pointer file, replaced by rename so that a reader finds the old or the new one."""
        new, old = self._path(f"{self.root}/meta.json.new"), self._path(f"{self.root}/meta.json")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        if self.fs.exists(old):
            self.fs.delete(old, False)
        self.fs.rename(new, old)

    def meta(self) -> dict:
        for name in ("meta.json", "meta.json.new"):
            path = self._path(f"{self.root}/{name}")
            if self.fs.exists(path):
                stream = self.fs.open(path)
                try:
                    return json.loads(bytes(stream.readAllBytes()))
                finally:
                    stream.close()
        raise FileNotFoundError(self.root)

    @contextmanager
    def _locked(self) -> Iterator[None]:
        lock = self._path(f"{self.root}/_lock")
        if not self.fs.createNewFile(lock):
            age = time.time() - self.fs.getFileStatus(lock).getModificationTime() / 1000
            if age <= self.lock_age:
                raise RuntimeError(f"another writer holds {lock}")
            self.fs.delete(lock, False)
            if not self.fs.createNewFile(lock):
                raise RuntimeError(f"another writer holds {lock}")
        try:
            yield
        finally:
            self.fs.delete(lock, False)

    def set_meta(self, **patch) -> dict:
        """Patches the meta data; values that are dicts are patched key by key."""
        with self._locked():
            meta = self.meta()
            for k, v in patch.items():
                meta[k] = meta[k] | v if isinstance(v, dict) and isinstance(meta.get(k), dict) else v
            self._write_meta(meta)
        return meta

    # rows

    def _bucket(self, url: str = "url"):
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, of some buckets or all; none if it was never written."""
        at = self.meta()["tables"].get(name, {})
        paths = [f"{self.root}/{name}-{version}/bucket={b}" for b, version in at.items() if version and (buckets is None or int(b) in buckets)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if buckets is not None:
            return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)
        # the files of a version never change, so they are listed once for all questions
        held = self._read.get(name)
        if held is None or held[0] != paths:
            held = self._read[name] = (paths, self.spark.read.schema(SCHEMAS[name]).parquet(*paths))
        return held[1]

    def touched(self, urls: DataFrame) -> list[int]:
        """The buckets of urls(url)."""
        return sorted(r.b for r in urls.select(self._bucket().alias("b")).distinct().collect())

    def _commit(self, changes: dict[str, DataFrame], buckets: list[int]) -> None:
        """New versions of these buckets of tables, all of them or none: the pointer moves once they are all written."""
        with self._locked():
            meta, version = self.meta(), str(time.time_ns())
            for name, df in changes.items():
                path = f"{self.root}/{name}-{version}"
                order = ["term", "id"] if "postings" in name else ["url"]
                rows = _filled(df, name).withColumn("bucket", self._bucket())
                rows.repartition(max(1, len(buckets)), "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
                at, written = meta["tables"].setdefault(name, {}), self._path(path)
                for b in buckets:
                    if at.get(str(b)):
                        meta["left"].append([f"{self.root}/{name}-{at[str(b)]}/bucket={b}", time.time()])
                    at[str(b)] = version if self.fs.exists(self._path(f"{path}/bucket={b}")) else None
                if not any(v == version for v in at.values()):
                    self.fs.delete(written, True)
                if "postings" in name:
                    texts = self._texts(changes, "chunks" if name == "chunk_postings" else "manifest")
                    sizes = lexical.document_lengths(texts).withColumn("bucket", F.pmod(F.xxhash64("id" if name[0] == "m" else F.regexp_extract("id", r"(?s)^(.*)#[^#]*$", 1)), F.lit(self.buckets)))
                    lengths = meta["lengths"].setdefault(name, {})
                    for b in buckets:
                        lengths.pop(str(b), None)
                    for r in sizes.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect():
                        lengths[str(r.bucket)] = [r.n, r.dl]
            kept = []
            for path, since in meta["left"]:
                if time.time() - since > self.grace:
                    self.fs.delete(self._path(path), True)
                else:
                    kept.append([path, since])
            meta["left"] = kept
            self._write_meta(meta)

    @staticmethod
    def _texts(changes: dict[str, DataFrame], name: str) -> DataFrame:
        """(id, text) of what a table's postings are made of."""
        if name == "chunks":
            return changes[name].select("id", F.coalesce("text", F.lit("")).alias("text"))
        return changes[name].select(F.col("url").alias("id"), route_text().alias("text"))

    def _with_postings(self, name: str, df: DataFrame) -> dict[str, DataFrame]:
        df = _filled(df, name)
        texts = self._texts({name: df}, name)
        index = lexical.postings(texts).join(lexical.document_lengths(texts), "id")
        url = F.regexp_extract("id", r"(?s)^(.*)#[^#]*$", 1) if name == "chunks" else F.col("id")
        return {name: df, f"{'chunk' if name == 'chunks' else name}_postings": index.withColumn("url", url)}

    def _upsert(self, name: str, rows: DataFrame, urls: DataFrame, buckets: list[int]) -> DataFrame:
        """The rows of these buckets with `rows` in place of those of urls(url)."""
        return self.table(name, buckets).join(urls, "url", "left_anti").unionByName(_filled(rows, name))

    def put_manifest(self, entries: DataFrame) -> None:
        """Replaces the manifest."""
        self._commit(self._with_postings("manifest", entries), list(range(self.buckets)))

    def put_manifest_entries(self, entries: DataFrame) -> None:
        urls = entries.select("url").distinct()
        at = self.touched(urls)
        if at:
            self._commit(self._with_postings("manifest", self._upsert("manifest", entries, urls, at)), at)

    def put_pages(self, pages: DataFrame, chunks: DataFrame) -> None:
        """Pages with their chunks in place of what those urls had. Every chunk needs a vector."""
        bare = chunks.where("vector is null").limit(1)
        if not bare.isEmpty():
            raise ValueError("a chunk without a vector")
        urls = pages.select("url").distinct()
        at = self.touched(urls)
        if at:
            self._commit({"pages": self._upsert("pages", pages, urls, at), **self._with_postings("chunks", self._upsert("chunks", chunks, urls, at))}, at)

    def delete_pages(self, urls: DataFrame) -> None:
        """Pages of urls(url) and their chunks; the manifest keeps them. Unknown urls change nothing."""
        gone = self.table("pages").select("url").join(urls.select("url").distinct(), "url", "left_semi")
        at = self.touched(gone)
        if at:
            none = {n: self.spark.createDataFrame([], SCHEMAS[n]) for n in ("pages", "chunks")}
            self._commit({"pages": self._upsert("pages", none["pages"], gone, at), **self._with_postings("chunks", self._upsert("chunks", none["chunks"], gone, at))}, at)

    def add_skipped(self, urls: DataFrame) -> None:
        urls = urls.select("url").distinct()
        at = self.touched(urls)
        if at:
            self._commit({"skipped": self._upsert("skipped", urls, urls, at)}, at)

    def clear(self) -> None:
        """Empties all tables and keeps the meta data."""
        with self._locked():
            meta, now = self.meta(), time.time()
            meta["left"] += [[f"{self.root}/{n}-{v}/bucket={b}", now] for n, at in meta["tables"].items() for b, v in at.items() if v]
            self._write_meta(meta | {"tables": {}, "lengths": {}})

    # searching

    def bm25(self, name: str, queries: DataFrame, k: int | None = 10) -> DataFrame:
        """lexical.bm25 of queries(query_id, text) on the stored postings of chunks or manifest; no text is read.

        A bucket's postings are sorted by term, so the scan skips what holds no term of the queries.
        """
        postings = "chunk_postings" if name == "chunks" else "manifest_postings"
        lengths = self.meta()["lengths"].get(postings, {}).values()
        n, total = sum(x for x, _ in lengths), sum(x for _, x in lengths)
        stats = self.spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(total / n if n else 0.0).alias("avgdl"))
        return lexical.bm25_index(self.table(postings), stats, queries, k)

    def stats(self) -> dict[str, int]:
        return {n: self.table(n).count() for n in ("pages", "chunks", "manifest")}


def _filled(df: DataFrame, name: str) -> DataFrame:
    fields = [c.split(" ", 1) for c in SCHEMAS[name].split(", ")]
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in fields))
