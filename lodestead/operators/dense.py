"""Dense search by brute force: native expressions for one query, Arrow matrices for many."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions.text import col

#: Numbers of the queries that one pass over the vectors compares, so that what is sent to executors is bounded.
QUERY_FLOATS = 4_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column | str) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    norm = l2_norm(v)
    return F.transform(col(v), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def usable(table: DataFrame, id_col: str = "id", dim: int = 64) -> DataFrame:
    """(id, vector) of rows with an id and `dim` numbers that are not all zero; the least vector of a repeated id."""
    ok = F.col(id_col).isNotNull() & (F.size("vector") == dim) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return table.where(ok).select(F.col(id_col).alias("id"), "vector").groupBy("id").agg(F.min("vector").alias("vector"))


def search(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """(id, dense): the k vectors with the largest cosine to the one row of query(vector), ties by id."""
    one = F.broadcast(query.limit(1).select(normalised("vector").alias("q")))
    scored = vectors.crossJoin(one).select("id", F.round(dot(normalised("vector"), "q"), 9).alias("dense"))
    return scored.orderBy(F.desc("dense"), "id").limit(k)


def search_all(vectors: DataFrame, queries: DataFrame | list, k: int = 10) -> DataFrame:
    """(query_id, id, dense, place): for each of queries(query_id string, vector) the k vectors of largest cosine, ties by id.

    queries may be rows at hand as well. They go to the executors in passes of at most QUERY_FLOATS numbers. Every task keeps k hits per query of
    each Arrow batch before the shuffle.
    """
    spark, out = vectors.sparkSession, None
    block: list = []

    def one_pass(rows: list) -> DataFrame:
        names = np.array([r.query_id for r in rows], object)
        q = np.array([r.vector for r in rows], np.float64)
        q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)).T.copy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sims = np.round(x @ q, 9)
                if n > k:  # all that tie with the k-th stay, so that ties go by id in the end
                    least = np.partition(sims, n - k, axis=0)[n - k]
                    at, which = np.nonzero(sims >= least[None, :])
                else:
                    at, which = (z.ravel() for z in np.indices(sims.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[which], pa.string()), batch.column("id").take(pa.array(at)), pa.array(sims[at, which])], names=["query_id", "id", "dense"]
                )

        return vectors.select("id", "vector").mapInArrow(run, "query_id string, id string, dense double")

    width = 1
    for r in queries if isinstance(queries, list) else queries.select("query_id", "vector").toLocalIterator():
        width = max(width, len(r.vector))
        block.append(r)
        if len(block) * width >= QUERY_FLOATS:
            out = one_pass(block) if out is None else out.unionByName(one_pass(block))
            block = []
    if block:
        out = one_pass(block) if out is None else out.unionByName(one_pass(block))
    if out is None:
        return spark.createDataFrame([], "query_id string, id string, dense double, place int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense"), "id"))
    return out.withColumn("place", place).where(F.col("place") <= k)
