"""Reciprocal rank fusion and hybrid search."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.operators import dense, lexical

#: The fusion constant, the least candidates, and the relevance floor.
RRF_K, LEAST_CANDIDATES, RELEVANCE_FLOOR = 60, 24, 0.28


def fuse(lists: list[DataFrame], weights: list[float] | None = None, limit: int | None = 20, k: int = RRF_K, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score, place, *carry) of ranked lists (query_id, id, place from 1), ties by id.

    A list of weight 0 ranks nothing. carry: columns of some lists that hits keep, null where no list has one for them;
    they go through the same aggregation, so no list is joined again.
    """
    weights = weights or [1.0] * len(lists)
    union = None
    for df, w in zip(lists, weights):
        part = df.select(
            "query_id", "id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("place"))).alias("part"), *(F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in carry)
        )
        union = part if union is None else union.unionByName(part)
    scored = union.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.max("part").alias("most"), *(F.max(c).alias(c) for c in carry)).where("most > 0").drop("most")
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    ranked = ranked.select("query_id", "id", "score", "place", *carry)
    return ranked if limit is None else ranked.where(F.col("place") <= limit)


def candidates_for(limit: int) -> int:
    return max(4 * limit, LEAST_CANDIDATES)


def hybrid(
    texts: DataFrame | None, vectors: DataFrame, queries: DataFrame, limit: int = 8, candidates: int | None = None, weights: tuple[float, float] = (1.0, 1.0),
    ranked: Callable[[DataFrame, int], DataFrame] | None = None, rows: list | None = None,
) -> DataFrame:
    """(query_id, id, score, dense, lexical, place) for queries(query_id string, text, vector).

    Both retrievers give their best candidates, which are fused. A hit that only one of them has reports 0 for the
    other, whatever its true score is. ranked(queries, depth) ranks by words where there is an index; else texts are read.
    rows: the queries with a vector, where the caller has them at hand.
    """
    depth = candidates or candidates_for(limit)
    near = dense.search_all(vectors, queries.where("vector is not null").select("query_id", "vector") if rows is None else rows, depth)
    asked = queries.select("query_id", "text")
    words = ranked(asked, depth) if ranked else lexical.bm25(texts, asked, depth)
    fused = fuse([near, words.withColumn("lexical", F.col("score"))], list(weights), limit, carry=("dense", "lexical"))
    zero = F.lit(0.0)
    return fused.select("query_id", "id", "score", F.coalesce("dense", zero).alias("dense"), F.coalesce("lexical", zero).alias("lexical"), "place")


def grounded(hits: DataFrame, floor: float = RELEVANCE_FLOOR) -> DataFrame:
    """Hits whose cosine, as a 32-bit float, reaches the floor."""
    return hits.where(F.col("dense").cast("float") >= F.lit(floor).cast("double"))
