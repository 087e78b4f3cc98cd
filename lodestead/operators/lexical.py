"""Lexical index and search: term statistics and BM25, for one query or many."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.functions.text import tokenize

#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Query terms up to which they are sent to every executor; more are joined by shuffling.
BROADCAST_TERMS = 200_000
#: Query terms up to which a scan of stored postings filters by them.
FILTER_TERMS = 500


def unique_rows(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows with an id; of rows that repeat an id the smallest text; null text is empty."""
    return table.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.min(text_col), F.lit("")).alias("text"))


def tokens(table: DataFrame, keep_stopwords: bool = False) -> DataFrame:
    """(id, term), one row per token of table(id, text)."""
    return table.select("id", F.explode(tokenize("text", keep_stopwords)).alias("term"))


def postings(table: DataFrame, keep_stopwords: bool = False) -> DataFrame:
    """(id, term, tf): how often a term occurs in a text."""
    return tokens(table, keep_stopwords).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_lengths(table: DataFrame) -> DataFrame:
    """(id, dl): tokens of a text, with those that were added; a text without tokens has 0."""
    return table.select("id", F.size(tokenize("text")).cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(n, avgdl) in one row; 0 and 0 for an empty corpus."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def idf_table(table: DataFrame) -> DataFrame:
    """(term, df, idf) over all texts."""
    stats = corpus_stats(document_lengths(table))
    return document_frequencies(postings(table)).crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def bm25(table: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """(query_id, id, score, place): the k best texts for each of queries(query_id, text), ties by id; k None: all.

    Each distinct term of a query counts once. Tokens that no query asks for are dropped before anything is counted. The
    one row of corpus statistics is broadcast, and so are the query terms if they are few enough. Queries without a
    known term have no rows.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    at_hand = F.broadcast if few else lambda df: df
    tokenized = table.select("id", tokenize("text").alias("tokens"))
    stats = tokenized.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    found = tokenized.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(at_hand(terms.select("term").distinct()), "term", "left_semi")
    index = found.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return _scored(index, stats, terms, at_hand, k)


def bm25_index(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """bm25 on stored postings(term, id, tf, dl) and one row of stats (n, avgdl): nothing is tokenised but the queries.

    The distinct terms of few queries go into the scan's filter; those of many meet the postings in a join.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    wanted = [r.term for r in terms.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
    if len(wanted) <= FILTER_TERMS:
        return _scored(postings.where(F.col("term").isin(wanted)), stats, terms, F.broadcast, k)
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    at_hand = F.broadcast if few else lambda df: df
    return _scored(postings.join(at_hand(terms.select("term").distinct()), "term", "left_semi"), stats, terms, at_hand, k)


def _scored(index: DataFrame, stats: DataFrame, terms: DataFrame, at_hand, k: int | None) -> DataFrame:
    """(query_id, id, score, place) of the query terms on an index(term, id, tf, dl) that holds all postings of those."""
    weighted = document_frequencies(index).crossJoin(F.broadcast(stats)).select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl").join(terms, "term")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    hits = index.join(at_hand(weighted), "term").select("query_id", "id", part.alias("part"))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked if k is None else ranked.where(F.col("place") <= k)
