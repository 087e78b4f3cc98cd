"""Queries on retrieval: BM25, dense search, fusion, hybrid search, grounding, suggestions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.catalogue import fragments as S
from lodestead.catalogue.registry import Registry
from lodestead.functions.text import route_text
from lodestead.operators import dense, fusion, lexical
from lodestead.operators.site import unique_entries
from lodestead.tables import persisted, table

R = Registry()


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    return lexical.unique_rows(table(spark, d, "chunks").select("id", "text"), "id", "text")


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return dense.usable(table(spark, d, "chunk_vectors"))


def golden_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden_cases").where("query is not null").select(F.col("item_id").alias("query_id"), F.col("query").alias("text")).distinct()


def route_texts(spark: SparkSession, d: str) -> DataFrame:
    return unique_entries(table(spark, d, "manifest_entries")).select(F.col("url").alias("id"), route_text().alias("text"))


def route_vectors(spark: SparkSession, d: str) -> DataFrame:
    return dense.usable(table(spark, d, "manifest_entries"), "url")


def paired_queries(spark: SparkSession, d: str, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id string, text, vector): each golden question with the vector of a chunk, both taken in order.

    There is no model here that would embed a question, so the n-th question takes the n-th usable vector by id: these
    queries test how searches are done, not what a question and its vector have to do with each other.
    """
    from pyspark.sql import Window

    questions = golden_queries(spark, d).withColumn("n", F.row_number().over(Window.orderBy("query_id")))
    found = (chunk_vectors(spark, d) if vectors is None else vectors).orderBy("id").limit(questions.count())
    vectors = found.withColumn("n", F.row_number().over(Window.orderBy("id"))).select("n", "vector")
    return questions.join(vectors, "n", "left").select(F.col("query_id").cast("string").alias("query_id"), "text", "vector")


_TEXTS = S.unique_rows("chunks", "id", "text", "texts")
_QUERIES = "queries as (select distinct item_id as query_id, query as text from golden_cases where query is not null)"
_BM25 = f"{_TEXTS}, {_QUERIES}, {S.bm25('texts', 'queries')}"
_VECTORS = S.usable_vectors("chunk_vectors", "id", "vectors") + f", units as (select id, {S.unit('vector')} as u from vectors)"
_PAIRED = f"""{_VECTORS}, nq as (select query_id, text, row_number() over (order by query_id) as n from queries),
nv as (select id, vector, row_number() over (order by id) as n from vectors),
paired as (select cast(q.query_id as varchar) as query_id, q.text, {S.unit('v.vector')} as u from nq q left join nv v using (n))"""
_DENSE = """near_all as (select p.query_id, x.id, round(list_inner_product(x.u, p.u), 9) as dense from paired p cross join units x where p.u is not null),
near as (select *, row_number() over (partition by query_id order by dense desc, id) as place from near_all)"""
_ENTRIES = """entries as (select * from (select *, row_number() over (partition by url order by enriched_at desc nulls last, lastmod nulls last, priority nulls last, description nulls last, summary nulls last) as rn
 from manifest_entries where url is not null) where rn = 1),
routes as (select url as id, trim(array_to_string(list_filter(list_concat([coalesce(slug_title, ''), coalesce(description, ''), coalesce(summary, ''), coalesce(category, '')], coalesce(segments, [])), lambda p: p <> ''), ' ')) as text from entries)"""


def _fused(dense_weight: float, lexical_weight: float, depth: int, limit: int) -> str:
    return f"""parts as (select query_id, id, {dense_weight}::double / (60::double + place) as part from near where place <= {depth}
 union all select cast(query_id as varchar), id, {lexical_weight}::double / (60::double + place) from scored where place <= {depth}),
fused_all as (select query_id, id, round(sum(part), 9) as score from parts where part > 0 group by 1, 2),
fused as (select *, row_number() over (partition by query_id order by score desc, id) as place from fused_all),
hybrid as (select f.query_id, f.id, f.score, coalesce(n.dense, 0) as dense, coalesce(s.score, 0) as lexical, f.place from fused f
 left join near n on n.query_id = f.query_id and n.id = f.id and n.place <= {depth}
 left join scored s on cast(s.query_id as varchar) = f.query_id and s.id = f.id and s.place <= {depth} where f.place <= {limit})"""


@R.query(f"with {_BM25} select query_id, id, round(score, 6) as score, cast(place as int) as place from scored where place <= 10")
def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(chunk_texts(spark, d), golden_queries(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@R.query(f"with {_BM25} select id, round(score, 6) as score, cast(place as int) as place from scored where query_id = (select min(query_id) from queries) and place <= 10")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    one = golden_queries(spark, d).orderBy("query_id").limit(1)
    return lexical.bm25(chunk_texts(spark, d), one, 10).select("id", F.round("score", 6).alias("score"), "place")


@R.query(f"with {S.usable_vectors('chunk_vectors', 'id', 'vectors')} select id, round(sqrt(list_sum(list_transform(vector::double[], lambda y: y * y))), 6) as norm from vectors")
def l2_norm(spark: SparkSession, d: str) -> DataFrame:
    return chunk_vectors(spark, d).select("id", F.round(dense.l2_norm("vector"), 6).alias("norm"))


@R.query(f"with {_VECTORS}, q as (select u from units order by id limit 1) select id, round(round(list_inner_product(units.u, q.u), 9), 6) as dense from units cross join q order by round(list_inner_product(units.u, q.u), 9) desc, id limit 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = chunk_vectors(spark, d)
    return dense.search(vectors, vectors.orderBy("id").limit(1).select("vector"), 10).select("id", F.round("dense", 6).alias("dense"))


@R.query(f"with {_QUERIES}, {_PAIRED}, {_DENSE} select query_id, id, round(dense, 6) as dense, cast(place as int) as place from near where place <= 10")
def dense_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = persisted(chunk_vectors(spark, d), "vectors")
    queries = paired_queries(spark, d, vectors).where("vector is not null").select("query_id", "vector")
    return dense.search_all(vectors, queries, 10).select("query_id", "id", F.round("dense", 6).alias("dense"), "place")


def _lists(spark: SparkSession, d: str, depth: int) -> list[DataFrame]:
    vectors = persisted(chunk_vectors(spark, d), "vectors")
    queries = paired_queries(spark, d, vectors)
    near = dense.search_all(vectors, queries.where("vector is not null").select("query_id", "vector"), depth)
    return [near, lexical.bm25(chunk_texts(spark, d), queries.select("query_id", "text"), depth)]


@R.query(f"with {_BM25}, {_PAIRED}, {_DENSE}, {_fused(1, 1, 24, 20)} select query_id, id, round(score, 6) as score, cast(place as int) as place from fused where place <= 20")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d, 24)).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@R.query(f"with {_BM25}, {_PAIRED}, {_DENSE}, {_fused(3, 1, 24, 20)} select query_id, id, round(score, 6) as score, cast(place as int) as place from fused where place <= 20")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d, 24), [3.0, 1.0]).select("query_id", "id", F.round("score", 6).alias("score"), "place")


@R.query(f"with {_BM25} select cast(query_id as varchar) as query_id, id, round(1::double / (60::double + place), 6) as score, cast(place as int) as place from scored where place <= 20")
def rrf_lexical_only(spark: SparkSession, d: str) -> DataFrame:
    """A list of weight 0 is skipped: the order of the other list alone."""
    return fusion.fuse(_lists(spark, d, 24), [0.0, 1.0]).select("query_id", "id", F.round("score", 6).alias("score"), "place")


_ROUTE_VECTORS = S.usable_vectors("manifest_entries", "url", "vectors") + f", units as (select id, {S.unit('vector')} as u from vectors)"
_PAIRED_ROUTES = _PAIRED.replace(_VECTORS, _ROUTE_VECTORS)
_HYBRID_COLUMNS = "query_id, id, round(score, 6) as score, round(dense, 6) as dense, round(lexical, 6) as lexical, cast(place as int) as place"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", *(F.round(c, 6).alias(c) for c in ("score", "dense", "lexical")), "place")


@R.query(f"with {_BM25}, {_PAIRED}, {_DENSE}, {_fused(1, 1, 32, 8)} select {_HYBRID_COLUMNS} from hybrid")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = persisted(chunk_vectors(spark, d), "vectors")
    return _rounded(fusion.hybrid(chunk_texts(spark, d), vectors, paired_queries(spark, d, vectors), limit=8))


@R.query(f"with {_ENTRIES}, {_QUERIES}, {S.bm25('routes', 'queries')}, {_PAIRED_ROUTES}, {_DENSE}, {_fused(1, 1, 36, 9)} select {_HYBRID_COLUMNS} from hybrid")
def hybrid_routes(spark: SparkSession, d: str) -> DataFrame:
    """The pages to read for each question, as the engine looks for them where no passage is close enough."""
    vectors = persisted(route_vectors(spark, d), "vectors")
    return _rounded(fusion.hybrid(route_texts(spark, d), vectors, paired_queries(spark, d, vectors), limit=9))


@R.query(f"with {_BM25}, {_PAIRED}, {_DENSE}, {_fused(1, 1, 24, 6)} select {_HYBRID_COLUMNS} from hybrid where cast(dense as float) >= 0.28::double")
def hybrid_grounded(spark: SparkSession, d: str) -> DataFrame:
    vectors = persisted(chunk_vectors(spark, d), "vectors")
    return _rounded(fusion.grounded(fusion.hybrid(chunk_texts(spark, d), vectors, paired_queries(spark, d, vectors), limit=6)))


@R.query(f"""with {_BM25}, {_PAIRED}, {_DENSE}, {_fused(1, 1, 24, 6)}
select p.query_id, count(h.id) > 0 as grounded, count(h.id) as n_citations from paired p left join hybrid h on h.query_id = p.query_id and cast(h.dense as float) >= 0.28::double group by 1""")
def grounded_or_refused(spark: SparkSession, d: str) -> DataFrame:
    vectors = persisted(chunk_vectors(spark, d), "vectors")
    queries = paired_queries(spark, d, vectors)
    hits = fusion.grounded(fusion.hybrid(chunk_texts(spark, d), vectors, queries, limit=6))
    counted = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(counted, "query_id", "left").select("query_id", F.coalesce(F.col("n") > 0, F.lit(False)).alias("grounded"), F.coalesce("n", F.lit(0)).alias("n_citations"))


@R.query(f"""with {_ENTRIES}, {_QUERIES}, {S.bm25('routes', 'queries')} select s.query_id, s.id as url, coalesce(nullif(e.slug_title, ''), s.id) as title, cast(s.place as int) as place from scored s join entries e on e.url = s.id where s.place <= 3""")
def route_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """The three routes to suggest for each question when it is refused, by the words of their routing text."""
    hits = lexical.bm25(route_texts(spark, d), golden_queries(spark, d), 3)
    titles = unique_entries(table(spark, d, "manifest_entries")).select(F.col("url").alias("id"), "slug_title")
    return hits.join(titles, "id").select("query_id", F.col("id").alias("url"), F.coalesce(F.nullif("slug_title", F.lit("")), "id").alias("title"), "place")


@R.query(f"""with {_BM25}, uchunks as (select distinct id, url, heading_path, body from chunks), pages as (select url, min(title) as title from extracted_pages group by 1)
select s.query_id, s.id, c.url, coalesce(nullif(p.title, ''), c.heading_path[1], c.url) as title, coalesce(array_to_string(c.heading_path, ' > '), '') as heading_path, cast(s.place as int) as place
from scored s join uchunks c on c.id = s.id left join pages p on p.url = c.url where s.place <= 6""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    """Hits with what a citation shows: page title, else the first heading, else the url."""
    hits = lexical.bm25(chunk_texts(spark, d), golden_queries(spark, d), 6)
    chunks = table(spark, d, "chunks").select("id", "url", "heading_path", "body").distinct()
    pages = table(spark, d, "extracted_pages").groupBy("url").agg(F.min("title").alias("title"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.get("heading_path", F.lit(0)), "url")
    return hits.join(chunks, "id").join(pages, "url", "left").select(
        "query_id", "id", "url", title.alias("title"), F.coalesce(F.array_join("heading_path", " > "), F.lit("")).alias("heading_path"), "place"
    )


@R.query(f"""with {_BM25}, hits as (select s.query_id, c.url from scored s join (select distinct id, url from chunks) c on c.id = s.id where s.place <= 6),
cases as (select distinct item_id, expect from golden_cases where expect is not null and query is not null and len(expect) > 0),
judged as (select item_id, coalesce(max(cast(len(list_filter(expect, lambda e: contains(h.url, e))) > 0 as int)), 0) as hit from cases c left join hits h on h.query_id = c.item_id group by 1)
select count(*) as n_cases, cast(sum(hit) as bigint) as n_hits, round(avg(hit), 6) as hit_rate from judged""")
def eval_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of the answerable golden questions of which an expected path is among the six best chunks."""
    chunks = table(spark, d, "chunks").select("id", "url").distinct()
    hits = lexical.bm25(chunk_texts(spark, d), golden_queries(spark, d), 6).join(chunks, "id").select(F.col("query_id").alias("item_id"), "url")
    cases = table(spark, d, "golden_cases").where("expect is not null and query is not null and size(expect) > 0").select("item_id", "expect").distinct()
    hit = F.exists("expect", lambda e: F.contains(F.col("url"), e)).cast("int")
    judged = cases.join(hits, "item_id", "left").groupBy("item_id").agg(F.coalesce(F.max(hit), F.lit(0)).alias("hit"))
    return judged.agg(F.count("*").alias("n_cases"), F.sum("hit").alias("n_hits"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@R.query("""select c.site, count(distinct c.id) as n_chunks, count(distinct case when v.id is not null then c.id end) as n_indexed
from chunks c left join (select distinct id from chunk_vectors where vector is not null and len(vector) = 64) v on v.id = c.id group by 1""")
def hydrated_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that have a vector of the right length, per site."""
    vectors = table(spark, d, "chunk_vectors").where(F.col("vector").isNotNull() & (F.size("vector") == 64)).select("id").distinct().withColumn("has", F.lit(1))
    joined = table(spark, d, "chunks").select("site", "id").distinct().join(vectors, "id", "left")
    return joined.groupBy("site").agg(F.countDistinct("id").alias("n_chunks"), F.count("has").alias("n_indexed"))


QUERIES, SQL = R.queries, R.sql
