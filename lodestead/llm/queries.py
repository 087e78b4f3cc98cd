"""Registered queries of the subpackage and, where SQL can say the same over whole tables, their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestead.llm import boilerplate, leakage, near_duplicates, neighbours, packing, repeated_lines, residue, shared_spans, splitting
from lodestead.tables import table


PAGE_COLUMNS = ("page_id", "fetch_id", "url", "title", "blocks")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    fetched = table(spark, d, "fetched_pages").select("fetch_id", "url", "html")
    return boilerplate.classify(table(spark, d, "extracted_pages").select(*PAGE_COLUMNS), fetched)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture(_classified(spark, d))


def p1_content(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages").select("page_id", "blocks", "text")
    return boilerplate.own_content(pages, _classified(spark, d)).select("page_id", F.size("blocks").alias("n_blocks"), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "extracted_pages").select("page_id", "url", "text"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages").select("page_id", "url", "text").distinct()
    return repeated_lines.without_repeated_lines(pages).select("page_id", "clean_text", F.size("removed_lines").alias("n_removed"))


def p2_sequences(spark: SparkSession, d: str) -> DataFrame:
    found, _ = repeated_lines.mined(table(spark, d, "extracted_pages").select("page_id", "url", "text"))
    return found.select("site", F.concat_ws(",", "pattern").alias("pattern"), "length", "support")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links, classes = near_duplicates.near_duplicates(table(spark, d, "extracted_pages").select("page_id", "text"))
    return near_duplicates.record_pairs(links, classes).select(F.col("a").alias("page_a"), F.col("b").alias("page_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    links, classes = near_duplicates.near_duplicates(table(spark, d, "extracted_pages").select("page_id", "text"))
    return near_duplicates.groups(links, classes).withColumnRenamed("id", "page_id")


def p3_walk(spark: SparkSession, d: str) -> DataFrame:
    """What the joins of tries visit, prune and find, by the rows of a trie."""
    rows, _, _ = near_duplicates.forest(table(spark, d, "extracted_pages").select("page_id", "text"))
    return near_duplicates.walk_counts(rows, near_duplicates.error_budget(near_duplicates.SIMILARITY))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "extracted_pages").select(*PAGE_COLUMNS, "text")
    return residue.judge_pages(pages, table(spark, d, "fetched_pages").select("fetch_id", "url", "html"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pages(spark, d).where("excluded").select("page_id")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks").select("id", "heading_path", "body"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("n_pieces > 1").select("id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumn("heading_path", F.array_join("heading_path", " > "))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = neighbours.usable_vectors(table(spark, d, "chunk_vectors").select("id", "vector"))
    routes = neighbours.usable_vectors(table(spark, d, "manifest_entries").select("url", "vector"), "url")
    return neighbours.neighbour_pairs(chunks).unionByName(neighbours.neighbour_pairs(routes))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every 20th vector by the hash of its id, against all; visits 40 % of the vectors for each, and no fewer than p6_found."""
    out = None
    for name, key in (("chunk_vectors", "id"), ("manifest_entries", "url")):
        vectors = neighbours.usable_vectors(table(spark, d, name).select(key, "vector"), key)
        asked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(20)) == 0)
        n = vectors.count()
        found = neighbours.nearest(vectors, asked, wanted=max(neighbours.visits_for(n), int(0.4 * n) + 1)).select(F.lit(name).alias("source"), "id", "neighbour", "similarity", "place")
        out = found if out is None else out.unionByName(found)
    return out


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents").select("doc_id", "n_tokens", "text"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "golden_cases").select("item_id", "passage"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where(F.col("longest_run") >= leakage.MIN_RUN).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return shared_spans.document_pairs(*shared_spans.shared_spans(documents), documents)


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "documents").select("doc_id", "text"))[0]


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return shared_spans.shared_share(*shared_spans.shared_spans(documents), documents)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_content, p2_found, p2_clean, p2_sequences, p3_found, p3_groups, p3_walk, p4_found, p4_pieces, p5_found, p5_pages, p6_found, p6_neighbours, p7_pack, p8_found, p8_leaks, p9_found, p9_spans, p9_shared)
}

#: White space that str.strip removes, for SQL's trim.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"

_P2_REPEATED = r"""
pages as (select distinct page_id, coalesce(lower(nullif(regexp_extract(url, '(?i)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')), '') as site, text
          from extracted_pages where page_id is not null and text is not null),
lines as (select page_id, site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from pages),
keyed as (select page_id, site, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') as k from lines),
sites as (select site, count(distinct page_id) as site_pages from pages group by site),
counted as (select site, k, count(distinct page_id) as support from keyed where k <> '' group by site, k),
repeated as (select site, k, support from counted join sites using (site) where support >= 5 and support * 10 >= site_pages)"""

_P3 = r"""
with pages as (select distinct page_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from extracted_pages where page_id is not null and text is not null),
long as (select page_id, w from pages where len(w) >= 60),
shingles as (select distinct page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from long),
sizes as (select page_id, count(*) as n from shingles group by 1),
common as (select a.page_id as page_a, b.page_id as page_b, count(*) as c from shingles a join shingles b on a.s = b.s and a.page_id < b.page_id group by 1, 2)
select page_a, page_b from common join sizes x on x.page_id = page_a join sizes y on y.page_id = page_b where c >= 0.7 * (x.n + y.n - c) - 1e-9"""

_P6 = r"""
with raw as (select 'c' as t, id, vector from chunk_vectors union all select 'm', url, vector from manifest_entries),
good as (select distinct t, id, vector::double[] as v from raw where id is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0
  and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0),
units as (select t, id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from good),
pairs as (select a.t, a.id as q, b.id as n, list_inner_product(a.u, b.u) as s from units a join units b on a.t = b.t and a.id <> b.id),
near as (select *, row_number() over (partition by t, q order by s desc, n) as r from pairs where s >= 0.9)
select distinct least(q, n) as id_a, greatest(q, n) as id_b from near where r <= 5"""

_P8 = r"""
with docs as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where doc_id is not null and text is not null),
items as (select distinct item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from golden_cases where item_id is not null and passage is not null),
d as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g from docs where len(w) >= 12),
p as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g from items where len(w) >= 12)
select distinct doc_id, item_id from d join p using (g)"""

_P9 = r"""
with docs as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 300),
windows as (select doc_id, hash(substr(text, i, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from docs)),
once as (select distinct doc_id, h from windows)
select distinct a.doc_id as doc_a, b.doc_id as doc_b from once a join once b on a.h = b.h and a.doc_id < b.doc_id"""

SQL = {
    "p2_found": f"with {_P2_REPEATED} select distinct page_id, cast(line_no as int) as line_no from keyed join repeated using (site, k)",
    "p3_found": _P3,
    "p6_found": _P6,
    "p8_found": _P8,
    "p9_found": _P9,
    "p4_found": f"select distinct id from chunks where length(trim(body, {_SPACE})) > 900",
}
