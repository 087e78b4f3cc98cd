"""Queries on text: tokens, statistics, sentences, headings, summaries, chunks, hashes."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestead.catalogue import fragments as S
from lodestead.catalogue.registry import Registry
from lodestead.functions import chunking, html, text
from lodestead.functions.hashing import content_hash
from lodestead.operators import lexical
from lodestead.tables import table

R = Registry()

_DOCS = S.unique_rows("documents", "doc_id", "text", "docs")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return lexical.unique_rows(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """One row per page_id: repeated rows are byte-identical."""
    return table(spark, d, "extracted_pages").dropDuplicates(["page_id"])


_PAGES = "pages as (select distinct page_id, url, title, blocks, text, hash from extracted_pages)"


@R.query(f"with {_DOCS}, {S.tokens('docs', 'id', 'text', 'tok')} select d.id as doc_id, count(t.term) as n_tokens, count(distinct t.term) as n_terms from docs d left join tok t on t.id = d.id group by 1")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.tokenize("text")
    return _documents(spark, d).select(F.col("id").alias("doc_id"), F.size(tokens).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("bigint").alias("n_terms"))


@R.query(f"with {_DOCS}, {S.tokens('docs', 'id', 'text', 'tok')} select id as doc_id, term, count(*) as tf from tok group by 1, 2")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(_documents(spark, d)).withColumnRenamed("id", "doc_id")


@R.query(f"with {_DOCS}, {S.tokens('docs', 'id', 'text', 'tok', False)} select term, count(*) as n, term in ({S.STOP}) as is_stop from tok group by 1")
def term_totals(spark: SparkSession, d: str) -> DataFrame:
    counted = lexical.tokens(_documents(spark, d), keep_stopwords=True).groupBy("term").agg(F.count("*").alias("n"))
    return counted.select("term", "n", text.is_stopword("term").alias("is_stop"))


_PHRASES = ("MRD-4400", "upgrade to version 3", "v3.2.1 is out", "ver 12", "v 2", "we have 34 people", "the rate limits are per organisation", "")


@R.query(
    "with phrases(phrase) as (values " + ", ".join(f"('{p}')" for p in _PHRASES) + f"), {S.tokens('phrases', 'phrase', 'phrase', 'tok')} select id as phrase, term, count(*) as n from tok group by 1, 2"
)
def version_bridge(spark: SparkSession, d: str) -> DataFrame:
    phrases = spark.createDataFrame([(p,) for p in _PHRASES], "id string").withColumn("text", F.col("id"))
    return lexical.postings(phrases).select(F.col("id").alias("phrase"), "term", F.col("tf").alias("n"))


@R.query(f"""with {_DOCS}, {S.tokens('docs', 'id', 'text', 'tok')}, dl as (select d.id, count(t.term) as dl from docs d left join tok t on t.id = d.id group by 1)
select count(*) as n, round(avg(dl), 6) as avgdl, cast(sum(dl) as bigint) as total, min(dl) as shortest, max(dl) as longest from dl""")
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    lengths = lexical.document_lengths(_documents(spark, d))
    return lengths.agg(
        F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("total"), F.min("dl").alias("shortest"), F.max("dl").alias("longest")
    )


@R.query(f"""with {_DOCS}, {S.tokens('docs', 'id', 'text', 'tok')}, stats as (select count(*) as n from docs), df as (select term, count(distinct id) as df from tok group by 1)
select term, df, round(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)), 6) as idf from df cross join stats""")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return lexical.idf_table(_documents(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


_SENTENCES = rf"""
with {_PAGES}, parts as (select page_id, unnest(range(1, len(blocks) + 1)) as pos, unnest(blocks) as b from pages),
split as (select page_id, pos, string_split(regexp_replace(b.text, '([.!?]){S.RUNS}', '\1' || chr(1), 'g'), chr(1)) as s from parts where b.type = 'text'),
each as (select page_id, pos, unnest(range(1, len(s) + 1)) as k, {S.trimmed('unnest(s)')} as sentence from split),
long as (select *, row_number() over (partition by page_id order by pos, k) as n from each where length(sentence) >= 20)"""


@R.query(f"{_SENTENCES} select page_id, n as place, substr(sentence, 1, 200) as sentence from long where n <= 3")
def lead_sentences(spark: SparkSession, d: str) -> DataFrame:
    leads = text.lead_sentences("blocks")
    return _pages(spark, d).select("page_id", F.posexplode(leads).alias("p", "sentence")).select("page_id", (F.col("p") + 1).cast("bigint").alias("place"), "sentence")


_HEADINGS = rf"""
with {_PAGES}, parts as (select page_id, title, unnest(range(1, len(blocks) + 1)) as pos, unnest(blocks) as b from pages),
heads as (select page_id, title, pos, {S.trimmed('b.text')} as heading from parts where b.type = 'heading'),
keyed as (select *, lower({S.squeezed('heading')}) as k from heads where length(heading) >= 3),
firsts as (select *, row_number() over (partition by page_id, k order by pos) as r from keyed where k <> lower({S.squeezed("coalesce(title, '')")})),
kept as (select page_id, pos, heading, row_number() over (partition by page_id order by pos) as place from firsts where r = 1)"""


@R.query(f"{_HEADINGS} select page_id, place, heading from kept")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    heads = text.headings_of("blocks", "title")
    return _pages(spark, d).select("page_id", F.posexplode(heads).alias("p", "heading")).select("page_id", (F.col("p") + 1).cast("bigint").alias("place"), "heading")


@R.query(_HEADINGS.replace("where k <> lower(" + S.squeezed("coalesce(title, '')") + ")", "where k <> ''") + " select page_id, heading from kept where heading like '%?'")
def question_headings(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.explode(text.question_headings("blocks")).alias("heading"))


@R.query(f"""{_SENTENCES}, {_HEADINGS.replace(_PAGES + ", parts", "parts2", 1).replace("from parts ", "from parts2 ").strip().removeprefix("with ")},
items as (select page_id, 0 as phase, place as n, heading as part from kept union all select page_id, 1, n, substr(sentence, 1, 200) from long where n <= 3),
heads_used as (select page_id, n, part, sum(length(part) + 1) over (partition by page_id order by n) as used from items where phase = 0),
heads_in as (select * from heads_used where used <= 700),
base as (select page_id, max(used) as used from heads_in group by 1),
leads_used as (select i.page_id, i.n, i.part, coalesce(b.used, 0) + sum(length(part) + 1) over (partition by i.page_id order by i.n) as used from items i left join base b using (page_id) where phase = 1),
chosen as (select page_id, 0 as phase, n, part from heads_in union all select page_id, 1, n, part from leads_used where used <= 700),
joined as (select page_id, string_agg(part, ' ' order by phase, n) as s from chosen group by 1)
select p.page_id, trim(coalesce(s, '')) as summary from pages p left join joined using (page_id) where blocks is not null""")
def page_summary(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("blocks is not null").select("page_id", text.summarize("blocks", "title").alias("summary"))


@R.query(rf"""with {_DOCS}, parts as (select id, unnest(string_split_regex(text, '\n{{2,}}')) as p from docs)
select id as doc_id, count(*) as n_blocks, cast(max(length({S.trimmed('p')})) as int) as longest from parts where {S.trimmed('p')} <> '' group by 1""")
def blocks_from_text(spark: SparkSession, d: str) -> DataFrame:
    blocks = _documents(spark, d).select("id", F.explode(text.blocks_from_text("text")).alias("b"))
    return blocks.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_blocks"), F.max(F.length("b.text")).alias("longest"))


@R.query(f"""{_HEADINGS}, used as (select page_id, place, heading, sum(length(heading) + 1) over (partition by page_id order by place) as used from kept)
select page_id, count(*) as n_kept, cast(max(used) as int) as used from used where used <= 200 group by 1""")
def greedy_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    kept = text.fitting_prefix(text.headings_of("blocks", "title"), 200)
    used = F.aggregate(kept, F.lit(0), lambda s, p: s + F.length(p) + 1)
    return _pages(spark, d).select("page_id", F.size(kept).cast("bigint").alias("n_kept"), used.alias("used")).where("n_kept > 0")


@R.query(f"""with {_PAGES}, parts as (select page_id, unnest(range(0, len(blocks))) as pos, unnest(blocks) as b from pages),
lev as (select page_id, pos, b.type as type, {S.trimmed('b.text')} as text, case when b.type = 'heading' then greatest(1, least(6, coalesce(b.level, 2))) end as lv from parts),
cross_up as (select t.page_id, t.pos, h.lv, h.pos as hpos, h.text as head from lev t join lev h on h.page_id = t.page_id and h.pos < t.pos and h.type = 'heading' and h.text <> '' where t.type = 'text' and t.text <> ''),
alive as (select c.* from cross_up c where not exists (select 1 from lev x where x.page_id = c.page_id and x.type = 'heading' and x.text <> '' and x.pos > c.hpos and x.pos < c.pos and x.lv <= c.lv)),
paths as (select page_id, pos, string_agg(head, ' > ' order by lv) as path from alive group by 1, 2)
select l.page_id, cast(l.pos as int) as pos, coalesce(path, '') as path from lev l left join paths p on p.page_id = l.page_id and p.pos = l.pos where l.type = 'text' and l.text <> ''""")
def heading_context(spark: SparkSession, d: str) -> DataFrame:
    """The headings in force at every text block: the last of each level, unless a higher one came since."""
    rows = _pages(spark, d).select("page_id", F.posexplode("blocks").alias("pos", "b"))
    rows = rows.select("page_id", "pos", F.col("b.type").alias("type"), text.trimmed("b.text").alias("text"), text.clamp_level("b.level").alias("level")).where("text != ''")
    so_far = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("type") == "heading"
    last = [F.last(F.when(heading & (F.col("level") == k), F.struct("pos", "text")), ignorenulls=True).over(so_far) for k in range(1, 7)]
    rows = rows.select("page_id", "pos", "type", *(c.alias(f"h{k}") for k, c in enumerate(last, 1)))
    parts = []
    for k in range(1, 7):
        above = [F.col(f"h{j}.pos") for j in range(1, k)]
        newest = F.greatest(*above) if len(above) > 1 else above[0] if above else None
        alive = F.lit(True) if newest is None else F.coalesce(newest < F.col(f"h{k}.pos"), F.lit(True))
        parts.append(F.when(alive, F.col(f"h{k}.text")))
    return rows.where("type = 'text'").select("page_id", "pos", F.concat_ws(" > ", *parts).alias("path"))


@R.query()
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    chunks = chunking.chunk_pages(pages.select("page_id", "blocks"), "page_id").withColumn("page_id", F.col("page_key").cast("bigint"))
    joined = chunks.join(pages.select("page_id", "url", "title"), "page_id")
    return joined.select(
        "page_id", F.concat("url", F.lit("#"), "chunk_index").alias("id"), "chunk_index", F.array_join("heading_path", " > ").alias("heading_path"), "body",
        text.compose("title", "heading_path", "body").alias("text"),
    )


_UNIQUE_CHUNKS = "uchunks as (select distinct * from chunks)"


@R.query(f"""with {_UNIQUE_CHUNKS}, firsts as (select id, heading_path, body, lead(heading_path) over (partition by url order by chunk_index, id) as nxt from uchunks)
select id, coalesce(array_to_string(case when len(heading_path) <= len(nxt) and list_slice(nxt, 1, len(heading_path)) = heading_path then heading_path
 when len(heading_path) > len(nxt) and list_slice(heading_path, 1, len(nxt)) = nxt then nxt end, ' > '), '-') as shared from firsts""")
def shared_heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """The heading path that a chunk and the next one of its page have in common."""
    rows = table(spark, d, "chunks").select("id", "url", "site", "chunk_index", "heading_path", "text", "body").distinct()
    following = F.lead("heading_path").over(Window.partitionBy("url").orderBy("chunk_index", "id"))
    return rows.withColumn("next", following).select("id", F.coalesce(F.array_join(text.common_path("heading_path", "next"), " > "), F.lit("-")).alias("shared"))


_UNITS = "list_transform(range(1, length(t) + 1), lambda i: unicode(t[i:i])::ubigint)"
_BASE36 = "ltrim(array_to_string(list_transform(range(10, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', cast((v // (36::hugeint ** k)::hugeint) % 36 as int) + 1, 1)), ''), '0')"


def _mix(a: str, b: str) -> str:
    return f"xor((xor({a}, {a} >> 16) * 2246822507::ubigint) & 4294967295::ubigint, (xor({b}, {b} >> 13) * 3266489909::ubigint) & 4294967295::ubigint)"


@R.query(f"""with {_PAGES}, input as (select page_id, '1 ' || coalesce(title, '') || ' ' || text as t from pages where text is not null),
lanes as (select page_id, list_reduce(list_concat([3735928559::ubigint], {_UNITS}), lambda a, u: (xor(a, u) * 2654435761::ubigint) & 4294967295::ubigint) as a,
 list_reduce(list_concat([1103547991::ubigint], {_UNITS}), lambda b, u: (xor(b, u) * 1597334677::ubigint) & 4294967295::ubigint) as b from input),
first as (select page_id, {_mix("a", "b")} as a, b from lanes),
ended as (select page_id, a, {_mix("b", "a")} as b from first),
val as (select page_id, (b & 2097151::ubigint)::hugeint * 4294967296 + a::hugeint as v from ended)
select page_id, {_BASE36} as hash from val""")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("1 "), F.coalesce("title", F.lit("")), F.lit(" "), "text")
    return _pages(spark, d).where("text is not null").select("page_id", content_hash(own).alias("hash"))


@R.query(f"with {_PAGES} select min(page_id) as first_page, count(distinct page_id) as n_pages, count(distinct url) as n_urls from pages where text is not null group by text having count(distinct page_id) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).where("text is not null").select("page_id", "url", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.length("text").alias("n"))
    return pages.groupBy("h1", "h2", "n").agg(F.min("page_id").alias("first_page"), F.countDistinct("page_id").alias("n_pages"), F.countDistinct("url").alias("n_urls")).where(
        "n_pages > 1"
    ).select("first_page", "n_pages", "n_urls")


@R.query(rf"""with {_PAGES} select page_id, cast(len(list_filter(list_transform(regexp_split_to_array(title, '\s+[—–|·]\s+|\s+-\s+'), lambda p: trim(p)), lambda p: p <> '')) as int) as n_parts,
lower(regexp_split_to_array(list_filter(list_transform(regexp_split_to_array(title, '\s+[—–|·]\s+|\s+-\s+'), lambda p: trim(p)), lambda p: p <> '')[-1], '\s+')[1]) as lead from pages where title is not null and trim(title) <> ''""")
def title_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = text.split_title("title")
    return _pages(spark, d).where("title is not null and trim(title) != ''").select("page_id", F.size(parts).alias("n_parts"), text.first_word(F.element_at(parts, -1)).alias("lead"))


@R.query(r"""select distinct id, length(substr(text, 1, 2000)) as n_read, case when length(text) > 300 then regexp_replace(substr(text, 1, 300), '\s+$', '') || '…' else text end as shown,
case when octet_length(encode(text)) >= 1000000 then round(octet_length(encode(text)) / 1e6)::bigint::varchar || ' MB' else round(octet_length(encode(text)) / 1e3)::bigint::varchar || ' kB' end as size
from chunks where text is not null""")
def clamped_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("text is not null").select("id", "text")
    return rows.select(
        "id", F.length(text.embed_input("text")).cast("bigint").alias("n_read"), text.clamp_text("text", 300).alias("shown"), text.format_bytes(F.octet_length("text")).alias("size")
    ).distinct()


@R.query()
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    fetched = table(spark, d, "fetched_pages").dropDuplicates(["fetch_id"])
    return html.extract_pages(fetched).select("fetch_id", "url", "title", "description", "category", F.size("blocks").alias("n_blocks"), "text", "hash", "lang")


@R.query(r"""with f as (select distinct fetch_id, html from fetched_pages where html is not null and status between 200 and 299)
select fetch_id, coalesce(nullif(trim(regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1)), ''), 'en') as lang from f""")
def page_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language that a page declares, as extraction gives it."""
    fetched = table(spark, d, "fetched_pages").where("html is not null and status between 200 and 299").dropDuplicates(["fetch_id"])
    return html.extract_pages(fetched).select("fetch_id", F.coalesce("lang", F.lit("en")).alias("lang"))


QUERIES, SQL = R.queries, R.sql
