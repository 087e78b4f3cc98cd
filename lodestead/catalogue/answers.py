"""Queries on prompts, answers and verdicts, over the golden cases."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestead.catalogue import fragments as S
from lodestead.catalogue.registry import Registry
from lodestead.catalogue.retrieval import _BM25, chunk_texts, golden_queries
from lodestead.operators import answers, lexical
from lodestead.tables import table

R = Registry()

_CASES = "cases as (select distinct item_id, query, passage, answer_must_contain, answer_match_any, answer_must_not_contain from golden_cases where item_id is not null)"
#: A raw answer to each case, as a generator may write it: reasoning, the passage, one valid marker and one that may be invented.
_RAW = "'<think>' || coalesce(query, '') || ' ...</think>  ' || coalesce(passage, 'NOT_FOUND') || ' [2] [1]  and [' || item_id || '] .<THINK>cut'"
_ANSWERS = f"{_CASES}, raw as (select item_id, {_RAW} as raw from cases)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    columns = ("item_id", "query", "passage", "answer_must_contain", "answer_match_any", "answer_must_not_contain")
    return table(spark, d, "golden_cases").where("item_id is not null").select(*columns).distinct()


def _raw(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(
        F.lit("<think>"), F.coalesce("query", F.lit("")), F.lit(" ...</think>  "), F.coalesce("passage", F.lit(answers.NOT_FOUND)), F.lit(" [2] [1]  and ["), F.col("item_id"), F.lit("] .<THINK>cut")
    )
    return cases(spark, d).select("item_id", raw.alias("raw"))


_CLEAN = f"{_ANSWERS}, clean as (select item_id, {S.trimmed(r'''regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', '')''')} as t from raw)"
_TEXT = r"""trim(regexp_replace(regexp_replace(case when item_id between 1 and 4 then t else replace(t, '[' || item_id || ']', '') end, '[ \t]+([.,;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'))"""


@R.query(f"with {_CLEAN} select item_id, t as text from clean")
def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("item_id", answers.without_reasoning("raw").alias("text"))


@R.query(f"with {_CLEAN} select item_id, array_to_string(list_filter(case when item_id between 3 and 4 then [2, 1, item_id] else [2, 1] end, lambda x: x >= 1), ',') as cited from clean")
def valid_citations(spark: SparkSession, d: str) -> DataFrame:
    clean = _raw(spark, d).select("item_id", answers.without_reasoning("raw").alias("t"))
    return clean.select("item_id", F.array_join(answers.cited_numbers("t", F.lit(4)).cast("array<string>"), ",").alias("cited"))


@R.query(f"""with {_CLEAN} select item_id, case when contains(t, 'NOT_FOUND') then '' else {_TEXT} end as text,
case when contains(t, 'NOT_FOUND') then '' when item_id between 3 and 4 then '2,1,' || item_id else '2,1' end as cited, contains(t, 'NOT_FOUND') as refused from clean""")
def process_answer(spark: SparkSession, d: str) -> DataFrame:
    done = _raw(spark, d).select("item_id", answers.processed("raw", F.lit(4)).alias("p"))
    return done.select("item_id", "p.text", F.array_join(F.col("p.cited").cast("array<string>"), ",").alias("cited"), "p.refused")


@R.query(f"""with {_CLEAN} select item_id, cast(case when item_id in (1, 2) then 7 when item_id in (3, 4) then 7 else 5 end as int) as n_parts, cast(case when item_id between 1 and 4 then 3 else 2 end as bigint) as n_citations from clean""")
def split_citations(spark: SparkSession, d: str) -> DataFrame:
    parts = _raw(spark, d).select("item_id", answers.split_citations(answers.without_reasoning("raw"), F.lit(4)).alias("parts"))
    return parts.select("item_id", F.size("parts").alias("n_parts"), F.size(F.filter("parts", lambda p: p["kind"] == "citation")).cast("bigint").alias("n_citations"))


@R.query(rf"""with {_CASES}, pairs as (select item_id, passage, coalesce(lag(passage) over (order by item_id), '') || ' ' || coalesce(query, '') as other from cases)
select item_id, len(list_filter(list_transform(regexp_extract_all(passage, '\d[\d,.]*'), lambda x: replace(regexp_replace(x, '[.,]+$', ''), ',', '')),
 lambda n: length(n) >= 2 and not contains(regexp_replace(other, '{S.RUNS}|,', '', 'g'), n))) > 0 as unsupported from pairs where passage is not null""")
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Whether a passage states a number that neither the passage before it nor its question has."""
    before = F.coalesce(F.lag("passage").over(Window.orderBy("item_id")), F.lit(""))
    pairs = cases(spark, d).select("item_id", "passage", F.concat(before, F.lit(" "), F.coalesce("query", F.lit(""))).alias("other"))
    return pairs.where("passage is not null").select("item_id", answers.unsupported_number("passage", "other").alias("unsupported"))


_MUST, _NOT = "coalesce(answer_must_contain, [])", "coalesce(answer_must_not_contain, [])"


@R.query(f"""with {_CASES} select item_id, case when passage is null or passage = '' then 'no-answer'
when len(list_filter({_NOT}, lambda x: contains(lower(passage), lower(x)))) > 0 then 'wrong-figure'
when case when coalesce(answer_match_any, false) then len(list_filter({_MUST}, lambda x: contains(lower(passage), lower(x)))) > 0
 else len(list_filter({_MUST}, lambda x: not contains(lower(passage), lower(x)))) = 0 end then 'correct' else 'missed-fact' end as verdict from cases""")
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on each reference passage as the answer to its own case."""
    judged = answers.verdict("passage", "answer_must_contain", "answer_match_any", "answer_must_not_contain")
    return cases(spark, d).select("item_id", judged.alias("verdict"))


@R.query(f"""with {_CASES}, judged as (select case when passage is null or passage = '' then 'no-answer'
when len(list_filter({_NOT}, lambda x: contains(lower(passage), lower(x)))) > 0 then 'wrong-figure'
when case when coalesce(answer_match_any, false) then len(list_filter({_MUST}, lambda x: contains(lower(passage), lower(x)))) > 0
 else len(list_filter({_MUST}, lambda x: not contains(lower(passage), lower(x)))) = 0 end then 'correct' else 'missed-fact' end as verdict from cases) select verdict, count(*) as n from judged group by 1""")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return judge_verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, text, citations): the six best chunks of each question in order, as prompts take them."""
    hits = lexical.bm25(chunk_texts(spark, d), golden_queries(spark, d), 6)
    chunks = table(spark, d, "chunks").groupBy("id").agg(F.min(F.struct("heading_path", "body")).alias("c"))
    one = F.struct("place", F.col("id").alias("title"), F.col("c.heading_path").alias("heading_path"), F.coalesce("c.body", F.lit("")).alias("body"))
    packed = hits.join(chunks, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("citations"))
    return packed.join(golden_queries(spark, d), "query_id")


_PACKED = f"""with {_BM25}, uchunks as (select id, min(struct_pack(h := heading_path, b := body)) as c from chunks group by 1),
cited as (select s.query_id, list(struct_pack(i := cast(s.place - 1 as int), n := length(coalesce(c.c.b, '')), used := 0::bigint, taken := []::int[]) order by s.place) as cs from scored s join uchunks c on c.id = s.id where s.place <= 6 group by 1),
packed as (select query_id, list_reduce(list_prepend(struct_pack(i := -1::int, n := 0::bigint, used := 0::bigint, taken := []::int[]), cs), lambda a, x: case when len(a.taken) < 4 and (len(a.taken) = 0 or a.used + x.n <= 2400)
 then struct_pack(i := x.i, n := x.n, used := a.used + x.n, taken := list_append(a.taken, x.i)) else struct_pack(i := x.i, n := x.n, used := a.used, taken := a.taken) end) as r from cited)"""


@R.query(f"{_PACKED} select query_id, array_to_string(r.taken, ',') as taken, r.used as chars from packed")
def prompt_pack(spark: SparkSession, d: str) -> DataFrame:
    taken = answers.packed_sources("citations")
    chars = F.aggregate(taken, F.lit(0).cast("bigint"), lambda s, i: s + F.length(F.get("citations", i)["body"]))
    return _cited(spark, d).select("query_id", F.array_join(taken.cast("array<string>"), ",").alias("taken"), chars.alias("chars"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SHOWN = """list_transform(range(1, len(r.taken) + 1), lambda k: '[' || k || '] ' || array_to_string(list_filter(list_concat([bodies[r.taken[k] + 1].id], coalesce(bodies[r.taken[k] + 1].h, [])), lambda h: h <> ''), ' > ')
 || chr(10) || case when length(bodies[r.taken[k] + 1].b) > 900 then regexp_replace(bodies[r.taken[k] + 1].b[1:900], '\\s+$', '') || '…' else bodies[r.taken[k] + 1].b end)"""


@R.query(f"""{_PACKED}, bodies as (select s.query_id, list(struct_pack(id := s.id, h := c.c.h, b := coalesce(c.c.b, '')) order by s.place) as bodies from scored s join uchunks c on c.id = s.id where s.place <= 6 group by 1),
questions as (select distinct item_id as query_id, query as text from golden_cases where query is not null),
shown as (select query_id, 'Sources:' || chr(10) || chr(10) || array_to_string({_SHOWN}, chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || text as user from packed join bodies using (query_id) join questions using (query_id))
select query_id, unnest([0, 1, 2, 3]) as turn, unnest(['system', 'user', 'assistant', 'user']) as role,
 unnest([{_quoted(answers.SYSTEM_PROMPT)}, {_quoted(answers.EXAMPLE[0])}, {_quoted(answers.EXAMPLE[1])}, user]) as content from shown""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The messages that a generator gets for each question."""
    turns = _cited(spark, d).select("query_id", F.posexplode(answers.messages("text", "citations")).alias("turn", "m"))
    return turns.select("query_id", "turn", "m.role", "m.content")


QUERIES, SQL = R.queries, R.sql
