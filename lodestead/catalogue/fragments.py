"""SQL that several queries share."""

from lodestead.functions.text import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
SPACES = r"^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$"
RUNS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '{SPACES}', '', 'g')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{RUNS}', ' ', 'g'))"


def tokens(source: str, id_col: str, text_col: str, name: str, stop: bool = True) -> str:
    """CTEs that end in name(id, term), one row per token of source."""
    return rf"""
{name}_raw as (select {id_col} as id, list_filter(regexp_extract_all(lower({text_col}), '[a-z0-9]+(?:[.\-_/][a-z0-9]+)*'), lambda t: length(t) <= 64) as r from {source}),
{name}_pairs as (select id, unnest(r) as t, unnest(list_concat(list_slice(r, 2, len(r)), [null])) as nxt from {name}_raw),
{name}_parts as (select id, t as part from {name}_pairs
                 union all select id, unnest(string_split_regex(t, '[.\-_/]')) from {name}_pairs where regexp_matches(t, '[.\-_/]')),
{name}_all as (select id, part as term from {name}_parts
               union all select id, substr(part, 2) from {name}_parts where regexp_full_match(part, 'v[0-9]+')
               union all select id, 'v' || nxt from {name}_pairs where t in ('version', 'ver', 'v') and regexp_full_match(nxt, '[0-9]+')),
{name} as (select id, term from {name}_all where term <> ''{f" and term not in ({STOP})" if stop else ""})"""


def unique_rows(table: str, id_col: str, text_col: str, name: str) -> str:
    return f"{name} as (select {id_col} as id, coalesce(min({text_col}), '') as text from {table} where {id_col} is not null group by 1)"


#: The directories and title of a url.
URL_PARTS = r"""
case when regexp_matches(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://')
     then coalesce(nullif(regexp_extract(url, '^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/') else url end"""


def bm25(texts: str, queries: str) -> str:
    """CTEs texts(id, text), queries(query_id, text) to scored(query_id, id, score, place)."""
    return f"""{tokens(texts, "id", "text", "tok")}, {tokens(queries, "query_id", "text", "qtok")},
tf as (select id, term, count(*) as tf from tok group by 1, 2),
dl as (select t.id, count(k.term) as dl from {texts} t left join tok k on k.id = t.id group by 1),
stats as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by 1),
terms as (select distinct id as query_id, term from qtok),
raw_scores as (select query_id, tf.id as id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 9) as score
  from terms join tf using (term) join df using (term) join dl on dl.id = tf.id cross join stats group by 1, 2),
scored as (select *, row_number() over (partition by query_id order by score desc, id) as place from raw_scores)"""


def usable_vectors(table: str, id_col: str, name: str) -> str:
    return f"""{name} as (select {id_col} as id, min(vector) as vector from {table} where {id_col} is not null and len(vector) = 64
  and len(list_filter(vector, lambda x: x <> 0)) > 0 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 group by 1)"""


def unit(v: str) -> str:
    return f"list_transform({v}::double[], lambda x: x / sqrt(list_sum(list_transform({v}::double[], lambda y: y * y))))"
