"""Prompts and answers: packing of sources, cleaning and checking of what a generator wrote, verdicts."""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestead.functions.text import clamp_text, col

#: The refusal token and the limits of a prompt.
NOT_FOUND = "NOT_FOUND"
MAX_SOURCES, MAX_CHARS, SOURCE_CHARS = 4, 2400, 900
SYSTEM_PROMPT = (
    "Answer the question in one or two sentences from the numbered sources alone, and name the source of each fact as [1]. "
    f"If no source speaks of the topic, reply with {NOT_FOUND} and nothing else."
)

#: A question answered as asked for: the example that goes before every question.
EXAMPLE = (
    "Sources:\n\n[1] Opening hours > Visits\nThe reading room is open from 10 to 18 on weekdays and closed in August.\n\nQuestion: when can I visit the reading room?",
    "The reading room is open on weekdays from 10 to 18 [1].",
)


def packed_sources(citations: Column | str, max_sources: int = MAX_SOURCES, max_chars: int = MAX_CHARS) -> Column:
    """Positions of the citations (structs with body) that go into a prompt: the first always, others while they fit."""
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))
    marked = F.transform(col(citations), lambda c, i: F.struct(i.alias("i"), F.length(c["body"]).alias("n")))

    def add(s: Column, c: Column) -> Column:
        fits = (F.size(s["taken"]) < max_sources) & ((F.size(s["taken"]) == 0) | (s["used"] + c["n"] <= max_chars))
        return F.struct(F.when(fits, s["used"] + c["n"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(c["i"]))).otherwise(s["taken"]).alias("taken"))

    return F.aggregate(marked, empty, add, lambda s: s["taken"])


def prompt(query: Column | str, citations: Column | str) -> Column:
    """The user message: the packed sources numbered from 1, then the question. citations: structs (title, heading_path, body)."""
    chosen = F.transform(packed_sources(citations), lambda i: F.get(col(citations), i))

    def shown(c: Column, i: Column) -> Column:
        heads = F.filter(F.concat(F.array(F.coalesce(c["title"], F.lit(""))), F.coalesce(c["heading_path"], F.array().cast("array<string>"))), lambda h: h != "")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.array_join(heads, " > "), F.lit("\n"), clamp_text(c["body"], SOURCE_CHARS))

    return F.concat(F.lit("Sources:\n\n"), F.array_join(F.transform(chosen, shown), "\n\n"), F.lit("\n\nQuestion: "), col(query))


def messages(query: Column | str, citations: Column | str) -> Column:
    """What a generator gets: the system prompt, the example and its answer, the question with its sources, as structs (role, content)."""
    turns = [("system", F.lit(SYSTEM_PROMPT)), ("user", F.lit(EXAMPLE[0])), ("assistant", F.lit(EXAMPLE[1])), ("user", prompt(query, citations))]
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def generated(rows: DataFrame, generate: Callable[[list[tuple[str, str]]], str]) -> DataFrame:
    """(query_id, raw) of rows(query_id, messages), written on the executors in Arrow batches; raw is null where generate fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = []
            for turns in pdf.messages:
                try:
                    raw.append(generate([(t["role"], t["content"]) for t in turns]))
                except Exception:  # noqa: BLE001
                    raw.append(None)
            yield pd.DataFrame({"query_id": pdf.query_id, "raw": raw})

    return rows.select("query_id", "messages").mapInPandas(run, "query_id string, raw string")


def without_reasoning(raw: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(raw), r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""), r"(?U)^\s+|\s+$", "")


def _marker(m: Column) -> Column:
    return F.try_to_number(m, F.lit("9999999999")).cast("bigint")


def cited_numbers(text: Column | str, n_sources: Column | str) -> Column:
    """Numbers of the [k] markers with 1 <= k <= n_sources, each once, in order of first use."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(r"\[(\d{1,10})\]"), F.lit(1)), _marker)
    return F.array_distinct(F.filter(found, lambda k: (k >= 1) & (k <= col(n_sources))))


_MARKED = re.compile(r"\[(\d+)\]")


@F.pandas_udf(T.StringType())
def drop_invalid_markers(text: pd.Series, n: pd.Series) -> pd.Series:
    """The text without [k] markers that point at no source, tidied."""

    def one(t, most):
        if t is None:
            return None
        t = _MARKED.sub(lambda m: m[0] if 1 <= int(m[1]) <= most else "", t)
        t = re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+([.,;:!?])", r"\1", t))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    return pd.Series([one(t, m) for t, m in zip(text, n)])


def processed(raw: Column | str, n_sources: Column | str) -> Column:
    """struct (text, cited, refused) of a raw answer: refused where the token occurs or nothing is left."""
    clean = without_reasoning(raw)
    text = drop_invalid_markers(clean, col(n_sources).cast("bigint"))
    refused = F.coalesce(F.contains(clean, F.lit(NOT_FOUND)) | (text == ""), F.lit(True))
    return F.struct(
        F.when(refused, "").otherwise(text).alias("text"),
        F.when(refused, F.array().cast("array<bigint>")).otherwise(cited_numbers(clean, n_sources)).alias("cited"),
        refused.alias("refused"),
    )


def unsupported_number(text: Column | str, sources: Column | str) -> Column:
    """Whether the text states a number of two digits or more that the sources, without white space and commas, don't hold."""
    hay = F.regexp_replace(col(sources), r"(?U)[\s,]", "")
    numbers = F.transform(F.regexp_extract_all(col(text), F.lit(r"\d[\d,.]*"), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, r"[.,]+$", ""), ",", ""))
    return F.exists(numbers, lambda d: (F.length(d) >= 2) & ~F.contains(hay, d))


def split_citations(text: Column | str, n_sources: Column | str) -> Column:
    """Parts of a text in order: structs (kind text or citation, text, index)."""
    return _parts(col(text), col(n_sources).cast("bigint"))


_PART = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("index", T.LongType())]))


@F.pandas_udf(_PART)
def _parts(text: pd.Series, n: pd.Series) -> pd.Series:
    def one(t, most):
        out, last = [], 0
        for m in _MARKED.finditer(t or ""):
            if 1 <= int(m[1]) <= most:
                if m.start() > last:
                    out.append({"kind": "text", "text": t[last : m.start()], "index": None})
                out.append({"kind": "citation", "text": None, "index": int(m[1])})
                last = m.end()
        if last < len(t or ""):
            out.append({"kind": "text", "text": t[last:], "index": None})
        return out

    return pd.Series([one(t, m) for t, m in zip(text, n)])


def verdict(answer: Column | str, must: Column | str, any_of: Column | str, must_not: Column | str) -> Column:
    """no-answer, wrong-figure, correct or missed-fact, without regard to case. An empty list of facts is met unless any is asked for."""
    low = F.lower(col(answer))
    none = F.array().cast("array<string>")
    wanted, banned = F.coalesce(col(must), none), F.coalesce(col(must_not), none)
    has = lambda x: F.contains(low, F.lower(x))
    met = F.when(F.coalesce(col(any_of), F.lit(False)), F.exists(wanted, has)).otherwise(F.forall(wanted, has))
    return (
        F.when(col(answer).isNull() | (col(answer) == ""), "no-answer").when(F.exists(banned, has), "wrong-figure").when(met, "correct").otherwise("missed-fact")
    )
