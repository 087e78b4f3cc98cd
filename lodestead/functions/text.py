"""Text functions as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval.
STOPWORDS = (
    "a an and are as at be but by can do does for from has have how i if in is it its of on or that the their them "
    "then there these they this to was were what when where which who will with you your"
).split()
MAX_TOKEN = 64
#: Limits of headings, sentences and summaries.
MIN_HEADING, MIN_SENTENCE, MAX_SENTENCE, LEAD_SENTENCES, MAX_SUMMARY = 3, 20, 200, 3, 700
MAX_EMBED_INPUT = 2000
#: Fixed value: what separates the parts of a page title.
TITLE_SEPARATOR = r"\s+[—–|·]\s+|\s+-\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def raw_tokens(c: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9]+(?:[.\-_/][a-z0-9]+)*"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) <= MAX_TOKEN)


def tokenize(c: Column | str, keep_stopwords: bool = False) -> Column:
    """Tokens of a text in order; null stays null.

    A compound (joined by . - _ /) gives itself and its parts; a part vN gives N too; `version`, `ver` or `v` before a
    number N gives vN. Stop words are left out unless kept.
    """
    raw = raw_tokens(c)

    def of(token: Column, following: Column) -> Column:
        parts = F.when(token.rlike(r"[.\-_/]"), F.concat(F.array(token), F.split(token, r"[.\-_/]"))).otherwise(F.array(token))
        versions = F.transform(F.filter(parts, lambda p: p.rlike(r"^v\d+$")), lambda p: F.substring(p, 2, MAX_TOKEN))
        bridge = F.when(token.isin("version", "ver", "v") & following.rlike(r"^\d+$"), F.array(F.concat(F.lit("v"), following))).otherwise(F.array().cast("array<string>"))
        # most tokens are neither compounds nor about versions
        return F.when(token.rlike(r"[.\-_/]|^v(?:\d+|er|ersion)?$"), F.concat(parts, versions, bridge)).otherwise(F.array(token))

    # each token with the next one; the last meets null
    tokens = F.flatten(F.zip_with(raw, F.slice(raw, 2, 2_000_000_000), of))
    if not keep_stopwords:
        tokens = F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))
    return tokens


def is_stopword(c: Column | str) -> Column:
    return col(c).isin(*STOPWORDS)


def split_sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), r"(?U)(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def lead_sentences(blocks: Column | str) -> Column:
    """The first sentences of the text blocks that are long enough, each cut."""
    texts = F.filter(col(blocks), lambda b: b["type"] == "text")
    sentences = F.flatten(F.transform(texts, lambda b: split_sentences(b["text"])))
    kept = F.slice(F.filter(sentences, lambda s: F.length(s) >= MIN_SENTENCE), 1, LEAD_SENTENCES)
    return F.transform(kept, lambda s: F.substring(s, 1, MAX_SENTENCE))


def headings_of(blocks: Column | str, title: Column | str) -> Column:
    """Headings in order, without short ones, repeats, and those that equal the title."""
    key = lambda t: F.lower(squeezed(t))
    texts = F.transform(F.filter(col(blocks), lambda b: b["type"] == "heading"), lambda b: trimmed(b["text"]))
    texts = F.filter(texts, lambda t: F.length(t) >= MIN_HEADING)
    keys = F.concat(F.array(key(F.coalesce(col(title), F.lit("")))), F.transform(texts, key))
    return F.filter(texts, lambda t, i: F.array_position(keys, key(t)) == i + 2)


def question_headings(blocks: Column | str) -> Column:
    return F.filter(headings_of(blocks, F.lit("")), lambda h: F.endswith(h, F.lit("?")))


def fitting_prefix(parts: Column | str, budget: int = MAX_SUMMARY) -> Column:
    """The leading parts whose lengths, each with one separator, stay within a budget; the first that doesn't ends it."""
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def add(state: Column, part: Column) -> Column:
        used = state["used"] + F.length(part) + 1
        fits = state["open"] & (used <= budget)
        return F.struct(
            F.when(fits, used).otherwise(state["used"]).alias("used"), fits.alias("open"),
            F.when(fits, F.concat(state["kept"], F.array(part))).otherwise(state["kept"]).alias("kept"),
        )

    return F.aggregate(col(parts), start, add, lambda s: s["kept"])


def summarize(blocks: Column | str, title: Column | str) -> Column:
    """Headings, then lead sentences, within the budget. Either list ends at the first part that doesn't fit."""
    heads, leads = headings_of(blocks, title), lead_sentences(blocks)
    kept = fitting_prefix(heads)
    used = F.aggregate(kept, F.lit(0), lambda s, p: s + F.length(p) + 1)
    total = F.aggregate(
        leads,
        F.struct(used.alias("used"), F.lit(True).alias("open"), kept.alias("kept")),
        lambda s, p: F.struct(
            F.when(s["open"] & (s["used"] + F.length(p) + 1 <= MAX_SUMMARY), s["used"] + F.length(p) + 1).otherwise(s["used"]).alias("used"),
            (s["open"] & (s["used"] + F.length(p) + 1 <= MAX_SUMMARY)).alias("open"),
            F.when(s["open"] & (s["used"] + F.length(p) + 1 <= MAX_SUMMARY), F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept"),
        ),
        lambda s: s["kept"],
    )
    return F.trim(F.array_join(total, " "))


def capitalised_words(c: Column | str, empty: str) -> Column:
    words = F.filter(F.split(col(c), r"[-_\s]+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.lit(empty)).otherwise(
        F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")
    )


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), r"(?U)\s+", "-")


def first_word(c: Column | str) -> Column:
    return F.lower(F.element_at(F.split(col(c), r"\s+"), 1))


def split_title(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), TITLE_SEPARATOR), lambda p: F.trim(p)), lambda p: p != "")


def blocks_from_text(c: Column | str) -> Column:
    """Paragraphs between blank lines as text blocks."""
    parts = F.filter(F.transform(F.split(col(c), r"\n{2,}"), trimmed), lambda t: t != "")
    return F.transform(parts, lambda t: F.struct(F.lit("text").alias("type"), F.lit(None).cast("int").alias("level"), t.alias("text")))


def compose(title: Column | str, path: Column | str, body: Column | str) -> Column:
    """What is embedded of a chunk: title, heading path, then the body."""
    return F.concat(
        F.coalesce(col(title), F.lit("")), F.when(F.size(col(path)) > 0, F.concat(F.lit(" › "), F.array_join(col(path), " › "))).otherwise(""), F.lit("\n"), col(body)
    )


def common_path(a: Column | str, b: Column | str) -> Column:
    """The shorter of two heading paths if it begins the other, else null."""
    a, b = col(a), col(b)
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return F.when(F.slice(long, F.lit(1), F.size(short)) == short, short)


def clamp_level(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.round(col(c)).cast("int"), F.lit(2))))


def clamp_text(c: Column | str, most: int) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.regexp_replace(F.substring(col(c), 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(col(c))


def embed_input(c: Column | str) -> Column:
    return F.substring(col(c), 1, MAX_EMBED_INPUT)


def breadcrumb(title: Column | str, path: Column | str) -> Column:
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(col(title), F.lit(""))), F.coalesce(col(path), F.array().cast("array<string>"))), lambda x: x != ""), " › ")


def format_bytes(c: Column | str) -> Column:
    """Whole megabytes from a million bytes on, else whole kilobytes."""
    return F.when(col(c) >= 1_000_000, F.concat(F.round(col(c) / 1e6).cast("bigint").cast("string"), F.lit(" MB"))).otherwise(
        F.concat(F.round(col(c) / 1e3).cast("bigint").cast("string"), F.lit(" kB"))
    )


def route_text(slug_title="slug_title", description="description", summary="summary", category="category", segments="segments") -> Column:
    """What the routing index searches of a page, the most curated first."""
    parts = F.concat(F.array(*(F.coalesce(col(c), F.lit("")) for c in (slug_title, description, summary, category))), F.coalesce(col(segments), F.array().cast("array<string>")))
    return F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def routing_need(c: Column | str) -> Column:
    """Distinct words that a route text offers."""
    return F.size(F.array_distinct(F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda w: w != "")))
