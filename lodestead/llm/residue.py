"""Problem 5: template residue and error-page text, by message templates mined with a fixed-depth prefix tree."""

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm import boilerplate
from lodestead.llm.grouping import consecutive
from lodestead.tables import persisted

#: Words that a page's own text has at most to count as short. Short pages give the template classifier its labels and a
#: template its odds; templates are mined from the own text of all pages.
SHORT_PAGE = 100
#: Tokens of the fixed-depth tree below the token count, and share of equal tokens that joins a message to a template.
DEPTH, ALIKE = 4, 0.6
#: Messages that the template classifier is fitted on, at most (about), of each kind.
FIT_MESSAGES = 6000
#: Messages of one leaf that are clustered together; the templates of a leaf's parts are clustered once more.
LEAF_ROWS = 2000
#: A word belongs to filler text if it is at least this many times as frequent there.
FILLER_ODDS = 10.0
WEIGHTS = 1 << 16

#: The forms that unresolved slots take.
SLOTS = re.compile(
    r"\{\{[^{}]*\}\}|\[\[[^\[\]]*\]\]|[$#]\{[^{}]*\}|<%.*?%>|%[A-Z][A-Z0-9_]*%|__[A-Z][A-Z0-9_]*__|\{\d+\}"
    r"|\[object Object\]|\[[A-Z][a-z]+(?: [a-z]+)*\]|\bundefined\b|\bNaN\b"
)
#: Fixed value: how well-known filler texts begin; their words are looked for elsewhere.
FILLER = r"(?i)^\W*(?:lorem ipsum|dolor sit amet|sed ut perspiciatis|li europan lingues|behind the word mountains|hinter den wortbergen|blindtext)\b"

#: What any slot holds, for a quick look.
SLOT_HINT = re.compile(r"[\[{%]|__|undefined|NaN")
WORD = re.compile(r"[^\W_]+")
MARKS = re.compile(r"[^\w<*>'’\- ]+")
VARIABLE = re.compile(r"/[\w./\-]+|\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d[\d.,:]*")


def message(text: str, site: str, slots: int = 1) -> str:
    """A block as a message: lower case, slots, paths, numbers, codes and the site's name replaced by <*>."""
    text = VARIABLE.sub("<*>", (SLOTS.sub("<*>", text) if slots else text).lower())
    text = MARKS.sub(" ", text)
    return " ".join("<*>" if w == site else w for w in text.split())


def grow_tree(messages: list[tuple[str, int]], depth: int = DEPTH, alike: float = ALIKE) -> list[str]:
    """For each (message, weight) the template it ends in.

    The tree branches on the number of tokens, then on the first `depth` tokens, <*> being a branch of its own. In a leaf
    a message joins the template with which it has the largest share of equal tokens, if that is at least `alike`;
    tokens that differ become <*>. Messages are taken in order of weight, then of text.
    """
    leaves: dict[tuple, list[list[str]]] = {}
    where: dict[str, list[str]] = {}
    for text, _ in sorted(messages, key=lambda m: (-m[1], m[0])):
        tokens = text.split(" ")
        leaf = leaves.setdefault((len(tokens), *tokens[:depth]), [])
        best, most = None, 0.0
        for template in leaf:
            same = sum(a == b for a, b in zip(template, tokens)) / len(tokens)
            if same > most:
                best, most = template, same
        if best is None or most < alike:
            best = list(tokens)
            leaf.append(best)
        for i, (a, b) in enumerate(zip(best, tokens)):
            if a != b:
                best[i] = "<*>"
        where[text] = best
    return [" ".join(where[m]) for m, _ in messages]


def leaf_tasks(messages: DataFrame, by, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """messages (msg, ...) with `task`, the tree's leaf, and `cut`, whether that is a part of one.

    A leaf of more than leaf_rows messages is cut into parts by the hash of `by`.
    """
    tokens = F.split("msg", " ")
    placed = messages.withColumn("leaf", F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH)))
    large = placed.groupBy("leaf").agg(F.ceil(F.count("*") / leaf_rows).cast("int").alias("parts")).where("parts > 1")
    placed = placed.join(large, "leaf", "left")
    part = F.xxhash64("leaf", F.pmod(F.xxhash64(by), F.col("parts")))
    return placed.withColumn("task", F.coalesce(part, "leaf")).withColumn("cut", F.col("parts").isNotNull()).drop("leaf", "parts")


def judged_messages(messages: DataFrame, judge, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(mid) of the messages (mid, msg, on_short, n) whose template judge(template, on_short, n) condemns, or judge(msg, None, None).

    The leaves of the tree are spread over tasks; each template is judged once, in the task that has all its messages,
    and they inherit the verdict. The templates of a leaf's parts are clustered once more, by their last token where they
    are still too many, so every message has a template, and one of a very large leaf may have two.
    """
    schema = "mid bigint, template string, weight bigint, on_short bigint, n bigint"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(rows: DataFrame, final: bool) -> DataFrame:
        def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, edges in consecutive(batches):
                mid, msg, weight, short, n, cut = (table.column(c).to_pylist() for c in ("mid", "msg", "weight", "on_short", "n", "cut"))
                out = []
                for s, e in zip(edges[:-1], edges[1:]):
                    templates = grow_tree(list(zip(msg[s:e], weight[s:e])))
                    if cut[s] and not final:
                        out += zip(mid[s:e], templates, weight[s:e], short[s:e], n[s:e])
                        continue
                    total: dict[str, list[int]] = {}
                    for t, x, y in zip(templates, short[s:e], n[s:e]):
                        sums = total.setdefault(t, [0, 0])
                        sums[0] += x
                        sums[1] += y
                    bad = {t for t, (x, y) in total.items() if judge(t, x, y)}
                    # what isn't a template by itself (mid is null) is known by its text
                    out += [(i, m if i is None else None, 0, 0, 0) for i, m, t in zip(mid[s:e], msg[s:e], templates) if t in bad or judge(m, None, None)]
                cols = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "template" else pa.int64()) for c, k in zip(cols, names)], names=names)

        return rows.select("task", "cut", "mid", "msg", *(F.col(c).cast("bigint").alias(c) for c in ("weight", "on_short", "n"))).repartition("task").sortWithinPartitions("task").mapInArrow(cluster, schema)

    first = persisted(run(leaf_tasks(messages.withColumn("weight", F.col("n")), F.col("msg"), leaf_rows), False), "p5-first")
    open_ = first.where("template is not null")
    if open_.isEmpty():
        return first.select("mid")
    parts = open_.groupBy(F.col("template").alias("msg")).agg(*(F.sum(c).alias(c) for c in ("weight", "on_short", "n"))).withColumn("mid", F.lit(None).cast("bigint"))
    second = run(leaf_tasks(parts, F.element_at(F.split("msg", " "), -1), leaf_rows), True)
    return first.where("template is null").select("mid").union(open_.join(second.select("template"), "template", "left_semi").select("mid"))


def _features(msg: str, known: dict[str, int]) -> np.ndarray:
    """Words, word pairs, first word and number of words of a message; known keeps the hashes of words."""
    tokens = msg.split(" ")
    for t in tokens:
        if t not in known:
            known[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
    ids = [known[t] for t in tokens]
    both = np.unique(boilerplate._word_features(ids))
    return np.append(both, [boilerplate._feature(60, ids[0]), boilerplate._feature(61, min(len(ids), 12))]) & (WEIGHTS - 1)


def filler_words(messages: DataFrame) -> set[str]:
    """Words of filler text, counted over all messages (msg): in at least two that begin like known filler, and
    FILLER_ODDS times as frequent in those as in the others. The words of known filler come to the driver.
    """
    is_filler = F.col("msg").rlike(FILLER)
    words = F.array_distinct(F.filter(F.split("msg", r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    near = messages.where(is_filler).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("near")).where("near > 1")
    near = persisted(near, "p5-filler")
    if near.isEmpty():
        return set()
    sizes = messages.agg(F.count(F.when(is_filler, 1)).alias("a"), F.count(F.when(~is_filler, 1)).alias("b")).first()
    far = messages.where(~is_filler).select(F.explode(words).alias("word")).join(near, "word", "left_semi").groupBy("word").agg(F.count("*").alias("far"))
    odds = F.col("near") / sizes.a > FILLER_ODDS * (F.coalesce("far", F.lit(0)) + 0.5) / max(1, sizes.b)
    return {r.word for r in near.join(far, "word", "left").where(odds).select("word").collect()}


def fitted(rows: list[tuple[np.ndarray, bool]]) -> np.ndarray:
    """Weights of a linear classifier of messages (features, whether on short pages); zeros unless there are both kinds.

    Error pages may be long, so a message isn't ordinary only because no short page has it: those that a classifier of
    the other half of the rows takes for residue aren't learned from.
    """

    def learned(part: list[tuple[np.ndarray, bool]]) -> np.ndarray:
        if not any(y for _, y in part) or all(y for _, y in part):
            return np.zeros(WEIGHTS + 1, np.float32)
        full = boilerplate.learn([f for f, _ in part], [y for _, y in part])
        return np.append(full[:WEIGHTS], full[-1])

    halves = [rows[::2], rows[1::2]]
    kept = []
    for own, other in (halves, halves[::-1]):
        w = learned(other)
        kept += [(f, y) for f, y in own if y or w[f].sum() + w[-1] <= 0]
    return learned(kept)


def page_blocks(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """(page_id, pos, mid, msg, words, own, body, slots, short): every block with text of every page.

    Lines of the text stand for the blocks where those are null. mid: hash of the block's message, which only body blocks
    have with them. own: content by the boilerplate operator. body: not a heading. words: at least 1. slots: unresolved
    ones. short: the page's own body has at most SHORT_PAGE words.
    """
    line = F.transform(F.split("text", "\n", -1), lambda t: F.struct(F.lit("text").alias("type"), F.lit(None).cast("int").alias("level"), t.alias("text")))
    pages = pages.withColumn("blocks", F.coalesce("blocks", line))
    schema = "page_id bigint, pos int, mid bigint, msg string, words int, own boolean, body boolean, slots int, short boolean"
    names = tuple(f.split(" ")[0] for f in schema.split(", "))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_())
    known: dict[tuple[str, str], tuple[int, str, int, int]] = {}  # short blocks come again

    def emit(page: int, site: str, blocks: list[tuple], content: list[bool]) -> list[tuple]:
        name, rows = boilerplate.site_name(site), []
        if len(known) > boilerplate.REPEATED:
            known.clear()
        for pos, ((kind, _, text), kept) in enumerate(zip(blocks, content)):
            if text.strip():
                key = (text, name if name in text.lower() else "")
                found = known.get(key)
                if found is None:
                    slots = len(SLOTS.findall(text)) if SLOT_HINT.search(text) else 0
                    msg = message(text, key[1], slots)
                    found = (xxhash.xxh64_intdigest(msg) - (1 << 63), msg, max(1, len(WORD.findall(text))), slots)
                    if len(text) < boilerplate.SHORT:
                        known[key] = found
                mid, msg, words, slots = found
                rows.append((page, pos, mid, msg if kind != "heading" else None, words, kept, kind != "heading", slots))
        short = sum(r[4] for r in rows if r[5] and r[6]) <= SHORT_PAGE
        return [(*r, short) for r in rows]

    return boilerplate.judged(pages, fetched, emit, names, kinds, schema)


def residue_blocks(blocks: DataFrame, fit_messages: int = FIT_MESSAGES) -> DataFrame:
    """blocks, without their message, with `residue`: what is filler, has an unresolved slot, or matches a template that stands for content.

    Messages are counted over all pages. Those of any page's own text, and all that are on a short page, make the
    template tree; a template is judged once, by a linear classifier of its words plus the log odds of the short and
    other pages that it is on, and its messages inherit the verdict. A message is filler if half of its words are. The
    classifier is fitted on bounded samples of messages of short pages' own text and of the other pages' blocks, by the
    hash of the message.
    """
    counted = blocks.where("msg != ''").groupBy("mid").agg(
        F.first("msg").alias("msg"), F.sum(F.col("short").cast("int")).alias("on_short"), F.max("own").alias("own"), F.count("*").alias("n"), F.max("slots").alias("slots")
    )
    counted = persisted(counted, "p5-messages")
    suspects = counted.where("own or on_short > 0")

    def sample(df: DataFrame, most: int) -> list:
        step = max(1, -(-df.count() // most))
        return df.where(F.pmod("mid", F.lit(step)) == 0).orderBy("msg").collect()

    words = filler_words(counted)
    known: dict[str, int] = {}

    def filled(msg: str) -> bool:
        own = WORD.findall(msg)
        return bool(own) and 2 * sum(map(words.__contains__, own)) >= len(own)

    rows = [(_features(r.msg, known), True) for r in sample(suspects.where("own and 2 * on_short > n"), fit_messages) if not filled(r.msg)]
    rows += [(_features(r.msg, known), False) for r in sample(counted.where("2 * on_short <= n"), 3 * fit_messages) if not filled(r.msg) and not r.slots]
    weights = fitted(rows)
    hashes: dict[str, int] = {}

    def judge(text: str, on_short: int | None, n: int | None) -> bool:
        """Of a template with its counts, whether it stands for content; of a message, whether it is filler."""
        if n is None:
            return bool(words) and filled(text)
        if len(hashes) > 300_000:
            hashes.clear()
        odds = math.log((on_short + 0.5) / (n - on_short + 0.5))
        return float(weights[_features(text, hashes)].sum() + weights[-1]) + odds > 0

    bad = persisted(judged_messages(suspects.select("mid", "msg", "on_short", "n"), judge), "p5-verdicts")
    known_bad = blocks.drop("msg").join(bad.distinct().withColumn("matched", F.lit(True)), "mid", "left")
    return known_bad.withColumn("residue", (F.col("slots") > 0) | F.coalesce("matched", F.lit(False))).drop("matched", "mid")


def judge_pages(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """(page_id, residue_words, own_words, excluded): one row per page with text.

    residue_words: words of the page's own body blocks that are residue, and of a short page's other body blocks that
    are; own_words: of its other own body blocks. Excluded are pages with residue where own_words aren't more. A page
    without such blocks is judged by its own headings. Pages whose blocks and text are null or blank have no row;
    repeated rows count once.
    """
    blocks = persisted(page_blocks(pages, fetched), "p5-blocks")
    judged = residue_blocks(blocks)
    body, own, bad = F.col("body"), F.col("own"), F.col("residue")

    def words(which):
        return F.sum(F.when(which, F.col("words")).otherwise(0))

    out = judged.groupBy("page_id").agg(
        words(bad & body & (own | F.col("short"))).alias("bad"), words(own & body & ~bad).alias("fine"), words(own & bad).alias("bad_heads"), words(own & ~bad).alias("fine_heads")
    )
    bare = (F.col("bad") + F.col("fine")) == 0
    out = out.select("page_id", F.when(bare, F.col("bad_heads")).otherwise(F.col("bad")).alias("residue_words"), F.when(bare, F.col("fine_heads")).otherwise(F.col("fine")).alias("own_words"))
    return out.withColumn("excluded", (F.col("residue_words") > 0) & (F.col("residue_words") >= F.col("own_words")))
