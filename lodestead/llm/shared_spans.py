"""Problem 9: long spans of text that occur verbatim in more than one record."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.filters import bloom, passing
from lodestead.llm.grouping import COPIES, expanded
from lodestead.tables import persisted

#: Characters of a shared span.
MIN_SPAN = 300
#: Occurrences of one anchor that are joined with the others at a time.
ANCHOR_ROWS = 2000
#: An odd multiplier modulo 2^64 and its inverse, for the rolling hash.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the word (a finaliser of multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, block: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hash of every window of `block` characters, one per start, from prefix sums of a polynomial modulo 2^64."""
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return _mixed((total[block:] - total[:-block]) * down[: len(codes) - block + 1])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Starts that are the smallest (the last of equals) in one of the runs of `width` successive windows.

    With fewer windows than width, the smallest of all.
    """
    n = len(hashes)
    width = min(width, n)
    low, step = hashes.copy(), 1
    while step < width:  # minimum over a power of two by doubling, then over width by overlap
        use = min(step, width - step)
        low = np.minimum(low[: len(low) - use], low[use:])
        step += use
    chosen = np.zeros(n, bool)
    # a start i is chosen if it equals the minimum of a run that holds it and nothing equal follows in that run
    change = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    ends = np.concatenate((change[1:], [len(low)]))
    for a, b in zip(change, ends):
        at = np.flatnonzero(hashes[a : b - 1 + width] == low[a]) + a
        if len(at) == 1:
            chosen[at[0]] = True
        else:
            for r in range(a, b):
                inside = at[(at >= r) & (at < r + width)]
                chosen[inside[-1]] = True
    return np.flatnonzero(chosen)


def hashed_rows(texts: DataFrame, least: int, block: int, chosen) -> DataFrame:
    """(key, rep, pos): the windows of `block` characters whose starts chosen(hashes) names, of texts of at least `least`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(_BASE, 1), _powers(_INVERSE, 1)
        for batch in batches:
            keys, reps, places = [], [], []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(codes) < least:
                    continue
                if len(up) < len(codes):
                    up, down = _powers(_BASE, 2 * len(codes)), _powers(_INVERSE, 2 * len(codes))
                hashes = window_hashes(codes, block, up, down)
                at = chosen(hashes)
                keys.append(hashes[at].view(np.int64))
                reps.append(np.full(len(at), rep, np.int64))
                places.append(at.astype(np.int32))
            done = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.int64), (reps, np.int64), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], names=["key", "rep", "pos"])

    return texts.select("rep", "text").mapInArrow(scan, "key bigint, rep bigint, pos int")


def anchor_rows(texts: DataFrame, min_span: int, block: int, index: str = "blocks") -> DataFrame:
    """(key, rep, pos, reference): windows of `block` characters by which equal spans of min_span characters meet.

    index "blocks": the reference blocks start at multiples of `block`, of which a span of 2 * block - 1 characters holds
    one wherever it starts. Every other rolling window probes them, and goes on if a Bloom filter of all reference
    blocks lets it pass, so that about as many windows as blocks are shuffled.
    index "content": of each min_span - block + 1 successive windows the one of the smallest hash is a reference on both
    sides, whatever its place; exact too, and without a filter, for collections whose blocks are too many for one.
    """
    if index == "content":
        return hashed_rows(texts, min_span, block, lambda h: anchors(h, min_span - block + 1)).withColumn("reference", F.lit(True))
    blocks = persisted(hashed_rows(texts, min_span, block, lambda h: np.arange(0, len(h), block)), "p9-blocks")
    words = blocks.sparkSession.sparkContext.broadcast(bloom(blocks.select("key")))

    def probes(hashes: np.ndarray) -> np.ndarray:
        at = passing(words.value, hashes)
        return at[at % block != 0]

    return blocks.withColumn("reference", F.lit(True)).unionByName(hashed_rows(texts, min_span, block, probes).withColumn("reference", F.lit(False)))


def text_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, rep): the smallest doc_id with the same text, so that copies are compared once."""
    own = documents.where("text is not null and doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.char_length("text").alias("n")
    ).distinct()
    reps = own.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    return own.join(reps, ["h1", "h2", "n"]).select("doc_id", "rep")


def shared_spans(documents: DataFrame, min_span: int = MIN_SPAN, block: int | None = None, index: str = "blocks") -> tuple[DataFrame, DataFrame]:
    """(spans, classes) of documents(doc_id, text).

    spans (rep_a, rep_b, start_a, start_b, length), rep_a < rep_b: maximal exact repeats of at least min_span
    characters between different texts. classes (doc_id, rep): documents with the same text share a rep; copies are not
    expanded into pairs. Null and empty texts have no spans. block None: half of min_span, the longest of which every span
    holds one; index as in anchor_rows. A key that many texts share is joined with its occurrences in salted parts; all
    its pairs are extended, none is dropped. A stretch of one repeated character is shared on each of its diagonals.
    """
    block = block or (min_span + 1) // 2
    if not 0 < block <= (min_span if index == "content" else (min_span + 1) // 2):
        raise ValueError("a span must hold a block wherever it starts")
    classes = persisted(text_classes(documents), "p9-classes")
    reps = classes.where("doc_id = rep").select("rep")
    # a doc_id that occurs in repeated rows gives the same text again
    texts = documents.where(F.char_length("text") >= min_span).select(F.col("doc_id").cast("bigint").alias("rep"), "text")
    texts = persisted(texts.join(reps, "rep", "left_semi").dropDuplicates(["rep"]), "p9-reps")
    found = persisted(anchor_rows(texts, min_span, block, index), "p9-anchors")
    several = found.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n"), F.max("reference").alias("indexed"))
    several = several.where("low < high and indexed").select("key", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("parts"))
    hits = persisted(found.join(several, "key"), "p9-hits")
    # the occurrences of a frequent block are cut into parts, each of which meets the references in a task of its own
    left = hits.select("key", F.pmod(F.xxhash64("rep", "pos"), "parts").cast("int").alias("part"), "rep", "pos", "reference")
    other = hits.where("reference").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("ref"), F.col("pos").alias("ref_pos"))
    pairs = left.join(other, ["key", "part"]).where("rep != ref and (not reference or rep < ref)")
    first = F.col("rep") < F.col("ref")
    one, two = F.struct("rep", "pos"), F.struct(F.col("ref").alias("rep"), F.col("ref_pos").alias("pos"))
    pairs = pairs.select(F.when(first, one).otherwise(two).alias("a"), F.when(first, two).otherwise(one).alias("b"))
    pairs = pairs.select(F.col("a.rep").alias("rep_a"), F.col("a.pos").alias("pos_a"), F.col("b.rep").alias("rep_b"), F.col("b.pos").alias("pos_b"))
    # anchors of one maximal repeat lie on one diagonal; a pair of texts is one row, so that it meets its texts once
    pairs = pairs.groupBy("rep_a", "rep_b", (F.col("pos_b") - F.col("pos_a")).alias("shift")).agg(F.array_sort(F.collect_set("pos_a")).alias("seeds"))
    pairs = pairs.groupBy("rep_a", "rep_b").agg(F.collect_list(F.struct("shift", "seeds")).alias("diagonals"))
    pairs = persisted(pairs, "p9-pairs")
    involved = pairs.select(F.col("rep_a").alias("rep")).union(pairs.select(F.col("rep_b").alias("rep"))).distinct()
    involved = persisted(texts.join(involved, "rep", "left_semi"), "p9-texts")
    joined = pairs.join(involved.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
    joined = joined.join(involved.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.text_a.encode("utf-32-le", "surrogatepass"), np.uint32)
                b = np.frombuffer(r.text_b.encode("utf-32-le", "surrogatepass"), np.uint32)
                for d in r.diagonals:
                    shift, seeds = int(d["shift"]), d["seeds"]
                    low, high = max(0, -shift), min(len(a), len(b) - shift)
                    breaks = np.flatnonzero(a[low:high] != b[low + shift : high + shift]) + low
                    edges = np.concatenate(([low - 1], breaks, [high]))
                    for k in np.unique(np.searchsorted(edges, seeds, "right")):
                        start, end = int(edges[k - 1]) + 1, int(edges[k])
                        if end - start >= min_span:
                            rows.append((r.rep_a, r.rep_b, start, start + shift, end - start))
            yield pd.DataFrame(rows, columns=["rep_a", "rep_b", "start_a", "start_b", "length"])

    spans = joined.select("rep_a", "rep_b", "diagonals", "text_a", "text_b").mapInPandas(
        extend, "rep_a bigint, rep_b bigint, start_a int, start_b int, length int"
    )
    return persisted(spans, "p9-spans"), classes


def document_pairs(spans: DataFrame, classes: DataFrame, documents: DataFrame, min_span: int = MIN_SPAN, copies: int | None = COPIES) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: the documents behind spans, with copies of a text of min_span characters or more.

    Up to `copies` of a text are written out in all pairs (None: any number of them); more as expanded says, and the
    classes tell which document stands for which.
    """
    long = documents.where(F.char_length("text") >= min_span).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    member = classes.join(long, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "rep")
    return expanded(spans.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), member, copies).toDF("doc_a", "doc_b")


def shared_share(spans: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, rep, copies, n_chars, shared_chars, n_spans): one row per document with text.

    shared_chars: characters that also occur in another document, each counted once however many spans cover it; all of
    them where another document has the same text.
    """
    sides = spans.select(F.col("rep_a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).union(
        spans.select("rep_b", "start_b", F.col("start_b") + F.col("length"))
    ).distinct()
    # length of a union of intervals: what reaches beyond the greatest end so far
    before = Window.partitionBy("rep").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = sides.withColumn("reach", F.coalesce(F.max("e").over(before), F.lit(0)))
    covered = covered.groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach"))).alias("covered"), F.count("*").alias("n_spans"))
    sizes = classes.groupBy("rep").agg(F.count("*").alias("copies"))
    chars = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length("text").alias("n_chars")).distinct()
    out = chars.join(classes, "doc_id").join(sizes, "rep").join(covered, "rep", "left")
    return out.select(
        "doc_id", "rep", "copies", "n_chars",
        F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )
