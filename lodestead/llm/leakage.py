"""Problem 8: evaluation passages inside documents. Rare n-gram seeds join them, then Smith-Waterman alignment on words."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.filters import bloom, passing
from lodestead.llm.near_duplicates import gram_hashes
from lodestead.tables import persisted

#: Words of an exact run that make a leak, and words of a seed.
MIN_RUN = 12
SEED = 5
#: Documents with a seed up to which their ids are sent to every executor; more are joined by shuffling.
BROADCAST_DOCUMENTS = 500_000
#: Smith-Waterman on words.
MATCH, MISMATCH, GAP = 2, -2, -1

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def align(doc: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best local alignment score, its end in doc, longest exact run) of two arrays of word numbers."""
    column = np.zeros(len(doc) + 1, np.int32)
    run = np.zeros(len(doc) + 1, np.int32)
    slope = -GAP * np.arange(len(doc) + 1, dtype=np.int32)
    best, end, longest = 0, 0, 0
    for w in passage:
        same = doc == w
        new = np.zeros_like(column)
        new[1:] = np.maximum(column[:-1] + np.where(same, MATCH, MISMATCH), column[1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along doc: new[j] = max over i <= j of new[i] + GAP * (j - i)
        column = np.maximum.accumulate(new + slope) - slope
        run[1:] = np.where(same, run[:-1] + 1, 0)
        run[0] = 0
        j = int(column.argmax())
        if column[j] > best:
            best, end = int(column[j]), j
        longest = max(longest, int(run.max()))
    return best, end, longest


def passage_grams(passages: DataFrame, n: int) -> DataFrame:
    """(item, part, pos, gram) of passages(item, part, passage): the hash of every n-gram of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            own = [gram_hashes(words(p), n, known) for p in batch.column("passage").to_pylist()]
            size = np.array([len(x) for x in own], np.int64)
            row = pa.array(np.repeat(np.arange(len(own)), size))
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            grams = np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(row), batch.column("part").take(row), pa.array(pos.astype(np.int32)), pa.array(grams)], names=["item", "part", "pos", "gram"])

    return passages.mapInArrow(run, "item bigint, part bigint, pos int, gram bigint")


def document_grams(texts: DataFrame, filter_words, n: int) -> DataFrame:
    """(gram, doc_id): the n-grams of each document that a Bloom filter (a broadcast variable) lets pass, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            docs, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = gram_hashes(words(text), n, known)
                hit = np.unique(own[passing(filter_words.value, own)])
                docs.append(np.full(len(hit), doc, np.int64))
                grams.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(docs))], names=["gram", "doc_id"])

    return texts.mapInArrow(run, "gram bigint, doc_id bigint")


def choose_seeds(grams: DataFrame, frequency: DataFrame, min_run: int, n: int) -> DataFrame:
    """(gram, item, part): in every window of min_run words of a passage its rarest n-gram (the last of equals).

    So every run of min_run words that a document shares with a passage holds a seed. A passage shorter than min_run
    has the window of all its words.
    """
    per = max(1, min_run - n + 1)
    whole = Window.partitionBy("item", "part")
    ahead = whole.orderBy("pos").rowsBetween(0, per - 1)
    counted = grams.join(frequency, "gram", "left").withColumn("own", F.count("*").over(whole))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("pos")).alias("back"), "gram")).over(ahead)
    chosen = counted.withColumn("best", rarest).where((F.col("pos") <= F.col("own") - per) | (F.col("pos") == 0))
    return chosen.select("best.gram", "item", "part").distinct()


def leaks(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, longest_run, score, end_word, share): documents that share a seed with an item's passage, aligned.

    longest_run: words of the longest exact run. score: Smith-Waterman score of document against passage, which ends at
    end_word; share: score by the score of the whole passage, 1 for a full copy, so paraphrased or edited copies rank by
    it. An item with several passages counts by the best of them, each aligned by itself.

    However many items there are, the documents are read twice: once for the n-grams that a Bloom filter of the passages'
    n-grams lets pass, which give both the frequencies over all documents and what the seeds join; once for the texts of
    documents with a seed. Passages of fewer words than a seed, null passages and null texts have no leaks. Repeated rows
    count once; a document's text is never cut.
    """
    passages = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("bigint").alias("item"), F.xxhash64("passage").alias("part"), "passage")
    passages = persisted(passages.dropDuplicates(["item", "part"]), "p8-passages")
    texts = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    grams = persisted(passage_grams(passages, seed), "p8-grams")
    filter_words = documents.sparkSession.sparkContext.broadcast(bloom(grams.select("gram").withColumnRenamed("gram", "key")))
    hits = persisted(document_grams(texts, filter_words, seed), "p8-hits")
    frequency = hits.groupBy("gram").agg(F.count("*").alias("n"))
    seeds = choose_seeds(grams, frequency, min_run, seed)
    met = persisted(hits.join(seeds, "gram").select("doc_id", "item", "part").distinct(), "p8-candidates")
    asked = met.join(passages, ["item", "part"]).groupBy("doc_id").agg(F.collect_list(F.struct("item", "passage")).alias("asked"))
    ids = met.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_DOCUMENTS else ids
    found = texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(asked, "doc_id")
    names = ["doc_id", "item_id", "longest_run", "score", "end_word", "share"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked"))):
                number: dict[str, int] = {}
                coded = np.array([number.setdefault(w, len(number)) for w in words(text)], np.int64)
                for one in wanted:
                    own = np.array([number.get(w, -1) for w in words(one["passage"])], np.int64)
                    best, end, run = align(coded, own)
                    rows.append((doc, one["item"], run, best, end, best / (MATCH * len(own))))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    aligned = found.select("doc_id", "text", "asked").mapInArrow(score, "doc_id bigint, item_id bigint, longest_run int, score int, end_word int, share double")
    # of several passages of an item the best by score, with the longest run of any
    best = F.max_by(F.struct("score", "end_word", "share"), F.struct("share", "score", "end_word"))
    out = aligned.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), best.alias("b"))
    return persisted(out.select("doc_id", "item_id", "longest_run", "b.score", "b.end_word", "b.share"), "p8-leaks")
