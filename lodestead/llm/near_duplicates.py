"""Problem 3: near-duplicate records, by a binary trie self-join over fingerprints under a Hamming error budget."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.grouping import COPIES, components, consecutive, expanded
from lodestead.tables import persisted

#: Words of a shingle, similarity of a pair, and words that a record has at least.
SHINGLE = 3
SIMILARITY = 0.7
MIN_WORDS = 60
#: Tries of the forest; minhashes that a root-to-bucket path spells; bits of the fingerprint below it.
TRIES, PATH = 20, 3
FINGERPRINT = 128
#: Standard deviations by which the error budget lies above the errors expected at the similarity.
SLACK = 4.0
#: Rows of one bucket that one task joins with as many others.
BUCKET_ROWS = 4096
#: Node pairs that go down a level together.
FRONTIER = 1 << 17


def error_budget(similarity: float, bits: int = FINGERPRINT, slack: float = SLACK) -> int:
    """Differing bits allowed between two fingerprints of records with that similarity.

    A fingerprint has two bits of each of bits / 2 minhashes. A minhash differs with probability 1 - similarity, and
    then each of its bits with probability 1/2.
    """
    n, p = bits // 2, 1 - similarity
    mean, variance = n * p, n * (p * 0.5 + p * (1 - p))
    return min(bits, int(mean + slack * variance**0.5))


def normalised(text):
    """Lower-case words (maximal runs of letters and digits) of a text column, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the sequences of n consecutive words, by their places. known keeps the hashes of words."""
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    codes = np.array([known[w] for w in words], np.uint64)
    if len(codes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        total = _mixed(total + codes[k : len(codes) - n + 1 + k] + np.uint64(k + 1))
    return total


def shingle_hashes(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the sequences of n consecutive words."""
    return np.unique(gram_hashes(words, n, known))


def signature(shingles: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A minhash per salt."""
    return _mixed(shingles[:, None] ^ salts[None, :]).min(axis=0)


def _salts(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def trie_rows(records: DataFrame, shingle: int, tries: int, path: int) -> DataFrame:
    """(bucket, rep, f1, f2): each record at its place in every trie.

    The bucket stands for the trie and the bits of `path` minhashes, along which no error is allowed; f1 and f2 are the
    bits that follow. Each trie spells other minhashes first.
    """
    salts = _salts(max(tries * path, FINGERPRINT // 2))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        two = np.arange(0, 64, 2, dtype=np.uint64)
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            reps, buckets, f1, f2 = [], [], [], []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles = shingle_hashes(text.split(" "), shingle, known)
                if not len(shingles):
                    continue
                low = signature(shingles, salts)
                at = np.arange(tries, dtype=np.uint64)
                for k in range(path):
                    at = _mixed(at + low[k : tries * path : path])
                bits = low[: FINGERPRINT // 2] & np.uint64(3)  # the last bits: the first ones of a minimum are 0
                reps.append(rep)
                buckets.append(at)
                f1.append(np.bitwise_or.reduce(bits[:32] << two))
                f2.append(np.bitwise_or.reduce(bits[32:] << two))
            n = len(reps)
            cols = [
                np.concatenate(buckets).view(np.int64) if n else np.empty(0, np.int64),
                np.repeat(np.array(reps, np.int64), tries),
                np.repeat(np.array(f1, np.uint64).view(np.int64), tries),
                np.repeat(np.array(f2, np.uint64).view(np.int64), tries),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "rep", "f1", "f2"])

    return records.select("rep", "norm").mapInArrow(scan, "bucket bigint, rep bigint, f1 bigint, f2 bigint")


def trie_walk(prints: np.ndarray, ranges: np.ndarray, budget: int, chunk: int = FRONTIER) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(i, j, node pairs, pruned): rows of prints whose fingerprints differ in at most budget bits, from joins of tries.

    prints (n, 2): fingerprints, sorted within each range; a range of rows that agree in their first bits is a node of a
    binary trie. ranges (k, 4): roots (a0, a1, b0, b1) of the tries to join; a trie joined with itself gives each pair of
    its rows once. Node pairs descend bit by bit, all of a level together: to the children that agree with the errors so
    far, to those that don't with one more, and those beyond the budget are pruned with all below them. Two leaves are
    joined by edges without branches, so their other bits are counted at once. More than `chunk` node pairs are split,
    and one part goes down to the leaves before the other.
    """
    ones: dict[int, np.ndarray] = {}
    found_i, found_j, visited, pruned = [np.empty(0, np.int64)], [np.empty(0, np.int64)], len(ranges), 0
    todo = [(0, ranges.astype(np.int64), np.zeros(len(ranges), np.int32))]
    while todo:
        level, pairs, errors = todo.pop()
        while len(pairs):
            leaves = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
            if leaves.any():
                i, j = pairs[leaves, 0], pairs[leaves, 2]
                near = (np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int32) <= budget) & (i != j)
                found_i.append(i[near])
                found_j.append(j[near])
                pruned += int((~near & (i != j)).sum())
                pairs, errors = pairs[~leaves], errors[~leaves]
            if level == FINGERPRINT:  # nodes of equal fingerprints
                for a0, a1, b0, b1 in pairs:
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij"))
                    once = i < j if a0 == b0 else np.ones(len(i), bool)
                    found_i.append(i[once])
                    found_j.append(j[once])
                break
            if len(pairs) > chunk:
                half = len(pairs) // 2
                todo.append((level, pairs[half:], errors[half:]))
                pairs, errors = pairs[:half], errors[:half]
            if level not in ones:
                bit = (prints[:, level // 64] >> np.uint64(63 - level % 64)) & np.uint64(1)
                ones[level] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
            c, (a0, a1, b0, b1) = ones[level], pairs.T
            am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
            twice = a0 != b0  # a node joined with itself meets its two children once
            children = np.concatenate([np.stack(x, axis=1) for x in ((a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am[twice], a1[twice], b0[twice], bm[twice]))])
            after = np.concatenate((errors, errors, errors + 1, errors[twice] + 1))
            real = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
            within = real & (after <= budget)
            visited, pruned = visited + int(within.sum()), pruned + int((real & ~within).sum())
            pairs, errors, level = children[within], after[within], level + 1
    return np.concatenate(found_i), np.concatenate(found_j), visited, pruned


def trie_tasks(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(task, side, rep, f1, f2), a task's rows together: the joins of tries, one or more a bucket.

    A bucket of more than bucket_rows rows is cut into parts, and each pair of parts is a task of its own (side 1 and 2;
    0 for a part with itself); a bucket with one row goes nowhere.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = rows.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("n") / bucket_rows).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select(
        F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).cast("tinyint").alias("side"),
        "rep", "f1", "f2",
    )
    return placed.repartition("task").sortWithinPartitions("task")


def _joined(table: pa.Table, edges: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """trie_walk over the tasks that the edges bound: (a, b) are reps."""
    side, rep = table.column("side").to_numpy(), table.column("rep").to_numpy()
    prints = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("f1", "f2")], axis=1)
    task = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((prints[:, 1], prints[:, 0], side, task))
    middle = edges[:-1] + np.add.reduceat((side == 1).astype(np.int64), edges[:-1])
    alone = side[edges[:-1]] == 0
    ranges = np.stack((edges[:-1], np.where(alone, edges[1:], middle), np.where(alone, edges[:-1], middle), edges[1:]), axis=1)
    ranges = ranges[(ranges[:, 0] < ranges[:, 1]) & (ranges[:, 2] < ranges[:, 3])]
    i, j, visited, pruned = trie_walk(prints[order], ranges, budget)
    return rep[order[i]], rep[order[j]], visited, pruned


def candidates(rows: DataFrame, budget: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b), a < b: records that meet in some trie within the budget, by joins of the tries below every bucket."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in consecutive(batches):
            x, y, _, _ = _joined(table, edges, budget)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return trie_tasks(rows, bucket_rows).mapInArrow(join, "a bigint, b bigint").distinct()


def walk_counts(rows: DataFrame, budget: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(n_rows, tasks, node_pairs, pruned, pairs): what the walks of tries of so many rows visit, prune and find."""
    names = ("n_rows", "node_pairs", "pruned", "pairs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in consecutive(batches):
            got = []
            for s, e in zip(edges[:-1], edges[1:]):
                x, _, visited, pruned = _joined(table.slice(s, e - s), np.array([0, e - s]), budget)
                got.append((int(e - s), visited, pruned, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=list(names))

    counted = trie_tasks(rows, bucket_rows).mapInArrow(count, ", ".join(f"{n} bigint" for n in names))
    return counted.groupBy("n_rows").agg(F.count("*").alias("tasks"), *(F.sum(c).alias(c) for c in names[1:]))


def forest(
    records: DataFrame, id_col: str = "page_id", text_col: str = "text", shingle: int = SHINGLE, min_words: int = MIN_WORDS, tries: int = TRIES, path: int = PATH,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows as in trie_rows, classes as in near_duplicates, texts (rep, norm)) of records."""
    usable = records.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("bigint").alias("id"), normalised(F.col(text_col)).alias("norm"), F.xxhash64(text_col).alias("raw"))
    usable = usable.where(F.size(F.split("norm", " ")) >= max(min_words, shingle))
    words = ["h1", "h2", "n"]
    own = usable.select("id", F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2"), F.length("norm").alias("n"), "raw")
    own = own.groupBy("id", *words).agg(F.min("raw").alias("raw"))
    # both minima are aggregated before they are shuffled; a class with many members is a skewed join, which is split
    same = own.groupBy(*words, "raw").agg(F.min("id").alias("same"))
    reps = same.groupBy(*words).agg(F.min("same").alias("rep"))
    classes = persisted(own.join(same.join(reps, words), [*words, "raw"]).select("id", "rep", "same"), "p3-classes")
    texts = usable.drop("raw").withColumnRenamed("id", "rep").join(classes.where("id = rep").select("rep"), "rep", "left_semi")
    return persisted(trie_rows(texts, shingle, tries, path).distinct(), "p3-tries"), classes, texts


def near_duplicates(
    records: DataFrame, id_col: str = "page_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS, tries: int = TRIES, path: int = PATH,
) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of records with a numeric id and a text.

    classes (id, rep, same): records of at least min_words words with the same words in the same order share the smallest
    id, rep; same is the smallest id of those whose text is equal as it stands.
    links (a, b, similarity), a < b: different classes whose sets of `shingle` consecutive words have that Jaccard
    similarity or more, counted exactly for every pair that the trie join finds. Null texts and ids take no part, nor
    do shorter texts. Repeated rows count once.
    """
    rows, classes, texts = forest(records, id_col, text_col, shingle, min_words, tries, path)
    pairs = persisted(candidates(rows, error_budget(similarity)), "p3-candidates")
    involved = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    involved = persisted(texts.join(involved, "rep", "left_semi").dropDuplicates(["rep"]), "p3-texts")
    joined = pairs.join(involved.select(F.col("rep").alias("a"), F.col("norm").alias("text_a")), "a")
    joined = joined.join(involved.select(F.col("rep").alias("b"), F.col("norm").alias("text_b")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shingles(text: str) -> set:
            words = text.split(" ")
            return set(zip(*(words[k:] for k in range(shingle))))

        for pdf in batches:
            kept, known = [], {}
            for r in pdf.itertuples(index=False):
                for rep, text in ((r.a, r.text_a), (r.b, r.text_b)):
                    if rep not in known:
                        known[rep] = shingles(text)
                x, y = known[r.a], known[r.b]
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    kept.append((r.a, r.b, both / (len(x) + len(y) - both)))
            yield pd.DataFrame(kept, columns=["a", "b", "similarity"])

    links = joined.select("a", "b", "text_a", "text_b").mapInPandas(verify, "a bigint, b bigint, similarity double")
    return persisted(links, "p3-links"), classes


def record_pairs(links: DataFrame, classes: DataFrame, copies: int | None = COPIES) -> DataFrame:
    """(a, b), a < b: the records behind links and within classes.

    Different texts of a class are linked with each other, and with those of the classes it is linked with, in all pairs;
    the copies of one text as expanded gives them: all pairs of up to `copies` of them (None: of any number), the first
    with each other one beyond. Which record stands for which is in the classes.
    """
    texts = classes.select(F.col("same").alias("id"), "rep").distinct()
    between = persisted(expanded(links.select("a", "b"), texts, None), "p3-pairs")
    return expanded(between, classes.select("id", F.col("same").alias("rep")), copies)


def groups(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, rep, component, n_links): one row per record that took part.

    n_links counts the other classes that the record's class is linked with; component is the smallest record reached
    over links, the class itself where there are none.
    """
    found = components(links.select("a", "b"), "p3-components")
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
