"""Problem 6: the most similar vectors of every vector, by an inverted multi-index."""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.grouping import consecutive
from lodestead.tables import persisted

K = 5
DIM = 64
#: Vectors that the codebooks are fitted on, at most (about); every vector is indexed.
FIT_ROWS = 20_000
#: Centroids of a half: a function of the number of vectors within these limits. From MOST * MOST * 64 vectors on a cell
#: holds more than 64 of them; what a query visits doesn't hang on that, since visits_for counts vectors.
FEWEST, MOST = 8, 2048
#: A tile of the grid of cells holds about TILE_ROWS vectors; one task compares about PART_ROWS vectors of a tile at most
#: with about ASK_ROWS queries. How many queries a tile has is told from PROBES of them, for the size of tasks alone.
TILE_ROWS, PART_ROWS, ASK_ROWS, PROBES = 262_144, 262_144, 262_144, 2000
#: Cosines that a task holds at a time, and about as many as it computes.
PRODUCTS, WORK = 8_000_000, 250_000_000
#: Groups of centroids of a half, at least, whose pairs are the tiles.
FEWEST_GROUPS = 2
#: Vectors that a query visits, at least; of larger tables WANTED_ROOT times the square root of the number of vectors.
WANTED, WANTED_ROOT = 2048, 4
#: Vectors are compared as 16-bit numbers, whose cosines are within COARSE of the exact ones: rounding turns a vector of DIM
#: numbers by at most sqrt(DIM) * 0.5 / 32767 = 1.22e-4, two of them by 2.45e-4.
COARSE = 2.5e-4
#: Decimals of a unit vector's components by which copies are told, whatever their lengths.
DIRECTION = 12


def usable_vectors(table: DataFrame, id_col: str = "id", dim: int = DIM) -> DataFrame:
    """(id, vector) that take part: id not null, `dim` finite numbers, not all zero."""
    v = F.col("vector")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(
        ~bad & F.exists("vector", lambda x: x != 0)
    ).select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("vector"))


def centroids_for(n: int) -> int:
    """Centroids per half for n vectors: a cell of the square grid holds about 64 vectors until MOST is reached."""
    return int(min(MOST, max(FEWEST, (n / 64) ** 0.5)))


def visits_for(n: int) -> int:
    """Vectors that a query visits of n: more of a larger table, whose grid has more cells for a pair to fall apart in."""
    return max(WANTED, round(WANTED_ROOT * n**0.5))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds; an emptied centroid moves to the point that is worst served."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        at, worst = d.argmin(1), np.argsort(-(d.min(1) + (x * x).sum(1)))
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for spare, j in enumerate(np.flatnonzero(n == 0)):
            c[j] = x[worst[spare]]
    return c.astype(np.float32)


def traverse(d1: np.ndarray, d2: np.ndarray, filled: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells (i, j) in order of d1[i] + d2[j] until they hold `wanted` vectors: the multi-sequence walk with a heap."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out, held = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = (int(o1[i]), int(o2[j]))
        if filled[cell]:
            out.append(cell)
            held += int(filled[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (float(d1[o1[a]] + d2[o2[b]]), a, b))
    return out


def traverse_all(d1: np.ndarray, d2: np.ndarray, filled: np.ndarray, wanted: int, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """traverse for every row of d1 and d2 at once: (query, cell number i * k2 + j) of what each visits.

    The nearest `width` centroids of each half make a grid whose cells are sorted by their sums; a query whose walk
    would leave the grid takes the heap.
    """
    k1, k2 = d1.shape[1], d2.shape[1]
    w1, w2 = min(width, k1), min(width, k2)
    o1, o2 = np.argsort(d1, axis=1, kind="stable")[:, :w1], np.argsort(d2, axis=1, kind="stable")[:, :w2]
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    sums = (s1[:, :, None] + s2[:, None, :]).reshape(len(d1), -1)
    cells = (o1[:, :, None] * k2 + o2[:, None, :]).reshape(len(d1), -1)
    order = np.argsort(sums, axis=1, kind="stable")
    sums, cells = np.take_along_axis(sums, order, 1), np.take_along_axis(cells, order, 1)
    held = filled.ravel()[cells]
    before = np.cumsum(held, axis=1) - held
    take = (before < wanted) & (held > 0)
    last = np.where(take, np.arange(take.shape[1]), 0).max(axis=1)
    # beyond the grid the next sum is at least the nearest of one half plus the first one left out of the other
    edge = np.full(len(d1), np.inf)
    if w1 < k1:
        edge = np.minimum(edge, s1[:, -1] + s2[:, 0])
    if w2 < k2:
        edge = np.minimum(edge, s2[:, -1] + s1[:, 0])
    short = (before[:, -1] + held[:, -1] < wanted) & np.isfinite(edge)
    outside = short | (np.take_along_axis(sums, last[:, None], 1)[:, 0] > edge)
    take[outside] = False
    q, p = np.nonzero(take)
    found_q, found_c = [q], [cells[q, p]]
    for r in np.flatnonzero(outside):
        walk = traverse(d1[r], d2[r], filled, wanted)
        found_q.append(np.full(len(walk), r))
        found_c.append(np.array([i * k2 + j for i, j in walk], np.int64))
    return np.concatenate(found_q), np.concatenate(found_c)


class Codebooks:
    """Centroids of the two halves of unit vectors, and tiles of the grid of their pairs.

    Near centroids of a half form a group; a tile is a pair of groups. So the cells that a query visits lie in few tiles.
    """

    def __init__(self, sample: np.ndarray, k: int, groups: int):
        half = sample.shape[1] // 2
        self.half, self.first, self.second = half, kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)
        one, two = (self._grouped(c, groups) for c in (self.first, self.second))
        self.tile = (one[:, None] * groups + two[None, :]).ravel().astype(np.int32)

    def asks(self, probes: np.ndarray, filled: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each tile the share of the probes that visit it, and the vectors that a probe visits there on average."""
        seen = np.zeros(int(self.tile.max()) + 1)
        visits = np.zeros(len(seen))
        for s in range(0, len(probes), 1024):
            q, cell = traverse_all(*self.distances(probes[s : s + 1024]), filled, wanted)
            pairs = np.unique(q * len(seen) + self.tile[cell])
            seen += np.bincount(pairs % len(seen), minlength=len(seen))
            visits += np.bincount(self.tile[cell], filled.ravel()[cell], minlength=len(seen))
        return seen / max(1, len(probes)), visits / max(1, len(probes))

    @staticmethod
    def _grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
        means = kmeans(centroids, groups)
        return ((means * means).sum(1)[None, :] - 2 * centroids @ means.T).argmin(1)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(
            (h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1)[None, :] for h, c in ((x[:, : self.half], self.first), (x[:, self.half :], self.second))
        )

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = self.distances(x)
        return d1.argmin(1), d2.argmin(1)


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _bytes(x: np.ndarray) -> pa.Array:
    """Unit vectors as 16-bit numbers, scaled by the largest component; the scale doesn't matter for a cosine."""
    small = np.round(x / np.abs(x).max(axis=1, keepdims=True) * 32767).astype(np.int16)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * small.shape[1]), len(small), [None, pa.py_buffer(small.tobytes())]).cast(pa.binary())


def fit(vectors: DataFrame, n: int, fit_rows: int = FIT_ROWS) -> tuple[Codebooks, np.ndarray] | None:
    """Codebooks from about fit_rows vectors, chosen by the hash of the id, and PROBES of these; None if there are no vectors."""
    step = max(1, -(-n // fit_rows))
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("vector").toArrow()
    if not rows.num_rows:
        rows = vectors.select("vector").limit(FEWEST).toArrow()
    if not rows.num_rows:
        return None
    x = np.stack(rows.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(x.T)]
    return Codebooks(x, centroids_for(n), max(FEWEST_GROUPS, round((n / TILE_ROWS) ** 0.5))), x[:: max(1, len(x) // PROBES)]


def _key(seed: int):
    return F.xxhash64("id", F.lit(seed))


def once(vectors: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """vectors (id, vector) without repeated rows, and the first seed from `seed` on by which _key tells all ids apart.

    Only the rows whose key occurs more than once are shuffled as a whole.
    """
    keyed = vectors.withColumn("key", _key(seed))
    repeated = persisted(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "p6-repeated")
    if repeated.isEmpty():
        return vectors, seed
    rows = persisted(keyed.join(repeated, "key", "left_semi").distinct(), "p6-once")
    if not rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").isEmpty():
        return once(vectors, seed + 1)
    return keyed.join(repeated, "key", "left_anti").select("id", "vector").unionByName(rows.select("id", "vector")), seed


def crowd(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(excess (id, copy), first (copy, id, place)) of vectors of one direction that more than k + 1 ids share.

    The first k + 1 ids of such a direction stay in the index; a vector in excess has the first k of them as neighbours.
    """

    def direction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), DIRECTION) + 0.0  # no -0.0
                copy = pa.array([xxhash.xxh3_128_digest(v) for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([copy, batch.column("id")], names=["copy", "id"])

    members = vectors.select("id", "vector").mapInArrow(direction, "copy binary, id string").distinct()
    many = members.groupBy("copy").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("copy")
    crowded = persisted(members.join(many, "copy", "left_semi"), "p6-crowded")
    # row_number under a limit keeps k + 1 rows of a group before the shuffle
    first = crowded.withColumn("place", F.row_number().over(Window.partitionBy("copy").orderBy("id"))).where(F.col("place") <= k + 1)
    first = persisted(first, "p6-first")
    return crowded.join(first.select("id"), "id", "left_anti"), first


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = K, wanted: int | None = None, floor: float = -1.0, fit_rows: int = FIT_ROWS, exact: bool = True,
) -> DataFrame:
    """(id, neighbour, similarity, place): the k most similar other ids of every query id, ties by id.

    vectors, queries: (id, vector) as from usable_vectors, queries being rows of vectors; None: all of them. `wanted` vectors (None: visits_for
    their number) are visited per query at least, cell by cell of the multi-index in order of summed distance. With a floor, only neighbours of at
    least that cosine are returned. Every visited vector within 2 * COARSE of the k-th is kept until exact cosines decide.
    exact: similarities are those of the vectors themselves; else only those near the floor are, and those that may or may
    not be among the k, and the others are within COARSE of them. An id never pairs with itself; repeated rows count once.
    An empty table has no neighbours.
    """
    vectors, seed = once(vectors)
    queries = None if queries is None else once(queries, seed)[0]
    n = vectors.count()
    wanted = wanted or visits_for(n)
    fitted = fit(vectors, n, fit_rows)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "id string, neighbour string, similarity double, place int")
    excess, first = crowd(vectors, k)
    excess = persisted(excess, "p6-excess")
    crowded = not excess.isEmpty()
    core = vectors.join(excess.select("id"), "id", "left_anti") if crowded else vectors
    books, probes = fitted
    k2, context = len(books.second), vectors.sparkSession.sparkContext
    shared_books = context.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column("vector"))
                c1, c2 = shared_books.value.cells(x)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array((c1 * k2 + c2).astype(np.int32)), _bytes(x)], names=["key", "cell", "v"])

    keyed = core.select(_key(seed).alias("key"), "vector")
    entries = persisted(keyed.mapInArrow(place, "key bigint, cell int, v binary"), "p6-entries")
    filled = np.zeros(len(books.first) * k2, np.int32)
    counts = entries.groupBy("cell").agg(F.count("*").cast("int").alias("n")).toArrow()  # two numbers of at most MOST * MOST cells
    filled[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    filled = filled.reshape(-1, k2)
    # the tasks of a tile: parts of its vectors times parts of its queries
    sizes = np.bincount(books.tile, filled.ravel(), minlength=int(books.tile.max()) + 1)
    share, visits = books.asks(probes, filled, wanted)
    n_asked = n if queries is None else queries.count()
    parts = np.maximum(1, np.ceil(sizes / PART_ROWS)).astype(np.int32)
    salts = np.maximum(1, np.ceil(np.maximum(share * n_asked / ASK_ROWS, visits * n_asked / parts / WORK))).astype(np.int32)
    shared = context.broadcast((filled, parts, salts))

    def tasks_of(tile: np.ndarray, key: np.ndarray, asks: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, task) of the rows with these tiles and keys: a vector goes to one part and all salts, a query the other way."""
        _, parts, salts = shared.value
        fixed, spread = (salts[tile], parts[tile]) if asks else (parts[tile], salts[tile])
        own = (key.view(np.uint64) >> np.uint64(17)) % fixed.astype(np.uint64)
        row = np.repeat(np.arange(len(tile)), spread)
        other = np.arange(len(row)) - np.repeat(np.cumsum(spread) - spread, spread)
        part, salt = (other, own[row].astype(np.int64)) if asks else (own[row].astype(np.int64), other)
        return row, (tile[row].astype(np.int64) << 32) + (part << 16) + salt

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            row, task = tasks_of(shared_books.value.tile[cell], batch.column("key").to_numpy(), False)
            taken = pa.array(row)
            lists = pa.array([None] * len(row), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(task), batch.column("key").take(taken), batch.column("cell").take(taken), lists, batch.column("v").take(taken)], names=["task", "key", "cell", "cells", "v"]
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                batch = whole.slice(s, 1024)
                x = _unit(batch.column("vector"))
                books = shared_books.value
                q, cell = traverse_all(*books.distances(x), shared.value[0], wanted)
                tile = books.tile[cell]
                order = np.lexsort((cell, tile, q))
                q, cell, tile = q[order], cell[order].astype(np.int32), tile[order]
                edges = np.concatenate(([0], np.flatnonzero((q[1:] != q[:-1]) | (tile[1:] != tile[:-1])) + 1, [len(q)])) if len(q) else np.array([0])
                at = edges[:-1]
                lists = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(at), [None, pa.py_buffer((edges * 4).astype(np.int64).tobytes()), pa.py_buffer(cell.tobytes())]
                ).cast(pa.binary())
                keys = batch.column("key").to_numpy()[q[at]]
                row, task = tasks_of(tile[at], keys, True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task), pa.array(keys[row]), pa.array(np.full(len(row), -1, np.int32)), lists.take(pa.array(row)), _bytes(x).take(pa.array(q[at][row].astype(np.int32)))],
                    names=["task", "key", "cell", "cells", "v"],
                )

    asked = keyed if queries is None else (queries.join(excess.select("id"), "id", "left_anti") if crowded else queries).select(_key(seed).alias("key"), "vector")
    schema = "task bigint, key bigint, cell int, cells binary, v binary"
    entry_rows, ask_rows = entries.mapInArrow(offer, schema), asked.mapInArrow(ask, schema)
    band, near, queries_are_all = 2 * COARSE, floor - COARSE, queries is None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in consecutive(batches):
            key, cell_of = (table.column(c).to_numpy() for c in ("key", "cell"))
            cells, v = table.column("cells").combine_chunks(), table.column("v").combine_chunks()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]

            def kth(sims: np.ndarray) -> np.ndarray:
                """The k-th largest of each row besides the query itself, or less: that of the largest of blocks of a long row."""
                if sims.shape[1] >= 64 * 4 * (k + 1):
                    even = sims.shape[1] // 64 * 64
                    sims = sims[:, :even].reshape(len(sims), -1, 64).max(axis=2)
                at = max(0, sims.shape[1] - k - 1)
                return np.partition(sims, at, axis=1)[:, at : at + 1]

            def matrix(at: np.ndarray, v=v) -> np.ndarray:
                x = np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), np.int16).reshape(len(at), -1).astype(np.float32)
                return x / np.linalg.norm(x, axis=1, keepdims=True)

            for s, e in zip(edges[:-1], edges[1:]):
                have, want = np.flatnonzero(cell_of[s:e] >= 0) + s, np.flatnonzero(cell_of[s:e] < 0) + s
                if not len(have) or not len(want):
                    continue
                have = have[np.argsort(cell_of[have], kind="stable")]
                local, starts = np.unique(cell_of[have], return_index=True)
                starts = np.append(starts, len(have))
                slot_of = np.repeat(np.arange(len(local)), np.diff(starts))
                x = matrix(have)
                for b in range(0, len(want), 4096):
                    rows = want[b : b + 4096]
                    y = matrix(rows)
                    lists = [np.frombuffer(z, np.int32) for z in cells.take(pa.array(rows)).to_pylist()]
                    of, cell = np.repeat(np.arange(len(rows)), [len(z) for z in lists]), np.concatenate(lists)
                    slot = np.minimum(np.searchsorted(local, cell), len(local) - 1)
                    here = local[slot] == cell  # a part of a tile may lack a cell
                    of, slot = of[here], slot[here]
                    order = np.argsort(slot, kind="stable")
                    of, slot = of[order], slot[order]
                    found_q, found_x, found_s = [], [], []
                    if near <= -1 and len(slot) > len(rows) * len(local) / 8:  # most cells are asked for: one product under a mask
                        asked_for = np.zeros((len(rows), len(local)), bool)
                        asked_for[of, slot] = True
                        step = max(1, PRODUCTS // len(x))
                        for z in range(0, len(rows), step):
                            sims = np.where(asked_for[z : z + step][:, slot_of], y[z : z + step] @ x.T, np.float32(-2))
                            p, r = np.nonzero((sims > -2) & (sims >= kth(sims) - band))
                            found_q.append(rows[z + p])
                            found_x.append(have[r])
                            found_s.append(sims[p, r])
                        slot = slot[:0]
                    ends = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)])) if len(slot) else np.array([0])
                    for f, t in zip(ends[:-1], ends[1:]):
                        lo, hi = starts[slot[f]], starts[slot[f] + 1]
                        step = max(1, PRODUCTS // int(hi - lo))
                        for z in range(f, t, step):
                            i = of[z : min(t, z + step)]
                            sims = y[i] @ x[lo:hi].T
                            hit = sims >= near if near > -1 else sims >= kth(sims) - band
                            if near > -1 and np.count_nonzero(hit) > 4 * k * len(i):  # more than a few of a cell: its best ones
                                hit &= sims >= kth(sims) - band
                            p, r = np.nonzero(hit)
                            found_q.append(rows[i[p]])
                            found_x.append(have[lo + r])
                            found_s.append(sims[p, r])
                    if not found_q:
                        continue
                    q, x_at, sim = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)
                    other = key[q] != key[x_at]
                    q, x_at, sim = q[other], x_at[other], sim[other]
                    order = np.lexsort((-sim, q))
                    q, x_at, sim = q[order], x_at[order], sim[order]
                    start, end = np.searchsorted(q, q), np.searchsorted(q, q, "right")
                    best = (end - start <= k) | (sim >= sim[np.minimum(start + k, end) - 1] - band)
                    out.append((key[q[best]], key[x_at[best]], sim[best]))
            a, b, c = (np.concatenate(z) for z in zip(*out))
            if queries_are_all:  # what one of two finds holds for the other
                a, b, c = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((c, c))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.float32))], names=["qkey", "xkey", "near"])

    tasks = entry_rows.unionByName(ask_rows).repartition("task").sortWithinPartitions("task")
    by_query = Window.partitionBy("qkey").orderBy(F.desc("near"), "xkey")
    # two products of the same pair may differ in the last bits
    found = tasks.mapInArrow(compare, "qkey bigint, xkey bigint, near float").groupBy("qkey", "xkey").agg(F.max("near").alias("near"))
    found = found.withColumn("r", F.row_number().over(by_query))
    own = Window.partitionBy("qkey")
    last, next_ = (F.max(F.when(F.col("r") == r, F.col("near"))).over(own) for r in (k, k + 1))
    found = found.select("qkey", "xkey", F.col("near").cast("double").alias("similarity"), last.alias("last"), next_.alias("next"))
    # what is exact must decide: about the floor, and who is k-th where the k-th and the next are too close to tell
    sim = F.col("similarity")
    tied = (F.col("last") - F.col("next") <= 2 * COARSE) & (sim <= F.col("last") + 2 * COARSE) & (sim >= F.col("next") - 2 * COARSE)
    found = found.where(F.col("last").isNull() | (sim >= F.col("last") - 2 * COARSE))
    found = persisted(found.select("qkey", "xkey", "similarity", (F.coalesce(tied, F.lit(False)) | (F.abs(sim - F.lit(floor)) <= COARSE)).alias("doubtful")), "p6-found")
    doubtful = F.lit(True) if exact else F.col("doubtful")
    sure = found.where(~doubtful & (F.col("similarity") >= floor)).select("qkey", "xkey", "similarity")
    found = persisted(sure.unionByName(_measured(core, found.where(doubtful), floor, seed)), "p6-near")
    names = core.select(_key(seed).alias("key"), "id").distinct()
    used = found.select(F.col("qkey").alias("key")).union(found.select("xkey")).distinct()
    names = persisted(names.join(used, "key", "left_semi"), "p6-names")
    measured = found.join(names.withColumnRenamed("key", "qkey"), "qkey").join(names.select(F.col("key").alias("xkey"), F.col("id").alias("neighbour")), "xkey")
    measured = measured.select("id", "neighbour", "similarity").where("id != neighbour")
    if crowded:
        of_excess = excess if queries is None else excess.join(queries.select("id"), "id", "left_semi")
        measured = measured.unionByName(
            of_excess.join(first.select("copy", F.col("id").alias("neighbour"), "place"), "copy").where(F.col("place") <= k).select("id", "neighbour", F.lit(1.0).alias("similarity"))
        )
    ranked = measured.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")))
    return ranked.where(F.col("place") <= k).select("id", "neighbour", "similarity", "place")


def _measured(core: DataFrame, pairs: DataFrame, floor: float, seed: int) -> DataFrame:
    """pairs (qkey, xkey) with their exact similarity, without those below the floor; each unordered pair is measured once."""
    pairs = persisted(pairs.select("qkey", "xkey"), "p6-doubtful")
    unordered = pairs.select(F.least("qkey", "xkey").alias("low"), F.greatest("qkey", "xkey").alias("high")).distinct()
    used = persisted(pairs.select(F.col("qkey").alias("key")).union(pairs.select("xkey")).distinct(), "p6-used")
    own = persisted(core.select(_key(seed).alias("key"), "vector").join(used, "key", "left_semi").dropDuplicates(["key"]), "p6-exact")
    both = unordered.join(own.select(F.col("key").alias("high"), F.col("vector").alias("y")), "high").join(own.select(F.col("key").alias("low"), F.col("vector").alias("x")), "low")

    def cosine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf.x.to_numpy()).astype(np.float64), np.stack(pdf.y.to_numpy()).astype(np.float64)
                sims = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                yield pdf[["low", "high"]].assign(similarity=sims)

    sims = both.select("low", "high", "x", "y").mapInPandas(cosine, "low bigint, high bigint, similarity double").where(F.col("similarity") >= floor)
    return pairs.withColumn("low", F.least("qkey", "xkey")).withColumn("high", F.greatest("qkey", "xkey")).join(sims, ["low", "high"]).select("qkey", "xkey", "similarity")


def neighbour_pairs(vectors: DataFrame, least: float = 0.9, k: int = K, wanted: int | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b by code point, of cosine at least `least`, where one is among the k nearest of the other."""
    found = nearest(vectors, None, k, wanted, least, exact=False)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
