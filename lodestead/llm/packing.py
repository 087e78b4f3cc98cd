"""Problem 7: filling fixed-capacity containers by best-two-fit."""

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Items per shard, on average. A shard is packed by one task and leaves at most a few containers badly filled.
SHARD_ITEMS = 20_000


class _Stock:
    """Items by size: add, take one, and the largest size at most x."""

    def __init__(self, items: list[tuple[int, int]]):
        self.by_size: dict[int, list[int]] = {}
        for size, k in sorted(items, reverse=True):
            self.by_size.setdefault(size, []).append(k)
        self.sizes = sorted(self.by_size)

    def fit(self, room: int) -> int:
        """The largest size there is that is at most room, or 0."""
        i = bisect.bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int) -> int:
        k = self.by_size[size].pop()
        if not self.by_size[size]:
            del self.by_size[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]
        return k

    def put(self, size: int, k: int) -> None:
        if size not in self.by_size:
            self.by_size[size] = []
            bisect.insort(self.sizes, size)
        self.by_size[size].append(k)

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Sizes of two items whose sum is the largest one at most room, if it is greater than above."""
        best = None
        i = bisect.bisect_right(self.sizes, room - 1) - 1
        while i >= 0 and 2 * self.sizes[i] > above:
            a = self.sizes[i]
            b = self.fit(min(a, room - a))
            if b == a and len(self.by_size[a]) < 2:
                b = self.fit(a - 1)
            if b and a + b > above:
                best, above = (a, b), a + b
                if above == room:
                    break
            i -= 1
        return best


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of positions in sizes. No size may be above the capacity.

    A container takes the largest item that fits until none does; then its smallest item is replaced by the two unpacked
    items that fit the gap so widened more tightly, if there are such.
    """
    stock = _Stock([(s, k) for k, s in enumerate(sizes)])
    out = []
    while stock.sizes:
        held: list[tuple[int, int]] = []
        room = capacity
        while size := stock.fit(room):
            held.append((size, stock.take(size)))
            room -= size
        if room:
            size, k = held[-1]
            if two := stock.best_two(room + size, size):
                held.pop()
                stock.put(size, k)
                held += [(s, stock.take(s)) for s in two]
        out.append([k for _, k in held])
    return out


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container string, doc_id, part, token_start, token_end): every token of every document in one container.

    Size: n_tokens, or one token per UTF-8 byte of text and a closing one where n_tokens is null or below 1 (null text:
    the closing token). A document above the capacity becomes full parts and a rest; other documents stay whole. Rows
    are spread over shards by the hash of doc_id, so no key is hot; a row that is repeated counts once. With no documents
    there are no containers.
    """
    size = F.when(F.col("n_tokens") >= 1, F.col("n_tokens")).otherwise(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    items = documents.where("doc_id is not null").select("doc_id", size.alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    shards = max(1, -(-documents.count() // shard_items))
    parts = items.select(
        "doc_id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {capacity}"))).alias("part")
    ).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", F.col("part").cast("int").alias("part"),
        (F.col("part") * capacity).alias("token_start"), F.least(F.col("size"), (F.col("part") + 1) * capacity).alias("token_end"),
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], ignore_index=True)
        number = [0] * len(pdf)
        for n, held in enumerate(pack((pdf.token_end - pdf.token_start).tolist(), capacity)):
            for k in held:
                number[k] = n
        return pdf.assign(container=[f"{s}-{n}" for s, n in zip(pdf.shard, number)])[["container", "doc_id", "part", "token_start", "token_end"]]

    return parts.groupBy("shard").applyInPandas(fill, "container string, doc_id bigint, part int, token_start bigint, token_end bigint")
