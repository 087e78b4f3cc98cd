"""Helpers shared by the operators: consecutive groups of sorted Arrow batches, and connected components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.tables import persisted


#: Copies of one text that are written out in all pairs, unless the caller asks for more.
COPIES = 256


def expanded(links: DataFrame, classes: DataFrame, copies: int | None = COPIES) -> DataFrame:
    """(a, b), a < b: pairs of the records of classes(id, rep) that links(a, b) between reps and equal texts stand for.

    A class of more than `copies` records isn't written out in all its pairs: its rep speaks for it in links, and each of
    its other records is paired with the rep, which the classes tell. copies None: all pairs, however many. No link
    between different texts is lost if a class holds copies of one text.
    """
    links = links.distinct()
    if copies is None:
        speaks, several, crowd = classes.select("id", "rep"), classes.select("id", "rep"), None
    else:
        sized = classes.join(classes.groupBy("rep").agg(F.count("*").alias("n")), "rep")
        speaks = sized.where((F.col("n") <= copies) | (F.col("id") == F.col("rep"))).select("id", "rep")
        several = sized.where((F.col("n") > 1) & (F.col("n") <= copies)).select("id", "rep")
        crowd = sized.where((F.col("n") > copies) & (F.col("id") != F.col("rep"))).select("rep", "id")
    across = links.join(speaks.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(speaks.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = several.join(several.select("rep", F.col("id").alias("other")), "rep").where("id < other").select("id", "other")
    pairs = across.union(within)
    return (pairs if crowd is None else pairs.union(crowd)).distinct()


def consecutive(batches: Iterator[pa.RecordBatch], key: str = "task") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the offsets at which groups begin and end; rows must be sorted by key (bigint)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column(key).to_numpy()
        if keys[0] == keys[-1] and len(held) > 1 and held[0].column(key)[0].as_py() == keys[0]:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        if len(edges) > 1:
            yield table.slice(0, edges[-1]), edges
            held = table.slice(edges[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        yield table, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of undirected links (a, b): the smallest node of each connected component.

    Alternating large-star and small-star steps until nothing changes; every step is written to the shared folder and
    no component is collected. Nodes without links don't appear.
    """
    edges = persisted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), label)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = persisted(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m"))).where("u != v").distinct()
        small = persisted(small, label)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", F.col("v").alias("component")).distinct()
    )
