"""Embedding hook: any function from texts to vectors; by default hashed words, which needs no model."""

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """Counts of lower-case words in hashed places with hashed signs, at unit length; a text without words is zero."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts):
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            h = zlib.crc32(w.encode())
            row[h % dim] += 1.0 if h >> 31 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(table: DataFrame, text_col: str = "text", embedder: Embedder = hashed_words, batch: int = 16, out_col: str = "vector") -> DataFrame:
    """table with the vector of a text column, of which the model reads 2000 characters; null text gives a null vector."""
    schema = table.drop(out_col)
    ddl = ", ".join([*(f"`{c}` {k}" for c, k in schema.dtypes), f"{out_col} array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for s in range(0, len(known), batch):
                part = known[s : s + batch]
                for i, v in zip(part, embedder([texts[i][:2000] for i in part])):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, out_col])

    return schema.mapInArrow(run, ddl)


def embed_one(text: str, embedder: Embedder = hashed_words) -> list[float]:
    return [float(x) for x in embedder([text[:2000]])[0]]
