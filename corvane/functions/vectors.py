"""Vectors: similarity, and embeddings by hashing of words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def hash_embedding(df: DataFrame, record: str, column: str, dimension: int = 64) -> DataFrame:
    """(record, embedding) from words hashed by MD5: all built-in, so it runs without Python.

    Word w adds 1 or -1 (by the digest's 16th hex digit) at its first 15 hex digits modulo `dimension`. Not normalised;
    texts without words have a vector of zeros. Rows of one record are added up.
    """
    words = F.explode_outer(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)))
    hashed = df.select(F.col(record).alias("_id"), words.alias("_w")).select("_id", F.md5(F.col("_w")).alias("_h"), F.col("_w").isNotNull().alias("_some"))
    at = F.pmod(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"), F.lit(dimension)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring("_h", 16, 1), 16, 10).cast("int"), F.lit(2)) == 1, 1).otherwise(-1)
    summed = hashed.groupBy("_id", F.coalesce(at, F.lit(0)).alias("_at")).agg(F.sum(F.when(F.col("_some"), sign).otherwise(0)).alias("_v"))
    cells = summed.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0)).cast("double"))
    return cells.select(F.col("_id").alias(record), vector.alias("embedding"))


class HashingEmbedder:
    """Words hashed by BLAKE2b into a vector of length 1 (or 0 for a text without words). Needs no model."""

    WORD = re.compile(r"[\w-]+")

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension
        self.version = f"hashing-v1:{dimension}"

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in self.WORD.findall((text or "").casefold()):
                value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[value % self.dimension] += 1.0 if value >> 8 & 1 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def embed(self, column: Column) -> Column:
        dimension = self.dimension

        @F.pandas_udf("array<float>")
        def embedded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = HashingEmbedder(dimension)
            for batch in texts:
                yield pd.Series(list(model.vectors(batch.tolist())))

        return embedded(column)
