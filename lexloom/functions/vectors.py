"""Vector functions on array columns (FN-12..17, AGG-23)."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """FN-12."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """FN-14. 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """FN-15."""
    return clamp01(cosine(a, b))


def softmax(values: Column) -> Column:
    """FN-13. Stable: the greatest value is subtracted first."""
    powers = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda p: p / total)


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """AGG-23. Mean vector of each group, of unit length. Means are taken by position, so a task holds sums only."""
    means = (
        rows.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))
    )
    size = norm(F.col("mean"))
    return means.select(group, F.transform("mean", lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0))).alias("centroid"))


def hash_embedding(dimension: int = 384, model: str = "local"):
    """FN-16. Deterministic unit vectors from SHA-256 counter blocks of a text, as a pandas function."""

    def one(text: str | None) -> list[float]:
        seed, values, counter = f"{model}:{text or ''}".encode(), [], 0
        while len(values) < dimension:
            block = hashlib.sha256(seed + struct.pack(">I", counter)).digest()
            values += [x / 0xFFFFFFFF * 2 - 1 for x in struct.unpack(">8I", block)]
            counter += 1
        v = np.array(values[:dimension])
        return (v / np.linalg.norm(v)).tolist()

    def run(text: pd.Series) -> pd.Series:
        return text.map(one)

    return F.pandas_udf(run, "array<double>")


def gram_embedding(dimension: int = 384):
    """FN-17. Words and character 3- to 5-grams hashed with a sign, of unit length, as a pandas function."""

    def one(text: str | None) -> list[float]:
        v = np.zeros(dimension)
        t = (text or "").lower()
        items = t.split() + [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]
        for item in items:
            h = int.from_bytes(hashlib.blake2b(item.encode(), digest_size=8).digest(), "big")
            v[h % dimension] += 1 if h >> 63 else -1
        size = np.linalg.norm(v)
        return (v / size if size else v).tolist()

    def run(text: pd.Series) -> pd.Series:
        return text.map(one)

    return F.pandas_udf(run, "array<double>")
