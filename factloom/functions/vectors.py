"""Vector functions on array<float> columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length; null where their dimensions differ."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms > 0, dot(a, b) / norms).otherwise(0.0))


def cosine_of(a, b) -> float | None:
    """cosine() of two plain sequences."""
    if a is None or b is None or len(a) != len(b):
        return None
    x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
    norms = float(np.sqrt((x @ x) * (y @ y)))
    return float(x @ y) / norms if norms > 0 else 0.0


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): the mean vector of each key, component sums combined before they are shuffled."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def hyperplane_bucket(vector: Column, dim: int, bits: int = 8, seed: int = 11) -> Column:
    """The side of `bits` fixed random hyperplanes on which a vector lies, as text: near vectors mostly share it. A
    partition for clustering at scales where one group can't be sequential; clusters across its borders are lost."""
    planes = np.random.default_rng(seed).standard_normal((bits, dim))
    sides = [F.when(dot(vector, F.array(*[F.lit(float(x)) for x in p])) >= 0, "1").otherwise("0") for p in planes]
    return F.concat(*sides)


def hash_embedding(dim: int = 64):
    """A deterministic encoder as a pandas UDF: signed word hashes, unit length; zeros for text without words."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = []
            for t in part:
                v = np.zeros(dim, np.float32)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1.0 if h & 0x40000000 else -1.0
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed


def encode_missing(df: DataFrame, body: str, vector: str = "embedding", encode=None, dim: int = 64) -> DataFrame:
    """`df` with a vector wherever there was none, made of `body`; only those texts go to the encoder."""
    encode = encode or hash_embedding(dim)
    missing = F.col(vector).isNull()
    return df.withColumn(vector, F.coalesce(vector, encode(F.when(missing, F.col(body)))))
