"""The engine's functions under names for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.functions import text, vectors


def register(spark: SparkSession, prefix: str = "fl_", dim: int = 64) -> list[str]:
    """Registers the batch functions (Arrow) for spark.sql: html_unescape, hash_embedding and cosine. Gives their names."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([vectors.cosine_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    found = {"html_unescape": text.unescaped_batch, "hash_embedding": vectors.hash_embedding(dim), "cosine": cosine}
    for name, function in found.items():
        spark.udf.register(prefix + name, function)
    return [prefix + n for n in found]
