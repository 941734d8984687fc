"""Writing: tables as a whole, bundles of tables, what is not embedded yet, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def rebuild(df: DataFrame, path: str, files: int | None = None) -> None:
    """Writes a table anew in place of what is there; run twice, it leaves the same. ``files`` compacts it to so many."""
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)


def bundle(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes several tables under a folder, each anew, and returns ``table, n_rows, n_columns`` of what can be read there."""
    parts = []
    for name, df in tables.items():
        rebuild(df, f"{folder}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        parts.append(back.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")))
    return reduce(DataFrame.union, parts)


@F.pandas_udf(ArrayType(DoubleType()))
def decoded(blobs: pd.Series) -> pd.Series:
    """Vectors from little-endian 32-bit floats; null and bytes that are no whole number of floats give null."""
    return blobs.map(lambda b: np.frombuffer(b, "<f4").astype(float).tolist() if b is not None and len(b) % 4 == 0 else None)


def missing(all_: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows that are not present yet."""
    return all_.join(present.select(key), key, "left_anti")


def encoded(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = 50) -> DataFrame:
    """``key, embedding``: texts through an encoder that is given, so many at once; null texts are empty."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t or "" for t in f[text]]
            for i in range(0, len(texts), batch):
                yield pd.DataFrame({key: f[key].iloc[i : i + batch].to_numpy(), "embedding": list(np.asarray(encode(texts[i : i + batch]), float))})

    return rows.select(key, text).mapInPandas(go, f"{key} long, embedding array<double>")


def impressions(shown: DataFrame, clicked: DataFrame, top: int = 20) -> DataFrame:
    """``query_id, id, rank, clicked``: a row for each result shown among the first, and one for each click.

    ``shown(query_id, id, rank)`` with ranks from 1, ``clicked(query_id, id)``.
    """
    log = shown.where(F.col("rank") <= top).select("query_id", "id", (F.col("rank") - 1).cast("int").alias("rank"))
    clicks = clicked.join(log, ["query_id", "id"], "left").select("query_id", "id", "rank")
    return log.withColumn("clicked", F.lit(0)).unionByName(clicks.withColumn("clicked", F.lit(1)))
