"""Cutting lineage and keeping tables, in a way that survives lost executors; broadcasting what has been counted."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows, after they have been counted.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one set on the context. Only in local mode, if neither is set, a temporary one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of the frame in the shared folder."""
    folder = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def keep(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table of its own in the shared folder, and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has no more rows than ``most``: they are counted first. Else Spark joins as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def met(rows: DataFrame, side: DataFrame, key: str, most: int = BROADCAST_ROWS, slices: int = 12) -> DataFrame:
    """The inner join with a side that has a key once, without shuffling the rows: the side is broadcast in slices, each of which meets all rows.

    Beyond ``slices`` of ``most`` rows Spark joins as it sees fit.
    """
    n = max(1, -(-side.count() // most))
    if n > slices:
        return rows.join(side, key)
    parts = [side.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [side]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(p), key) for p in parts])
