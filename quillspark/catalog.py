"""Tables by name. A table is one Parquet path under the data folder; its columns are checked on opening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

COLUMNS = {
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
    "lineitem": ("l_orderkey", "l_partkey", "l_quantity"),
    "orders": ("o_orderkey", "o_custkey", "o_orderdate"),
    "customer": ("c_custkey", "c_nationkey"),
    "nation": ("n_nationkey", "n_regionkey"),
    "region": ("r_regionkey",),
    "part": ("p_partkey", "p_name"),
    "supplier": ("s_suppkey",),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that must be there, with the columns that queries rely on."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if lacking := [c for c in COLUMNS.get(name, ()) if c not in df.columns]:
        raise ValueError(f"{name} has no column {', '.join(lacking)}")
    return df


def optional_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table that may be missing: then an empty one of the given schema."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    except AnalysisException:
        return spark.createDataFrame([], schema)
