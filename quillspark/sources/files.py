"""CSV, and JSON as models write it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV after RFC 4180: quotes doubled inside quotes, quoted fields over several lines."""
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, quote='"', escape='"')


def split_csv(line: Column, fields: int) -> Column:
    """The first fields of a line up to so many commas, and the rest as it is, without enclosing quotes."""
    part = F.split(line, ",", fields)
    return F.transform(part, lambda p: F.regexp_replace(F.trim(p), '^"|"$', ""))


def recovered_array(text: Column, schema: str) -> Column:
    """An array of structs from JSON in a code fence, with commas too many, bare keys or a cut tail; null if nothing can be read."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*|```.*$", ""), r",\s*([\]}])", "$1")
    t = F.regexp_replace(t, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    start = F.instr(t, "[")
    body = F.when(start > 0, F.substring(t, start, F.length(t)))
    last = F.regexp_extract(body, r"(?s)^(.*\})", 1)
    whole = F.when(F.rtrim(body).endswith("]"), body).when(last != "", F.concat(last, F.lit("]")))
    return F.from_json(whole, f"array<{schema}>")


def listed(text: Column, kind: str = "string") -> Column:
    """A JSON list column; what is null or no list is an empty one."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
