"""Token counts kept as rollups under signed changes.

A change is a row ``(source, lang, tokenizer_version, sign, docs, tokens)``: an insert adds, a
delete takes away, a revised count takes the old away and adds the new. A batch of changes is
summed by key before anything is written and is committed under its name: its folder counts once
Spark has marked the write as complete, a batch that is there is not written again, and one that
broke off is written over. Totals add the committed batches; ``compact`` replaces them by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import Scratch, chunks, column, columns_or_null
from .mixing import word_count
from .tokens import CHUNK, WordEncoder

KEY = ("source", "lang", "tokenizer_version")
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    """A table of batches in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        """The names of the batches that count."""
        fs, root = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = sorted(n for n in names if n.startswith("batch=") and fs.exists(self._fs(f"{self.root}/{n}/_SUCCESS")[1]))
        compacted = [n for n in found if n.startswith("batch=upto-")]
        if not compacted:
            return found
        # a compacted batch holds a list of what it replaces
        gone = {r[0] for n in compacted for r in self.spark.read.schema("name string").json(f"{self.root}/replaced/{n}").collect()}
        return [n for n in found if n not in gone]

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Adds a batch, once: False if it is there. Names are given by whoever makes the batch and stay the same on a retry."""
        fs, done = self._fs(f"{self.root}/batch={name}/_SUCCESS")
        replaced, all_ = self._fs(f"{self.root}/replaced")
        if fs.exists(done) or (replaced.exists(all_) and f"batch={name}" in {r[0] for r in self.spark.read.schema("name string").json(f"{self.root}/replaced/*").collect()}):
            return False
        sums = changes.groupBy(*KEY).agg(F.sum(F.col("sign") * F.col("docs")).cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/batch={name}")
        return True

    def totals(self) -> DataFrame:
        """One row for each key with documents or tokens left."""
        names = self.committed()
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.root}/{n}" for n in names]) if names else self.spark.createDataFrame([], TOTALS)
        sums = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, name: str) -> None:
        """Sums the committed batches into one, once for each name. What it replaces is listed first, so a broken-off run changes nothing."""
        fs, done = self._fs(f"{self.root}/batch=upto-{name}/_SUCCESS")
        names = [n for n in self.committed() if n != f"batch=upto-{name}"]
        if fs.exists(done) or not names:
            return
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").json(f"{self.root}/replaced/batch=upto-{name}")
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.root}/{n}" for n in names])
        rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode("overwrite").parquet(f"{self.root}/batch=upto-{name}")


def token_counts(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """Adds ``n_bpe``: the number of ids of the whole text. Null and empty: 0."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("n_bpe", LongType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for whole in batches:
            for b in chunks(whole, CHUNK):
                n = encoder.count(column(b, text))
                yield pa.record_batch([*b.columns, pa.array(n.astype(np.int64))], [*b.schema.names, "n_bpe"])

    return docs.mapInArrow(go, schema)


def changes(rows: DataFrame, sign: int, **tokens: str) -> DataFrame:
    """Changes of one sign; ``tokens`` names the column with the count for each tokenizer version."""
    each = [F.struct(F.lit(v).alias("tokenizer_version"), F.col(c).cast("long").alias("tokens")) for v, c in tokens.items()]
    return rows.select("source", "lang", F.explode(F.array(*each)).alias("t")).select("source", "lang", "t.tokenizer_version", F.lit(sign).alias("sign"), F.lit(1).alias("docs"), "t.tokens")


def document_token_rollup(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``source, lang, tokenizer_version, n_docs, n_tokens`` of the distinct texts, by way of three batches.

    ``load`` inserts every document with its word count and, as a first guess for the BPE, a
    quarter of its characters; ``revise`` takes the guess back for the true count; ``dedup``
    deletes later copies of a text. A batch delivered twice changes nothing. Null sources and
    languages are keys of their own; null texts are empty. An empty table gives no rows.
    """
    scratch = Scratch(spark, "rollup")
    docs = columns_or_null(docs, doc_id="long", text="string", source="string", lang="string")
    counted = token_counts(docs.withColumn("n_words", word_count()).withColumn("guess", F.coalesce(F.length("text"), F.lit(0)) / 4).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))), tokenizer).drop("text")
    rows = scratch.save(counted.withColumn("guess", F.floor("guess")), "counts")
    rollup = TokenRollup(spark, f"{scratch.root}/rollup")
    load = changes(rows, 1, words="n_words", bpe49k="guess")
    rollup.commit("load", load)
    rollup.commit("revise", changes(rows, -1, bpe49k="guess").union(changes(rows, 1, bpe49k="n_bpe")))
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang")).alias("f"), F.count("*").alias("n"), F.first("n_words").alias("w"), F.first("n_bpe").alias("b"))
    many = scratch.save(first.where("n > 1"), "repeated")  # a table, so that Spark may split a hot digest in the join
    # all rows of a text go, its first comes back: sums by key, so a group of copies is never gathered
    gone = rows.join(many.select("digest"), "digest", "left_semi")
    back = many.select("f.source", "f.lang", F.col("w").alias("n_words"), F.col("b").alias("n_bpe"))
    rollup.commit("dedup", changes(gone, -1, words="n_words", bpe49k="n_bpe").union(changes(back, 1, words="n_words", bpe49k="n_bpe")))
    rollup.commit("load", load)  # delivered again
    return rollup.totals()


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_rollup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
