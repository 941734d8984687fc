"""From raw documents to packed token sequences.

Each stage takes what its predecessor kept; ``run`` writes it as Parquet and reads it again, so
that a lost executor costs one stage's tasks at most. All stages but the last return the columns
of ``documents``. Nulls, empty texts and empty tables are as each operator defines; other columns may
be of any kind, maps too. Of rows that a stage takes for one document, the one whose whole row has
the smallest hash stays, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, free_name, row_check, row_key
from quillspark.llm.exact_dedup import LAST, classes, with_digest
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.language_id import UNKNOWN, predictor, train
from quillspark.llm.mixing import mix_sources
from quillspark.llm.packing import pack_documents

#: A text that is nearly orthogonal to every language's prototype is in none of them.
LEAST_SCORE = 0.05


def whole_rows(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, source, lang``: every row in one struct, beside the columns that operators read.

    Whatever other columns are called, they cannot meet the names that a stage gives.
    """
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string"}
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def row_hash(seed: int, row: str = "row") -> Column:
    """A hash of all columns, whatever their kinds. Null fields are left out of the JSON, so they differ from every value."""
    return F.xxhash64(F.lit(seed), F.to_json(row))


def one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows themselves, one for each key: that of the smallest hash."""
    least = F.min_by("row", F.struct(row_hash(1), row_hash(2)))
    return rows.groupBy(*keys).agg(least.alias("row")).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that resemble no language. Their lang stays as it is.

    Where no document has a language there is nothing to resemble: all with letters stay.
    """
    found = free_name(docs, "found")
    langs, prototypes = train(whole_rows(docs).select("doc_id", "text", "lang"))
    if not langs:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    rows = docs.withColumn(found, predictor(langs, prototypes)(F.col("text").cast("string")))
    kept = rows.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: that of the smallest doc_id; of several of that doc_id see ``one_of_each``."""
    rows = whole_rows(docs)
    _, found = classes(spark, rows.select("doc_id", "text"), Scratch(spark, "exact"))
    rows = with_digest(rows).withColumn("keep_id", F.coalesce("doc_id", F.lit(LAST)))
    kept = rows.join(found.select("keep_id", "digest"), ["keep_id", "digest"], "left_semi")
    return one_of_each(kept, "keep_id", "digest")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest doc_id. Rows are known by doc_id and text."""
    rows = whole_rows(docs)
    found = jaccard_components(spark, rows.select("doc_id", "text"), by_row=True)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("rk").alias("key")))
    kept = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias("key"))
    rows = rows.withColumn("key", row_key()).withColumn("rc", row_check())
    return one_of_each(rows.join(kept, "key", "left_semi"), "key", "rc")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole copies of documents, as many as the mix says; a second copy is a row of its own."""
    rows = whole_rows(docs)
    rows = rows.withColumn("key", F.concat_ws(":", row_hash(1), row_hash(2)))  # rows of one key are equal in every column
    copies = mix_sources(spark, rows.select("doc_id", "text", "source", "key"), key="key").groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    kept = rows.select("key", "row").dropDuplicates(["key"]).join(copies, "key")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; one row per piece."""
    return pack_documents(spark, docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mix),
    ("packing", packing),
]
#: The last stage's checksums are of token ids, which SQL cannot make; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
