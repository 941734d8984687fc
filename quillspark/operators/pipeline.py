"""The search pipeline: a table of queries in, one ranked and tiered list for each out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..lineage import keep, met
from . import fts, ranking, termstats


def search(index: fts.Index, queries: DataFrame, k: int = 10, lane_k: int = 50, phrase_weight: float = 3.0, lanes: dict[str, tuple[DataFrame, float]] | None = None, similar: DataFrame | None = None) -> DataFrame:
    """``query_id, id, rank, tier, specificity, sources`` for queries ``(item_id, text)`` over an index.

    Lexical lanes: BM25, exact phrase of the whole query, proximity of its longest words; ``lanes`` adds
    others, as ``(query_id, id, rank)`` with a weight. They are fused by reciprocal rank; fused rows get their share
    of the query's term weight, their similarity from ``similar(query_id, id, similarity)`` (else that share) and a tier,
    are cut at a floor, and are ordered by specificity. A query without any hit has no rows.
    """
    terms = keep(fts.query_terms(queries), "terms")
    best = fts.bm25(index, terms, lane_k).select("query_id", F.col("doc_id").alias("id"), "rank")
    by_id = W.partitionBy("query_id").orderBy("id")
    lane = lambda hits: hits.select("query_id", F.col("doc_id").alias("id")).withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= lane_k)
    exact = keep(lane(fts.phrase(index, terms)), "exact")
    close = lane(fts.near(index, fts.longest(terms)))
    fused = keep(ranking.fuse({"bm25": (best, 1.0), "phrase": (exact, phrase_weight), "near": (close, 1.0), **(lanes or {})}), "fused")
    covered = fts.coverage(index, termstats.term_weights(index, terms)).withColumnRenamed("doc_id", "id")
    rows = fused.join(covered, ["query_id", "id"], "left").join(exact.select("query_id", "id", F.lit(True).alias("phrase")), ["query_id", "id"], "left").withColumn("lex", F.coalesce("coverage", F.lit(0.0)))
    rows = rows.join(similar.select("query_id", "id", F.col("similarity").alias("sim")), ["query_id", "id"], "left") if similar is not None else rows.withColumn("sim", F.col("lex"))
    rows = rows.select("query_id", "id", "rank", "sources", F.col("score").alias("rrf"), "lex", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.coalesce("phrase", F.lit(False)).alias("phrase"), F.lit(False).alias("topical"))
    rows = ranking.tiers(ranking.above_floor(rows), F.lit(0.5))
    order = W.partitionBy("query_id").orderBy(F.desc("specificity"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "tier", "specificity", "sources")


def cluster_labels(index: fts.Index, member: DataFrame, k: int = 5, least_idf: float = 4.5) -> DataFrame:
    """``g, term, weight, rank``: of each group the k terms of greatest tf * idf among the rare ones that are no numbers."""
    idfs = termstats.inverse_document_frequency(index).where((F.col("idf") >= least_idf) & ~F.col("term").rlike("^[0-9-]+$")).select("term", "idf")
    # Postings meet their groups where they are, and are added up before anything is shuffled.
    tf = met(index.posts.select("doc_id", "term", "tf"), member, "doc_id").groupBy("g", "term").agg(F.sum("tf").alias("tf")).join(idfs, "term")
    rows = tf.select("g", "term", F.round(F.col("tf") * F.col("idf"), 4).alias("weight"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= k)


def training_pairs(rows: DataFrame, anchor: str, positive: str, group: str, seed: str = "pairs") -> DataFrame:
    """``anchor, positive, negative``: distinct pairs with the next row of the same group as negative, in an order by hash."""
    pairs = rows.where(F.col(anchor).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(anchor).alias("anchor"), F.col(positive).alias("positive")).agg(F.min(group).alias("g"))
    order = W.partitionBy("g").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "anchor", "positive")), "anchor", "positive")
    return pairs.withColumn("negative", F.lead("positive").over(order)).where("negative IS NOT NULL AND negative <> positive").select("anchor", "positive", "negative")
