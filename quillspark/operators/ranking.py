"""Fusing ranked lists, scoring rows, cutting result lists, and judging them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid

RRF_K = 60


def fuse(lists: dict[str, tuple[DataFrame, float]], k: float = RRF_K) -> DataFrame:
    """``query_id, id, score, sources, rank``: weighted reciprocal ranks, raised where two or more lists agree.

    Each list is ``(query_id, id, rank)``.
    """
    rows = None
    for name, (df, weight) in lists.items():
        part = df.select("query_id", "id", F.lit(name).alias("source"), (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    sums = rows.groupBy("query_id", "id").agg(F.sum("part").alias("s"), F.count_distinct("source").alias("sources"))
    score = F.round(F.col("s") * F.when(F.col("sources") >= 3, 1.4).when(F.col("sources") == 2, 1.2).otherwise(1.0), 8)
    sums = sums.select("query_id", "id", score.alias("score"), "sources")
    return sums.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def fusion_grid(rows: DataFrame, wanted: DataFrame, ks: tuple[int, ...], top: int = 10) -> DataFrame:
    """``k, queries, ndcg10, mrr, hit_rate``: how well each constant of the reciprocal ranks finds what is wanted.

    ``rows(query_id, id, rank, w)`` of all lists, ``wanted(query_id, id)``.
    """
    each = F.explode(F.array(*[F.lit(float(k)) for k in ks])).alias("k")
    sums = rows.select("*", each).groupBy("k", "query_id", "id").agg(F.round(F.sum(F.col("w") / (F.col("k") + F.col("rank"))), 8).alias("s"))
    order = sums.withColumn("rank", F.row_number().over(W.partitionBy("k", "query_id").orderBy(F.desc("s"), "id"))).where(F.col("rank") <= top).select("k", "query_id", "id", "rank")
    hits = wanted.select("*", each).join(order, ["k", "query_id", "id"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count("*"), F.lit(top)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    gain = F.sum(F.coalesce(1.0 / F.log2(F.col("rank") + 1.0), F.lit(0.0)))
    one = hits.groupBy("k", "query_id").agg(F.round(gain / ideal, 6).alias("ndcg"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return one.groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 5).alias("ndcg10"), F.round(F.avg("rr"), 5).alias("mrr"), F.round(F.avg((F.col("rr") > 0).cast("int")), 5).alias("hit_rate"))


def group_scores(ranked: DataFrame, member: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, g, score, best, rank``: groups by the sum of their members' scores over the root of their number."""
    rows = ranked.join(member, "id").groupBy("query_id", "g").agg(F.round(F.sum("score") / F.sqrt(F.count("*")), 6).alias("score"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("best"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "g"))).where(F.col("rank") <= k)


def tiers(rows: DataFrame, weight: Column) -> DataFrame:
    """Adds ``tier`` and ``specificity`` from similarity ``sim``, fused score ``rrf`` and lexical coverage ``lex``, ``phrase`` evidence, ``topical``."""
    rrf = F.least(8 * F.col("rrf"), F.lit(0.99))
    gate = sigmoid(20 * (F.col("sim") - (0.28 - 0.08 * (weight - 0.5))))
    tier = F.when(F.col("phrase"), 2).when(gate >= 0.5, 3).when(F.col("topical"), 4).otherwise(5)
    within = F.when(F.col("phrase"), F.greatest("sim", 0.6 * F.col("lex"), rrf)).when(gate >= 0.5, gate * F.col("sim")).when(F.col("topical"), gate * F.col("sim") + (1 - gate) * rrf).otherwise(rrf + 0.3 * gate * F.col("sim"))
    return rows.withColumn("tier", tier).withColumn("specificity", F.round((6 - F.col("tier")) + F.least(F.lit(0.99), within), 6))


def above_floor(rows: DataFrame, least: float = 0.15, share: float = 0.08, top: int = 20) -> DataFrame:
    """Rows similar enough, or with a fused score not far below the best of the first."""
    w = W.partitionBy("query_id")
    best = F.max(F.when(F.col("rank") <= top, F.col("rrf"))).over(w)
    return rows.withColumn("_floor", F.greatest(share * best, F.lit(0.001))).where((F.col("sim") >= least) | (F.col("rrf") >= F.col("_floor"))).drop("_floor")


def elbow(rows: DataFrame, most: int = 24) -> DataFrame:
    """``query_id, keep, support`` of lists of six or more whose first is of a high tier: after which rank they fall off; lists that do not have no row.

    Rows: ``query_id, rank, tier, specificity, meaning, confidence``, the first ``most`` of which count. A cut
    keeps two rows and leaves three at least; it needs a gap that stands out among all gaps (by median and MAD), little mass of
    the scores behind it, and a margin of meaning between what is before and the next five. The best supported one counts.
    """
    w = W.partitionBy("query_id")
    order = w.orderBy("rank")
    r = rows.where(F.col("rank") <= most).withColumn("n", F.count("*").over(w)).withColumn("head_tier", F.min(F.when(F.col("rank") == 1, F.col("tier"))).over(w)).where("n >= 6 AND head_tier <= 3")
    r = r.withColumn("gap", F.col("specificity") - F.lead("specificity").over(order))
    sorted_ = lambda c: F.array_sort(F.collect_list(c))
    at = lambda a, share: F.get(a, F.floor((F.size(a) - 1) * share).cast("int"))
    median = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    lists = r.groupBy("query_id").agg(sorted_("specificity").alias("s"), sorted_("gap").alias("g"), F.max("specificity").alias("top"))
    lists = lists.withColumn("mid", median(F.col("g")))
    lists = lists.withColumn("sigma", F.greatest(F.lit(0.02), 1.4826 * median(F.array_sort(F.transform("g", lambda x: F.abs(x - F.col("mid")))))))
    lists = lists.withColumn("heat", F.greatest(F.lit(0.08), (at(F.col("s"), 0.75) - at(F.col("s"), 0.25)) / 1.349)).select("query_id", "mid", "sigma", "heat")
    r = r.withColumn("first", F.first("specificity").over(order)).join(lists, "query_id")
    r = r.withColumn("e", F.exp((F.col("specificity") - F.col("first")) / F.col("heat")))
    tail = F.greatest(F.lit(0.0), 1 - F.sum("e").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("e").over(w))
    margin = F.avg("meaning").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.avg("meaning").over(order.rowsBetween(1, 5))
    r = r.withColumn("z", (F.col("gap") - F.col("mid")) / F.col("sigma")).withColumn("tail", tail).withColumn("margin", margin)
    factor = 0.8 + F.least(F.lit(0.2), 0.2 * F.greatest(F.lit(0.0), F.col("confidence")))
    r = r.withColumn("support", F.round(F.col("z") * (1 - F.col("tail")) * F.greatest("margin", F.lit(0.0)) * factor, 6))
    fits = (F.col("rank") >= 2) & (F.col("n") - F.col("rank") >= 3) & (F.col("z") >= 2.5) & (F.col("tail") <= 0.35) & (F.col("margin") >= 0.18)
    best = r.where(fits).groupBy("query_id").agg(F.max(F.struct("support", (-F.col("rank")).alias("rank"))).alias("b"))
    return best.where("b.support >= 0.9").select("query_id", (-F.col("b.rank")).alias("keep"), "b.support")


def judge(results: DataFrame, wanted: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``query_id, rr, top1, top3`` and ``ndcg`` at each k, from ``results(query_id, id, rank)`` and ``wanted(query_id, id)``."""
    hits = wanted.join(results, ["query_id", "id"], "left")
    gain = lambda k: F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.count("*"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    first = F.min("rank")
    return hits.groupBy("query_id").agg(
        F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("rr"), F.coalesce(first <= 1, F.lit(False)).alias("top1"), F.coalesce(first <= 3, F.lit(False)).alias("top3"),
        *[F.round(gain(k) / ideal(k), 6).alias(f"ndcg{k}") for k in ks])


def monotonicity(rows: DataFrame, score: str) -> DataFrame:
    """``query_id, monotone``: of neighbours in a list, how many do not rise."""
    order = W.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("p", F.lag(score).over(order)).where("p IS NOT NULL").groupBy("query_id").agg(F.round(F.avg((F.col(score) <= F.col("p")).cast("double")), 6).alias("monotone"))


def diversified(candidates: DataFrame, k: int = 20, memory: int = 8, boost: float = 2.0) -> DataFrame:
    """``query_id, id, rank``: greedy choice of what is relevant and unlike the last picks, among a few hundred candidates a query.

    ``candidates(query_id, id, score, v, rrf, trade)``: ``trade`` is what relevance weighs against variety,
    ``rrf`` is added ``boost`` times. Every pick depends on those before it, so a query is one group; ties go to the better score, then the smaller id.
    """
    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        m = np.array([np.asarray(v, np.float64) for v in f["v"]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        trade, score, extra = float(f["trade"].iloc[0]), f["score"].to_numpy(), boost * f["rrf"].to_numpy()
        left, chosen = list(range(len(f))), []
        while left and len(chosen) < k:
            near = np.maximum(0, (m[left] @ m[chosen[-memory:]].T).max(1)) if chosen else np.zeros(len(left))
            chosen.append(left.pop(int(np.argmax(np.round(trade * score[left] - (1 - trade) * near + extra[left], 9)))))
        return pd.DataFrame({"query_id": f["query_id"].iloc[0], "id": f["id"].to_numpy()[chosen], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, id long, rank int")


def transport(pairs: DataFrame, rounds: int = 15, epsilon: float = 0.1) -> DataFrame:
    """``query_id, id, cost``: optimal transport between two sets of vectors by Sinkhorn's iteration, uniform weights.

    ``pairs(query_id, id, a, b)``, a and b arrays of vectors.
    """
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b in zip(f["a"], f["b"], strict=True):
                x, y = (np.array([np.asarray(v, np.float64) for v in s]) for s in (a, b))
                cost = np.sqrt(np.maximum(((x[:, None] - y[None]) ** 2).sum(2), 0))
                kernel, u, v = np.exp(-cost / epsilon), np.ones(len(x)) / len(x), np.ones(len(y)) / len(y)
                left, right = np.ones(len(x)), np.ones(len(y))
                for _ in range(rounds):
                    left = u / np.maximum(kernel @ right, 1e-300)
                    right = v / np.maximum(kernel.T @ left, 1e-300)
                out.append(float((left[:, None] * kernel * right * cost).sum()))
            yield pd.DataFrame({"query_id": f["query_id"], "id": f["id"], "cost": out})

    return pairs.mapInPandas(go, "query_id long, id long, cost double")


def blended(similarity: Column, cost: Column, confidence: Column) -> Column:
    """Similarity with 0.4 of what transport says, where the search is not sure of itself and there is any similarity."""
    return F.when((confidence < 0.7) & (similarity > 0), F.round(0.6 * similarity + 0.4 * F.exp(-3.0 * cost), 4)).otherwise(F.round(similarity, 4))


def alignment(pairs: DataFrame, window: int = 50, overlap: float = 1.0) -> DataFrame:
    """``query_id, id, chamfer, emd, score``: how near two sequences of vectors are as sets, in order, and both.

    ``pairs(query_id, id, a, b)``, a and b arrays of vectors of tokens. ``chamfer`` is the mean distance (1 - cosine) to the nearest of
    the other side; ``emd`` the cheapest path that passes both in order, of b's first ``window``, by length of a, 1 at most. ``overlap`` is the share of tokens in common.
    """
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda s: (m := np.array([np.asarray(v, np.float64) for v in s])) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        for f in frames:
            out = []
            for a, b in zip(f["a"], f["b"], strict=True):
                cost = 1 - np.clip(unit(a) @ unit(b).T, 0, 1)
                chamfer = (cost.min(1).mean() + cost.min(0).mean()) / 2
                path = np.full((len(cost) + 1, min(cost.shape[1], window) + 1), np.inf)
                path[0, 0] = 0
                for i in range(1, path.shape[0]):
                    for j in range(1, path.shape[1]):
                        path[i, j] = cost[i - 1, j - 1] + min(path[i - 1, j - 1], path[i, j - 1], path[i - 1, j])
                out.append((chamfer, min(1.0, path[-1, 1:].min() / len(cost))))
            c, e = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0))
            score = np.minimum(1, 0.5 * np.exp(-3 * c) + 0.3 * np.exp(-2.5 * e) + 0.2 * overlap)
            yield pd.DataFrame({"query_id": f["query_id"], "id": f["id"], "chamfer": c.round(6), "emd": e.round(6), "score": score.round(6)})

    return pairs.mapInPandas(go, "query_id long, id long, chamfer double, emd double, score double")
