"""Learning from feedback: gradients of weights, one step of Adam, calibration curves, hard negatives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import dice
from ..lineage import small
from .events import bursts, millis, without_outliers


def gradients(feedback: DataFrame, slots: DataFrame) -> DataFrame:
    """``slot, gradient, n``: what clicks say about each weight, each weighed by the root of its rank against position bias.

    ``feedback(source, rank)`` with ranks from 0, ``slots(source, slot)``; ranks past 49 are dropped.
    """
    rows = feedback.where(F.col("rank").between(0, 49)).join(small(slots), "source")
    w = F.sqrt(F.col("rank") + 1.0)
    reciprocal = 1.0 / (F.col("rank") + 1.0)
    return rows.groupBy("slot").agg(F.round(F.sum((reciprocal - 0.15) * 0.01 * w) / F.sum(w), 8).alias("gradient"), F.count("*").alias("n"))


def adam(weights: DataFrame, grads: DataFrame, step: int = 1, rate: float = 0.01, low: float = 0.05, high: float = 3.0) -> DataFrame:
    """``slot, weight, m, v`` after a step towards the gradient; half of a move of more than a fifth, within bounds."""
    rows = weights.join(grads.select("slot", "gradient"), "slot", "left").withColumn("g", F.coalesce("gradient", F.lit(0.0)))
    rows = rows.withColumn("m", 0.9 * F.col("m") + 0.1 * F.col("g")).withColumn("v", 0.999 * F.col("v") + 0.001 * F.col("g") * F.col("g"))
    move = rate * (F.col("m") / (1 - 0.9**step)) / (F.sqrt(F.col("v") / (1 - 0.999**step)) + 1e-8)
    rows = rows.withColumn("move", F.when(F.abs(move) > 0.2 * F.col("weight"), move / 2).otherwise(move))
    return rows.select("slot", F.round(F.least(F.lit(high), F.greatest(F.lit(low), F.col("weight") + F.col("move"))), 8).alias("weight"), F.round("m", 10).alias("m"), F.round("v", 12).alias("v"))


def _pool(f: pd.DataFrame) -> list[tuple[float, float, int, int]]:
    """Pools adjacent violators of rows ``low, high, s, n`` in order: blocks whose rate exceeds the next one's are joined."""
    blocks: list[tuple[float, float, int, int]] = []
    for low, high, s, n in zip(f["low"], f["high"], f["s"], f["n"], strict=True):
        blocks.append((low, high, int(s), int(n)))
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] > blocks[-1][2] * blocks[-2][3]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append((a[0], b[1], a[2] + b[2], a[3] + b[3]))
    return blocks


def calibration(points: DataFrame, least: int = 5) -> DataFrame:
    """``tier, x, y``: rising steps by pooling adjacent violators, for tiers with enough points; x is the middle of a block.

    ``points(tier, score, clicked)``. Points of one score count as one. Ranges of the score are pooled each by
    itself first, which changes nothing in the end, so what meets in a tier's last group are blocks, not points.
    """
    enough = points.groupBy("tier").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("tier")
    rows = points.join(enough, "tier").groupBy("tier", "score").agg(F.sum("clicked").alias("s"), F.count("*").alias("n"))
    rows = rows.select("tier", F.col("score").alias("low"), F.col("score").alias("high"), "s", "n").repartitionByRange("tier", "low").sortWithinPartitions("tier", "low")
    schema = "tier int, low double, high double, s long, n long"

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tier, own in f.groupby("tier", sort=False):
                yield pd.DataFrame([(tier, *b) for b in _pool(own)], columns=["tier", "low", "high", "s", "n"])

    def tiers(f: pd.DataFrame) -> pd.DataFrame:
        found = _pool(f.sort_values("low"))
        return pd.DataFrame([(f["tier"].iloc[0], (a + b) / 2, s / n) for a, b, s, n in found], columns=["tier", "x", "y"])

    return rows.mapInPandas(ranges, schema).groupBy("tier").applyInPandas(tiers, "tier int, x double, y double")


def calibrated(rows: DataFrame, curve: DataFrame) -> DataFrame:
    """``rows`` with ``probability``: the curve of their tier at their score, straight between its points, level outside; null without a curve.

    ``rows(tier, score, ...)``, ``curve(tier, x, y)``: of one tier's points, the last before and the first after a score are looked up.
    """
    lists = curve.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("curve"))
    rows = rows.join(lists, "tier", "left")
    before = F.get(F.filter("curve", lambda p: p["x"] <= F.col("score")), F.size(F.filter("curve", lambda p: p["x"] <= F.col("score"))) - 1)
    after = F.get(F.filter("curve", lambda p: p["x"] > F.col("score")), F.lit(0))
    rows = rows.withColumn("a", before).withColumn("b", after)
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("score") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    return rows.withColumn("probability", F.round(F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull(), F.col("a.y")).otherwise(line), 6)).drop("curve", "a", "b")


def hard_negatives(neighbours: DataFrame, groups: DataFrame, texts: DataFrame, low: float = 0.5, high: float = 0.9, least: float = 0.08) -> DataFrame:
    """``id, negative, score``: for each item the neighbour of another chapter that looks most like it, neither too near nor too far.

    ``neighbours(query_id, id, similarity)``, ``groups(id, chapter, book)``, ``texts(id, tokens)``: pairs share ``least``
    of their distinct tokens (Dice); likeness is similarity, overlap and being of the same book.
    """
    side = lambda x: groups.join(texts, "id").select(F.col("id").alias(x), F.col("chapter").alias(f"c{x}"), F.col("book").alias(f"b{x}"), F.array_distinct("tokens").alias(f"t{x}"))
    rows = neighbours.where(F.col("similarity").between(low, high)).join(side("query_id"), "query_id").join(side("id"), "id").where("cquery_id <> cid")
    rows = rows.withColumn("overlap", F.round(dice(F.col("tquery_id"), F.col("tid")), 6)).where(F.col("overlap") >= least)
    score = 0.72 * F.col("similarity") + 0.2 * F.col("overlap") + F.when(F.col("bquery_id") == F.col("bid"), 0.08).otherwise(0.0)
    best = rows.withColumn("score", F.round(score, 6)).withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("r = 1")
    return best.select(F.col("query_id").alias("id"), F.col("id").alias("negative"), "score")


def cleaned(feedback: DataFrame, source: str, value: str, days: int = 7, most: int = 1000, span_ms: int = 90_000, burst: int = 12) -> DataFrame:
    """Feedback of the last days that can be learnt from, with ``weight``, the root of the rank from 1: the oldest thousand with a rank below 50,

    less bursts of a source and values far off its mean. ``now`` is a column in milliseconds; the thousand are a bound on
    what one round of learning reads, not on the table.
    """
    rows = feedback.where((millis() >= F.col("now") - days * 86_400_000) & F.col("rank").between(0, 49)).orderBy(millis(), "event_id").limit(most)
    rows = bursts(rows, source, span_ms, burst).where("NOT burst")
    return without_outliers(rows, source, value).withColumn("weight", F.round(F.sqrt(F.col("rank") + 1.0), 6))


def triggers(feedback: DataFrame, every: int = 20, hour_ms: int = 3_600_000) -> DataFrame:
    """``event_id, ms, n``: the feedback that calls for training, every so many in an hour."""
    order = W.partitionBy(F.floor(F.col("ms") / hour_ms)).orderBy("ms", "event_id")
    return feedback.withColumn("n", F.row_number().over(order)).where(F.col("n") % every == 0).select("event_id", "ms", "n")


def sliding_triggers(feedback: DataFrame, every: int = 20, span_ms: int = 3_600_000, slice_ms: int = 60_000) -> DataFrame:
    """``event_id, ms, n``: the feedback at which the number within the span before it, itself counted, is a multiple of ``every``.

    Feedback comes in the order of ``ms, event_id``; what is exactly a span old no longer counts; rows without a time or id
    are left out. Each counts one more at its time and one less a span later, so a sum over slices of time is enough: slices
    are added up by themselves, and one row a slice is run over in order.
    """
    known = feedback.where("ms IS NOT NULL AND event_id IS NOT NULL").select("event_id", F.col("ms").cast("long").alias("ms"))
    signed = known.select("event_id", "ms", F.explode(F.array(F.lit(1), F.lit(-1))).alias("d"))
    signed = signed.withColumn("at", F.col("ms") + F.when(F.col("d") < 0, span_ms).otherwise(0)).withColumn("slice", F.floor(F.col("at") / slice_ms))
    totals = signed.groupBy("slice").agg(F.sum("d").alias("d"))
    before = totals.select("slice", (F.sum("d").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("d")).alias("before"))
    own = F.sum("d").over(W.partitionBy("slice").orderBy("at", "d", "event_id").rowsBetween(W.unboundedPreceding, 0))
    rows = signed.withColumn("own", own).where("d > 0").join(before, "slice").withColumn("n", F.col("own") + F.col("before"))
    return rows.where((F.col("n") % every == 0) & (F.col("n") > 0)).select("event_id", "ms", "n")


def boosted_weights(feedback: DataFrame, trees: int = 20, seed: int = 5) -> DataFrame:
    """``slot, weight``: what boosted trees make of feedback, read back through ridge regression and bounded.

    ``feedback(event_type, rank)``: features are the reciprocal rank, being first, and the kind of source; the label is the reciprocal rank.
    """
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    label = 1.0 / (1.0 + F.coalesce(F.col("rank"), F.lit(10)))
    rows = feedback.withColumn("label", label).withColumn("by_rank", label).withColumn("first", (F.coalesce("rank", F.lit(10)) == 0).cast("double"))
    rows = StringIndexer(inputCol="event_type", outputCol="kind", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=["by_rank", "first", "kind"], outputCol="features").transform(rows)
    said = GBTRegressor(maxIter=trees, maxDepth=4, stepSize=0.1, seed=seed).fit(rows).transform(rows).drop("label").withColumnRenamed("prediction", "label")
    ridge = LinearRegression(regParam=1.0 / 1000, elasticNetParam=0.0, standardization=False).fit(said.select("features", "label"))
    bounded = [max(0.05, min(3.0, abs(float(c)))) for c in ridge.coefficients]
    return feedback.sparkSession.createDataFrame([(i, round(w, 6)) for i, w in enumerate(bounded)], "slot int, weight double")
