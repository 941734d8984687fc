"""Reading events: coverage, dwell, sessions, trends, bursts, pace, review queues."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..lineage import small


def millis(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def coverage(events: DataFrame, group: list[str], dwell: str, kind: str = "view") -> DataFrame:
    return events.where(F.col("event_type") == kind).groupBy(*group).agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.round(F.sum(dwell), 4).alias("dwell"))


def top_dwell(events: DataFrame, item: str, dwell: str, least: float, k: int) -> DataFrame:
    sums = events.where(F.col(dwell) > least).groupBy(item).agg(F.count("*").alias("n"), F.round(F.avg(dwell), 6).alias("mean"), F.round(F.sum(dwell), 4).alias("total"))
    return sums.orderBy(F.desc("total"), item).limit(k)


def sequences(events: DataFrame, session: str, item: str, k: int) -> DataFrame:
    """The items of each session in order of time, of the k sessions last active. These are picked first."""
    latest = events.groupBy(session).agg(F.max("ts").alias("last")).orderBy(F.desc("last"), session).limit(k).select(session)
    ordered = F.array_sort(F.collect_list(F.struct("ts", F.col(item).alias("item"))))
    rows = events.join(small(latest), session, "left_semi").groupBy(session).agg(ordered.alias("o"))
    return rows.select(session, F.array_join(F.transform("o", lambda x: x["item"].cast("string")), ",").alias("items"))


def trending(events: DataFrame, item: str, now: Column, filler: DataFrame, k: int) -> DataFrame:
    """``item, score``: views of a day count 3 and of a week 1, clicks of a day 2 and of a week 1; a prior fills up."""
    age = (now - millis()) / 3_600_000.0
    views = F.sum(F.when((F.col("event_type") == "view") & (age <= 24), 3).when((F.col("event_type") == "view") & (age <= 168), 1).otherwise(0))
    clicks = F.sum(F.when((F.col("event_type") == "click") & (age <= 24), 2).when((F.col("event_type") == "click") & (age <= 168), 1).otherwise(0))
    hot = events.groupBy(F.col(item).alias("item")).agg((views + clicks).alias("hot"))
    rows = hot.join(filler, "item", "full").select("item", F.coalesce("hot", F.lit(0)).alias("hot"), F.coalesce("prior", F.lit(0.0)).alias("prior"))
    return rows.withColumn("score", F.round(F.col("hot") + 5 * F.col("prior"), 6)).orderBy(F.desc("score"), "item").limit(k).select("item", "score")


def without_outliers(rows: DataFrame, group: str, value: str, sigmas: float = 2.5) -> DataFrame:
    """Rows within so many population deviations of their group's mean, with ``z``; a deviation of 0 counts as 1e-9."""
    stats = rows.groupBy(group).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.abs(F.col(value) - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-9)
    return rows.join(small(stats), group).withColumn("z", z).where(F.col("z") <= sigmas).drop("_mean", "_sd")


def at_index(rows: DataFrame, group: str, value: str, index: Callable[[Column], Column], share: float) -> DataFrame:
    """``group, value``: the value at ``index(n)`` (from 0) of each group in order, where that is about ``share`` of n.

    An approximate quantile, whose error in rank is bounded, brackets the place; only rows inside the bracket
    are ranked, by what is left of the index after those below are counted. So a group of any size is never sorted whole.
    """
    rows = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("value"))
    edge = lambda s: F.percentile_approx("value", F.lit(min(1.0, max(0.0, s))), F.lit(10_000))
    around = rows.groupBy(group).agg(F.count("*").alias("n"), edge(share - 3e-4).alias("low"), edge(share + 3e-4).alias("high"), F.min("value").alias("least"), F.max("value").alias("most"))
    wide = F.col("n") < 20_000  # so few rows are ranked whole
    around = around.select(group, "n", F.when(wide, F.col("least")).otherwise(F.col("low")).alias("low"), F.when(wide, F.col("most")).otherwise(F.col("high")).alias("high"))
    near = rows.join(small(around), group)
    below = near.groupBy(group, "n").agg(F.count_if(F.col("value") < F.col("low")).alias("below"))
    inside = near.where(F.col("value").between(F.col("low"), F.col("high"))).groupBy(group, "value").agg(F.count("*").alias("c"))
    run = F.sum("c").over(W.partitionBy(group).orderBy("value"))
    at = inside.withColumn("run", run).join(small(below), group).withColumn("i", index(F.col("n")) - F.col("below"))
    return at.where((F.col("run") > F.col("i")) & (F.col("run") - F.col("c") <= F.col("i"))).select(group, "value")


def at_floor(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """The value at index floor((n - 1) * share) of each group in order."""
    return at_index(rows, group, value, lambda n: F.floor((n - 1) * share), share)


def middle(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group, median``: the middle value, or the mean of the two middle ones."""
    both = at_index(rows, group, value, lambda n: F.floor((n - 1) / 2), 0.5).unionByName(at_index(rows, group, value, lambda n: F.floor(n / 2), 0.5))
    return both.groupBy(group).agg(F.avg("value").alias("median"))


def robust(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median, median absolute deviation (scaled by 1.4826) and the spread from index floor((n - 1) / 4) to floor(3 (n - 1) / 4) of each group."""
    m = small(middle(rows, group, value))
    off = rows.join(m, group).select(group, F.abs(F.col(value) - F.col("median")).alias("off"))
    mad = middle(off, group, "off").withColumnRenamed("median", "mad")
    quarter = lambda q, name: at_index(rows, group, value, lambda n: F.floor((n - 1) * q), q).withColumnRenamed("value", name)
    out = m.join(mad, group).join(quarter(0.75, "q3"), group).join(quarter(0.25, "q1"), group)
    return out.select(group, F.round("median", 6).alias("median"), F.round(F.col("mad") * 1.4826, 6).alias("mad"), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))


def bursts(events: DataFrame, session: str, span_ms: int = 90_000, most: int = 12) -> DataFrame:
    """Adds ``burst``: whether the event lies in a window of that length, from an event on, with more than so many events.

    Time is cut into stretches of that length, and every stretch sees the next one, then the one
    before: a session of any size is never in one window.
    """
    rows = events.withColumn("ms", millis()).withColumn("_b", F.floor(F.col("ms") / span_ms))
    w = W.partitionBy(session, "_b").orderBy("ms")

    def with_other(r: DataFrame, step: int) -> DataFrame:
        """Rows, and beside them those that the neighbouring stretch has to see."""
        each = F.explode(F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_b") + step).alias("b"), F.lit(False).alias("own")))).alias("_e")
        return r.select("*", each).withColumn("_b", F.col("_e.b")).withColumn("_own", F.col("_e.own")).drop("_e")

    rows = with_other(rows, -1).withColumn("_ahead", F.count("*").over(w.rangeBetween(0, span_ms))).where("_own").drop("_own")
    rows = with_other(rows, 1).withColumn("burst", F.max("_ahead").over(w.rangeBetween(-span_ms, 0)) > most).where("_own")
    return rows.drop("_own", "_ahead", "_b")


def dwell(events: DataFrame, session: str, least_ms: int = 0) -> DataFrame:
    """Adds ``dwell_ms``: the time until the session's next event."""
    w = W.partitionBy(session).orderBy("ts", "event_id")
    return events.withColumn("dwell_ms", F.lead(millis()).over(w) - millis()).where(F.col("dwell_ms") >= least_ms)


def pace(events: DataFrame, session: str, expected_ms: Column) -> DataFrame:
    """Adds ``pace`` (mean of the last five ratios of elapsed to expected time) and ``flow``: below 0.6 with three at least."""
    w = W.partitionBy(session).orderBy("ts", "event_id")
    rows = events.withColumn("ratio", (millis() - F.lag(millis()).over(w)) / expected_ms)
    five = w.rowsBetween(-4, 0)
    return rows.withColumn("pace", F.round(F.avg("ratio").over(five), 6)).withColumn("flow", (F.col("pace") < 0.6) & (F.count("ratio").over(five) >= 3))


def near_pairs(events: DataFrame, session: str, item: str, reach: int = 2) -> DataFrame:
    """``a, b, n``: how often two different items are within so many places of each other in a session, both ways."""
    order = W.partitionBy(session).orderBy("ts", "event_id")
    after = events.select(F.col(item).alias("x"), F.array_compact(F.array(*[F.lead(item, i).over(order) for i in range(1, reach + 1)])).alias("next"))
    pairs = after.select("x", F.explode("next").alias("y")).where("x <> y")
    each = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")
    return pairs.select(each).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def last_distinct(events: DataFrame, session: str, item: str, k: int = 5) -> DataFrame:
    """The k items last seen in each session, each once, latest first."""
    last = events.groupBy(session, item).agg(F.max("ts").alias("last"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy(session).orderBy(F.desc("last"), item))).where(F.col("rank") <= k).select(session, item, "rank")


def rate_limited(events: DataFrame, key: list[str], per_minute: int) -> DataFrame:
    """Minutes in which a key had more events than allowed."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    return events.groupBy(*key, minute.alias("minute")).agg(F.count("*").alias("n")).where(F.col("n") > per_minute)


def first_event_windows(events: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """``key, first_us, n, refused``: windows that begin with a key's first event after the last window has closed.

    Such windows are a chain, unlike tumbling ones: where one begins depends on all before it. A slice of
    time as long as a window, in which a key has no event, breaks the chain, so that each stretch between
    empty slices is folded by itself. Events of one microsecond are counted before the shuffle; slices, not
    events, are what a key is numbered by. A stretch is one group: it holds its distinct times, 16 bytes each.
    Events without a time take no part; a null key is a key. An empty table has no windows.
    """
    width = seconds * 1_000_000
    times = events.where(F.col("ts").isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    times = times.groupBy("k", "at").agg(F.count("*").alias("n")).withColumn("slice", F.floor(F.col("at") / width))
    order = W.partitionBy("k").orderBy("slice")
    slices = times.select("k", "slice").distinct()
    begins = F.coalesce(F.col("slice") - F.lag("slice").over(order) > 1, F.lit(True)).cast("long")
    stretches = slices.withColumn("begins", begins).select(F.col("k").alias("k2"), F.col("slice").alias("slice2"), F.sum("begins").over(order).alias("stretch"))
    rows = times.join(stretches, F.col("k").eqNullSafe(F.col("k2")) & (F.col("slice") == F.col("slice2"))).select("k", "stretch", "at", "n")

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at", ignore_index=True)
        at, total = f["at"].to_numpy(), np.append(0, np.cumsum(f["n"].to_numpy()))
        cuts = [0]
        while cuts[-1] < len(at):
            cuts.append(int(np.searchsorted(at, at[cuts[-1]] + width)))
        return pd.DataFrame({"k": f["k"].iloc[[0] * (len(cuts) - 1)].to_numpy(), "first_us": at[cuts[:-1]], "n": np.diff(total[cuts])})

    kind = rows.schema["k"].dataType.simpleString()
    found = rows.groupBy("k", "stretch").applyInPandas(fold, f"k {kind}, first_us long, n long")
    return found.select(F.col("k").alias(key), "first_us", "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def spaced_reviews(events: DataFrame) -> DataFrame:
    """``session, item, easiness, interval_days, repetitions, next_review_ms``: the review state after all qualifying events.

    The state folds over each key's events in order, so it is an aggregate over the sorted list: a
    click counts as quality 5, a purchase as 4, another as 3; a first review comes after 4 days for quality 5, else 1.
    """
    quality = F.when(F.col("event_type") == "click", 5).when(F.col("event_type") == "purchase", 4).otherwise(3)
    rows = events.groupBy("session", "item").agg(F.array_sort(F.collect_list(F.struct(millis().alias("ms"), quality.alias("q")))).alias("e"))
    start = F.struct(F.lit(2.5).alias("ease"), F.lit(0.0).alias("days"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("at"))

    def step(s, e):
        short = 5 - e["q"]
        ease = F.greatest(F.lit(1.3), s["ease"] + 0.1 - short * (0.08 + short * 0.02))
        first = F.when(e["q"] == 5, 4.0).otherwise(1.0)
        days = F.when(s["n"] == 0, first).when(s["n"] == 1, 6.0).otherwise(F.round(s["days"] * ease, 0))
        return F.struct(F.when(s["n"] == 0, s["ease"]).otherwise(ease).alias("ease"), days.alias("days"), (s["n"] + 1).alias("n"), e["ms"].alias("at"))

    s = rows.withColumn("s", F.aggregate("e", start, step))
    return s.select("session", "item", F.round("s.ease", 6).alias("easiness"), F.col("s.days").alias("interval_days"), F.col("s.n").alias("repetitions"), (F.col("s.at") + (F.col("s.days") * 86_400_000).cast("long")).alias("next_review_ms"))
