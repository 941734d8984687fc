"""Spaced reviews as state in a stream: the same fold as ``operators.events.spaced_reviews``, whatever the batches.

A key's events wait, in order, until the watermark has passed them; then a timer folds them into the
state, which no later event can precede any more. So what waits is bounded by the lateness that the
watermark allows, and the state does not depend on how events were dealt to batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs Spark's RocksDB store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
QUALITY = {"click": 5, "purchase": 4}
OUT = "session long, item long, easiness double, interval_days double, repetitions int, next_review_ms long"
DAY = 86_400_000


class Review(NamedTuple):
    """Ease, days until the next review, reviews so far, and the last one's time."""

    ease: float = 2.5
    days: float = 0.0
    n: int = 0
    at: int = 0

    def after(self, ms: int, quality: int) -> Review:
        if self.n == 0:
            return Review(self.ease, 4.0 if quality == 5 else 1.0, 1, ms)
        short = 5 - quality
        ease = max(1.3, self.ease + 0.1 - short * (0.08 + short * 0.02))
        return Review(ease, 6.0 if self.n == 1 else float(math.floor(self.days * ease + 0.5)), self.n + 1, ms)


class Reviews(StatefulProcessor):
    """Emits a key's review state, with what waits counted in, each time events of it arrive. With ``forget_ms``, a key without events for so long is dropped."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "ease double, days double, n int, at long")
        self.waiting = handle.getListState("waiting", "ms long, quality int")

    def _state(self) -> Review:
        return Review(*self.folded.get()) if self.folded.exists() else Review()

    def _settle(self, events: list[tuple[int, int]], watermark: int) -> list[tuple[int, int]]:
        """Folds what the watermark has passed; keeps the rest, with a timer for the first of it."""
        done, rest = [e for e in events if e[0] <= watermark], [e for e in events if e[0] > watermark]
        if done:
            state = self._state()
            for e in done:
                state = state.after(*e)
            self.folded.update(tuple(state))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        elif self.waiting.exists():
            self.waiting.clear()
        return rest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(ms), int(q)) for f in rows for ms, q in zip(f["ms"], f["quality"], strict=True)]
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        rest = self._settle(sorted(waiting + new), timerValues.getCurrentWatermarkInMs())
        state = self._state()
        for e in rest:
            state = state.after(*e)
        if self.forget_ms is not None:
            self.handle.registerTimer(state.at + self.forget_ms)
        yield pd.DataFrame([(key[0], key[1], round(state.ease, 6), state.days, state.n, min(state.at + int(state.days * DAY), 2**63 - 1))], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        watermark = timerValues.getCurrentWatermarkInMs()
        rest = self._settle(sorted(waiting), watermark)
        if self.forget_ms is not None and not rest and self._state().at + self.forget_ms <= watermark:
            self.folded.clear()
        yield from ()

    def close(self) -> None:
        pass


def review_stream(events: DataFrame, late: str = "30 days", forget_ms: int | None = None) -> DataFrame:
    """A stream of ``OUT``: a row for each key and batch with events of it; the row with most ``repetitions`` is the latest.

    ``events`` has ``session, item, ts, event_type``. Events later than the watermark allows are dropped by Spark. Null keys are a key.
    """
    events.sparkSession.conf.set(*STORE)
    quality = F.coalesce(*[F.when(F.col("event_type") == k, q) for k, q in QUALITY.items()], F.lit(3))
    ts = F.col("ts").cast("timestamp")
    rows = events.select("session", "item", ts.alias("ts"), F.unix_millis(ts).alias("ms"), quality.alias("quality")).withWatermark("ts", late)
    return rows.groupBy("session", "item").transformWithStateInPandas(Reviews(forget_ms), OUT, "Append", "EventTime")


def latest(rows: DataFrame) -> DataFrame:
    """Of the rows that a review stream has written, each key's last."""
    state = F.struct("easiness", "interval_days", "next_review_ms")
    return rows.groupBy("session", "item").agg(F.max_by(state, "repetitions").alias("s"), F.max("repetitions").alias("repetitions")).select("session", "item", "s.easiness", "s.interval_days", "repetitions", "s.next_review_ms")
