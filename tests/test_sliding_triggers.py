"""Feedback counted over the span before it, against a plain version."""

import random

from quillspark.operators import learning


def found(spark, rows, **named):
    return [(r["event_id"], r["ms"], r["n"]) for r in learning.sliding_triggers(spark.createDataFrame(rows, "event_id long, ms long"), **named).orderBy("ms", "event_id").collect()]


def test_spans(spark):
    r = random.Random(3)
    rows = [(i, r.choice([r.randrange(40_000), 7_000, 8_000, -r.randrange(9_000)])) for i in range(600)]
    order = sorted((ms, i) for i, ms in rows)
    wanted = []
    for k, (ms, i) in enumerate(order):
        n = sum(1 for other, _ in order[: k + 1] if other > ms - 1_000)
        if n % 5 == 0:
            wanted.append((i, ms, n))
    assert len(wanted) > 50
    assert found(spark, rows, every=5, span_ms=1_000, slice_ms=300) == wanted
    assert found(spark, rows, every=5, span_ms=1_000, slice_ms=7_000) == wanted


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1), (1, None), (2, 0), (3, 1_000), (4, 1_999)], every=2, span_ms=1_000) == [(4, 1_999, 2)]
