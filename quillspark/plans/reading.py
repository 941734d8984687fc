"""Queries of reading events. The item of an event is ``props.k``; now is the table's last time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import table
from ..functions.numeric import lcg, park_miller
from ..lineage import shared_dir
from ..operators import events as E, relational
from ..streaming import reviews as R
from ..streaming.events import read_events, to_table
from .registry import register

EV = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms, (props->>'k')::BIGINT AS item FROM events)"


def events(s, d):
    return table(s, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("long"))


def now(e):
    return e.agg(F.max(E.millis()).alias("now"))


register("reading_coverage", lambda s, d: E.coverage(events(s, d), ["user_id"], "value").withColumn("last", E.millis("last")), f"WITH {EV} SELECT user_id, count(*) AS n, max(ms) AS last, round(sum(value), 4) AS dwell FROM e WHERE event_type = 'view' GROUP BY user_id")
register("top_dwell", lambda s, d: E.top_dwell(events(s, d), "item", "value", 5.0, 100), f"WITH {EV} SELECT item, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM e WHERE value > 5 GROUP BY item ORDER BY total DESC, item LIMIT 100")
register("session_sequence", lambda s, d: E.sequences(events(s, d), "user_id", "item", 200), f"WITH {EV} SELECT user_id, string_agg(item::VARCHAR, ',' ORDER BY ts, item) AS items FROM e GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 200")


def trending(s, d):
    e = events(s, d)
    prior = e.groupBy("item").agg((F.count("*") / 1000.0).alias("prior"))
    return E.trending(e.join(F.broadcast(now(e))), "item", F.col("now"), prior, 50)


register("trending", trending, f"""WITH {EV}, a AS (SELECT *, ((SELECT max(ms) FROM e) - ms) / 3600000.0::DOUBLE AS age FROM e)
    SELECT item, round(sum(CASE WHEN event_type = 'view' AND age <= 24 THEN 3 WHEN event_type = 'view' AND age <= 168 THEN 1 WHEN event_type = 'click' AND age <= 24 THEN 2 WHEN event_type = 'click' AND age <= 168 THEN 1 ELSE 0 END) + 5 * (count(*) / 1000.0::DOUBLE), 6) AS score
    FROM a GROUP BY item ORDER BY score DESC, item LIMIT 50""")
register("source_outliers", lambda s, d: E.without_outliers(events(s, d), "event_type", "value").select("event_id", "event_type", F.round("z", 6).alias("z")), "WITH z AS (SELECT event_id, event_type, abs(value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)) SELECT event_id, event_type, round(z, 6) AS z FROM z WHERE z <= 2.5")
register("p95_floor", lambda s, d: E.at_floor(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice", 0.95), "SELECT l_returnflag, l_extendedprice AS value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 = floor((count(*) OVER (PARTITION BY l_returnflag) - 1) * 0.95::DOUBLE)")
register("robust_stats", lambda s, d: E.robust(table(s, d, "orders"), "o_orderpriority", "o_totalprice"), """WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)),
    m AS (SELECT o_orderpriority, median(v) AS m, max(v) FILTER (i = floor((n - 1) * 0.75::DOUBLE)) - max(v) FILTER (i = floor((n - 1) * 0.25::DOUBLE)) AS iqr FROM r GROUP BY 1)
    SELECT o_orderpriority, round(any_value(m), 6) AS median, round(median(abs(o_totalprice - m)) * 1.4826, 6) AS mad, round(any_value(iqr), 6) AS iqr FROM orders JOIN m USING (o_orderpriority) GROUP BY 1""")
register("burst_spam", lambda s, d: E.bursts(events(s, d), "event_type", 3_600_000, 5).select("event_id", "burst"), f"""WITH {EV}, a AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN CURRENT ROW AND 3600000 FOLLOWING) AS ahead FROM e)
    SELECT event_id, max(ahead) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) > 5 AS burst FROM a""")
register("dwell_lead", lambda s, d: E.dwell(events(s, d), "user_id", 1000).select("event_id", "dwell_ms"), f"WITH {EV} SELECT event_id, dwell_ms FROM (SELECT event_id, lead(ms) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ms AS dwell_ms FROM e) WHERE dwell_ms >= 1000")
register("rolling_pace", lambda s, d: E.pace(events(s, d), "user_id", (F.col("item") + 1) * 600_000.0).select("event_id", "pace", "flow"), f"""WITH {EV}, r AS (SELECT *, (ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / ((item + 1) * 600000.0::DOUBLE) AS ratio FROM e),
    p AS (SELECT event_id, round(avg(ratio) OVER w, 6) AS pace, count(ratio) OVER w AS n FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT event_id, pace, pace < 0.6 AND n >= 3 AS flow FROM p""")
register("last5_distinct", lambda s, d: E.last_distinct(events(s, d), "user_id", "item"), f"WITH {EV} SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, item)::INT AS rank FROM e GROUP BY user_id, item QUALIFY rank <= 5")
register("rate_limit", lambda s, d: E.rate_limited(events(s, d), ["event_type"], 1).withColumn("minute", E.millis("minute")), f"WITH {EV} SELECT event_type, epoch_us(date_trunc('minute', ts)) // 1000 AS minute, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1")
register(
    "first_event_windows",
    lambda s, d: E.first_event_windows(events(s, d), "event_type", 3600, 5),
    """WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) AS us FROM events),
    w(event_type, first_us) AS (SELECT event_type, min(us) FROM e GROUP BY event_type UNION ALL SELECT w.event_type, min(e.us) FROM w JOIN e ON e.event_type = w.event_type AND e.us >= w.first_us + 3600000000 GROUP BY w.event_type)
    SELECT w.event_type, first_us, count(*) AS n, greatest(count(*) - 5, 0) AS refused FROM w JOIN e ON e.event_type = w.event_type AND e.us >= first_us AND e.us < first_us + 3600000000 GROUP BY ALL""",
)
register("event_ingest", lambda s, d: events(s, d).select("event_id", F.least(F.col("value") * 1000, F.lit(300_000.0)).alias("dwell_ms"), F.col("event_type").isin("view", "click").alias("counts")), "SELECT event_id, least(value * 1000, 300000.0::DOUBLE) AS dwell_ms, event_type IN ('view', 'click') AS counts FROM events")


def reviews(s, d):
    return E.spaced_reviews(events(s, d).where(F.col("event_type").isin("click", "purchase", "signup")).withColumnRenamed("user_id", "session"))


SRS = f"""{EV}, ev AS (SELECT user_id AS session, item, ms, CASE event_type WHEN 'click' THEN 5 WHEN 'purchase' THEN 4 ELSE 3 END AS q, row_number() OVER (PARTITION BY user_id, item ORDER BY epoch_us(ts) // 1000, CASE event_type WHEN 'click' THEN 5 WHEN 'purchase' THEN 4 ELSE 3 END) AS k FROM e WHERE event_type IN ('click', 'purchase', 'signup')),
    f(session, item, k, ease, days, ms) AS (SELECT session, item, 1::BIGINT, 2.5::DOUBLE, CASE q WHEN 5 THEN 4.0 ELSE 1.0 END::DOUBLE, ms FROM ev WHERE k = 1
      UNION ALL SELECT session, item, k + 1, ne, CASE WHEN k = 1 THEN 6.0 ELSE round(days * ne) END, nms FROM (SELECT f.session, f.item, f.k, f.days, greatest(1.3::DOUBLE, f.ease + 0.1::DOUBLE - (5 - ev.q) * (0.08::DOUBLE + (5 - ev.q) * 0.02::DOUBLE)) AS ne, ev.ms AS nms FROM f JOIN ev ON ev.session = f.session AND ev.item = f.item AND ev.k = f.k + 1)),
    srs AS (SELECT session, item, round(ease, 6) AS easiness, days AS interval_days, k AS repetitions, ms + (days * 86400000)::BIGINT AS next_review_ms FROM f QUALIFY k = max(k) OVER (PARTITION BY session, item))"""
register("srs_state", reviews, f"WITH RECURSIVE {SRS} SELECT * FROM srs")


def due(s, d):
    """Reviews due within a day, each with whether it is overdue, as one struct of text for the sake of comparing."""
    rows = reviews(s, d).join(F.broadcast(now(events(s, d)))).where("next_review_ms <= now + 86400000").orderBy("next_review_ms", "session", "item").limit(100)
    review = F.struct("next_review_ms", "interval_days", "repetitions", (F.col("next_review_ms") < F.col("now")).alias("overdue"))
    return rows.select("session", "item", review.alias("review")).select("session", "item", "review.next_review_ms", "review.overdue", F.to_json("review").alias("review"))


register("due_queue", due, f"""WITH RECURSIVE {SRS} SELECT session, item, next_review_ms, next_review_ms < now AS overdue, '{{"next_review_ms":' || next_review_ms || ',"interval_days":' || interval_days::DOUBLE || ',"repetitions":' || repetitions || ',"overdue":' || (next_review_ms < now) || '}}' AS review
    FROM srs, (SELECT max(ms) AS now FROM e) WHERE next_review_ms <= now + 86400000 ORDER BY next_review_ms, session, item LIMIT 100""")
register(
    "calendar_pick",
    lambda s, d: table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select(
        F.col("day").cast("string").alias("day"), (F.floor((F.dayofyear("day") - 1) / 7) + 1).alias("week"), (F.dayofweek("day") - 1).alias("weekday"), F.pmod(F.year("day") - 2026, F.lit(4)).alias("cycle"),
        (lcg(F.dayofyear("day") + F.year("day") * 366) % 97).alias("pick"), (park_miller(F.dayofyear("day") + F.lit(7)) % 97).alias("other_pick")),
    """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day::VARCHAR AS day, (dayofyear(day) - 1) // 7 + 1 AS week, dayofweek(day)::INT AS weekday, (((year(day) - 2026) % 4 + 4) % 4)::INT AS cycle,
    ((1664525::BIGINT * (dayofyear(day) + year(day) * 366) + 1013904223) % 4294967296) % 97 AS pick, ((dayofyear(day) + 7) * 16807 % 2147483647) % 97 AS other_pick FROM d""",
)


def reviews_of_a_stream(s, d):
    """The review state after the event table has been read as a stream to its end."""
    home = f"{shared_dir(s)}/reviews-{uuid.uuid4().hex}"
    rows = read_events(s, d).where(F.col("event_type").isin("click", "purchase", "signup")).select(F.col("user_id").cast("long").alias("session"), F.get_json_object("props", "$.k").cast("long").alias("item"), "ts", "event_type")
    to_table(R.review_stream(rows, "3650 days"), f"{home}/rows", f"{home}/checkpoint").awaitTermination()
    return R.latest(s.read.schema(R.OUT).parquet(f"{home}/rows"))


register("srs_stream", reviews_of_a_stream, f"WITH RECURSIVE {SRS} SELECT * FROM srs")
register("event_histograms", lambda s, d: relational.histograms(table(s, d, "events").withColumn("item", F.get_json_object("props", "$.k")), ["event_type", "item"], "user_id"),
    """SELECT 'event_type' AS field, event_type AS value, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type
    UNION ALL SELECT 'item', props->>'k', count(*), count(DISTINCT user_id) FROM events GROUP BY 2""")
