"""Queries of entities, tolerant sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import table
from ..lineage import shared_dir
from ..operators import entities as N
from ..sources.files import listed, recovered_array, split_csv
from ..streaming import events as V
from .registry import register


def mentions(s, d):
    o = table(s, d, "orders")
    text = F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", " '), F.col("o_orderstatus"), F.lit('"]'))
    return N.index(o, "o_orderkey", listed(F.when(F.col("o_orderkey") % 7 > 0, text).otherwise(F.lit("not json"))))


MEN = "men AS (SELECT DISTINCT lower(trim(x)) AS name, o_orderkey AS item FROM (SELECT o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS x FROM orders WHERE o_orderkey % 7 > 0))"
register("entity_index", mentions, f"WITH {MEN} SELECT * FROM men")


def groups(s, d):
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("item"), F.col("c_nationkey").alias("book"), F.col("c_mktsegment").alias("volume"))


register("entity_ambiguous", lambda s, d: N.ambiguous(mentions(s, d), groups(s, d)), f"WITH {MEN} SELECT name, count(*) AS n, count(DISTINCT c_nationkey) AS n_books, count(DISTINCT c_mktsegment) AS n_volumes, count(DISTINCT c_mktsegment) >= 2 OR count(DISTINCT c_nationkey) >= 5 OR count(*) > 100 AS ambiguous FROM men JOIN orders ON o_orderkey = item JOIN customer ON c_custkey = o_custkey GROUP BY name HAVING count(*) >= 3")


def scored(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_discount").alias("disc"), F.min("l_linenumber").alias("line"))
    prior = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("prior"))
    return N.score(li.join(prior, "l_suppkey").select("l_orderkey", "l_suppkey", (F.col("disc") * 10).alias("sim"), "prior", (F.col("line") - 1).alias("away"), F.lit(7.0).alias("span")))


SCO = """li AS (SELECT l_orderkey, l_suppkey, max(l_discount) * 10 AS sim, min(l_linenumber) - 1 AS away FROM lineitem GROUP BY ALL), pr AS (SELECT l_suppkey, ln(1 + count(*)) AS p FROM lineitem GROUP BY 1),
    x AS (SELECT l_orderkey, l_suppkey, sim, p, exp(-3.0::DOUBLE * away / 7.0::DOUBLE) AS n FROM li JOIN pr USING (l_suppkey)),
    sc AS (SELECT l_orderkey, l_suppkey, round(0.40::DOUBLE * sim + 0.10::DOUBLE * p + 0.20::DOUBLE * n + 0.15::DOUBLE * sim * n + 0.05::DOUBLE * sim * p + 0.05::DOUBLE * n * p + 0.05::DOUBLE * sim * n * p, 6) AS score FROM x)"""
register("entity_score", lambda s, d: scored(s, d).select("l_orderkey", "l_suppkey", "score"), f"WITH {SCO} SELECT * FROM sc")
register("entity_assign", lambda s, d: N.assign(scored(s, d), "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey", "queued"), f"""WITH {SCO}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey) AS r FROM sc)
    SELECT l_orderkey, max(l_suppkey) FILTER (r = 1) AS l_suppkey, coalesce(max(score) FILTER (r = 1) - max(score) FILTER (r = 2) < 0.15, false) AS queued FROM r WHERE r <= 2 GROUP BY l_orderkey""")
register("entity_split", lambda s, d: N.split(mentions(s, d), "f", [("f early", 0, 5_000), ("f late", 5_001, 50_000)]), f"WITH {MEN} SELECT DISTINCT CASE WHEN name <> 'f' THEN name WHEN item BETWEEN 0 AND 5000 THEN 'f early' WHEN item BETWEEN 5001 AND 50000 THEN 'f late' ELSE 'f early' END AS name, item FROM men")
register("entity_merge", lambda s, d: N.merge(mentions(s, d), s.createDataFrame([("p", "open"), ("o", "open")], "old string, new string")), f"WITH {MEN} SELECT DISTINCT CASE WHEN name IN ('p', 'o') THEN 'open' ELSE name END AS name, item FROM men")


def repaired(s, d):
    e = table(s, d, "events")
    made = F.concat(F.lit('Here it is:\n```json\n[{kind: "'), F.col("event_type"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(',}, {"kind": "tail", "k": 1}'), F.when(F.col("event_id") % 2 == 0, F.lit(",]\n```")).otherwise(F.lit(', {"kind": "cut')))
    return e.select("event_id", F.explode(recovered_array(made, "struct<kind:string,k:bigint>")).alias("x")).select("event_id", "x.kind", "x.k")


register("json_repair", repaired, "SELECT event_id, event_type AS kind, (props->>'k')::BIGINT AS k FROM events UNION ALL SELECT event_id, 'tail', 1 FROM events")
register("csv_split", lambda s, d: table(s, d, "part").select("p_partkey", split_csv(F.concat(F.lit('"'), F.col("p_brand"), F.lit('", '), F.col("p_type"), F.lit(","), F.col("p_name"), F.lit(", and, more")), 3).alias("f")).select("p_partkey", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[2].alias("c")), "SELECT p_partkey, p_brand AS a, trim(p_type) AS b, p_name || ', and, more' AS c FROM part")


def streamed(s, d):
    """The events as a stream, counted by the hour once the watermark has passed; the sink is a table that reads back what was committed."""
    root = f"{shared_dir(s)}/counts-{uuid.uuid4().hex}"

    def add(batch, number):
        batch.withColumn("start", F.unix_millis("start")).write.mode("overwrite").parquet(f"{root}/table/batch={number}")

    V.counts(V.ingest(V.read_events(s, d))).writeStream.foreachBatch(add).outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.parquet(f"{root}/table")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select("start", "event_type", "n", "dwell_ms")


register("stream_counts", streamed, "SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS start, event_type, count(*) AS n, round(sum(least(value * 1000, 300000.0::DOUBLE)), 3) AS dwell_ms FROM events GROUP BY 1, 2")
