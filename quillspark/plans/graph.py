"""Queries of graph operators. Topics are parts, items are suppliers or orders, sources are users."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import table
from ..lineage import keep
from ..operators import graphs as G
from .registry import register
from .vector import KNN, knn, vecs


def bridge(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("topic")).distinct()


BR = "br AS (SELECT DISTINCT l_suppkey AS item, l_partkey AS topic FROM lineitem)"
ED = "ed AS (SELECT src, dst, w, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT a.item AS src, b.item AS dst, count(*) AS w FROM br a JOIN br b ON a.topic = b.topic AND a.item <> b.item GROUP BY ALL))"
register("topic_index", lambda s, d: G.topic_index(bridge(s, d)).select("item", "n", F.md5(F.array_join("topics", ",")).alias("digest")), f"WITH {BR} SELECT item, count(*) AS n, md5(string_agg(topic::VARCHAR, ',' ORDER BY topic)) AS digest FROM br WHERE item IS NOT NULL AND item <> -1 GROUP BY item")
register("shared_edges", lambda s, d: G.shared_edges(bridge(s, d)).select("src", "dst", "w", F.round("p", 8).alias("p")), f"WITH {BR}, {ED} SELECT src, dst, w, round(p, 8) AS p FROM ed")


def pagerank_sql(rounds: int) -> str:
    parts = ["m AS (SELECT topic, count(*) AS m FROM br GROUP BY topic HAVING count(*) >= 2)", "n AS (SELECT count(DISTINCT item) AS n, count(DISTINCT topic) AS t FROM br)", "p0 AS (SELECT DISTINCT item, 1.0::DOUBLE / n AS pr FROM br, n)"]
    for i in range(1, rounds + 1):
        p = f"p{i - 1}"
        parts.append(f"s{i} AS (SELECT topic, sum(pr) AS s FROM br JOIN m USING (topic) JOIN {p} USING (item) GROUP BY topic)")
        parts.append(f"g{i} AS (SELECT item, sum((s - pr) / (m - 1)) AS g FROM br JOIN m USING (topic) JOIN s{i} USING (topic) JOIN {p} USING (item) GROUP BY item)")
        parts.append(f"r{i} AS (SELECT item, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(g, 0) / t AS pr FROM {p} LEFT JOIN g{i} USING (item), n)")
        parts.append(f"p{i} AS (SELECT item, pr / (SELECT sum(pr) FROM r{i}) AS pr FROM r{i})")
    return ", ".join(parts)


register("pagerank", lambda s, d: G.topic_pagerank(bridge(s, d)).select("item", F.round("pagerank", 10).alias("pagerank")), f"WITH {BR}, {pagerank_sql(25)} SELECT item, round(pr, 10) AS pagerank FROM p25")


def walk_sql(rounds: int, tolerance: float, home: str, factor: str, prune: str = "") -> str:
    """Rounds x1 .. xN of a walk over ``ed`` from ``x0(seed, item, score)``, and ``xx``: of each seed the first round that moves it by less than the tolerance."""
    parts = []
    for i in range(1, rounds + 1):
        parts.append(f"x{i} AS MATERIALIZED (SELECT seed, item, sum(score) AS score FROM (SELECT seed, dst AS item, {factor}::DOUBLE * score * p AS score FROM x{i - 1} JOIN ed ON src = item {prune} UNION ALL SELECT seed, item, {home} AS score FROM x0) {'WHERE score > 1e-7' if prune else ''} GROUP BY ALL)")
        parts.append(f"l{i} AS (SELECT seed, {i} AS k FROM (SELECT seed, sum(abs(coalesce(a.score, 0) - coalesce(b.score, 0))) AS d FROM x{i} a FULL JOIN x{i - 1} b USING (seed, item) GROUP BY seed) WHERE d < {tolerance}::DOUBLE)")
    parts.append("stop AS (SELECT seed, min(k) AS k FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, rounds)) + f" UNION ALL SELECT DISTINCT seed, {rounds} FROM x0) GROUP BY seed)")
    parts.append("xx AS (SELECT seed, item, score FROM (" + " UNION ALL ".join(f"SELECT {i} AS k, * FROM x{i}" for i in range(1, rounds + 1)) + ") JOIN stop USING (seed, k))")
    return ", ".join(parts)


def named(s, d):
    """Suppliers and the names of the parts that they deliver, as topics."""
    from .lanes import members

    return members(s, d).select("item", F.col("slug").alias("topic"))


def topic_ppr(s, d):
    b = named(s, d)
    seeds = b.withColumn("bias", 1.0 / F.count("*").over(W.partitionBy("topic"))).select(F.col("topic").alias("seed"), "item", "bias")
    return G.personalised_pagerank(b, seeds)


NAMED = BR.replace("SELECT DISTINCT l_suppkey AS item, l_partkey AS topic FROM lineitem", "SELECT DISTINCT l_suppkey AS item, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS topic FROM lineitem JOIN part ON p_partkey = l_partkey")
PPR = f"x0 AS (SELECT topic AS seed, item, 1.0::DOUBLE / count(*) OVER (PARTITION BY topic) AS score FROM br), {walk_sql(20, 1e-4, '0.15::DOUBLE * score', '0.85')}, ppr AS (SELECT seed, item, round(score, 8) AS score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 8) DESC, item)::INT AS rank FROM xx WHERE score > 1e-8 QUALIFY rank <= 200)"
register("topic_ppr", topic_ppr, f"WITH {NAMED}, {ED}, {PPR} SELECT * FROM ppr")


def rwr(s, d):
    return G.bridge_walk_with_restart(bridge(s, d))


RWR = f"x0 AS (SELECT DISTINCT item AS seed, item, 1.0::DOUBLE AS score FROM br), {walk_sql(15, 1e-5, '0.85::DOUBLE', '(1 - 0.85::DOUBLE)', 'WHERE score >= 1e-7')}, rwr AS (SELECT seed AS src, item AS dst, round(score, 8) AS score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 8) DESC, item)::INT AS rank FROM xx WHERE seed <> item AND score > 1e-8 QUALIFY rank <= 20)"
register("rwr", rwr, f"WITH {BR}, {ED}, {RWR} SELECT * FROM rwr")


def query_ppr(s, d):
    near = knn(s, d, 10)
    seeds = near.where("query_id % 20 = 0 AND rank <= 7").select("query_id", "id", (0.12 + 0.24 * F.col("similarity")).alias("weight"))
    edges = near.select(F.col("query_id").alias("src"), "id", (F.greatest("similarity", F.lit(0.0)) * F.exp(-0.1 * (F.col("rank") - 1))).alias("w")).where("w > 0")
    refs = vecs(s, d).select(F.col("id").alias("src"), (F.col("id") + 1).alias("id"), F.lit(0.74).alias("w"))
    return G.query_walk(seeds, [edges, refs])


register("query_ppr", query_ppr, f"""WITH {KNN}, sd AS (SELECT query_id, id, w / sum(w) OVER (PARTITION BY query_id) AS s FROM (SELECT query_id, id, 0.12::DOUBLE + 0.24::DOUBLE * similarity AS w FROM knn WHERE query_id % 20 = 0 AND rank <= 7)),
    raw AS (SELECT query_id AS src, id, greatest(similarity, 0) * exp(-0.1::DOUBLE * (rank - 1)) AS w FROM knn WHERE rank <= 10 AND similarity > 0 UNION ALL SELECT id, id + 1, 0.74::DOUBLE FROM e),
    ed AS (SELECT src, id AS dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, id, max(w) AS w FROM raw GROUP BY ALL)),
    a AS (SELECT query_id, id, sum(s) AS s FROM (SELECT query_id, dst AS id, 0.8::DOUBLE * s * p AS s FROM sd JOIN ed ON src = id UNION ALL SELECT query_id, id, (1 - 0.8::DOUBLE) * s FROM sd) GROUP BY ALL),
    b AS (SELECT query_id, id, sum(s) AS s FROM (SELECT query_id, dst AS id, 0.8::DOUBLE * s * p AS s FROM a JOIN ed ON src = id UNION ALL SELECT query_id, id, (1 - 0.8::DOUBLE) * s FROM sd) GROUP BY ALL)
    SELECT query_id, id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM b""")


def related(s, d):
    b = bridge(s, d)
    shared = keep(G.shared_edges(b), "shared")
    similar = shared.select("src", "dst", F.round(F.col("w") / (F.col("w") + 10.0), 6).alias("similarity"))
    groups = table(s, d, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("g"))
    topical = topic_ppr(s, d).select(F.col("seed").alias("topic"), F.col("item").alias("dst"), "score")
    best = named(s, d).withColumnRenamed("item", "src").join(topical, "topic").groupBy("src", "dst").agg(F.max("score").alias("ppr"))
    return G.related(similar, G.random_walk_with_restart(shared, b.select("item").distinct()), shared, G.topic_index(b).select("item", "n"), groups, G.topic_pagerank(b), best)


RELATED_PPR = PPR.replace("FROM br)", "FROM nb)").replace("JOIN ed ON", "JOIN ned ON")
register("related", related, f"""WITH {BR}, {ED}, {NAMED.replace('br AS', 'nb AS')}, {ED.replace('ed AS', 'ned AS').replace('br a', 'nb a').replace('br b', 'nb b')}, tpp AS (WITH {RELATED_PPR} SELECT * FROM ppr), wk AS (WITH {RWR} SELECT src, dst, score AS walk FROM rwr), pk AS (WITH {pagerank_sql(25)} SELECT item, pr FROM p25),
    bp AS (SELECT nb.item AS src, tpp.item AS dst, max(score) AS ppr FROM nb JOIN tpp ON seed = topic GROUP BY ALL), sm AS (SELECT src, dst, round(w / (w + 10.0::DOUBLE), 6) AS similarity FROM ed), st AS (SELECT item, list(topic) AS t FROM br GROUP BY item),
    j AS (SELECT src, dst, similarity, coalesce(walk, 0) AS walk, coalesce(ppr, 0) AS ppr, pr, len(list_intersect(x.t, y.t)) AS nb, len(list_distinct(list_concat(x.t, y.t))) AS uni FROM sm FULL JOIN wk USING (src, dst) LEFT JOIN bp USING (src, dst) JOIN st x ON x.item = src JOIN st y ON y.item = dst JOIN pk ON pk.item = dst),
    sc AS (SELECT src, dst, round(CASE WHEN similarity IS NULL THEN 3 * walk ELSE similarity + 2 * walk + 0.5::DOUBLE * ppr END + 0.15::DOUBLE * nb + 0.5::DOUBLE * nb / uni + 2000.0::DOUBLE * pr, 6) AS score FROM j WHERE (SELECT s_nationkey FROM supplier WHERE s_suppkey = src) <> (SELECT s_nationkey FROM supplier WHERE s_suppkey = dst))
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INT AS rank FROM sc QUALIFY rank <= 10""")


def for_you(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").cast("long").alias("item"), "ts")
    member = table(s, d, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("g"), (F.abs("s_acctbal") / 10_000.0).alias("distance"))
    walks = topic_ppr(s, d).select(F.col("seed").alias("topic"), "item", "score").where("rank <= 50")
    return G.affinity(e, member, G.topic_pagerank(named(s, d)).withColumnRenamed("pagerank", "prior"), named(s, d), walks)


register("for_you", for_you, f"""WITH {NAMED}, {ED}, {PPR}, pk AS (WITH {pagerank_sql(25)} SELECT item, pr FROM p25), e AS (SELECT user_id AS session, (props->>'k')::BIGINT AS item, ts FROM events),
    sn AS (SELECT session, item, row_number() OVER (PARTITION BY session ORDER BY max(ts) DESC, item) AS n FROM e GROUP BY session, item), gr AS (SELECT session, s_nationkey AS g, count(*) AS c FROM sn JOIN supplier ON s_suppkey = item WHERE n <= 100 GROUP BY ALL),
    tg AS (SELECT session, g, c / max(c) OVER (PARTITION BY session) AS share FROM (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY session ORDER BY c DESC, g) <= 5)),
    mm AS (SELECT s_suppkey AS item, s_nationkey AS g, abs(s_acctbal) / 10000.0::DOUBLE AS distance FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) / 10000.0::DOUBLE, s_suppkey) <= 30),
    tn AS (SELECT DISTINCT session, topic FROM sn JOIN br USING (item) WHERE n <= 30),
    pt AS (SELECT session, mm.item, 0.6::DOUBLE * share * greatest(0, 1 - distance) AS part FROM tg JOIN mm USING (g) UNION ALL SELECT session, ppr.item, 0.4::DOUBLE * sum(score) FROM tn JOIN ppr ON seed = topic WHERE rank <= 50 GROUP BY session, ppr.item),
    sc AS (SELECT session, item, sum(part) AS score FROM pt WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.session = pt.session AND sn.item = pt.item) GROUP BY ALL),
    fl AS (SELECT session, item, 0.2::DOUBLE * pr AS score FROM (SELECT DISTINCT session FROM sn), (SELECT * FROM pk ORDER BY pr DESC, item LIMIT 100)),
    fm AS (SELECT fl.* FROM fl ANTI JOIN sn ON sn.session = fl.session AND sn.item = fl.item), al AS (SELECT * FROM sc UNION ALL SELECT fm.* FROM fm ANTI JOIN sc ON sc.session = fm.session AND sc.item = fm.item)
    SELECT session, item, round(score, 9) AS score, row_number() OVER (PARTITION BY session ORDER BY round(score, 9) DESC, item)::INT AS rank FROM al QUALIFY rank <= 20""")
register("xref_lane", lambda s, d: knn(s, d, 8).where("query_id % 20 = 0").select("query_id", F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("ref"), "id").join(vecs(s, d).select(F.col("id").alias("ref")), "ref", "left_semi").where("ref <> query_id").groupBy("query_id", "ref").agg(F.count("*").alias("n")),
    f"WITH {KNN}, x AS (SELECT query_id, id + k AS ref FROM knn, unnest([1, 2]) AS t(k) WHERE query_id % 20 = 0 AND rank <= 8) SELECT query_id, ref, count(*) AS n FROM x WHERE ref <> query_id AND ref IN (SELECT id FROM e) GROUP BY ALL")
