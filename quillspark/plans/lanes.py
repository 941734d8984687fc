"""Queries of topics, intents, walks and boosts. Topics are part names, their items suppliers; results are vectors and their neighbours."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import table
from ..functions.numeric import confidence
from ..functions.text import slug, tokens
from ..lineage import keep
from ..operators import fts, graphs, lanes as L, vectors as V
from . import graph as G, search as S
from .reading import EV, events
from .registry import QUERIES, SQL, register
from .vector import CENT, KNN, UNIT, knn, stated, vecs


def topics(s, d):
    return table(s, d, "part").select(F.col("p_name").alias("name"), slug("p_name").alias("slug")).distinct()


def members(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), slug("p_name").alias("slug"))
    return table(s, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("item")).distinct().join(p, "l_partkey").select("slug", "item").distinct()


def topic_queries(s, d):
    """Every part asks: by its whole name, by its name among other words, by one word of it, by a beginning, or for nothing there."""
    w, k = F.split("p_name", " "), F.col("p_partkey") % 5
    t = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("my "), "p_name")).when(k == 2, w[1]).when(k == 3, F.substring("p_name", 1, 4)).otherwise(F.concat("p_name", F.lit(" that is long and so not asked for")))
    return table(s, d, "part").select(F.col("p_partkey").alias("query_id"), t.alias("text"))


TOPICS = r"""tp AS (SELECT DISTINCT lower(p_name) AS name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part),
    mb AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, l_suppkey AS item FROM lineitem JOIN part ON p_partkey = l_partkey),
    tq AS (SELECT p_partkey AS query_id, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'my ' || p_name WHEN 2 THEN string_split(p_name, ' ')[2] WHEN 3 THEN substr(p_name, 1, 4) ELSE p_name || ' that is long and so not asked for' END AS text FROM part)"""
MATCH = r"""tn AS (SELECT query_id, trim(regexp_replace(lower(text), '[^a-z0-9\-\s]', '', 'g')) AS norm FROM tq), tw AS (SELECT *, list_filter(regexp_split_to_array(norm, '\s+'), lambda x: len(x) >= 2) AS w FROM tn),
    tm AS (SELECT query_id, slug, name, replace(slug, '-', ' ') AS sp, w, len(w) AS n, (replace(slug, '-', ' ') = norm OR name = norm OR slug = regexp_replace(norm, '\s+', '-', 'g')) AND norm <> '' AS exact, len(w) >= 5 AS structured FROM tw, tp),
    tk AS (SELECT query_id, slug, exact, CASE WHEN NOT structured AND n BETWEEN 2 AND 4 THEN coalesce(list_position(list_transform(range(1, n), lambda i: contains(sp, w[i] || ' ' || w[i + 1]) OR contains(name, w[i] || ' ' || w[i + 1])), true), 0) ELSE 0 END AS pair,
      NOT structured AND n <= 3 AND len(list_filter(w, lambda x: contains(sp, x) OR contains(name, x))) > 0 AS word FROM tm),
    tr AS (SELECT *, CASE WHEN exact THEN 0 WHEN pair > 0 THEN 1 ELSE 2 END AS kind FROM tk WHERE exact OR pair > 0 OR word),
    tg AS (SELECT query_id, slug, exact, (row_number() OVER (PARTITION BY query_id ORDER BY kind, pair, slug) - 1)::INT AS i FROM (SELECT *, min(kind) OVER (PARTITION BY query_id) AS best FROM tr) WHERE kind < 2 OR best = 2 QUALIFY i < 10)"""


def matches(s, d):
    return L.topic_matches(topic_queries(s, d), topics(s, d), F.size(tokens(F.col("text"), drop=True)) >= 5)


register("topic_match", matches, f"WITH {TOPICS}, {MATCH} SELECT * FROM tg")
register("topic_lane", lambda s, d: L.topic_lane(matches(s, d), members(s, d)), f"""WITH {TOPICS}, {MATCH}, ma AS (SELECT *, max(exact) OVER (PARTITION BY query_id) AS anyx FROM tg QUALIFY i < 3), mo AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY item) - 1 AS pos FROM mb),
    sg AS (SELECT query_id, item, slug, i, round(1 + CASE WHEN anyx AND i = 0 THEN 0.35::DOUBLE ELSE 0 END + greatest(0, 0.18::DOUBLE - 0.04::DOUBLE * i) - 0.015::DOUBLE * pos, 4) AS signal FROM ma JOIN mo USING (slug) WHERE pos < CASE WHEN anyx THEN 15 ELSE 10 END),
    sb AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY signal DESC, i, slug DESC) = 1) SELECT query_id, item, signal, slug, row_number() OVER (PARTITION BY query_id ORDER BY signal DESC, item)::INT AS rank FROM sb""")
register("topic_search", lambda s, d: L.topic_search(topic_queries(s, d), topics(s, d), members(s, d)), f"""WITH {TOPICS}, k AS (SELECT query_id, slug, CASE WHEN slug = t OR name = t THEN 0 WHEN starts_with(slug, t) OR starts_with(name, t) THEN 1 WHEN contains(slug, t) OR contains(name, t) THEN 2 END AS kind FROM (SELECT query_id, lower(trim(text)) AS t FROM tq) q, tp WHERE t <> ''),
    m AS (SELECT query_id, slug FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY kind, slug) = 1)
    SELECT query_id, slug, item, total, rank FROM m JOIN (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY item)::INT AS rank, count(*) OVER (PARTITION BY slug) AS total FROM mb) USING (slug) WHERE rank <= 10""")


def intent_features(s, d):
    """Of the short and long queries: words, names, BM25 confidence, the two nearest clusters of the query's vector, topics and quality."""
    q = S.short_queries(s, d).withColumn("text", F.when(F.col("item_id") % 10 == 3, F.concat(F.lit("src"), F.col("item_id") % 20)).when(F.col("item_id") % 10 == 8, F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), (F.col("item_id") % 4 + 1).cast("int"))).otherwise(F.col("text")))
    i, terms = S.index(s, d), keep(fts.query_terms(q), "terms")
    best = fts.bm25(i, terms).groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    near = L.nearest_concepts(vecs(s, d).select(F.col("id").alias("query_id"), "v"), V.mean_vector(vecs(s, d), "label").withColumnRenamed("label", "concept"), 2, -2.0)
    near = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("near"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    name = lambda f: terms.join(i.postings.where(F.col("field") == f).select("term").distinct(), "term").select("query_id").distinct().withColumn(f, F.lit(True))
    rows = q.select(F.col("item_id").alias("query_id"), F.size(tokens(F.col("text"), keep=r"a-z\s")).alias("words"), F.length("text").alias("h"))
    rows = rows.join(best, "query_id", "left").join(near.where("query_id % 3 > 0"), "query_id", "left").join(name("source"), "query_id", "left").join(name("lang"), "query_id", "left")
    conf = F.round(confidence(F.coalesce("top", F.lit(0.0)) / 4, F.coalesce("n", F.lit(0)) * 2), 6)
    no = F.lit(False)
    return rows.select("query_id", "words", F.coalesce("source", no).alias("person"), F.coalesce("lang", no).alias("place"), conf.alias("confidence"), "near", F.coalesce("second", F.when(F.col("near").isNotNull(), 0.0)).alias("second"), (F.col("h") % 4 == 0).alias("exact"), (F.col("h") % 3).alias("hits"), (F.col("h") % 10 / 10.0).alias("quality"))


INTENT_Q = f"""bq AS (SELECT item_id, CASE WHEN item_id % 10 = 3 THEN 'src' || item_id % 20 WHEN item_id % 10 = 8 THEN ['en', 'fr', 'de', 'es'][item_id % 4 + 1] ELSE text END AS text FROM (SELECT item_id, {S.SHORT} AS text FROM benchmark)),
    {S.QUERY.replace('FROM benchmark', 'FROM bq')}, {S.BM25}"""
INTENT_F = rf"""bt AS (SELECT query_id, max(score) AS top, count(*) AS n FROM best GROUP BY query_id), cs AS (SELECT id, cen.label, round(list_cosine_similarity(v, c), 6) AS x FROM e, cen), c2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, label) AS r FROM cs),
    nr AS (SELECT id AS query_id, max(x) FILTER (r = 1) AS near, max(x) FILTER (r = 2) AS second FROM c2 WHERE r <= 2 AND id % 3 > 0 GROUP BY id),
    ft AS (SELECT item_id AS query_id, len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '\s+'), lambda x: len(x) >= 2)) AS words, EXISTS (SELECT 1 FROM q JOIN documents dd ON dd.source = q.term WHERE q.query_id = item_id) AS person, EXISTS (SELECT 1 FROM q JOIN documents dd ON dd.lang = q.term WHERE q.query_id = item_id) AS place,
      round(sqrt(1 / (1 + exp(-2.0::DOUBLE * (abs(coalesce(top, 0) / 4) - 5))) * (1 / (1 + exp(-0.15::DOUBLE * (coalesce(n, 0) * 2 - 15))))), 6) AS c, near, second, text FROM bq LEFT JOIN bt ON bt.query_id = item_id LEFT JOIN nr ON nr.query_id = item_id)"""


def query_intents(s, d):
    return L.intents(intent_features(s, d))


def tree(h: str) -> str:
    return f"""SELECT query_id, CASE WHEN words <= 2 AND person THEN 'entity/person' WHEN words <= 2 AND place THEN 'entity/place' WHEN near IS NOT NULL AND c >= 0.70 THEN 'keyword/bm25' WHEN near > 0.55 AND near - second > 0.07 AND c < 0.60 THEN 'conceptual/cluster'
      WHEN near > 0.38 AND words >= 2 AND c < 0.55 THEN 'situational/topical' WHEN near IS NOT NULL AND c >= 0.40 THEN 'mixed/hybrid' WHEN near IS NOT NULL AND (near > 0.28 OR c < 0.30) THEN 'conceptual/embedding' WHEN c >= 0.60 THEN 'keyword/bm25' WHEN c >= 0.30 THEN 'mixed/hybrid' ELSE 'conceptual/embedding' END AS x, words, {h} AS h FROM ft"""


# Topic signals of a query are made from its length here, as both engines can compute it.
INTENT = f"""it AS ({tree('len(text)')}), ir AS (SELECT query_id, CASE WHEN x IN ('keyword/bm25', 'mixed/hybrid') AND h % 4 = 0 AND words <= 2 THEN 'conceptual/topic-exact' WHEN x IN ('keyword/bm25', 'mixed/hybrid') AND h % 3 > 0 AND words <= 3 AND h % 10 / 10.0 < 0.6 THEN 'situational/topic-probe' ELSE x END AS x, h FROM it),
    intent AS (SELECT query_id, split_part(x, '/', 1) AS intent, split_part(x, '/', 2) AS subtype, h FROM ir)"""
INTENT_ALL = f"{S.POSTS}, {S.TF}, {S.VOCAB}, {INTENT_Q}, {CENT}, {INTENT_F}, {INTENT}"
register("query_intent", query_intents, f"WITH {INTENT_ALL} SELECT query_id, intent, subtype FROM intent")
_P = ", ".join(f"('{p[0]}', " + ", ".join(f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in p[1:]) + ")" for p in L.PROFILES)
register("walk_profiles", lambda s, d: L.walk_profiles(query_intents(s, d), intent_features(s, d).select("query_id", "exact", "hits")), f"""WITH {INTENT_ALL}, p(name, damping, hops, rounds, seeds, influence, neighbours, "references", we, wt, wo) AS (VALUES {_P})
    SELECT query_id, intent, damping, hops, rounds, seeds, influence, neighbours, "references", CASE WHEN h % 4 = 0 THEN we WHEN h % 3 > 0 THEN wt ELSE wo END AS topic_edges FROM intent JOIN p ON name = intent""")


def profiled(s, d):
    """Walks from the neighbours of each query's vector, by the profile of its intent; its topics are those of the item of its number."""
    p = W_PROFILES(s, d)
    near = keep(knn(s, d), "near")
    seeds = near.select("query_id", "id", (0.12 + 0.24 * F.greatest("similarity", F.lit(0.0)) + 0.28).alias("weight"))
    edges = near.select(F.lit("near").alias("kind"), F.col("query_id").alias("src"), "id", (F.greatest("similarity", F.lit(0.0)) * F.exp(-0.1 * (F.col("rank") - 1))).alias("w"), F.col("rank").alias("n"))
    ids = vecs(s, d).select("id")
    refs = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).withColumn("id", F.col("src") + F.col("n")).join(ids, "id", "left_semi")
    edges = edges.unionByName(refs.select(F.lit("reference").alias("kind"), "src", "id", (0.74 * F.exp(-0.12 * (F.col("n") - 1))).alias("w"), "n"))
    topics = keep(G.named(s, d), "named")
    walks = G.topic_ppr(s, d).select(F.col("seed").alias("topic"), "item", "score", "rank")
    return graphs.profiled_walk(seeds, p, edges, topics.select(F.col("item").alias("query_id"), "topic"), topics, walks)


def ways_sql(frontier: str) -> str:
    return f"""SELECT query_id, src, dst, w / sum(w) OVER (PARTITION BY query_id, src) AS p FROM (SELECT query_id, src, dst, max(w) AS w FROM (
      SELECT f.query_id, src, dst, w FROM {frontier} f JOIN pf USING (query_id) JOIN ed ON src = f.id WHERE n <= CASE kind WHEN 'near' THEN neighbours ELSE "references" END
      UNION ALL SELECT query_id, src, dst, w FROM (SELECT f.query_id, f.id AS src, tp.item AS dst, 0.55::DOUBLE * sqrt(tp.score) AS w, topic_edges, row_number() OVER (PARTITION BY f.query_id, f.id, a.topic ORDER BY tp.rank) AS nth
        FROM {frontier} f JOIN pf USING (query_id) JOIN nm a ON a.item = f.query_id JOIN nm b ON b.item = f.id AND b.topic = a.topic JOIN tp ON tp.seed = a.topic AND tp.item <> f.id WHERE topic_edges > 0) WHERE nth <= topic_edges) GROUP BY ALL)"""


def rounds_sql(n: int) -> str:
    return ", ".join(f"""r{i} AS (SELECT query_id, id, sum(s) AS s FROM (SELECT query_id, id, (1 - damping) * s AS s FROM sd JOIN pf USING (query_id) WHERE rounds >= {i}
      UNION ALL SELECT r.query_id, dst, damping * s * p FROM r{i - 1} r JOIN pf USING (query_id) JOIN wy ON wy.query_id = r.query_id AND src = r.id WHERE rounds >= {i} UNION ALL SELECT r.query_id, r.id, s FROM r{i - 1} r JOIN pf USING (query_id) WHERE rounds < {i}) GROUP BY ALL)""" for i in range(1, n + 1))


W_PROFILES = QUERIES["walk_profiles"]
register("profiled_walk", profiled, f"""WITH pf AS MATERIALIZED ({SQL["walk_profiles"]}), kn AS MATERIALIZED ({SQL["knn_graph"]}), tp AS MATERIALIZED ({SQL["topic_ppr"]}), nm AS MATERIALIZED (WITH {G.NAMED} SELECT * FROM br),
    ed AS MATERIALIZED (SELECT 'near' AS kind, query_id AS src, id AS dst, similarity * exp(-0.1::DOUBLE * (rank - 1)) AS w, rank AS n FROM kn WHERE similarity > 0 UNION ALL SELECT 'reference', a.vec_id, b.vec_id, 0.74::DOUBLE * exp(-0.12::DOUBLE * (n - 1)), n FROM embeddings a, unnest(range(1, 7)) AS t(n), embeddings b WHERE b.vec_id = a.vec_id + n),
    sd AS MATERIALIZED (SELECT query_id, id, w / sum(w) OVER (PARTITION BY query_id) AS s FROM (SELECT query_id, id, 0.12::DOUBLE + 0.24::DOUBLE * greatest(similarity, 0) + 0.28::DOUBLE AS w, count(*) OVER (PARTITION BY query_id) AS c FROM kn JOIN pf USING (query_id) WHERE rank <= seeds) WHERE c >= 3),
    w0 AS MATERIALIZED ({ways_sql("sd")}), f1 AS MATERIALIZED (SELECT DISTINCT w0.query_id, dst AS id FROM w0 JOIN pf USING (query_id) WHERE hops > 1 AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.query_id = w0.query_id AND sd.id = dst)),
    wy AS MATERIALIZED (SELECT * FROM w0 UNION ALL {ways_sql("f1")}), r0 AS (SELECT * FROM sd), {rounds_sql(5)}
    SELECT query_id, id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM r5""")


def results(s, d, k=20):
    """Every stated query's neighbours as a result list."""
    return V.top_similar(stated(s, d), vecs(s, d), k).select("query_id", "id", F.col("similarity").alias("score"), "rank")


RES = f"{KNN}, res AS (SELECT query_id, id, similarity AS score, rank FROM knn WHERE query_id % 20 = 0)"
BRIDGE = "bt AS (SELECT l_suppkey AS id, list_sort(list_distinct(list(l_partkey))) AS topics FROM lineitem GROUP BY 1)"


def supplier_topics(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("topics"))


register("context_boost", lambda s, d: L.context_boost(results(s, d).drop("rank"), stated(s, d).select("query_id", (F.floor(F.col("query_id") / 20)).cast("long").alias("item")), vecs(s, d).select("id", F.col("label").alias("v")), supplier_topics(s, d)),
    f"""WITH {RES}, {BRIDGE} SELECT query_id, r.id, round(score + CASE WHEN x.label = y.label THEN 0.05::DOUBLE ELSE 0 END + 0.08::DOUBLE * coalesce(len(list_intersect(a.topics, b.topics)), 0), 4) AS score FROM res r JOIN e x ON x.id = r.id LEFT JOIN e y ON y.id = query_id // 20 LEFT JOIN bt a ON a.id = r.id LEFT JOIN bt b ON b.id = query_id // 20""")


def dwelt(s, d):
    return events(s, d).where((F.col("event_type") == "view") & (F.col("value") > 3)).groupBy(F.col("item").alias("id")).agg(F.round(F.sum("value"), 4).alias("total"))


register("dwell_boost", lambda s, d: L.dwell_boost(results(s, d).drop("rank"), dwelt(s, d)), f"""WITH {RES}, {EV.replace('e AS', 'evt AS')}, dw AS (SELECT item AS id, round(sum(value), 4) AS total FROM evt WHERE event_type = 'view' AND value > 3 GROUP BY item ORDER BY total DESC, id LIMIT 500)
    SELECT query_id, res.id, round(score + 0.15::DOUBLE * coalesce(total / (SELECT max(total) FROM dw), 0), 6) AS score FROM res LEFT JOIN dw ON dw.id = res.id""")


def walk_steps(s, d):
    """Two steps over the neighbour graph, as walks."""
    n = knn(s, d, 5).where("similarity > 0").withColumn("p", F.col("similarity") / F.sum("similarity").over(W.partitionBy("query_id"))).select("query_id", "id", "p")
    two = n.join(n.select(F.col("query_id").alias("id"), F.col("id").alias("dst"), F.col("p").alias("q")), "id").groupBy(F.col("query_id").alias("src"), "dst").agg(F.round(F.sum(F.col("p") * F.col("q")), 8).alias("walk"))
    return two.where("src <> dst")


register("walk_injection", lambda s, d: L.walk_injection(results(s, d, 10), walk_steps(s, d)), f"""WITH {RES}, r10 AS (SELECT * FROM res WHERE rank <= 10), st AS (SELECT query_id, id, similarity / sum(similarity) OVER (PARTITION BY query_id) AS p FROM knn WHERE rank <= 5 AND similarity > 0),
    wk AS (SELECT a.query_id AS src, b.id AS dst, round(sum(a.p * b.p), 8) AS walk FROM st a JOIN st b ON b.query_id = a.id GROUP BY ALL HAVING a.query_id <> b.id),
    re AS (SELECT query_id, dst AS id, sum(walk) AS sm, max(walk) AS mx FROM r10 JOIN wk ON src = id WHERE rank <= 3 GROUP BY ALL)
    SELECT query_id, id, round(score + 0.1::DOUBLE * coalesce(sm, 0), 8) AS score, 'result' AS source FROM r10 LEFT JOIN re USING (query_id, id)
    UNION ALL SELECT query_id, id, round(0.08::DOUBLE * mx, 8), 'walk' FROM (SELECT * FROM re ANTI JOIN r10 USING (query_id, id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mx DESC, id) <= 5)""")


def priors(s, d):
    """Prior of the results: rank is the share of lines of an item, the rest is made from their scores and ids."""
    ranks = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("pagerank"))
    one = ranks.withColumn("n", F.count("*").over(W.partitionBy())).withColumn("i", F.row_number().over(W.orderBy("pagerank", "id")) - 1).where(F.col("i") == F.floor((F.col("n") - 1) * 0.95)).select(F.col("pagerank").alias("p95"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("conceptual", "situational", "mixed", "keyword")]), (F.col("query_id") / 20 % 4 + 1).cast("int"))
    rows = results(s, d).join(ranks, "id", "left").fillna(0, ["pagerank"]).join(F.broadcast(one))
    rows = rows.select("query_id", "id", kind.alias("intent"), (F.col("query_id") / 20 % 5 + 1).cast("int").alias("words"), (F.col("rank") / 20.0).alias("quality"), (F.col("id") % 7 == 0).alias("direct"), "pagerank", "p95", (F.col("id") % 4 + 1).alias("sources"), "score", (F.col("score") / 2).alias("walk"))
    return L.structure_prior(rows.withColumn("topical", F.col("score")).withColumn("shape", F.col("walk"))).select("query_id", "id", "intent", "prior")


register("structure_prior", priors, f"""WITH {RES}, pk AS (SELECT l_suppkey AS id, count(*) AS pagerank FROM lineitem GROUP BY 1), p9 AS (SELECT pagerank AS p95 FROM pk QUALIFY row_number() OVER (ORDER BY pagerank, id) - 1 = floor((count(*) OVER () - 1) * 0.95::DOUBLE)),
    x AS (SELECT query_id, res.id, ['conceptual', 'situational', 'mixed', 'keyword'][query_id // 20 % 4 + 1] AS intent, query_id // 20 % 5 + 1 AS words, rank / 20.0::DOUBLE AS quality, res.id % 7 = 0 AS direct, coalesce(pagerank, 0) / greatest(p95, 1e-9) AS pr, (res.id % 4) / 3.0::DOUBLE AS so, score FROM res LEFT JOIN pk ON pk.id = res.id, p9),
    y AS (SELECT *, CASE WHEN intent = 'conceptual' THEN 0.07::DOUBLE ELSE 0.05::DOUBLE END AS most, 0.45::DOUBLE * least(1, pr) + 0.2::DOUBLE * least(1, so) + 0.15::DOUBLE * greatest(0, least(1, score)) + 0.2::DOUBLE * greatest(0, least(1, score / 2)) AS blend FROM x)
    SELECT query_id, id, intent, CASE WHEN (intent IN ('conceptual', 'situational') OR (intent = 'mixed' AND words <= 2)) AND NOT (words >= 4 AND quality >= 0.45) AND NOT direct THEN round(least(most, blend * most), 6) ELSE 0 END AS prior FROM y""")


def picks(s, d):
    e = events(s, d).select(F.col("user_id").alias("session"), "item", "ts")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    member = table(s, d, "supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("distance"))
    return L.daily_pick(e, member, F.date_format("now", "yyyyMMdd").cast("long"), F.col("now"))


register("daily_pick", picks, f"""WITH {EV}, h AS (SELECT user_id AS session, item, ts, (SELECT max(ts) FROM e) AS now FROM e), l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, item) <= 30),
    t0 AS (SELECT session, s_nationkey AS g, count(*) AS c, strftime(max(now), '%Y%m%d')::BIGINT AS day FROM l JOIN supplier ON s_suppkey = item GROUP BY session, s_nationkey), t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY c DESC, g) = 1),
    f AS (SELECT DISTINCT session, item FROM h WHERE ts > now - INTERVAL 1 DAY), r AS (SELECT t.session, day, g, s_suppkey AS item, row_number() OVER (PARTITION BY t.session ORDER BY s_acctbal, s_suppkey) - 1 AS i FROM t JOIN supplier ON s_nationkey = g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.session = t.session AND f.item = s_suppkey) QUALIFY i < 50)
    SELECT session, day, g, item FROM r QUALIFY i = day % count(*) OVER (PARTITION BY session)""")
register("entropy_trade", lambda s, d: L.entropy_trade(V.top_similar(stated(s, d), vecs(s, d), 100).select("query_id", "similarity")), f"""WITH {KNN.replace('rank <= 20', 'rank <= 100')}, p AS (SELECT query_id, similarity / sum(similarity) OVER (PARTITION BY query_id) AS p FROM knn WHERE query_id % 20 = 0 AND similarity > 0)
    SELECT query_id, round(sum(-p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) >= 2 THEN 0.5::DOUBLE + 0.4::DOUBLE / (1 + exp(2.0::DOUBLE * (sum(-p * ln(p)) - 3.0::DOUBLE))) ELSE 0.9 END, 6) AS trade FROM p GROUP BY query_id""")


def bayes(s, d):
    """Similarity of the results, times what the topics that the items share tell."""
    t = supplier_topics(s, d)
    rows = results(s, d).join(t, "id", "left").join(t.select(F.col("id").alias("query_id"), F.col("topics").alias("own")), "query_id", "left")
    none = F.array().cast("array<bigint>")
    a, b = F.coalesce(F.col("topics").cast("array<bigint>"), none), F.coalesce(F.col("own").cast("array<bigint>"), none)
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    jaccard = F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(0.0)
    return rows.select("query_id", "id", F.round(F.col("score") * (1 + 0.3 * both + 2.0 * jaccard), 6).alias("relevance"))


register("bayes_relevance", bayes, f"""WITH {RES}, {BRIDGE}, x AS (SELECT query_id, res.id, score, coalesce(len(list_intersect(a.topics, b.topics)), 0) AS k, len(list_distinct(list_concat(a.topics, b.topics))) AS u, a.topics IS NOT NULL AND b.topics IS NOT NULL AS two FROM res LEFT JOIN bt a ON a.id = res.id LEFT JOIN bt b ON b.id = query_id)
    SELECT query_id, id, round(score * (1 + 0.3::DOUBLE * k + 2.0::DOUBLE * CASE WHEN two THEN k / u ELSE 0 END), 6) AS relevance FROM x""")
SESSION = f"{EV.replace('e AS', 'evt AS')}, l5 AS (SELECT user_id AS session, item, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, item)::INT AS rank FROM evt GROUP BY user_id, item QUALIFY rank <= 5)"


def recent(s, d):
    from ..operators.events import last_distinct

    return last_distinct(events(s, d), "user_id", "item").withColumnRenamed("user_id", "session")


register("session_centroid", lambda s, d: L.recency_centroid(recent(s, d), vecs(s, d)).select("session", F.posexplode("centroid").alias("i", "x")).select("session", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")), f"""WITH {UNIT}, {SESSION},
    m AS (SELECT session, i, sum(pow(0.6::DOUBLE, rank - 1) * v[i]) / sum(pow(0.6::DOUBLE, rank - 1)) AS x FROM l5 JOIN e ON e.id = item, unnest(range(1, 65)) AS t(i) GROUP BY ALL) SELECT session, i - 1 AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY session)), 6) AS x FROM m""")
register("concept_expand", lambda s, d: L.nearest_concepts(stated(s, d), V.mean_vector(vecs(s, d), "label").select(F.col("label").alias("concept"), "centroid"), 3, 0.1), f"""WITH {CENT}, x AS (SELECT id AS query_id, cen.label AS concept, round(list_cosine_similarity(v, c), 6) AS similarity FROM e, cen WHERE id % 20 = 0)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, concept)::INT AS rank FROM x WHERE similarity > 0.1 QUALIFY rank <= 3""")


def projected(s, d):
    """How like each result is to the place that the query's five nearest give it."""
    r = keep(results(s, d), "results")
    place = L.seed_projection(r.where("rank <= 5").withColumnRenamed("score", "similarity"), vecs(s, d).select("id", "v"))
    from ..functions.numeric import cosine

    return r.join(place.withColumnRenamed("v", "q"), "query_id").join(vecs(s, d).select("id", "v"), "id").select("query_id", "id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("shape"))


register("seed_projection", projected, f"""WITH {RES}, m AS (SELECT query_id, i, sum(score * v[i]) / sum(score) AS x FROM res JOIN e USING (id), unnest(range(1, 65)) AS t(i) WHERE rank <= 5 AND score > 0 GROUP BY ALL), p AS (SELECT query_id, list(x ORDER BY i) AS q FROM m GROUP BY query_id)
    SELECT query_id, id, round(list_cosine_similarity(q, v), 6) AS shape FROM res JOIN p USING (query_id) JOIN e USING (id)""")
register("company_boost", lambda s, d: L.company_boost(results(s, d), vecs(s, d).select("id", "v")), f"""WITH {RES}, m AS (SELECT query_id, i, avg(v[i]) AS x FROM res JOIN e USING (id), unnest(range(1, 65)) AS t(i) WHERE rank <= 5 GROUP BY ALL), p AS (SELECT query_id, list(x ORDER BY i) AS q FROM m GROUP BY query_id)
    SELECT query_id, id, round(score + 0.1::DOUBLE * list_cosine_similarity(q, v), 6) AS score FROM res JOIN p USING (query_id) JOIN e USING (id)""")
register("quota", lambda s, d: L.within_quota(results(s, d, 50).join(vecs(s, d).select("id", "label"), "id"), "label", 5, 30).select("query_id", "id", "label", "place"), f"""WITH {KNN.replace('rank <= 20', 'rank <= 50')}, a AS (SELECT query_id, k.id, label, rank FROM knn k JOIN e ON e.id = k.id WHERE query_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) <= 5)
    SELECT query_id, id, label, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM a QUALIFY place <= 30""")


def summaries(s, d):
    """Conversations are searched by their first turns, any word by prefix; the turns of the best are the lane."""
    c = table(s, d, "conversations")
    docs = c.where("turn = 0").select(F.col("conv_id").alias("doc_id"), "text")
    i = fts.build(docs)
    q = fts.query_terms(S.short_queries(s, d).where("item_id % 5 IN (1, 3)"))
    hits = fts.prefixes(i, q, False).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("matched"), "doc_id"))).select("query_id", F.col("doc_id").alias("chapter"), "rank")
    return L.summary_lane(hits, c.select(F.col("conv_id").alias("chapter"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id")))


register("summary_lane", summaries, f"""WITH cp AS (SELECT conv_id, unnest(t) AS term FROM (SELECT conv_id, {S.TOK} AS t FROM conversations WHERE turn = 0)), ct AS (SELECT DISTINCT conv_id, term FROM cp),
    sq AS (SELECT DISTINCT item_id AS query_id, unnest(t) AS term FROM (SELECT item_id, {S.TOK} AS t FROM (SELECT item_id, {S.SHORT} AS text FROM benchmark WHERE item_id % 5 IN (1, 3)))),
    h AS (SELECT query_id, conv_id, count(DISTINCT sq.term) AS matched FROM sq JOIN ct ON starts_with(ct.term, sq.term) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, conv_id) AS r FROM h QUALIFY r <= 15)
    SELECT query_id, c.conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY query_id ORDER BY r, turn)::INT AS rank FROM b JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) c ON c.conv_id = b.conv_id WHERE n <= 5""")
