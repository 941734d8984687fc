"""Queries of fusion, tiers, judging and learning. Lanes are BM25, term coverage and title order of documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import table
from ..functions.numeric import confidence, relevance_logit, sigmoid
from ..lineage import keep
from ..operators import fts, lanes as N, learning as L, ranking as R
from ..operators.vectors import top_similar
from . import search as S
from .registry import register
from .vector import KNN, knn, stated, vecs


def lanes(s, d):
    """BM25, and documents that hold a query's longest words near each other, by id."""
    best = S.bm25_topk(s, d).select("query_id", F.col("doc_id").alias("id"), "rank", "score")
    near = fts.near(S.index(s, d), fts.longest(S.asked(s, d))).select("query_id", F.col("doc_id").alias("id"))
    return best, near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("id")))


BASE = f"{S.POSTS}, {S.TF}, {S.VOCAB}, {S.QUERY}, {S.BM25}, {S.LONGEST}, {S.NEAR}, nr AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM near)"
RRF = """u AS (SELECT query_id, doc_id AS id, 'b' AS source, 1.0::DOUBLE / (60 + rank) AS part FROM best UNION ALL SELECT query_id, id, 'n', 3.0::DOUBLE / (60 + rank) FROM nr),
    rrf AS (SELECT query_id, id, round(sum(part) * CASE WHEN count(DISTINCT source) >= 3 THEN 1.4 WHEN count(DISTINCT source) = 2 THEN 1.2 ELSE 1.0 END::DOUBLE, 8) AS score, count(DISTINCT source) AS sources FROM u GROUP BY ALL),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM rrf)"""


def fused(s, d, k=60.0):
    best, near = lanes(s, d)
    return R.fuse({"b": (best, 1.0), "n": (near, 3.0)}, k)


register("rrf", fused, f"WITH {BASE}, {RRF} SELECT * FROM fused")


KS = (10, 20, 30, 40, 50, 60, 70, 80, 100)


def holders(s, d):
    """The documents that a query is meant to find: those that hold its text."""
    return fts.phrase(S.index(s, d), S.asked(s, d)).select("query_id", F.col("doc_id").alias("id"))


def grid(s, d):
    """For each constant of the fusion: nDCG and reciprocal rank at 10 and hit rate, over queries whose text some document holds."""
    best, near = lanes(s, d)
    rows = best.select("query_id", "id", "rank", F.lit(1.0).alias("w")).unionByName(near.select("query_id", "id", "rank", F.lit(3.0).alias("w")))
    return R.fusion_grid(rows, holders(s, d), KS)


GRID_DCG = "list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE)))"
register("rrf_k_grid", grid, f"""WITH {BASE}, {S.PHRASE}, r AS (SELECT query_id, doc_id AS id, rank, 1.0::DOUBLE AS w FROM best UNION ALL SELECT query_id, id, rank, 3.0::DOUBLE FROM nr),
    g AS (SELECT k, query_id, id, round(sum(w / (k + rank)), 8) AS s FROM r, unnest({list(KS)}) AS t(k) GROUP BY ALL), o AS (SELECT k, query_id, id, row_number() OVER (PARTITION BY k, query_id ORDER BY s DESC, id) AS rank FROM g),
    e AS (SELECT t.k, p.query_id, round(sum(CASE WHEN o.rank <= 10 THEN 1 / log2(o.rank + 1.0::DOUBLE) ELSE 0 END) / {GRID_DCG}, 6) AS ndcg, coalesce(1.0::DOUBLE / min(CASE WHEN o.rank <= 10 THEN o.rank END), 0) AS rr
      FROM phrase p CROSS JOIN unnest({list(KS)}) AS t(k) LEFT JOIN o ON o.k = t.k AND o.query_id = p.query_id AND o.id = p.doc_id GROUP BY t.k, p.query_id)
    SELECT k::DOUBLE AS k, count(*) AS queries, round(avg(ndcg), 5) AS ndcg10, round(avg(rr), 5) AS mrr, round(avg((rr > 0)::INT), 5) AS hit_rate FROM e GROUP BY k""")
register("chapter_aggregate", lambda s, d: R.group_scores(fused(s, d), table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("g"))),
    f"WITH {BASE}, {RRF}, g AS (SELECT query_id, source AS g, round(sum(score) / sqrt(count(*)), 6) AS score, arg_min(id, (-score, id)) AS best FROM (SELECT f.query_id, f.id, f.score, d.source FROM fused f JOIN documents d ON d.doc_id = f.id) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, g)::INT AS rank FROM g QUALIFY rank <= 10")


def features(s, d):
    i, q = S.index(s, d), S.asked(s, d)
    best = fts.bm25(i, q)
    top = best.groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    rows = best.join(fts.coverage(i, S.termstats.term_weights(i, q)), ["query_id", "doc_id"]).join(top, "query_id")
    return rows.select("query_id", F.col("doc_id").alias("id"), "rank", F.col("coverage").alias("lex"), (F.col("score") / F.col("top")).alias("sim"), (1.0 / (60 + F.col("rank"))).alias("rrf"), (F.col("coverage") >= 0.9).alias("phrase"), (F.col("doc_id") % 5 == 0).alias("topical"), F.round(confidence(F.col("top"), F.col("n")), 6).alias("confidence"))


FEAT = f"{S.WBASE}, {S.COVER}, {S.BM25}"
FULL_BEST = """tp AS (SELECT query_id, max(score) AS top, count(*) AS n FROM best GROUP BY query_id),
    ft AS (SELECT f.query_id, f.doc_id AS id, f.rank, c.coverage AS lex, f.score / tp.top AS sim, 1.0::DOUBLE / (60 + f.rank) AS rrf, c.coverage >= 0.9 AS phrase, f.doc_id % 5 = 0 AS topical,
      round(sqrt(1 / (1 + exp(-2.0::DOUBLE * (abs(tp.top) - 5))) * (1 / (1 + exp(-0.15::DOUBLE * (tp.n - 15))))), 6) AS confidence FROM best f JOIN cov c ON c.query_id = f.query_id AND c.doc_id = f.doc_id JOIN tp ON tp.query_id = f.query_id)"""
TIER = """gt AS (SELECT *, 1 / (1 + exp(-20::DOUBLE * (sim - (0.28::DOUBLE - 0.08::DOUBLE * (0.6::DOUBLE - 0.5::DOUBLE))))) AS gate, least(8 * rrf, 0.99::DOUBLE) AS r FROM ft),
    tr AS (SELECT *, CASE WHEN phrase THEN 2 WHEN gate >= 0.5 THEN 3 WHEN topical THEN 4 ELSE 5 END AS tier, CASE WHEN phrase THEN greatest(sim, 0.6::DOUBLE * lex, r) WHEN gate >= 0.5 THEN gate * sim WHEN topical THEN gate * sim + (1 - gate) * r ELSE r + 0.3::DOUBLE * gate * sim END AS w FROM gt),
    ti AS (SELECT query_id, id, rank, lex, sim, rrf, confidence, tier, round(6 - tier + least(0.99::DOUBLE, w), 6) AS specificity FROM tr)"""
tiered = lambda s, d: R.tiers(features(s, d), F.lit(0.6))
register("tiering", lambda s, d: tiered(s, d).select("query_id", "id", "rank", "tier", "specificity"), f"WITH {FEAT}, {FULL_BEST}, {TIER} SELECT query_id, id, rank, tier, specificity FROM ti")


def probability(s, d):
    zero = F.lit(0.0)
    x = relevance_logit(spec=F.col("specificity"), tier=F.col("tier").cast("double"), sim=F.col("sim"), lex=F.col("lex"), window=zero, seq=zero, phrase=zero, walk=zero, prior=zero, sources=F.lit(1), anchor=zero, topical=zero, confidence=F.col("confidence"))
    return tiered(s, d).select("query_id", "id", F.round(sigmoid(x), 4).alias("probability"))


register("relevance_prob", probability, f"""WITH {FEAT}, {FULL_BEST}, {TIER} SELECT query_id, id, round(1 / (1 + exp(-(-4.7::DOUBLE + 1.18::DOUBLE * specificity + 0.38::DOUBLE * greatest(0, 5 - tier) + 2.05::DOUBLE * sim + 2 * lex + 0.12::DOUBLE + 0.65::DOUBLE * confidence
    + 1.9::DOUBLE * greatest(0, lex - 0.72::DOUBLE) + 0.9::DOUBLE * greatest(0, specificity - 1.55::DOUBLE)))), 4) AS probability FROM ti""")
register("score_floor", lambda s, d: R.above_floor(features(s, d), 0.8, 0.95).select("query_id", "id"), f"WITH {FEAT}, {FULL_BEST} SELECT query_id, id FROM ft QUALIFY sim >= 0.8 OR rrf >= greatest(0.95::DOUBLE * max(CASE WHEN rank <= 20 THEN rrf END) OVER (PARTITION BY query_id), 0.001)")


def kept(s, d):
    """The tiered results up to where their list falls off, if it does."""
    from ..functions.numeric import meaning

    rows = keep(tiered(s, d), "tiered")
    p = logit_of(rows)
    cut = R.elbow(rows.withColumn("meaning", F.round(meaning(F.round(sigmoid(p), 4), F.col("specificity")), 6)))
    return rows.join(cut, "query_id", "left").where("keep IS NULL OR rank <= keep").select("query_id", "id", "rank", F.coalesce("keep", F.lit(0)).alias("keep"), F.coalesce("support", F.lit(0.0)).alias("support"))


def logit_of(rows):
    zero = F.lit(0.0)
    return relevance_logit(spec=F.col("specificity"), tier=F.col("tier").cast("double"), sim=F.col("sim"), lex=F.col("lex"), window=zero, seq=zero, phrase=zero, walk=zero, prior=zero, sources=F.lit(1), anchor=zero, topical=zero, confidence=F.col("confidence"))


PROB = """pb AS (SELECT *, round(1 / (1 + exp(-(-4.7::DOUBLE + 1.18::DOUBLE * specificity + 0.38::DOUBLE * greatest(0, 5 - tier) + 2.05::DOUBLE * sim + 2 * lex + 0.12::DOUBLE + 0.65::DOUBLE * confidence
    + 1.9::DOUBLE * greatest(0, lex - 0.72::DOUBLE) + 0.9::DOUBLE * greatest(0, specificity - 1.55::DOUBLE)))), 4) AS probability FROM ti)"""
ELBOW = f"""{PROB}, me AS (SELECT *, round(0.82::DOUBLE * probability + 0.18::DOUBLE / (1 + exp(-3.2::DOUBLE * (specificity - 3.0::DOUBLE))), 6) AS meaning, count(*) OVER w AS n, min(CASE WHEN rank = 1 THEN tier END) OVER w AS ht, specificity - lead(specificity) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM pb WHERE rank <= 24 WINDOW w AS (PARTITION BY query_id)),
    mo AS (SELECT * FROM me WHERE n >= 6 AND ht <= 3), ls AS (SELECT query_id, list_sort(list(specificity)) AS sp, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS g FROM mo GROUP BY query_id), lm AS (SELECT *, (g[(len(g) - 1) // 2 + 1] + g[len(g) // 2 + 1]) / 2 AS mid FROM ls),
    lo2 AS (SELECT *, list_sort(list_transform(g, lambda x: abs(x - mid))) AS dv FROM lm), lh AS (SELECT query_id, mid, greatest(0.02::DOUBLE, 1.4826::DOUBLE * (dv[(len(dv) - 1) // 2 + 1] + dv[len(dv) // 2 + 1]) / 2) AS sigma, greatest(0.08::DOUBLE, (sp[floor((len(sp) - 1) * 0.75)::INT + 1] - sp[floor((len(sp) - 1) * 0.25)::INT + 1]) / 1.349::DOUBLE) AS heat FROM lo2),
    ex AS (SELECT mo.*, mid, sigma, exp((specificity - first_value(specificity) OVER (PARTITION BY query_id ORDER BY rank)) / heat) AS e FROM mo JOIN lh USING (query_id)),
    zz AS (SELECT *, (gap - mid) / sigma AS z, greatest(0, 1 - sum(e) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY query_id)) AS tail,
      avg(meaning) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - avg(meaning) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS margin FROM ex),
    su AS (SELECT query_id, rank, round(z * (1 - tail) * greatest(margin, 0) * (0.8::DOUBLE + least(0.2::DOUBLE, 0.2::DOUBLE * greatest(0, confidence))), 6) AS support FROM zz WHERE rank >= 2 AND n - rank >= 3 AND z >= 2.5 AND tail <= 0.35 AND margin >= 0.18),
    cu AS (SELECT query_id, rank AS keep, support FROM (SELECT * FROM su QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY support DESC, rank) = 1) WHERE support >= 0.9)"""
register("elbow_cut", kept, f"WITH {FEAT}, {FULL_BEST}, {TIER}, {ELBOW} SELECT query_id, id, rank, coalesce(keep, 0)::INT AS keep, coalesce(support, 0) AS support FROM ti LEFT JOIN cu USING (query_id) WHERE keep IS NULL OR rank <= keep")
register("monotonicity", lambda s, d: R.monotonicity(tiered(s, d), "specificity"), f"WITH {FEAT}, {FULL_BEST}, {TIER}, m AS (SELECT query_id, specificity, lag(specificity) OVER (PARTITION BY query_id ORDER BY rank) AS p FROM ti) SELECT query_id, round(avg((specificity <= p)::INT), 6) AS monotone FROM m WHERE p IS NOT NULL GROUP BY query_id")


def metrics(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.judge(S.bm25_topk(s, d).select("query_id", F.col("doc_id").alias("id"), "rank"), holders(s, d)).join(q.select("query_id"), "query_id")


DCG = "1 / log2(rank + 1.0::DOUBLE)"
register("ir_metrics", metrics, f"""WITH {S.POSTS}, {S.TF}, {S.VOCAB}, {S.QUERY}, {S.BM25}, {S.PHRASE},
    h AS (SELECT p.query_id, b.rank FROM phrase p LEFT JOIN best b ON b.query_id = p.query_id AND b.doc_id = p.doc_id)
    SELECT query_id, round(coalesce(1 / min(rank), 0), 6) AS rr, coalesce(min(rank) <= 1, false) AS top1, coalesce(min(rank) <= 3, false) AS top3,
      round(sum(CASE WHEN rank <= 5 THEN {DCG} ELSE 0 END) / list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg5,
      round(sum(CASE WHEN rank <= 10 THEN {DCG} ELSE 0 END) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg10 FROM h GROUP BY query_id""")


def varied(s, d):
    """Of the hundred nearest of each stated query, twenty that are unlike each other; the trade follows from the spread of similarity."""
    near = keep(top_similar(stated(s, d), vecs(s, d), 100), "near")
    trade = N.entropy_trade(near).select("query_id", "trade")
    rows = near.select("query_id", "id", F.col("similarity").alias("score"), (0.1 / (60 + F.col("rank"))).alias("rrf")).join(trade, "query_id").join(vecs(s, d).select("id", "v"), "id")
    return R.diversified(rows)


KNN100 = KNN.replace("rank <= 20", "rank <= 100")
register("mmr", varied, f"""WITH RECURSIVE {KNN100}, p AS (SELECT query_id, similarity / sum(similarity) OVER (PARTITION BY query_id) AS p FROM knn WHERE query_id % 20 = 0 AND similarity > 0),
    td AS (SELECT query_id, round(CASE WHEN count(*) >= 2 THEN 0.5::DOUBLE + 0.4::DOUBLE / (1 + exp(2.0::DOUBLE * (sum(-p * ln(p)) - 3.0::DOUBLE))) ELSE 0.9 END, 6) AS trade FROM p GROUP BY query_id),
    c AS (SELECT k.query_id, k.id, similarity AS score, 0.1::DOUBLE / (60 + rank) AS rrf, trade, v FROM knn k JOIN td ON td.query_id = k.query_id JOIN e ON e.id = k.id),
    st(query_id, n, id, chosen, vs) AS (SELECT DISTINCT query_id, 0, NULL::BIGINT, []::BIGINT[], []::DOUBLE[][] FROM c
      UNION ALL SELECT query_id, n + 1, id, list_append(chosen, id), list_append(vs, v) FROM (SELECT s.query_id, s.n, s.chosen, s.vs, c.id, c.v,
        row_number() OVER (PARTITION BY s.query_id ORDER BY round(trade * score - (1 - trade) * greatest(0, coalesce(list_max(list_transform(s.vs[-8:], lambda x: list_cosine_similarity(x, c.v))), 0)) + 2.0::DOUBLE * rrf, 9) DESC, score DESC, c.id) AS r
        FROM st s JOIN c ON c.query_id = s.query_id WHERE s.n < 20 AND NOT list_contains(s.chosen, c.id)) WHERE r = 1)
    SELECT query_id, id, n AS rank FROM st WHERE n > 0""")


def sinkhorn(s, d):
    """The group of each stated query against the groups of its neighbours. A group is ten ids."""
    group = lambda c: F.floor(F.col(c) / 10)
    v = vecs(s, d).groupBy(group("id").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("vs"))
    near = top_similar(stated(s, d), vecs(s, d)).select(group("query_id").alias("query_id"), group("id").alias("id")).distinct()
    return near.join(v.select(F.col("g").alias("query_id"), F.col("vs").alias("a")), "query_id").join(v.select(F.col("g").alias("id"), F.col("vs").alias("b")), "id")


GROUPS = f"""{KNN}, nr AS (SELECT DISTINCT query_id // 10 AS q, id // 10 AS g FROM knn WHERE query_id % 20 = 0),
    ct AS (SELECT q, g, x.id % 10 AS i, y.id % 10 AS j, x.v AS xv, y.v AS yv FROM nr JOIN e x ON x.id // 10 = q JOIN e y ON y.id // 10 = g)"""


def sinkhorn_sql(rounds: int) -> str:
    parts = ["ck AS (SELECT q, g, i, j, list_distance(xv, yv) AS c, exp(-list_distance(xv, yv) / 0.1::DOUBLE) AS k FROM ct)", "nl AS (SELECT q, g, count(DISTINCT i) AS ni, count(DISTINCT j) AS nj FROM ck GROUP BY ALL)", "v0 AS (SELECT DISTINCT q, g, j, 1.0::DOUBLE AS v FROM ck)"]
    for t in range(1, rounds + 1):
        parts.append(f"u{t} AS MATERIALIZED (SELECT q, g, i, 1.0::DOUBLE / any_value(ni) / greatest(sum(k * v), 1e-300) AS u FROM ck JOIN v{t - 1} USING (q, g, j) JOIN nl USING (q, g) GROUP BY q, g, i)")
        parts.append(f"v{t} AS MATERIALIZED (SELECT q, g, j, 1.0::DOUBLE / any_value(nj) / greatest(sum(k * u), 1e-300) AS v FROM ck JOIN u{t} USING (q, g, i) JOIN nl USING (q, g) GROUP BY q, g, j)")
    return ", ".join(parts) + f", tc AS (SELECT q AS query_id, g AS id, round(sum(u * k * v * c), 6) AS cost FROM ck JOIN u{rounds} USING (q, g, i) JOIN v{rounds} USING (q, g, j) GROUP BY q, g)"


register("sinkhorn", lambda s, d: R.transport(sinkhorn(s, d)).select("query_id", "id", F.round("cost", 6).alias("cost")), f"WITH {GROUPS}, {sinkhorn_sql(15)} SELECT * FROM tc")
register("transport_blend", lambda s, d: R.transport(sinkhorn(s, d)).join(top_similar(stated(s, d), vecs(s, d)).groupBy(F.floor(F.col("query_id") / 10).alias("query_id"), F.floor(F.col("id") / 10).alias("id")).agg(F.max("similarity").alias("similarity")), ["query_id", "id"]).select("query_id", "id", R.blended(F.col("similarity"), F.col("cost"), F.lit(0.5)).alias("score")),
    f"WITH {GROUPS}, {sinkhorn_sql(15)}, ms AS (SELECT query_id // 10 AS query_id, id // 10 AS id, max(similarity) AS similarity FROM knn WHERE query_id % 20 = 0 GROUP BY ALL), bc AS (SELECT q AS query_id, g AS id, sum(u * k * v * c) AS cost FROM ck JOIN u15 USING (q, g, i) JOIN v15 USING (q, g, j) GROUP BY q, g) SELECT query_id, id, round(CASE WHEN similarity > 0 THEN 0.6::DOUBLE * similarity + 0.4::DOUBLE * exp(-3.0::DOUBLE * cost) ELSE similarity END, 4) AS score FROM bc JOIN ms USING (query_id, id)")
register("token_alignment", lambda s, d: R.alignment(sinkhorn(s, d)), f"""WITH RECURSIVE {GROUPS}, cc AS (SELECT q, g, i, j, 1 - greatest(0, least(1, list_cosine_similarity(xv, yv))) AS c FROM ct),
    ch AS (SELECT q, g, (avg(mi)) AS a FROM (SELECT q, g, i, min(c) AS mi FROM cc GROUP BY ALL) GROUP BY q, g), cv AS (SELECT q, g, avg(mj) AS b FROM (SELECT q, g, j, min(c) AS mj FROM cc GROUP BY ALL) GROUP BY q, g),
    sz AS (SELECT q, g, count(DISTINCT i) AS m, count(DISTINCT j) AS n, list(c ORDER BY i, j) AS cs FROM cc GROUP BY q, g),
    dp(q, g, k, cells) AS (SELECT q, g, 0::BIGINT, []::DOUBLE[] FROM sz UNION ALL SELECT d.q, d.g, d.k + 1, list_append(d.cells, cs[d.k + 1] + least(CASE WHEN d.k = 0 THEN 0 WHEN d.k < n OR d.k % n = 0 THEN 'inf'::DOUBLE ELSE d.cells[d.k - n] END, CASE WHEN d.k % n = 0 THEN 'inf'::DOUBLE ELSE d.cells[d.k] END, CASE WHEN d.k < n THEN 'inf'::DOUBLE ELSE d.cells[d.k - n + 1] END))
      FROM dp d JOIN sz USING (q, g) WHERE d.k < m * n),
    em AS (SELECT q, g, least(1, list_min(cells[(m - 1) * n + 1:]) / m) AS emd FROM dp JOIN sz USING (q, g) WHERE k = m * n)
    SELECT q AS query_id, g AS id, round((a + b) / 2, 6) AS chamfer, round(emd, 6) AS emd, round(least(1, 0.5::DOUBLE * exp(-3 * (a + b) / 2) + 0.3::DOUBLE * exp(-2.5::DOUBLE * emd) + 0.2::DOUBLE), 6) AS score FROM ch JOIN cv USING (q, g) JOIN em USING (q, g)""")


def feedback(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("rank"), "value")


def slots(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("source")).distinct().select("source", F.length("source").alias("slot"))


GRAD = "f AS (SELECT length(event_type) AS slot, (props->>'k')::BIGINT AS rank FROM events), gr AS (SELECT slot, round(sum((1 / (rank + 1.0::DOUBLE) - 0.15::DOUBLE) * 0.01::DOUBLE * sqrt(rank + 1.0::DOUBLE)) / sum(sqrt(rank + 1.0::DOUBLE)), 8) AS gradient, count(*) AS n FROM f WHERE rank BETWEEN 0 AND 49 GROUP BY slot)"
gradient = lambda s, d: L.gradients(feedback(s, d), slots(s, d)).withColumn("slot", F.col("slot").cast("long"))
register("feedback_gradient", gradient, f"WITH {GRAD} SELECT * FROM gr")


def adam_step(s, d):
    w = slots(s, d).select(F.col("slot").cast("long").alias("slot")).distinct().select("slot", F.lit(0.5).alias("weight"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    return L.adam(w, gradient(s, d))


register("adam_step", adam_step, f"""WITH {GRAD}, a AS (SELECT slot, 0.1::DOUBLE * gradient AS m, 0.001::DOUBLE * gradient * gradient AS v FROM gr), b AS (SELECT *, 0.01::DOUBLE * (m / (1 - 0.9::DOUBLE)) / (sqrt(v / (1 - 0.999::DOUBLE)) + 1e-8::DOUBLE) AS mv FROM a)
    SELECT slot, round(least(3, greatest(0.05, 0.5::DOUBLE + CASE WHEN abs(mv) > 0.1 THEN mv / 2 ELSE mv END)), 8) AS weight, round(m, 10) AS m, round(v, 12) AS v FROM b""")


def points(s, d):
    return feedback(s, d).select((F.col("rank") % 3).cast("int").alias("tier"), (F.col("value") / 100).alias("score"), (F.col("source") == "click").cast("int").alias("clicked"))


PAV = """pt AS (SELECT ((props->>'k')::BIGINT % 3)::INT AS tier, value / 100 AS score, (event_type = 'click')::INT AS clicked FROM events), pg AS (SELECT tier, score, sum(clicked)::BIGINT AS s, count(*) AS n, row_number() OVER (PARTITION BY tier ORDER BY score) AS i FROM pt WHERE tier IN (SELECT tier FROM pt GROUP BY tier HAVING count(*) >= 5) GROUP BY tier, score),
    cu AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM pg WINDOW w AS (PARTITION BY tier ORDER BY i)),
    lf AS (SELECT b.tier, b.i, max((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) AS l FROM cu b JOIN cu a ON a.tier = b.tier AND a.i <= b.i GROUP BY b.tier, b.i), rt AS (SELECT a.tier, a.i, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) AS r FROM cu a JOIN cu b ON a.tier = b.tier AND a.i <= b.i GROUP BY a.tier, a.i),
    br AS (SELECT cu.*, sum(coalesce((l <= r)::INT, 1)) OVER (PARTITION BY cu.tier ORDER BY cu.i) AS block FROM cu LEFT JOIN lf ON lf.tier = cu.tier AND lf.i = cu.i - 1 LEFT JOIN rt ON rt.tier = cu.tier AND rt.i = cu.i AND lf.i IS NOT NULL),
    pav AS (SELECT tier, (min(score) + max(score)) / 2 AS x, sum(s) / sum(n) AS y FROM br GROUP BY tier, block)"""
rounded = lambda c: c.select("tier", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))
register("pav_curve", lambda s, d: rounded(L.calibration(points(s, d))), f"WITH {PAV} SELECT tier, round(x, 8) AS x, round(y, 8) AS y FROM pav")
register("calibrated", lambda s, d: L.calibrated(table(s, d, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("tier"), (F.col("value") / 100).alias("score")), rounded(L.calibration(points(s, d)))).select("event_id", "probability"), f"""WITH {PAV}, cr AS (SELECT tier, round(x, 8) AS x, round(y, 8) AS y FROM pav), ev AS (SELECT event_id, (event_id % 3)::INT AS tier, value / 100 AS score FROM events),
    ab AS (SELECT event_id, score, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb FROM ev LEFT JOIN LATERAL (SELECT x, y FROM cr WHERE cr.tier = ev.tier AND cr.x <= ev.score ORDER BY x DESC, y DESC LIMIT 1) a ON true LEFT JOIN LATERAL (SELECT x, y FROM cr WHERE cr.tier = ev.tier AND cr.x > ev.score ORDER BY x, y LIMIT 1) b ON true)
    SELECT event_id, round(CASE WHEN ax IS NULL THEN bb WHEN bx IS NULL THEN ay ELSE ay + (bb - ay) * (score - ax) / (bx - ax) END, 6) AS probability FROM ab""")
MADE_TEXT = "list_transform(range(0, 12), lambda i: 'w' || ((id * (i + 3)) % 17 + label))"


def made_texts(s, d):
    """Twelve words of each vector, from its id and label."""
    word = lambda i: F.concat(F.lit("w"), ((F.col("id") * (i + 3)) % 17 + F.col("label")).cast("string"))
    return vecs(s, d).select("id", F.transform(F.sequence(F.lit(0), F.lit(11)), word).alias("tokens"))


register("hard_negatives", lambda s, d: L.hard_negatives(knn(s, d).select("query_id", "id", "similarity"), vecs(s, d).select("id", F.floor(F.col("id") / 10).alias("chapter"), F.col("label").alias("book")), made_texts(s, d), 0.1),
    f"""WITH {KNN}, w AS (SELECT id, id // 10 AS chapter, label AS book, list_distinct({MADE_TEXT}) AS t FROM e), p AS (SELECT k.query_id AS id, k.id AS negative, similarity, round(2.0::DOUBLE * len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t)), 6) AS overlap, x.book = y.book AS same FROM knn k JOIN w x ON x.id = k.query_id JOIN w y ON y.id = k.id WHERE similarity BETWEEN 0.1 AND 0.9 AND x.chapter <> y.chapter),
    s AS (SELECT id, negative, round(0.72::DOUBLE * similarity + 0.2::DOUBLE * overlap + CASE WHEN same THEN 0.08::DOUBLE ELSE 0 END, 6) AS score FROM p WHERE overlap >= 0.08) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, negative) = 1""")
SETS = "s AS (SELECT user_id, list_sort(list_distinct(list((props->>'k')::BIGINT))) AS t FROM events GROUP BY user_id)"


def sets(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.get_json_object("props", "$.k").cast("long"))).alias("t"))


def set_scores(s, d):
    from ..functions.text import dice, jaccard

    a = sets(s, d)
    b = a.select((F.col("user_id") + 1).alias("user_id"), F.col("t").alias("u"))
    return a.join(b, "user_id").select("user_id", F.round(jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"), F.round(dice(F.col("t"), F.col("u")), 6).alias("dice"))


register("jaccard", set_scores, f"WITH {SETS} SELECT a.user_id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard, round(2.0::DOUBLE * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)), 6) AS dice FROM s a JOIN s b ON a.user_id = b.user_id + 1")


def searched(s, d):
    """Lexical lanes, the vectors nearest to the query's own, and where two steps of the neighbour graph lead from the first of these."""
    from ..operators.pipeline import search
    from .lanes import walk_steps

    asked = vecs(s, d).join(table(s, d, "benchmark").select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query_id"), "v")
    near = keep(top_similar(asked, vecs(s, d), 50), "near")
    reach = near.where("rank <= 3").select("query_id", F.col("id").alias("src")).join(walk_steps(s, d), "src").groupBy("query_id", F.col("dst").alias("id")).agg(F.max("walk").alias("walk"))
    walk = reach.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("walk"), "id"))).where("rank <= 20")
    return search(S.index(s, d), table(s, d, "benchmark"), lanes={"vector": (near.select("query_id", "id", "rank"), 1.0), "walk": (walk.select("query_id", "id", "rank"), 0.5)}, similar=near)


def labelled(s, d):
    from ..operators.pipeline import cluster_labels

    return cluster_labels(S.index(s, d), table(s, d, "documents").select("doc_id", F.col("source").alias("g")))


def pairs(s, d):
    from ..operators.pipeline import training_pairs

    return training_pairs(table(s, d, "part"), "p_name", "p_type", "p_brand")


B50 = S.BM25.replace("rank <= 10", "rank <= 50")
register("search_pipeline", searched, f"""WITH {S.WBASE}, {S.COVER}, {B50}, {S.PHRASE}, {S.LONGEST}, {S.NEAR}, {KNN.replace('rank <= 20', 'rank <= 50')},
    st AS (SELECT query_id, id, similarity / sum(similarity) OVER (PARTITION BY query_id) AS p FROM knn WHERE rank <= 5 AND similarity > 0), wk AS (SELECT a.query_id AS src, b.id AS dst, round(sum(a.p * b.p), 8) AS walk FROM st a JOIN st b ON b.query_id = a.id GROUP BY ALL HAVING a.query_id <> b.id),
    vn AS (SELECT knn.* FROM knn JOIN benchmark ON item_id = query_id), re AS (SELECT query_id, dst AS id, max(walk) AS walk FROM vn JOIN wk ON src = id WHERE rank <= 3 GROUP BY ALL),
    ln AS (SELECT query_id, doc_id AS id, rank, 1.0::DOUBLE AS w, 'b' AS s FROM best UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r, 3.0, 'p' FROM phrase QUALIFY r <= 50 UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r, 1.0, 'n' FROM near QUALIFY r <= 50
      UNION ALL SELECT query_id, id, rank, 1.0, 'v' FROM vn UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY walk DESC, id) AS r, 0.5, 'w' FROM re QUALIFY r <= 20),
    fu AS (SELECT query_id, id, round(sum(w / (60 + rank)) * CASE WHEN count(DISTINCT s) >= 3 THEN 1.4 WHEN count(DISTINCT s) = 2 THEN 1.2 ELSE 1.0 END::DOUBLE, 8) AS rrf, count(DISTINCT s) AS sources FROM ln GROUP BY query_id, id),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM fu),
    fx AS (SELECT f.*, coalesce(c.coverage, 0) AS lex, coalesce(v.similarity, 0) AS sim, p.doc_id IS NOT NULL AS phrase FROM fr f LEFT JOIN cov c ON c.query_id = f.query_id AND c.doc_id = f.id LEFT JOIN vn v ON v.query_id = f.query_id AND v.id = f.id LEFT JOIN (SELECT * FROM phrase QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) <= 50) p ON p.query_id = f.query_id AND p.doc_id = f.id),
    fl AS (SELECT * FROM fx QUALIFY sim >= 0.15 OR rrf >= greatest(0.08::DOUBLE * max(CASE WHEN rank <= 20 THEN rrf END) OVER (PARTITION BY query_id), 0.001)),
    gt2 AS (SELECT *, 1 / (1 + exp(-20::DOUBLE * (sim - 0.28::DOUBLE))) AS gate, least(8 * rrf, 0.99::DOUBLE) AS r FROM fl),
    tr2 AS (SELECT query_id, id, sources, CASE WHEN phrase THEN 2 WHEN gate >= 0.5 THEN 3 ELSE 5 END AS tier, CASE WHEN phrase THEN greatest(sim, 0.6::DOUBLE * lex, r) WHEN gate >= 0.5 THEN gate * sim ELSE r + 0.3::DOUBLE * gate * sim END AS w FROM gt2),
    sp2 AS (SELECT query_id, id, tier, sources, round(6 - tier + least(0.99::DOUBLE, w), 6) AS specificity FROM tr2)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY specificity DESC, id)::INT AS rank, tier, specificity, sources FROM sp2 QUALIFY rank <= 10""")
register("cluster_labels", labelled, f"""WITH {S.POSTS}, {S.TF}, {S.VOCAB}, i AS (SELECT term, round(ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1, 6) AS idf FROM vocab WHERE NOT regexp_matches(term, '^[0-9-]+$')),
    g AS (SELECT source AS g, term, sum(tf) AS tf FROM tf JOIN documents d ON d.doc_id = tf.doc_id GROUP BY ALL), w AS (SELECT g, term, round(tf * idf, 4) AS weight FROM g JOIN i USING (term) WHERE idf >= 4.5)
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY weight DESC, term)::INT AS rank FROM w QUALIFY rank <= 5""")
register("training_pairs", pairs, """WITH p AS (SELECT p_name AS anchor, p_type AS positive, min(p_brand) AS g FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL GROUP BY ALL),
    n AS (SELECT *, lead(positive) OVER (PARTITION BY g ORDER BY md5('pairs|' || anchor || '|' || positive), anchor, positive) AS negative FROM p) SELECT anchor, positive, negative FROM n WHERE negative IS NOT NULL AND negative <> positive""")
