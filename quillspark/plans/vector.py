"""Queries of vector search and reduction, on embeddings; label stands for a cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import relational, vectors as V
from .registry import register


def vecs(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def stated(s, d):
    """The stated query set: every id divisible by 20."""
    return vecs(s, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")


def knn(s, d, k=20):
    v = vecs(s, d)
    return V.top_similar(v.select(F.col("id").alias("query_id"), "v"), v, k)


UNIT = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
SIM = f"{UNIT}, sim AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a, e b WHERE a.id <> b.id)"
KNN = f"{SIM}, knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sim QUALIFY rank <= 20)"
CENT = f"{UNIT}, cm AS (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM e, unnest(range(1, 65)) AS t(i) GROUP BY ALL), cn AS (SELECT label, sqrt(sum(x * x)) AS norm FROM cm GROUP BY label), cen AS (SELECT label, list(x / norm ORDER BY i) AS c, max(n) AS n FROM cm JOIN cn USING (label) GROUP BY label)"

register("brute_topk", lambda s, d: V.top_similar(stated(s, d), vecs(s, d), 50, 0.0), f"WITH {SIM} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sim WHERE query_id % 20 = 0 AND similarity > 0 QUALIFY rank <= 50")
register("knn_graph", knn, f"WITH {KNN} SELECT * FROM knn")
register("centroids", lambda s, d: V.mean_vector(vecs(s, d), "label").select("label", F.col("n"), F.posexplode("centroid").alias("i", "x")).select("label", "n", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")), f"WITH {CENT} SELECT label, n, i - 1 AS i, round(x / norm, 6) AS x FROM cm JOIN cn USING (label)")


def assigned(s, d, k):
    c = V.mean_vector(vecs(s, d), "label")
    return V.assign(vecs(s, d), c, k)


DIST = f"{CENT}, dist AS (SELECT id, cen.label, round(list_distance(v, c), 6) AS distance FROM e, cen), near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, label)::INT AS rank FROM dist)"
register("assign_centroid", lambda s, d: assigned(s, d, 1), f"WITH {DIST} SELECT * FROM near WHERE rank = 1")
register("nearest_clusters", lambda s, d: assigned(s, d, 3), f"WITH {DIST} SELECT * FROM near WHERE rank <= 3")


def expanded(s, d):
    edges = knn(s, d).select(F.col("query_id").alias("src"), "id", "similarity", "rank")
    parents = V.top_similar(stated(s, d), vecs(s, d), 12)
    return V.expand(parents.select("query_id", "id", "similarity"), edges)


register("knn_expand", expanded, f"""WITH {KNN}, p AS (SELECT * FROM knn WHERE query_id % 20 = 0 AND rank <= 12),
    m AS (SELECT p.query_id, k.id, round(avg(k.similarity * exp(-0.15::DOUBLE * (k.rank - 1))), 6) AS score FROM p JOIN knn k ON k.query_id = p.id WHERE p.similarity >= 0.25 AND k.similarity >= 0.2 GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = m.query_id AND p.id = m.id) QUALIFY rank <= 30""")
register("semantic_injection", lambda s, d: relational.upsert(
    V.top_similar(stated(s, d), vecs(s, d), 30).select("query_id", "id", "similarity"),
    expanded(s, d).select("query_id", "id", (F.col("score") * 0.9).alias("similarity")), ["query_id", "id"], "max").select("query_id", "id", F.round("similarity", 6).alias("similarity")),
    f"""WITH {KNN}, big AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim WHERE query_id % 20 = 0 QUALIFY rank <= 30), p AS (SELECT * FROM knn WHERE query_id % 20 = 0 AND rank <= 12),
    m AS (SELECT p.query_id, k.id, round(avg(k.similarity * exp(-0.15::DOUBLE * (k.rank - 1))), 6) AS score FROM p JOIN knn k ON k.query_id = p.id WHERE p.similarity >= 0.25 AND k.similarity >= 0.2 GROUP BY ALL),
    x AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = m.query_id AND p.id = m.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30)
    SELECT query_id, id, round(greatest(similarity, score * 0.9), 6) AS similarity FROM (SELECT query_id, id, similarity FROM big) FULL JOIN (SELECT query_id, id, score FROM x) USING (query_id, id)""")
register("encoder_agreement", lambda s, d: V.agreement(vecs(s, d).join(V.mean_vector(vecs(s, d), "label"), "label"), "v", "centroid"), f"WITH {CENT}, c AS (SELECT list_cosine_similarity(v, c) AS x FROM e JOIN cen USING (label)) SELECT count(*) AS n, round(min(x), 6) AS least, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.05), 6) AS p5 FROM c")


def coarse(frame):
    """The same vectors as an encoder of few bits gives them: components cut to eighths."""
    return frame.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * 8) / 8))


register(
    "encoder_neighbours",
    lambda s, d: V.neighbour_agreement(V.top_similar(stated(s, d), vecs(s, d), 10), V.top_similar(coarse(stated(s, d)), coarse(vecs(s, d)), 10)),
    """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: floor(x * 8) / 8) AS w FROM embeddings),
    sim AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS s, round(list_cosine_similarity(a.w, b.w), 6) AS t FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS x, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, id) AS y FROM sim)
    SELECT query_id, count(*) FILTER (x <= 10 AND y <= 10) AS shared, round(count(*) FILTER (x <= 10 AND y <= 10) / count(*), 6) AS jaccard, bool_or(x = 1 AND y = 1) AS same_first, bool_and(x = y) AS same_order
    FROM r WHERE x <= 10 OR y <= 10 GROUP BY query_id""",
)


def edges(s, d):
    e = knn(s, d, 10).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.greatest("similarity", F.lit(0.0)).alias("w"))
    return e.union(e.select("b", "a", "w")).groupBy("a", "b").agg(F.max("w").alias("w")).where("w > 0")


register("normalised_adjacency", lambda s, d: (lambda e: e.join(e.groupBy("a").agg(F.sum("w").alias("x")), "a").join(e.groupBy(F.col("a").alias("b")).agg(F.sum("w").alias("y")), "b").select("a", "b", F.round(F.col("w") / F.sqrt(F.col("x") * F.col("y")), 6).alias("w")))(edges(s, d)),
    f"""WITH {KNN}, k AS (SELECT query_id AS a, id AS b, greatest(similarity, 0) AS w FROM knn WHERE rank <= 10), u AS (SELECT a, b, max(w) AS w FROM (SELECT * FROM k UNION ALL SELECT b, a, w FROM k) GROUP BY a, b HAVING max(w) > 0), g AS (SELECT a AS n, sum(w) AS d FROM u GROUP BY a)
    SELECT a, b, round(w / sqrt(x.d * y.d), 6) AS w FROM u JOIN g x ON x.n = a JOIN g y ON y.n = b""")
register("kmeans", lambda s, d: V.clusters(vecs(s, d), 10))
register("whiten", lambda s, d: V.whitened(vecs(s, d)))
register("svd", lambda s, d: V.principal(vecs(s, d), 16))


def item2vec(s, d):
    e = table(s, d, "events").withColumn("item", F.get_json_object("props", "$.k"))
    sessions = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "item"))), lambda x: x["item"]).alias("items"))
    return V.item_vectors(sessions)


register("item2vec", item2vec)
register("ann_lsh", lambda s, d: V.hashed_neighbours(vecs(s, d), stated(s, d)))
