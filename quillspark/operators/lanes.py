"""Lanes beside the lexical ones: topics, intents, walks, and what raises results by context, dwell and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from ..functions.text import tokens
from ..lineage import small


def topic_matches(queries: DataFrame, topics: DataFrame, structured: Column, cap: int = 10) -> DataFrame:
    """``query_id, slug, exact, i``: the topics that a query names, at most ``cap``, numbered from 0.

    ``queries(query_id, text)``, ``topics(slug, name)``; there are few topics. A topic whose slug or name is the
    whole query comes first; then, for unstructured queries of two to four words, those that hold
    one of its pairs of neighbours; only if there are none, and for three words at most, those that hold a word.
    """
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9\-\s]", ""))
    q = queries.select("query_id", norm.alias("norm"), tokens(F.col("text"), drop=True).alias("w"), structured.alias("structured")).withColumn("n", F.size("w"))
    t = small(topics.select("slug", F.lower("name").alias("name"), F.replace("slug", F.lit("-"), F.lit(" ")).alias("spaced")))
    whole = (F.col("norm") != "") & ((F.col("spaced") == F.col("norm")) | (F.col("name") == F.col("norm")) | (F.col("slug") == F.regexp_replace("norm", r"\s+", "-")))
    has = lambda x: F.contains("spaced", x) | F.contains("name", x)
    pair = F.when(~F.col("structured") & F.col("n").between(2, 4), F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: has(F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))), True)).otherwise(0)
    word = F.when(~F.col("structured") & (F.col("n") <= 3), F.exists("w", has)).otherwise(False)
    rows = q.join(t).withColumn("exact", whole).withColumn("pair", pair).withColumn("word", word).where("exact OR pair > 0 OR word")
    rows = rows.withColumn("kind", F.when(F.col("exact"), 0).when(F.col("pair") > 0, 1).otherwise(2)).withColumn("best", F.min("kind").over(W.partitionBy("query_id"))).where("kind < 2 OR best = 2")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("kind", "pair", "slug")) - 1
    return rows.withColumn("i", place).where(F.col("i") < cap).select("query_id", "slug", "exact", "i")


def topic_lane(matches: DataFrame, members: DataFrame) -> DataFrame:
    """``query_id, item, signal, slug, rank``: the first items of the first three topics, of an exact match 15, else 10.

    ``members(slug, item)``. Of an item in several topics the strongest signal counts.
    """
    exact = F.max("exact").over(W.partitionBy("query_id"))
    m = matches.withColumn("any", exact).where("i < 3")
    first = members.distinct().withColumn("at", F.row_number().over(W.partitionBy("slug").orderBy("item")) - 1).where("at < 15")
    rows = m.join(first, "slug").where(F.col("at") < F.when(F.col("any"), 15).otherwise(10))
    signal = 1 + F.when(F.col("any") & (F.col("i") == 0), 0.35).otherwise(0.0) + F.greatest(F.lit(0.0), 0.18 - 0.04 * F.col("i")) - 0.015 * F.col("at")
    best = rows.groupBy("query_id", "item").agg(F.max(F.struct(F.round(signal, 4).alias("signal"), (-F.col("i")).alias("i"), "slug")).alias("b")).select("query_id", "item", "b.signal", "b.slug")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("signal"), "item")))


def topic_search(queries: DataFrame, topics: DataFrame, members: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    """``query_id, slug, item, total, rank``: a page of the items of the topic that a query means: the same name, else its beginning, else a part."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("t")).where("t <> ''")
    t = small(topics.select("slug", F.lower("name").alias("name")))
    either = lambda f: f("slug") | f("name")
    kind = F.when(either(lambda c: F.col(c) == F.col("t")), 0).when(either(lambda c: F.startswith(F.col(c), F.col("t"))), 1).when(either(lambda c: F.contains(F.col(c), F.col("t"))), 2)
    meant = q.join(t).withColumn("kind", kind).where("kind IS NOT NULL").groupBy("query_id").agg(F.min(F.struct("kind", "slug"))["slug"].alias("slug"))
    one = W.partitionBy("slug")
    listed = members.distinct().withColumn("rank", F.row_number().over(one.orderBy("item"))).withColumn("total", F.count("*").over(one)).where(F.col("rank").between(page * size + 1, page * size + size))
    return meant.join(listed, "slug").select("query_id", "slug", "item", "total", "rank")


def intents(f: DataFrame) -> DataFrame:
    """``query_id, intent, subtype`` from ``words, person, place, confidence, near, second, exact, hits, quality``.

    ``near`` and ``second`` are the similarities of the two nearest clusters, null without a query vector. Short
    queries that name an entity come first; the rest is decided by confidence and clusters, then refined by topics.
    """
    c, s1, gap = F.col("confidence"), F.col("near"), F.col("near") - F.col("second")
    made = lambda kind, sub: F.struct(F.lit(kind).alias("intent"), F.lit(sub).alias("subtype"))
    short, vector = F.col("words") <= 2, s1.isNotNull()
    first = (
        F.when(short & F.col("person"), made("entity", "person")).when(short & F.col("place"), made("entity", "place"))
        .when(vector & (c >= 0.70), made("keyword", "bm25")).when(vector & (s1 > 0.55) & (gap > 0.07) & (c < 0.60), made("conceptual", "cluster"))
        .when(vector & (s1 > 0.38) & (F.col("words") >= 2) & (c < 0.55), made("situational", "topical")).when(vector & (c >= 0.40), made("mixed", "hybrid"))
        .when(vector & ((s1 > 0.28) | (c < 0.30)), made("conceptual", "embedding"))
        .when(c >= 0.60, made("keyword", "bm25")).when(c >= 0.30, made("mixed", "hybrid")).otherwise(made("conceptual", "embedding"))
    )
    rows = f.withColumn("x", first)
    open_ = F.col("x.intent").isin("keyword", "mixed")
    refined = F.when(F.col("exact") & short & open_, made("conceptual", "topic-exact")).when((F.col("hits") > 0) & (F.col("words") <= 3) & (F.col("quality") < 0.6) & open_, made("situational", "topic-probe")).otherwise(F.col("x"))
    return rows.select("query_id", refined.alias("x")).select("query_id", "x.intent", "x.subtype")


# The walk of each intent: damping, hops, rounds, seeds, most influence, neighbours, references, edges of topics with an exact topic, with topics, without.
PROFILES = [
    ("phrase", 0.72, 1, 3, 5, 0.06, 8, 4, 0, 0, 0),
    ("keyword", 0.76, 1, 3, 6, 0.07, 8, 5, 2, 0, 0),
    ("mixed", 0.80, 2, 4, 7, 0.09, 10, 6, 2, 2, 0),
    ("situational", 0.83, 2, 4, 8, 0.12, 10, 6, 4, 4, 0),
    ("conceptual", 0.84, 2, 5, 8, 0.14, 12, 6, 4, 4, 2),
    ("entity", 0.78, 1, 3, 5, 0.07, 8, 4, 0, 0, 0),
]


def walk_profiles(found: DataFrame, topical: DataFrame) -> DataFrame:
    """``query_id, intent, damping, hops, rounds, seeds, influence, neighbours, references, topic_edges`` of each query; an unknown intent walks like ``mixed``.

    ``found(query_id, intent)``, ``topical(query_id, exact, hits)``. References are not walked.
    """
    names = "name, damping, hops, rounds, seeds, influence, neighbours, references, with_exact, with_topics, without".split(", ")
    kinds = ["string", "double", "int", "int", "int", "double", *["int"] * 5]
    profiles = F.array(*[F.struct(*[F.lit(x).cast(k).alias(n) for x, n, k in zip(p, names, kinds, strict=True)]) for p in PROFILES])
    rows = found.where("intent <> 'reference'").join(topical, "query_id", "left")
    own = F.filter(profiles, lambda p: p["name"] == F.col("intent"))
    rows = rows.withColumn("p", F.coalesce(F.get(own, F.lit(0)), F.get(F.filter(profiles, lambda p: p["name"] == "mixed"), F.lit(0))))
    edges = F.when(F.coalesce("exact", F.lit(False)), F.col("p.with_exact")).when(F.coalesce("hits", F.lit(0)) > 0, F.col("p.with_topics")).otherwise(F.col("p.without"))
    return rows.select("query_id", "intent", *[f"p.{n}" for n in names[1:8]], edges.alias("topic_edges"))


def context_boost(results: DataFrame, context: DataFrame, volume: DataFrame, topics: DataFrame) -> DataFrame:
    """Results with ``score`` raised by 0.05 in the volume of the query's context item and by 0.08 for each topic shared with it.

    ``results(query_id, id, score)``, ``context(query_id, item)``, ``volume(id, v)``, ``topics(id, topics)``.
    """
    rows = results.join(context, "query_id", "left")
    rows = rows.join(volume, "id", "left").join(volume.select(F.col("id").alias("item"), F.col("v").alias("cv")), "item", "left")
    rows = rows.join(topics, "id", "left").join(topics.select(F.col("id").alias("item"), F.col("topics").alias("ct")), "item", "left")
    shared = F.coalesce(F.size(F.array_intersect("topics", "ct")), F.lit(0))
    shared = F.when(F.col("topics").isNull() | F.col("ct").isNull(), 0).otherwise(shared)
    return rows.select("query_id", "id", F.round(F.col("score") + F.when(F.col("v") == F.col("cv"), 0.05).otherwise(0.0) + 0.08 * shared, 4).alias("score"))


def dwell_boost(results: DataFrame, dwell: DataFrame, most: int = 500) -> DataFrame:
    """Results with ``score`` raised by up to 0.15 for the items that are dwelt on longest. ``dwell(id, total)``."""
    top = dwell.orderBy(F.desc("total"), "id").limit(most)
    peak = top.agg(F.max("total").alias("peak"))
    share = top.join(F.broadcast(peak)).select("id", (F.col("total") / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1)).alias("share"))
    return results.join(share, "id", "left").select("query_id", "id", F.round(F.col("score") + 0.15 * F.coalesce("share", F.lit(0.0)), 6).alias("score"))


def walk_injection(results: DataFrame, walks: DataFrame, seeds: int = 3, new: int = 5) -> DataFrame:
    """``query_id, id, score, source``: results raised by a tenth of the walks from the first ones, and the best five that these reach besides.

    ``results(query_id, id, score, rank)``, ``walks(src, dst, walk)``.
    """
    reach = results.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("src")).join(walks, "src").groupBy("query_id", F.col("dst").alias("id")).agg(F.sum("walk").alias("sum"), F.max("walk").alias("most"))
    rows = results.select("query_id", "id", "score").join(reach, ["query_id", "id"], "full")
    fresh = rows.where("score IS NULL").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("most"), "id"))).where(F.col("n") <= new)
    old = rows.where("score IS NOT NULL").select("query_id", "id", F.round(F.col("score") + 0.1 * F.coalesce("sum", F.lit(0.0)), 8).alias("score"), F.lit("result").alias("source"))
    return old.union(fresh.select("query_id", "id", F.round(0.08 * F.col("most"), 8), F.lit("walk")))


def structure_prior(rows: DataFrame) -> DataFrame:
    """Adds ``prior``: a weak share of rank, agreement of sources, topic, walk and shape, for vague intents only.

    Rows have ``intent, words, quality, direct, pagerank, p95, sources, topical, walk, shape``.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    vague = F.col("intent").isin("conceptual", "situational") | ((F.col("intent") == "mixed") & (F.col("words") <= 2))
    used = vague & ~((F.col("words") >= 4) & (F.col("quality") >= 0.45)) & ~F.col("direct")
    rank = unit(F.col("pagerank") / F.greatest(F.col("p95"), F.lit(1e-9)))
    blend = 0.45 * rank + 0.20 * unit((F.col("sources") - 1) / 3.0) + 0.15 * unit(F.col("topical")) + 0.12 * unit(F.col("walk")) + 0.08 * unit(F.col("shape"))
    most = F.when(F.col("intent") == "conceptual", 0.07).otherwise(0.05)
    return rows.withColumn("prior", F.when(used, F.round(F.least(most, blend * most), 6)).otherwise(0.0))


def daily_pick(history: DataFrame, member: DataFrame, day: Column, now: Column, recent: int = 30, pool: int = 50) -> DataFrame:
    """``session, day, g, item``: an unread item of the group that a session read most of late; the day picks it.

    ``history(session, item, ts)``, ``member(item, g, distance)``; what was read in the last day before ``now`` is left out.
    ``day`` is a number of the date, ``now`` a timestamp; both columns of ``history``.
    """
    one = W.partitionBy("session")
    last = history.withColumn("n", F.row_number().over(one.orderBy(F.desc("ts"), "item"))).where(F.col("n") <= recent)
    top = last.join(member.select("item", "g"), "item").groupBy("session", "g").agg(F.count("*").alias("c"), F.max(day).alias("day"))
    top = top.withColumn("r", F.row_number().over(one.orderBy(F.desc("c"), "g"))).where("r = 1").select("session", "g", "day")
    fresh = history.where(F.col("ts") > now - F.expr("INTERVAL 1 DAY")).select("session", "item").distinct()
    rows = top.join(member, "g").join(fresh, ["session", "item"], "left_anti")
    rows = rows.withColumn("i", F.row_number().over(one.orderBy("distance", "item")) - 1).where(F.col("i") < pool).withColumn("n", F.count("*").over(one))
    return rows.where(F.col("i") == F.col("day") % F.col("n")).select("session", "day", "g", "item")


def entropy_trade(sims: DataFrame) -> DataFrame:
    """``query_id, entropy, trade``: how evenly similarity is spread over a query's candidates, and what relevance weighs against variety then."""
    pos = sims.where("similarity > 0").withColumn("p", F.col("similarity") / F.sum("similarity").over(W.partitionBy("query_id")))
    h = pos.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("p") > 1e-12, -F.col("p") * F.log("p")).otherwise(0.0)).alias("h"))
    rows = sims.select("query_id").distinct().join(h, "query_id", "left")
    trade = F.when(F.coalesce("n", F.lit(0)) >= 2, 0.5 + 0.4 / (1.0 + F.exp(2.0 * (F.col("h") - 3.0)))).otherwise(0.9)
    return rows.select("query_id", F.round(F.coalesce("h", F.lit(0.0)), 6).alias("entropy"), F.round(trade, 6).alias("trade"))


def recency_centroid(history: DataFrame, vectors: DataFrame, alpha: float = 0.4) -> DataFrame:
    """``session, centroid``: the mean of the vectors of a session's last items, each step back weighing 1 - alpha of the one before; of length 1.

    ``history(session, item, rank)`` with rank 1 the latest, ``vectors(id, v)``.
    """
    rows = history.join(vectors.select(F.col("id").alias("item"), "v"), "item").select("session", F.pow(F.lit(1 - alpha), F.col("rank") - 1).alias("w"), F.posexplode("v").alias("i", "x"))
    sums = rows.groupBy("session", "i").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("session")))
    sums = sums.withColumn("x", F.when(norm > 0, F.col("x") / norm).otherwise(F.col("x")))
    return sums.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_concepts(queries: DataFrame, concepts: DataFrame, k: int = 3, least: float = 0.4) -> DataFrame:
    """``query_id, concept, similarity, rank``: the concepts most like a query's vector. ``concepts(concept, centroid)``, some hundreds."""
    rows = queries.select("query_id", "v").join(small(concepts, 5_000)).select("query_id", "concept", F.round(cosine(F.col("v"), F.col("centroid")), 6).alias("similarity")).where(F.col("similarity") > least)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "concept"))).where(F.col("rank") <= k)


def seed_projection(seeds: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query_id, v``: a query's place among other vectors of the same items: the mean of its seeds', by similarity, of length 1.

    ``seeds(query_id, id, similarity)``, ``vectors(id, v)``, for instance the spectral ones.
    """
    rows = seeds.where("similarity > 0").join(vectors, "id").select("query_id", "similarity", F.posexplode("v").alias("i", "x"))
    sums = rows.groupBy("query_id", "i").agg((F.sum(F.col("similarity") * F.col("x").cast("double")) / F.sum("similarity")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("query_id")))
    sums = sums.withColumn("x", F.when(norm > 0, F.col("x") / norm).otherwise(0.0))
    return sums.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def company_boost(results: DataFrame, vectors: DataFrame, first: int = 5) -> DataFrame:
    """Results with ``score`` raised by a tenth of their likeness to the mean of the first ones' vectors. ``results(query_id, id, score, rank)``."""
    own = results.where(F.col("rank") <= first).join(vectors, "id").select("query_id", F.posexplode("v").alias("i", "x"))
    mean = own.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    rows = results.join(vectors, "id", "left").join(mean, "query_id", "left")
    like = F.when(F.col("v").isNotNull() & F.col("mean").isNotNull(), cosine(F.col("v"), F.col("mean"))).otherwise(0.0)
    return rows.select("query_id", "id", F.round(F.col("score") + 0.1 * like, 6).alias("score"))


def within_quota(rows: DataFrame, group: str, each: int, limit: int) -> DataFrame:
    """``rows`` with ``place``: at most ``each`` of a group and ``limit`` of a query, in the order of ``rank``."""
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id", group).orderBy("rank"))).where(F.col("_n") <= each).drop("_n")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= limit)


def summary_lane(hits: DataFrame, members: DataFrame, k: int = 15, each: int = 5) -> DataFrame:
    """``query_id, id, rank``: the first five members of the fifteen best chapters of a search of summaries.

    ``hits(query_id, chapter, rank)``, ``members(chapter, id)``.
    """
    first = members.withColumn("n", F.row_number().over(W.partitionBy("chapter").orderBy("id"))).where(F.col("n") <= each)
    rows = hits.where(F.col("rank") <= k).withColumnRenamed("rank", "by").join(first, "chapter")
    return rows.select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy("by", "n")).alias("rank"))
