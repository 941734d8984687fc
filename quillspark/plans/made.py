"""Queries of sinks, validation, ranges, entity search, concepts, cleaning of feedback and generated benchmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..catalog import table
from ..functions.numeric import mulberry
from ..lineage import keep, shared_dir
from ..operators import entities as N, events as E, fts, learning as L, relational as R, vectors as V
from ..sources import sinks
from . import search as S
from .lanes import TOPICS, members, topics
from .more import MEN, groups, mentions
from .reading import EV, events, now
from .registry import register
from .texts import fragments
from .vector import KNN, knn, stated, vecs


@F.pandas_udf(BinaryType())
def _blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.asarray(x, "<f4").tobytes())


register("decoded_vectors", lambda s, d: vecs(s, d).select("id", sinks.decoded(_blob(F.col("v"))).alias("v")).select("id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("sum")), "SELECT vec_id AS id, len(embedding)::INT AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS sum FROM embeddings")


def bundled(s, d):
    """The index, the parts of the star and the neighbour graph as one bundle."""
    i = S.index(s, d)
    return sinks.bundle(s, {"vocab": i.vocab, "nations": table(s, d, "nation"), "members": members(s, d), "neighbours": knn(s, d, 5)}, f"{shared_dir(s)}/bundle")


register("bundle", bundled, f"WITH {TOPICS}, {S.POSTS}, {KNN} SELECT 'vocab' AS \"table\", count(DISTINCT term) AS n_rows, 3 AS n_columns FROM posts UNION ALL SELECT 'nations', count(*), 3 FROM nation UNION ALL SELECT 'members', count(*), 2 FROM mb UNION ALL SELECT 'neighbours', count(*), 4 FROM knn WHERE rank <= 5")


def _sizes(texts: list[str]) -> np.ndarray:
    """An encoder that stands for a model: characters, words, and digits of a text."""
    return np.array([[len(t), len(t.split()), sum("0" <= c <= "9" for c in t)] for t in texts], float)


def embedded(s, d):
    rest = sinks.missing(table(s, d, "documents").select("doc_id", "text"), table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return sinks.encoded(rest, "doc_id", "text", _sizes).select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("chars"), F.get("embedding", F.lit(2)).cast("long").alias("digits"))


register("embed_missing", embedded, "SELECT doc_id, len(coalesce(text, ''))::BIGINT AS chars, len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::BIGINT AS digits FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")


def validated(s, d):
    """Extracted entities made of orders, some of them of no known type, without a name, or with verses out of bounds."""
    o = table(s, d, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("person", "place", "group", "thing")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("name"), kind.alias("type"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat(kind, F.lit(":"))).otherwise(F.lit("Old:")), F.lit("Name "), F.col("o_orderpriority"), F.lit("!")).alias("uid"),
                    F.array((F.col("o_orderkey") % 40).cast("string"), F.lit("0"), F.lit("x"), F.lit("12")).alias("verses"), F.lit(30).alias("most"))
    return N.validated(rows).select("key", "name", "type", "uid", F.array_join(F.transform("verses", lambda v: v.cast("string")), ",").alias("verses"))


register("validated_entities", validated, r"""WITH r AS (SELECT o_orderkey AS key, trim(o_orderpriority) AS name, ['person', 'place', 'group', 'thing'][o_orderkey % 4 + 1] AS type, lower(o_orderpriority) AS p, o_orderkey % 40 AS v FROM orders WHERE o_orderkey % 9 > 0)
    SELECT key, name, type, type || ':' || regexp_replace(regexp_replace('name ' || p, '\s+', '_', 'g'), '[^a-z0-9_:]', '', 'g') AS uid, CASE WHEN v BETWEEN 1 AND 30 THEN v || ',12' ELSE '12' END AS verses FROM r WHERE type <> 'thing'""")


def lookups(s, d):
    """A title that exists, one that only parts of titles match, one known by another name, one that is nowhere."""
    n = table(s, d, "nation")
    alias = n.select("n_nationkey", F.concat(F.lit("LAND "), F.col("n_nationkey")).alias("alias"))
    asked = {"exact": "Nation_7", "part": "ation_2", "alias": "land 11", "none": "atlantis"}
    out = None
    for name, wanted in asked.items():
        hits = R.lookup_any(n, alias, "n_nationkey", "n_name", "alias", wanted).select(F.lit(name).alias("asked"), "n_nationkey", F.col("match").cast("long").alias("match"))
        out = hits if out is None else out.unionByName(hits)
    return out


register("ref_lookup", lookups, """WITH a(asked, w) AS (VALUES ('exact', 'nation_7'), ('part', 'ation_2'), ('alias', 'land 11'), ('none', 'atlantis')),
    h AS (SELECT asked, n_nationkey, CASE WHEN lower(n_name) = w THEN 0 WHEN contains(lower(n_name), w) THEN 1 WHEN lower('LAND ' || n_nationkey) = w THEN 2 END::BIGINT AS match FROM a, nation) SELECT * FROM h WHERE match IS NOT NULL QUALIFY match = min(match) OVER (PARTITION BY asked)""")


def calendar_rows(s, d):
    """Volumes and titles made of parts, with the group of their year's reading, and how a version is cited."""
    p = table(s, d, "part")
    title = F.element_at(F.array(*[F.lit(x) for x in ("Moses", "The Articles of Faith", "Joseph Smith-History", "JS-M 1", "Genesis")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = p.select("p_partkey", (F.col("p_size") % 4 + 1).cast("int").alias("volume"), title.alias("book"), (F.col("p_partkey") % 9 + 2022).cast("int").alias("year"), F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("xx")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("lang"), F.when(F.col("p_partkey") % 2 == 0, "de").alias("second"))
    return rows.select("p_partkey", R.reading_group(F.col("year")).alias("g"), R.in_group(F.col("volume"), F.col("book"), R.reading_group(F.col("year"))).alias("read"), R.citation(F.col("lang"), F.col("volume"), F.col("second")).alias("cited"))


register("calendar_groups", calendar_rows, """WITH r AS (SELECT p_partkey, p_size % 4 + 1 AS v, ['Moses', 'The Articles of Faith', 'Joseph Smith-History', 'JS-M 1', 'Genesis'][p_partkey % 5 + 1] AS b, ['ot', 'nt', 'bom', 'dc'][((p_partkey % 9 + 2022 - 2026) % 4 + 4) % 4 + 1] AS g, ['en', 'fr', 'xx'][p_partkey % 3 + 1] AS l, CASE WHEN p_partkey % 2 = 0 THEN 'de' END AS s FROM part)
    SELECT p_partkey, g, CASE g WHEN 'ot' THEN v = 1 OR b = 'Moses' WHEN 'nt' THEN v = 2 OR b = 'JS-M 1' WHEN 'bom' THEN v = 3 ELSE v = 4 OR b IN ('The Articles of Faith', 'Joseph Smith-History') END AS read,
      CASE WHEN s IS NOT NULL AND v >= 3 THEN CASE l WHEN 'fr' THEN 'French' ELSE 'English' END || ' vs German' WHEN s IS NOT NULL THEN CASE l WHEN 'en' THEN 'KJV' WHEN 'fr' THEN 'LSG' ELSE 'XX' END || ' vs LUT' WHEN v >= 3 THEN CASE v WHEN 3 THEN 'BoM' ELSE 'D&C' END || ', ' || CASE l WHEN 'fr' THEN 'French' ELSE 'English' END
        ELSE CASE l WHEN 'en' THEN 'KJV' WHEN 'fr' THEN 'LSG' ELSE 'XX' END END AS cited FROM r""")


def ranged(s, d):
    """Whether an order's customer lies in the range of customers that its priority covers; half where it has none."""
    o = table(s, d, "orders")
    spans = o.where("o_orderpriority <> '3-MEDIUM'").groupBy("o_orderpriority").agg(F.min("o_custkey").alias("low"), (F.max("o_custkey") / 2).cast("long").alias("high"))
    return R.in_range(o.select("o_orderkey", "o_orderpriority", "o_custkey"), spans, "o_orderpriority", "o_custkey").select("o_orderkey", "share")


register("range_share", ranged, "WITH s AS (SELECT o_orderpriority, min(o_custkey) AS low, floor(max(o_custkey) / 2)::BIGINT AS high FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1) SELECT o_orderkey, CASE WHEN low IS NULL THEN 0.5 WHEN o_custkey BETWEEN low AND high THEN 1.0 ELSE 0.0 END::DOUBLE AS share FROM orders LEFT JOIN s USING (o_orderpriority)")
register("nearest_mention", lambda s, d: N.nearest(table(s, d, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("at")), table(s, d, "lineitem").where("l_discount >= 0.09").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("at"))).select("chapter", "at", "away"), "SELECT DISTINCT a.l_orderkey AS chapter, a.l_linenumber AS at, (SELECT min(abs(b.l_linenumber - a.l_linenumber)) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_discount >= 0.09) AS away FROM lineitem a".replace(" AS at,", ' AS "at",'))
register("skip_pairs", lambda s, d: E.near_pairs(events(s, d), "user_id", "item", 2), f"""WITH {EV}, p AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e) SELECT a.item AS a, b.item AS b, count(*) AS n FROM p a JOIN p b ON a.user_id = b.user_id AND abs(a.i - b.i) BETWEEN 1 AND 2 WHERE a.item <> b.item GROUP BY ALL""")
register("coordinate_overlay", lambda s, d: R.overlay(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("text")), table(s, d, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linestatus").alias("text")), ["l_orderkey", "l_linenumber", "l_partkey"], "text").select("l_orderkey", "l_linenumber", "text", "from_overlay"),
    "WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_linestatus) AS t FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) SELECT l_orderkey, l_linenumber, coalesce(t, l_returnflag) AS text, t IS NOT NULL AS from_overlay FROM lineitem LEFT JOIN o USING (l_orderkey, l_linenumber, l_partkey)")
register("similarity_spread", lambda s, d: V.counted_spread(V.similarity_counts(stated(s, d), vecs(s, d))), f"WITH {KNN.replace('rank <= 20', 'true')} SELECT count(*) AS n, round(min(similarity), 6) AS least, round(quantile_cont(similarity, 0.05), 6) AS p5, round(quantile_cont(similarity, 0.25), 6) AS p25, round(median(similarity), 6) AS p50, round(quantile_cont(similarity, 0.75), 6) AS p75, round(quantile_cont(similarity, 0.95), 6) AS p95, round(max(similarity), 6) AS most FROM knn WHERE query_id % 20 = 0")
register("explained_variance", lambda s, d: V.explained(vecs(s, d)))
register("spectral", lambda s, d: V.spectral(_edges(s, d), 8))


def _edges(s, d):
    from .vector import edges

    return edges(s, d)


def found_entities(s, d):
    """Names asked for, some with a note or as a part, resolved by the item at hand, else by name, with a page of items by volume."""
    m = keep(mentions(s, d), "mentions")
    q = table(s, d, "region").select(F.col("r_regionkey").alias("query_id"), F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT (old)", "f", "5-low", "3-med", "nobody")]), (F.col("r_regionkey") % 5 + 1).cast("int")).alias("name"))
    return N.search(q, m, groups(s, d))


register("entity_search", found_entities, f"""WITH {MEN}, q AS (SELECT r_regionkey AS query_id, ['1-urgent', 'f', '5-low', '3-med', 'nobody'][r_regionkey % 5 + 1] AS n FROM region), nm AS (SELECT name, count(*) AS n_items FROM men GROUP BY name),
    k AS (SELECT query_id, name, CASE WHEN name = n THEN 0 WHEN starts_with(name, n) THEN 1 WHEN contains(name, n) THEN 2 END AS stage, n_items FROM q, nm), r AS (SELECT * FROM k WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY stage, n_items DESC, name) = 1),
    p AS (SELECT query_id, r.name, stage, n_items, item FROM r JOIN men USING (name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY item) <= 10)
    SELECT query_id, p.name, stage, n_items, c_mktsegment AS volume, count(*) AS n, min(item) AS first_item FROM p JOIN orders ON o_orderkey = item JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")


def concept_list(s, d):
    """Phrases of topics, entities, summaries' topics and synonyms; each from the first of these that has it."""
    lists = {"topic": topics(s, d).select(F.col("name").alias("phrase")), "entity": mentions(s, d).select(F.col("name").alias("phrase")), "summary": table(s, d, "part").select(F.lower("p_type").alias("phrase")), "synonym": table(s, d, "part").select(F.split("p_name", " ")[0].alias("phrase"))}
    return N.concepts(lists)


register("concepts", concept_list, f"WITH {MEN}, u AS (SELECT lower(trim(p_name)) AS phrase, 0 AS p, 'topic' AS source FROM part UNION ALL SELECT name, 1, 'entity' FROM men UNION ALL SELECT lower(p_type), 2, 'summary' FROM part UNION ALL SELECT string_split(lower(p_name), ' ')[1], 3, 'synonym' FROM part) SELECT DISTINCT phrase, source FROM u WHERE len(phrase) > 1 QUALIFY p = min(p) OVER (PARTITION BY phrase)")


def cleaned(s, d):
    e = events(s, d).select("event_id", "event_type", "ts", "value", F.col("item").alias("rank"))
    return L.cleaned(e.join(F.broadcast(now(events(s, d)))), "event_type", "value").select("event_id", "event_type", "rank", "weight")


register("feedback_cleaned", cleaned, f"""WITH {EV}, w AS (SELECT * FROM e WHERE ms >= (SELECT max(ms) FROM e) - 604800000 AND item BETWEEN 0 AND 49 ORDER BY ms, event_id LIMIT 1000),
    a AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN CURRENT ROW AND 90000 FOLLOWING) AS ahead FROM w), b AS (SELECT *, max(ahead) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 90000 PRECEDING AND CURRENT ROW) > 12 AS burst FROM a),
    z AS (SELECT *, abs(value - avg(value) OVER x) / stddev_pop(value) OVER x AS z FROM b WHERE NOT burst WINDOW x AS (PARTITION BY event_type)) SELECT event_id, event_type, item AS rank, round(sqrt(item + 1), 6) AS weight FROM z WHERE z <= 2.5""")


def silver(s, d):
    """Benchmark items: topics as keywords and as questions, and sentences of documents as paraphrases."""
    m = members(s, d)
    few = m.groupBy("slug").agg(F.count("*").alias("c")).where("c BETWEEN 3 AND 1000")
    first = m.join(few, "slug").withColumn("r", F.row_number().over(W.partitionBy("slug").orderBy("item"))).where("r <= 5").groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("expected"))
    t = topics(s, d).join(first, "slug")
    keyword = t.select(F.concat(F.lit("tg-"), F.col("slug")).alias("id"), F.lit("topical").alias("category"), F.lower("name").alias("query"), "expected", F.lit(10).alias("threshold"))
    question = t.where(F.contains("name", F.lit(" "))).select(F.concat(F.lit("tg-q-"), F.col("slug")), F.lit("topical"), F.concat(F.lit("what is said about "), F.lower("name")), "expected", F.lit(10))
    from ..functions.text import sentences

    told = S.docs(s, d).select("doc_id", F.get(sentences(F.regexp_replace("text", "\n+", " ")), F.lit(0)).alias("q")).where("q IS NOT NULL")
    told = told.select(F.concat(F.lit("summ-"), F.col("doc_id")), F.lit("paraphrase"), F.lower(F.regexp_replace(F.regexp_replace("q", "^(It |He |She )", ""), r"\.$", "")).alias("q"), F.col("doc_id").cast("string"), F.lit(5)).where(F.length("q") >= 40)
    return keyword.union(question).union(told)


register("silver_benchmark", silver, rf"""WITH {TOPICS}, f AS (SELECT slug FROM mb GROUP BY slug HAVING count(*) BETWEEN 3 AND 1000), x AS (SELECT slug, array_to_string(list_sort(list(item::VARCHAR)), ',') AS expected FROM (SELECT * FROM mb JOIN f USING (slug) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY item) <= 5) GROUP BY slug),
    s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\n+', ' ', 'g'), '[.!?]\s+'), lambda x: trim(x))[2:], lambda x: len(x) BETWEEN 50 AND 180)[1] AS q FROM documents WHERE text IS NOT NULL)
    SELECT 'tg-' || slug AS id, 'topical' AS category, name AS query, expected, 10 AS threshold FROM tp JOIN x USING (slug) UNION ALL SELECT 'tg-q-' || slug, 'topical', 'what is said about ' || name, expected, 10 FROM tp JOIN x USING (slug) WHERE contains(name, ' ')
    UNION ALL SELECT 'summ-' || doc_id, 'paraphrase', q2, doc_id::VARCHAR, 5 FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(q, '^(It |He |She )', ''), '\.$', '')) AS q2 FROM s WHERE q IS NOT NULL) WHERE len(q2) >= 40""")


def snapshot(s, d):
    """The first ten results of 24 fragment queries, drawn by a generator of fixed seed among texts of middling length."""
    drawn = S.docs(s, d).where(F.length("text").between(50, 2_800)).select("doc_id", mulberry(F.col("doc_id") + 20_260_404).alias("u")).orderBy("u", "doc_id").limit(24)
    q = fragments(s, d, F.broadcast(drawn)).select(F.col("doc_id").alias("item_id"), F.col("query").alias("text"))
    return fts.bm25(S.index(s, d), fts.query_terms(q))


MULBERRY = """m1 AS (SELECT doc_id, (doc_id + 20260404 + 1831565813) % 4294967296 AS a FROM documents WHERE len(text) BETWEEN 50 AND 2800), m2 AS (SELECT doc_id, ((xor(a, a // 32768)::HUGEINT * (a | 1)) % 4294967296)::BIGINT AS t FROM m1),
    m3 AS (SELECT doc_id, xor(((t + (xor(t, t // 128)::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT, t) AS t FROM m2), dr AS (SELECT doc_id, xor(t, t // 16384) / 4294967296.0::DOUBLE AS u FROM m3 ORDER BY u, doc_id LIMIT 24)"""
FRAGMENTS = r"""fw AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s'']', ' ', 'g'), '\s+'), lambda x: x <> '') AS w, (doc_id + 20260404) * 16807 % 2147483647 AS seed FROM documents),
    fc AS (SELECT doc_id, seed, CASE WHEN len(list_filter(w, lambda x: len(x) >= 4)) >= 4 THEN list_filter(w, lambda x: len(x) >= 4) ELSE list_filter(w, lambda x: len(x) >= 3) END AS s FROM fw),
    fa AS (SELECT *, greatest(3, least(len(s), 4 + seed % 4)) AS width FROM fc), fq AS (SELECT doc_id AS item_id, array_to_string(s[(seed // 4) % (greatest(len(s) - width, 0) + 1) + 1:(seed // 4) % (greatest(len(s) - width, 0) + 1) + width], ' ') AS text FROM fa WHERE len(s) > 0 AND doc_id IN (SELECT doc_id FROM dr))"""
register("baseline_snapshot", snapshot, f"WITH {S.POSTS}, {S.TF}, {S.VOCAB}, {MULBERRY}, {FRAGMENTS}, {S.QUERY.replace('FROM benchmark', 'FROM fq')}, {S.BM25} SELECT * FROM best")
register("impression_log", lambda s, d: sinks.impressions(S.bm25_topk(s, d).select("query_id", F.col("doc_id").alias("id"), "rank"), table(s, d, "events").where("event_type = 'click'").select((F.col("event_id") % 40).alias("query_id"), F.get_json_object("props", "$.k").cast("long").alias("id"))),
    f"WITH {S.POSTS}, {S.TF}, {S.VOCAB}, {S.QUERY}, {S.BM25}, c AS (SELECT event_id % 40 AS query_id, (props->>'k')::BIGINT AS id FROM events WHERE event_type = 'click') SELECT query_id, doc_id AS id, rank - 1 AS rank, 0 AS clicked FROM best UNION ALL SELECT c.query_id, c.id, rank - 1, 1 FROM c LEFT JOIN best ON best.query_id = c.query_id AND doc_id = c.id")
register("retrain_triggers", lambda s, d: L.triggers(events(s, d).select("event_id", E.millis().alias("ms")), hour_ms=86_400_000), f"WITH {EV}, c AS (SELECT event_id, ms, row_number() OVER (PARTITION BY ms // 86400000 ORDER BY ms, event_id) AS n FROM e) SELECT event_id, ms, n FROM c WHERE n % 20 = 0")
register("sliding_triggers", lambda s, d: L.sliding_triggers(events(s, d).select("event_id", E.millis().alias("ms"))), f"""WITH {EV}, c AS (SELECT event_id, ms, count(*) OVER (ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY ms) + row_number() OVER (PARTITION BY ms ORDER BY event_id) AS n FROM e)
    SELECT event_id, ms, n FROM c WHERE n % 20 = 0""")
register("boosted_weights", lambda s, d: L.boosted_weights(events(s, d).select("event_type", F.col("item").alias("rank"))))
register("cursor_round_trip", lambda s, d: table(s, d, "orders").select("o_orderkey", R.cursor_of(F.concat_ws("|", "o_orderpriority", "o_orderstatus"), F.col("o_orderkey")).alias("c")).select("o_orderkey", "c", R.cursor_parts(F.col("c")).alias("p")).select("o_orderkey", "c", "p.k", "p.o"),
    """SELECT o_orderkey, rtrim(translate(to_base64(encode('{"k":"' || o_orderpriority || '|' || o_orderstatus || '","o":' || o_orderkey || '}')), '+/', '-_'), '=') AS c, o_orderpriority || '|' || o_orderstatus AS k, o_orderkey AS o FROM orders""")
