"""Queries of browsing, lookup, merging and checking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import optional_table, table
from ..functions import text as X
from ..lineage import small
from ..operators import relational as R
from .registry import register
from .search import POSTS, TF, VOCAB, index


def star(s, d):
    r, n, c, o = (table(s, d, t) for t in ("region", "nation", "customer", "orders"))
    dims = n.join(r, n.n_regionkey == r.r_regionkey)
    rows = o.join(c, o.o_custkey == c.c_custkey).join(small(dims), c.c_nationkey == n.n_nationkey)
    return rows.withColumn("title", F.format_string("%s %d:%d", "n_name", "c_custkey", "o_orderkey"))


STAR = "star AS (SELECT *, n_name || ' ' || c_custkey || ':' || o_orderkey AS title FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
register("star_view", lambda s, d: star(s, d).select("r_name", "n_name", "c_custkey", "o_orderkey", "title"), f"WITH {STAR} SELECT r_name, n_name, c_custkey, o_orderkey, title FROM star")
register(
    "browse_counts",
    lambda s, d: star(s, d).groupBy("r_name", "n_name").agg(F.count_distinct("c_custkey").alias("n_customers"), F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id")),
    f"WITH {STAR} SELECT r_name, n_name, count(DISTINCT c_custkey) AS n_customers, count(*) AS n_orders, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM star GROUP BY ALL",
)
register("like_scan", lambda s, d: table(s, d, "documents").where(R.holds_all([F.col("text"), F.col("source")], ["there", "src1", "ing"])).select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE " + " AND ".join(f"(contains(lower(text), '{w}') OR contains(lower(source), '{w}'))" for w in ("there", "src1", "ing")))
register("literal_priority", lambda s, d: R.literal_first(table(s, d, "documents"), "text", "public license", F.col("doc_id"), 50).select("doc_id", "priority"), "SELECT doc_id, CASE WHEN contains(lower(text), 'public license') THEN 0 ELSE 1 END AS priority FROM documents ORDER BY 2, 1 LIMIT 50")
register(
    "suggest_prefix",
    lambda s, d: R.suggest(index(s, d).vocab, table(s, d, "part").select(F.col("p_name").alias("title")), "th"),
    f"""WITH {POSTS}, {TF}, {VOCAB}, t AS (SELECT term AS suggestion, 'term' AS source, 0 AS p, row_number() OVER (ORDER BY df DESC, term) AS i FROM vocab WHERE starts_with(term, 'th') AND len(term) > 2 QUALIFY i <= 10),
    b AS (SELECT DISTINCT p_name AS x FROM part WHERE contains(lower(p_name), 'th')), u AS (SELECT * FROM t UNION ALL SELECT x, 'title', 1, i FROM (SELECT x, row_number() OVER (ORDER BY x) AS i FROM b) WHERE i <= 5),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY suggestion ORDER BY p, i) = 1) SELECT suggestion, source, row_number() OVER (ORDER BY p, i)::INT AS rank FROM f""",
)
register(
    "translation_overlay",
    lambda s, d: R.overlay(table(s, d, "documents").select("doc_id", "text"), table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), ["doc_id"], "text").select("doc_id", F.md5("text").alias("digest"), "from_overlay"),
    "SELECT d.doc_id, md5(coalesce(b.text, d.text)) AS digest, b.text IS NOT NULL AS from_overlay FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id",
)


def passages(s, d):
    """Sources as books, ids dealt to chapters and verses; references as people write them, every third with a verse."""
    texts = table(s, d, "documents").select("doc_id", F.col("source").alias("book"), (F.col("doc_id") % 12 + 1).alias("chapter"), (F.col("doc_id") % 7 + 1).alias("verse"))
    i = F.col("item_id")
    text = F.concat(F.lit(" SRC"), i % 5, F.lit(" "), i % 13 + 1, F.when(i % 3 == 0, F.concat(F.lit(":"), i % 7 + 1)).otherwise(""))
    return R.passages(texts, table(s, d, "benchmark").select(i.alias("query_id"), X.reference(text, {}).alias("ref")), "doc_id", 20, 1)


register(
    "passages",
    passages,
    """WITH q AS (SELECT item_id AS query_id, 'src' || item_id % 5 AS b, item_id % 13 + 1 AS c, CASE WHEN item_id % 3 = 0 THEN item_id % 7 + 1 END AS v FROM benchmark)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INT AS place, count(*) OVER (PARTITION BY query_id) AS n
    FROM q JOIN documents ON lower(source) = b AND doc_id % 12 + 1 = c AND (v IS NULL OR doc_id % 7 + 1 = v) QUALIFY place BETWEEN 2 AND 21""",
)
register("language_catalog", lambda s, d: optional_table(s, d, "translations", "doc_id long, lang string, text string").join(table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "right").select("lang", "n", F.col("text").isNull().alias("falls_back")).distinct(), "SELECT lang, count(*) AS n, true AS falls_back FROM documents GROUP BY lang")
register("anti_unread", lambda s, d: table(s, d, "part").select("p_partkey").join(table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"), "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
register("semi_topic", lambda s, d: table(s, d, "orders").select("o_orderkey").join(table(s, d, "lineitem").where(F.col("l_partkey").isin(1, 7, 42, 99)).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"), "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey IN (1, 7, 42, 99))")
register("adjacent", lambda s, d: R.adjacent(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
register("shared_topic_self_join", lambda s, d: R.sharing(table(s, d, "lineitem"), "l_suppkey", "l_orderkey"), "WITH b AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) SELECT *, row_number() OVER (PARTITION BY item ORDER BY shared DESC, other)::INT AS rank FROM (SELECT a.l_suppkey AS item, b.l_suppkey AS other, count(*) AS shared FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL) QUALIFY rank <= 8")
register("page_cursor", lambda s, d: R.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20, 40), """WITH p AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 40)
    SELECT o_orderkey, o_totalprice, count(*) OVER () > 20 AS more, CASE WHEN count(*) OVER () > 20 THEN rtrim(translate(to_base64(encode('{"o":60}')), '+/', '-_'), '=') END AS cursor FROM p QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 20""")
register("capped_count", lambda s, d: table(s, d, "lineitem").where("l_quantity > 10").limit(2000).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem WHERE l_quantity > 10 LIMIT 2000)")


def halves(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("X")).alias("o_orderstatus"), (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(0)).alias("o_totalprice"))
    return old, new


HALVES = "a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' END AS o_orderstatus, o_totalprice * CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"
register("upsert_replace", lambda s, d: R.upsert(*halves(s, d), ["o_orderkey"]), f"WITH {HALVES} SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
register("insert_ignore", lambda s, d: R.upsert(*halves(s, d), ["o_orderkey"], "ignore"), f"WITH {HALVES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
register("upsert_coalesce", lambda s, d: R.upsert(*halves(s, d), ["o_orderkey"], "fill"), f"WITH {HALVES} SELECT o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice FROM a FULL JOIN b USING (o_orderkey)")
register("upsert_max", lambda s, d: R.upsert(*halves(s, d), ["o_orderkey"], "max"), f"WITH {HALVES} SELECT o_orderkey, greatest(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, greatest(a.o_totalprice, b.o_totalprice) AS o_totalprice FROM a FULL JOIN b USING (o_orderkey)")
register("artifact_checks", lambda s, d: R.checks(s, {"documents": (table(s, d, "documents"), 100, "error"), "embeddings": (table(s, d, "embeddings"), 1_000_000, "warn"), "graph": (None, 1, "error")}), "SELECT 'documents' AS artifact, count(*) AS n_rows, 100 AS least, CASE WHEN count(*) >= 100 THEN 'ok' ELSE 'error' END AS status FROM documents UNION ALL SELECT 'embeddings', count(*), 1000000, CASE WHEN count(*) >= 1000000 THEN 'ok' ELSE 'warn' END FROM embeddings UNION ALL SELECT 'graph', NULL, 1, 'error'")
register("dimension_check", lambda s, d: table(s, d, "embeddings").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count("*").alias("n")), "SELECT min(len(embedding))::INT AS low, max(len(embedding))::INT AS high, count(*) AS n FROM embeddings")
register(
    "status_machine",
    lambda s, d: R.status_step(table(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "pending").otherwise("ai-ok").alias("status"), (F.col("doc_id") % 4).alias("attempts"), F.when(F.col("doc_id") % 3 > 0, F.col("quality")).alias("result")), "result").drop("result"),
    """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pending' ELSE 'ai-ok' END AS status, doc_id % 4 AS attempts, CASE WHEN doc_id % 3 > 0 THEN quality END AS result FROM labels),
    n AS (SELECT *, attempts + CASE WHEN status = 'pending' AND result IS NULL THEN 1 ELSE 0 END AS more FROM l)
    SELECT doc_id, more AS attempts, CASE WHEN status = 'pending' AND result IS NOT NULL THEN 'ai-ok' WHEN status = 'ai-ok' AND result = 1 THEN 'ai-verified' WHEN more >= 3 THEN 'failed' ELSE status END AS status FROM n""",
)


def popular_orders(s, d):
    """Every order, with whether it holds any of the hundred parts that are ordered most."""
    lines = table(s, d, "lineitem")
    top = lines.groupBy("l_partkey").count().orderBy(F.desc("count"), "l_partkey").limit(100)
    return R.any_overlap(lines, "l_orderkey", "l_partkey", top)


register("any_overlap", popular_orders, "WITH top AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY count(*) DESC, l_partkey LIMIT 100) SELECT l_orderkey, bool_or(l_partkey IN (SELECT l_partkey FROM top)) AS overlaps FROM lineitem GROUP BY l_orderkey")
