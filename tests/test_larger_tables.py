"""Results that differed from their SQL, or plans that grew faster than their input, on tables larger than the smallest."""

import duckdb
from test_queries import plain

from quillspark.plans import all_queries, all_sql

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL over small tables of one's own, both sorted."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = all_queries()[name](spark, str(folder)).toPandas()
    wanted = con.sql(all_sql()[name]).df()
    assert plain(found) == plain(wanted)
    return found


def test_a_word_that_names_a_language_is_looked_for_in_the_text(spark, tmp_path):
    docs = [(1, "mar de sal alta luz", "es", "src1", 19), (2, "one two three four five", "de", "src2", 23), (3, "sal de mar luz alta", "de", "src1", 19)]
    asked = [(i, t) for i in range(10) for t in ["de mar sal luz alta"]]
    found = same_as_sql(spark, tmp_path, "match_search", documents=(docs, DOCUMENTS), benchmark=(asked, "item_id long, text string"))
    assert found.set_index("query_id").loc[1, "n_docs"] == 2


def test_walks_over_the_bridge_in_slices_are_those_over_all_edges(spark):
    from quillspark.operators import graphs as G

    rows = [(i, f"t{(i * i + 3 * j) % 11}") for i in range(1, 25) for j in range(2)] + [(1, "t0"), (1, "t0"), (99, "alone")]
    bridge = spark.createDataFrame(rows, "item long, topic string")
    wanted = G.random_walk_with_restart(G.shared_edges(bridge), bridge.select("item").distinct(), rounds=4).collect()
    found = G.bridge_walk_with_restart(bridge, rounds=4, pairs=40).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, wanted)) and found


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_searches_of_the_document_pass_shuffle_no_hits(spark):
    from quillspark.operators import fts, termstats

    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alphabet soup beta"), (3, "betamax gamma"), (3, "alpha alpha"), (4, None)], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "alpha beta"), (2, "gam"), (3, "al be ga")], "item_id long, text string")
    i, terms = fts.build(docs), fts.query_terms(ask)
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    every, some = fts.prefixes(i, terms), fts.prefixes(i, terms, False)
    assert rows(every) == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (2, 1, 1), (2, 3, 1), (3, 1, 3), (3, 3, 3)]
    assert rows(some) == sorted([*rows(every), (3, 2, 2)])
    assert rows(fts.all_terms(i, terms)) == [(1, 1, 2)]
    assert rows(i.posts.where("doc_id = 3").select("term", "tf", "places", "len")) == [("alpha", 2, [1, 2], 4), ("betamax", 1, [1], 4), ("gamma", 1, [2], 4)]
    once = fts.build(docs.where("doc_id <> 3"))  # rows that share an id are put together, which is a shuffle
    for frame in (fts.prefixes(once, terms), fts.prefixes(once, terms, False), fts.all_terms(once, terms), termstats.tf_idf(once, 1)):
        assert "Exchange hashpartitioning" not in _plan(frame)
    pairs = spark.createDataFrame([("alpha", "gamma"), ("alpha", "beta"), ("beta", "soup")], "a string, b string")
    assert rows(termstats.together(i, pairs, 2)) == [("alpha", "beta", 1), ("alpha", "gamma", 2), ("beta", "soup", 1)]


def test_a_spread_of_counts_is_that_of_the_pairs_and_hashing_hands_on_few_rows(spark):
    import numpy as np

    from quillspark.operators import vectors as V

    r = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, [float(x) for x in r.normal(size=6)]) for i in range(200)], "id long, v array<float>")
    asked = vectors.where("id % 20 = 0").selectExpr("id AS query_id", "v")
    pairs = V.top_similar(asked, vectors, 1_000)
    counted = V.similarity_counts(asked, vectors, rows=64)
    assert V.counted_spread(counted).first() == V.spread(pairs, "similarity").first()
    assert counted.agg({"n": "sum"}).first()[0] == 10 * 199
    near = V.hashed_neighbours(vectors, asked, 5, width=8.0)
    assert near.count() == 50 and "Generate" not in _plan(near).split("MapInArrow")[0]
