"""Operators on small cases with known results."""

from pyspark.sql import functions as F

from quillspark.functions import numeric as N, text as X
from quillspark.operators import events as E, fts, relational as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_numbers(spark):
    lit = lambda x: F.lit(float(x))
    r = one(spark, idf=N.idf(lit(1000), lit(30)), g=N.two_cell_g(lit(30), lit(10), lit(1000)), npmi=N.npmi(lit(20), lit(50), lit(40), lit(1000)), dice=X.dice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))), jac=X.jaccard(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))))
    assert [round(x, 6) for x in (r.idf, r.g, r.npmi, r.dice, r.jac)] == [4.474768, 26.323526, 0.588592, 0.666667, 0.5]


def test_references(spark):
    rows = spark.createDataFrame([(t,) for t in ("John 3:16", "1 ne 3 7", "Genesis 5", "hello", "", None)], "t string")
    found = [r.r and tuple(r.r) for r in rows.select(X.reference(F.col("t"), {"1 ne": "1 Nephi"}).alias("r")).collect()]
    assert found == [("John", 3, 16), ("1 Nephi", 3, 7), ("Genesis", 5, None), None, None, None]


def test_containment_ends_at_a_word(spark):
    r = one(spark, a=X.contains_to_word_end(F.lit("faithful heart"), F.lit("faith")), b=X.contains_to_word_end(F.lit("faithful heart"), F.lit("faithful")))
    assert (r.a, r.b) == (False, True)


def test_bursts(spark):
    rows = spark.createDataFrame([(i, "s", 1_000_000 + i * 6_000 if i < 13 else 2_000_000) for i in range(14)], "event_id long, s string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert [r.burst for r in E.bursts(rows, "s").orderBy("event_id").collect()] == [True] * 13 + [False]
    assert not any(r.burst for r in E.bursts(rows.where("event_id > 0"), "s").collect())


def test_phrase_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown quick the fox"), (3, None), (4, "")], "doc_id long, text string")
    ask = spark.createDataFrame([(9, "quick brown"), (8, None), (7, "no such")], "item_id long, text string")
    i, terms = fts.build(docs), fts.query_terms(ask)
    assert [tuple(r) for r in fts.phrase(i, terms).collect()] == [(9, 1)]
    assert sorted(r.doc_id for r in fts.all_terms(i, terms).collect()) == [1, 2]
    assert fts.bm25(i, terms).count() == 2 and i.size.first()["n"] == 4
    none = fts.build(docs.limit(0))
    assert fts.bm25(none, terms).count() == 0 and fts.phrase(none, terms).count() == 0


def test_cascade_takes_the_first_stage_with_hits(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "brown quick fox jumps over dogs"), (3, "quicksand")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "the quick brown"), (2, "fox quick"), (3, "quicks"), (4, "icksan"), (5, "dogs zebra"), (6, "zebra")], "item_id long, text string")
    got = {(r.query_id, r.doc_id, r.stage) for r in fts.cascade(fts.build(docs), docs, fts.query_terms(ask)).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (2, 2, 2), (3, 3, 7), (4, 3, 8), (5, 2, 4)}


def test_upserts(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    b = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, n int")
    got = lambda p: sorted(map(tuple, R.upsert(a, b, ["k"], p).collect()))
    assert got("replace") == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert got("ignore") == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]
    assert got("fill") == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]


def test_filters_reach_the_scan(spark):
    from quillspark.plans import all_queries

    plan = all_queries()["anti_unread"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in plan


def test_searches_take_whole_queries(spark, tmp_path):
    from quillspark.plans import search as S
    from quillspark.operators.pipeline import search

    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:30], "else"])), (3, " ".join(words[30:]))], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs.selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    asked.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id: r.sequence for r in S.sequence_score(spark, str(tmp_path)).collect()} == {1: 1.0, 2: 0.75, 3: 0.25}
    assert [(r.id, r.tier) for r in search(S.index(spark, str(tmp_path)), asked).collect() if r.tier == 2] == [(1, 2)]


def test_transport_answers_the_stated_queries(spark):
    from quillspark.plans import all_queries, vector as P

    data = "/root/testdata/sf0.001"
    stated = {r.id // 10 for r in P.vecs(spark, data).where("id % 20 = 0").collect()}
    assert {r.query_id for r in all_queries()["sinkhorn"](spark, data).collect()} == stated


def test_vector_searches_answer_the_stated_queries(spark):
    from quillspark.operators import vectors as V
    from quillspark.plans import all_queries, vector as P

    data = "/root/testdata/sf0.001"
    stated = {r.id for r in P.vecs(spark, data).where("id % 20 = 0").collect()}
    assert {r.query_id for r in all_queries()["mmr"](spark, data).select("query_id").distinct().collect()} == stated
    found = {(r.query_id, r.id) for r in all_queries()["ann_lsh"](spark, data).collect()}
    assert {q for q, _ in found} == stated
    wanted = {(r.query_id, r.id) for r in V.top_similar(P.stated(spark, data), P.vecs(spark, data), 10).collect()}  # of unit vectors, the order of distance
    assert len(found & wanted) >= 0.95 * len(wanted)

    far = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 9.0])], "id long, v array<double>")
    assert V.hashed_neighbours(far, far.selectExpr("id AS query_id", "v").where("query_id = 0"), width=100.0).count() == 2


def test_porter():
    from quillspark.functions.stem import porter

    # Pairs from the published description.
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit digitizer digit operator oper feudalism feudal formaliti formal triplicate triplic electrical electr goodness good revival reviv adjustable adjust replacement replac adoption adopt probate probat rate rate cease ceas controll control roll roll".split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]
    assert [porter(w) for w in ("as", "", "naïve", "x-ray")] == ["as", "", "naïve", "x-ray"]


def test_sentences_have_no_cap(spark):
    text = "first. " + "a sentence that is long enough to be one of those counted here. " * 200_000
    assert spark.createDataFrame([(text,)], "t string").select(F.size(X.sentences(F.col("t"))).alias("n")).first()["n"] >= 199_999


def test_empty_and_null_vectors_and_graphs(spark):
    from quillspark.operators import graphs as G, vectors as V

    none = spark.createDataFrame([], "id long, v array<double>")
    assert V.whitened(none).count() == V.principal(none, 2).count() == V.explained(none).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 1.0])], "id long, v array<double>")
    assert [(r.query_id, r.id) for r in V.top_similar(some.selectExpr("id AS query_id", "v"), some).orderBy("query_id").collect()] == [(1, 3), (3, 1)]
    bridge = spark.createDataFrame([], "item long, topic string")
    assert G.topic_pagerank(bridge).count() == 0 and G.shared_edges(bridge).count() == 0
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "item long, topic string")
    seeds = one.selectExpr("topic AS seed", "item", "IF(topic = 'a', 0.5D, 1.0D) AS bias")
    got = {(r.seed, r.item): r.score for r in G.personalised_pagerank(one, seeds).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 3)} and abs(got["a", 1] - 0.5) < 1e-4 and abs(got["b", 3] - 0.15) < 1e-9


def clustered(spark):
    import numpy as np

    r = np.random.default_rng(2)
    m = np.concatenate([r.normal(c, 0.3, (60, 6)) for c in (0, 4, 8)]) @ np.diag([1, 2, 1, 1, 0.5, 1])
    return m, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")


def test_reductions_against_numpy(spark):
    import numpy as np

    from quillspark.operators import vectors as V

    m, frame = clustered(spark)
    read = lambda df: np.array([r.v for r in df.orderBy("id").collect()])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    w, u = np.linalg.eigh(np.cov(m.T, bias=True))
    centred = m - m.mean(0)
    assert np.allclose(read(V.whitened(frame)), unit(centred @ u @ np.diag(1 / np.sqrt(w + 1e-5)) @ u.T), atol=1e-6)
    got, want = read(V.principal(frame, 3)), unit(centred @ u[:, ::-1][:, :3])
    assert np.allclose(np.abs((got * want).sum(0)), (want**2).sum(0), atol=1e-6)
    assert [r.share for r in V.explained(frame).orderBy("k").collect()] == [round(float(w[::-1][:k].sum() / w.sum()), 6) for k in (1, 2, 4)]
    groups = {}
    for r in V.clusters(frame, 3).collect():
        groups.setdefault(r.cluster, []).append(r.id)
    assert sorted(map(sorted, groups.values())) == [list(range(60)), list(range(60, 120)), list(range(120, 180))]


def test_spectral_against_numpy(spark):
    import numpy as np

    from quillspark.operators import vectors as V

    r = np.random.default_rng(3)
    a = np.kron(np.eye(3), np.ones((8, 8))) * r.random((24, 24)) + 0.02
    a = (a + a.T) / 2
    np.fill_diagonal(a, 0)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(24) for j in range(24) if i != j], "a long, b long, w double")
    got = np.array([x.v for x in V.spectral(edges, 3, 30).orderBy("id").collect()])
    d = a.sum(0)
    _, u = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    want = u[:, -3:] / np.linalg.norm(u[:, -3:], axis=1, keepdims=True)
    assert np.allclose(got @ got.T, want @ want.T, atol=0.05)  # the same directions, up to a turn


def test_items_of_one_session_are_alike(spark):
    import numpy as np

    from quillspark.operators import vectors as V

    sessions = spark.createDataFrame([([f"{g}{(i * k) % 5}" for i in range(30)],) for g in "ab" for k in range(1, 41)], "items array<string>")
    v = {r.word: np.array(r.vector) / np.linalg.norm(r.vector) for r in V.item_vectors(sessions, rate=0.5).collect()}
    inside = [v[x] @ v[y] for x in v for y in v if x < y and x[0] == y[0]]
    across = [v[x] @ v[y] for x in v for y in v if x[0] < y[0]]
    assert np.mean(inside) > np.mean(across) + 0.2


def test_calibration_and_boosted_weights(spark):
    from quillspark.operators import learning as L

    points = spark.createDataFrame([(1, x / 10, c) for x, c in zip(range(8), (0, 1, 0, 0, 1, 1, 0, 1))] + [(2, 0.1, 1)], "tier int, score double, clicked int")
    curve = [tuple(r) for r in L.calibration(points).orderBy("x").collect()]
    assert [(t, round(x, 6), round(y, 6)) for t, x, y in curve] == [(1, 0.0, 0.0), (1, 0.2, 0.333333), (1, 0.5, 0.666667), (1, 0.7, 1.0)]
    at = spark.createDataFrame([(1, -1.0), (1, 0.1), (1, 0.35), (1, 9.0), (2, 0.1)], "tier int, score double")
    made = [r.probability for r in L.calibrated(at, L.calibration(points)).orderBy("tier", "score").collect()]
    assert made == [0.0, 0.166667, 0.5, 1.0, None]
    feedback = spark.createDataFrame([("ab"[i % 2], i % 7) for i in range(140)], "event_type string, rank long")
    weights = [r.weight for r in L.boosted_weights(feedback).orderBy("slot").collect()]
    assert len(weights) == 3 and all(0.05 <= w <= 3.0 for w in weights) and weights[0] > 0.5


def test_streams_write_once_and_train(spark, tmp_path):
    from quillspark.streaming import events as V

    rows = [(i, f"2024-01-01 0{i % 3}:10:00", i, "view", 1_000.0 if i else 5.0, "{}") for i in range(6)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    for _ in range(2):  # the second run finds nothing new
        V.to_table(V.ingest(V.read_events(spark, str(tmp_path))), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and out.agg(F.max("dwell_ms")).first()[0] == 300_000.0
    seen = []
    V.train_on(V.read_events(spark, str(tmp_path)), lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c2")).awaitTermination()
    assert seen == [(0, 6)]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    import pytest

    from quillspark import lineage

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        lineage.shared_dir(Session())


def test_csv_over_several_lines(spark, tmp_path):
    from quillspark.sources.files import read_csv

    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines, ""quoted"""\n2,plain\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), "a int, b string").orderBy("a").collect()] == [(1, 'two\nlines, "quoted"'), (2, "plain")]


def test_first_event_windows_against_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(key, rng.choice([0, 10**9]) + rng.randrange(0, 400_000_000)) for key in ("a", "b", None) for _ in range(60)]
    rows += [("a", 7), ("a", 7), ("c", 59_999_999), ("c", 119_999_998), ("c", 119_999_999), ("d", None)]
    frame = spark.createDataFrame(rows, "k string, us long").select("k", F.timestamp_micros("us").alias("ts"))
    wanted = []
    for key in {k for k, _ in rows}:
        times, end = sorted(t for k, t in rows if k == key and t is not None), None
        for t in times:
            if end is None or t >= end:
                end = t + 60_000_000
                wanted.append([key, t, 0])
            wanted[-1][2] += 1
    found = E.first_event_windows(frame, "k", 60, 3).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order([(r.k, r.first_us, r.n, r.refused) for r in found]) == order([(k, t, n, max(n - 3, 0)) for k, t, n in wanted])
    assert E.first_event_windows(frame.limit(0), "k", 60, 3).count() == 0


def test_vectors_of_other_lengths_are_not_compared(spark):
    from quillspark.operators import vectors as V

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.0, 0.1]), (5, [1.0]), (6, None)]
    some = spark.createDataFrame(rows, "id long, v array<double>")
    found = V.top_similar(some.selectExpr("id AS query_id", "v"), some).collect()
    assert {(r.query_id, r.id) for r in found} == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_agreement_of_two_rankings(spark):
    from quillspark.operators import vectors as V

    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 11, 2), (3, 10, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1), (2, 12, 2)], "query_id long, id long, rank int")
    found = {tuple(r) for r in V.neighbour_agreement(a, b).collect()}
    assert found == {(1, 2, 1.0, True, True), (2, 1, 0.333333, False, False), (3, 0, 0.0, False, False)}
    assert V.neighbour_agreement(a.limit(0), b.limit(0)).count() == 0


def test_passages_by_chapter_and_verse(spark):
    texts = spark.createDataFrame([(1, "Genesis", 1, 1), (2, "genesis", 1, 2), (3, "GENESIS", 1, 2), (4, "Exodus", 1, 1), (5, None, 1, 1), (6, "Genesis", None, 1)], "id long, book string, chapter int, verse int")
    asked = spark.createDataFrame([(1, "Genesis 1"), (2, "gen 1:2"), (3, "Exodus 9"), (4, "nothing"), (5, None)], "query_id long, t string").select("query_id", X.reference(F.col("t"), {"gen": "Genesis"}).alias("ref"))
    found = lambda size, offset: {tuple(r) for r in R.passages(texts, asked, "id", size, offset).collect()}
    assert found(9, 0) == {(1, 1, 1, 3), (1, 2, 2, 3), (1, 3, 3, 3), (2, 2, 1, 2), (2, 3, 2, 2)}
    assert found(1, 1) == {(1, 2, 2, 3), (2, 3, 2, 2)}
    assert R.passages(texts.limit(0), asked, "id", 5).count() == 0
