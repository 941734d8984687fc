"""Cases at the edge of what a stage or operator is asked for."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import nearest, suffix_dedup, token_rollup


def test_language_stage_keeps_an_unlabelled_table(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(1, "some words", None, "s"), (2, "12 + 3", None, "s"), (3, None, None, "s"), (4, "é", None, None)], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in C.language_id(spark, docs, str(tmp_path)).collect()) == [1, 4]


def test_stages_take_maps_and_keep_one_row_by_its_hash(spark, tmp_path):
    import corpus_pipeline as C

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", {"k": i}, [i]) for i in (1, 2, 3)] + [(2, text + " more", "en", "s", None, None), (3, "other words", "en", None, {}, [])]
    kind = "doc_id long, text string, lang string, source string, extra map<string,int>, row array<int>"
    kept = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, kind).repartition(2)
        once = C.exact_dedup(spark, docs, str(tmp_path))
        assert once.columns == docs.columns and once.count() == 3
        near = C.jaccard_join(spark, docs, str(tmp_path))
        assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == [1, 3]
        assert C.source_mix(spark, docs, str(tmp_path)).columns == docs.columns
        kept.add((str([r.extra for r in once.orderBy("doc_id").collect()]), str([r.extra for r in near.orderBy("doc_id").collect()])))
    assert len(kept) == 1


def test_compaction_may_be_asked_for_twice(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    r.compact("early")  # nothing is there
    change = spark.createDataFrame([("a", "en", "v1", 1, 1, 10)], "source string, lang string, tokenizer_version string, sign int, docs int, tokens long")
    assert r.committed() == [] and r.commit("one", change) and r.commit("two", change)
    for _ in range(3):
        r.compact("k")
        assert r.committed() == ["batch=upto-k"] and [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 2, 20)]
    assert r.commit("three", change) and r.committed() == ["batch=three", "batch=upto-k"]
    r.compact("later")
    assert r.committed() == ["batch=upto-later"] and [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 3, 30)]
    assert not r.commit("one", change)


def test_texts_of_one_md5_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00" * 16))
    docs = spark.createDataFrame([(1, "a" * 40 + "first text, which is long enough to be cut"), (2, "b" * 40 + "another text, as long as the one before it")], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeated_bytes(spark, docs).collect()] == [0, 0]


def test_queries_of_a_leaf_are_dealt_in_blocks(spark):
    assert nearest.query_blocks(10**7, 500, 4000, 50_000) == 25 and nearest.query_blocks(7, 10**6, 40, 50_000) == 1
    v = np.random.default_rng(3).normal(size=(300, 8))
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, nearest.nearest_neighbours(spark, t, t, leaf=40, probes=30, leaf_queries=n).collect())) for n in (10**6, 20)]
    assert found[0] == found[1] and len(found[0]) == 3000


def test_no_group_of_queries_grows_with_their_number(spark):
    """The largest group that a leaf's queries form stays at about what is asked for."""
    v = np.random.default_rng(3).normal(size=(2000, 4))
    forest = nearest.Forest(v, 2, 2)
    for n in (500, 2000):
        blocks = nearest.query_blocks(n, 8, 8, 100)
        t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:n])], "query long, embedding array<double>")
        opened = t.mapInPandas(nearest._open(forest, 8, 1, blocks), nearest.BLOB)
        sizes: dict[int, int] = {}
        for r in opened.collect():
            sizes[r.part] = sizes.get(r.part, 0) + len(nearest.unpack(r.blob)[1])
        assert sum(sizes.values()) == 8 * n and max(sizes.values()) < 160
