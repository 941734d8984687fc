"""Each operator against a plain version of its contract, with the hard cases in one small table."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, jaccard_join, language_id, mixing, nearest, packing, pii, suffix_dedup, token_rollup, window_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, keep_id string, score string"


def corpus():
    r = random.Random(3)
    words = {"en": "the of and to in that with for was this have from".split(), "fr": "le la les des une pour dans avec être été où çà".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "s", "er", "ing"]) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "fr", r.randint(1, 120)), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(60)]
    long_ = text("en", 9000)
    rows += [(60, long_, "en", None), (61, rows[3][1], "fr", "s1"), (62, rows[3][1].replace(" ", "  \n", 3), None, "s1"), (63, None, "en", "s2"), (64, "", None, "s2"), (65, " \t ", "en", "s3"), (66, "12 + 3", "en", "s3")]
    rows += [(67, long_[:3000] + " other end é", "en", "s0"), (68, "x" * 400, "en", "s0"), (69, "mail a.b@c-d.example.org or +1 (743) 555-3824, 10.2.3.4, 4111 1111 1111 1111; 999.1.1.1 and a@b", "en", "s1")]
    rows += [(70 + i, " ".join(long_.split()[:200][: 100 - i] + [f"new{i}"] + long_.split()[:200][101 - i :]), "en", "s0") for i in range(8)]
    rows += [rows[5], (None, "no number at all", "en", "s1")]
    return [(*x, len(x[1] or ""), 7, "clash", "clash") for x in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def high(x):
    return 2**63 if x is None else x


def test_exact(spark, docs, rows, none):
    groups = {}
    for x in rows:
        groups.setdefault(squeezed(x[1]), []).append(x[0])
    want = sorted((high(x[0]), min(map(high, groups[squeezed(x[1])])), len(groups[squeezed(x[1])]), hashlib.sha256(squeezed(x[1]).encode()).hexdigest()) for x in rows)
    got = sorted((high(r.doc_id), high(r.keep_id), r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(spark, docs).collect())
    assert got == want
    assert exact_dedup.exact_duplicates(spark, none).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 256, (5000, 32), np.uint8)
    assert sorted(exact_dedup.PerfectHash(keys).slots(keys)) == list(range(5000))


def test_packing(spark, docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for x in rows:
        ids.setdefault(x[0], []).append(np.array([*t.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    out = packing.pack_documents(spark, docs).toPandas()
    for doc, part in out.groupby("doc_id", dropna=False):
        own = ids[None if doc != doc else int(doc)]
        assert part["length"].sum() == sum(map(len, own))
        for p in part.itertuples():
            assert any(zlib.crc32(i[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for i in own)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 2048
    assert packing.pack_documents(spark, none).count() == 0


def test_cutting_stock_is_near_the_bound():
    r = np.random.default_rng(0)
    demand = {int(w): int(n) for w, n in enumerate(np.bincount(r.integers(1, 101, 20_000), minlength=257)) if n}
    plan = packing.cutting_stock(demand, 256)
    held = {}
    for take, n in plan:
        assert sum(w * a for w, a in take.items()) <= 256
        for w, a in take.items():
            held[w] = held.get(w, 0) + a * n
    assert all(held[w] >= n for w, n in demand.items())
    assert sum(n for _, n in plan) <= sum(w * n for w, n in demand.items()) / 256 * 1.01 + 60


def test_language(spark, docs, rows, none):
    out = language_id.identify_languages(spark, docs).toPandas()  # its column score is replaced
    assert len(out) == len(rows)
    blank = out["text"].map(lambda t: not any(c.isalpha() for c in t or ""))
    assert (out.loc[blank, "lang_pred"] == "und").all() and (out.loc[~blank, "lang_pred"] != "und").all()
    known = out[out["held_out"] & out["lang"].notna() & ~blank & (out["text"].str.len() > 60) & (out["doc_id"] < 60)]
    assert (known["lang_pred"] == known["lang"]).mean() > 0.9
    assert out["score"].between(0, 1).all()
    assert language_id.identify_languages(spark, none).count() == 0


def test_mixing(spark, docs, rows, none):
    out = mixing.mix_sources(spark, docs).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all() and (out["taken"] % out["size"].where(out["size"] > 0, 1) == 0).all()
    total = sum(len(split(x[1])) for x in rows)
    by = out.groupby("source", dropna=False).agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(by["target"].sum() - 1.5 * total) < 1e-6 and (by["target"] <= 2 * by["size"] + 1e-9).all()
    assert ((by["taken"] - by["target"]).abs() <= by["most"]).all()
    again = mixing.mix_sources(spark, docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].fillna(-1).sort_values(key).to_numpy().tolist() == again[key].fillna(-1).sort_values(key).to_numpy().tolist()
    assert mixing.mix_sources(spark, none).count() == 0


def test_rollup(spark, docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    first = {}
    for x in sorted(rows, key=lambda x: (x[0] is None, high(x[0]))):
        first.setdefault(x[1] or "", x)
    want = {}
    for x in first.values():
        for v, n in (("words", len(split(x[1]))), ("bpe49k", len(t.encode(x[1] or "", add_special_tokens=False).ids))):
            a = want.setdefault((x[3], x[2], v), [0, 0])
            a[0] += 1
            a[1] += n
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in token_rollup.document_token_rollup(spark, docs).collect()}
    assert got == want
    assert token_rollup.document_token_rollup(spark, none).count() == 0


def test_rollup_commits_once_and_compacts(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    change = spark.createDataFrame([("a", "en", "v1", 1, 1, 10), ("a", "en", "v1", 1, 1, 5), ("b", None, "v1", 1, 1, 7)], "source string, lang string, tokenizer_version string, sign int, docs int, tokens long")
    assert r.commit("one", change) and not r.commit("one", change)
    assert r.commit("two", change.where("source = 'b'").withColumn("sign", F.lit(-1)))
    want = [("a", "en", "v1", 2, 15)]
    assert [tuple(x) for x in r.totals().collect()] == want
    r.compact("now")
    assert [tuple(x) for x in r.totals().collect()] == want and len(r.committed()) == 1
    assert not r.commit("one", change) and [tuple(x) for x in r.totals().collect()] == want


def test_suffix(spark, docs, rows, none):
    first = {}
    for x in rows:
        b = (x[1] or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 2**64), high(x[0]))
    want = []
    for x in rows:
        b = (x[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < high(x[0]):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((high(x[0]), len(b), sum(gone), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest()))
    got = [(high(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(spark, docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.remove_repeated_bytes(spark, none).count() == 0


@pytest.mark.parametrize("data", [b"ab" * 300, b"a" * 500, bytes(np.random.default_rng(2).integers(97, 100, 800, np.uint8)), b"xyz" * 40 + b"q" + b"xyz" * 40])
def test_suffix_order(data):
    a = np.frombuffer(data, np.uint8)
    places = np.arange(len(a) - 60)
    got = suffix_dedup.suffix_order(a, places)
    assert [data[i : i + 50] for i in got] == sorted(data[i : i + 50] for i in places)


def test_windows(spark, docs, rows, none):
    seen = {}
    for x in rows:
        w = split(x[1])
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = []
    for x in rows:
        w = split(x[1])
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((high(x[0]), len(w), sum(gone), hashlib.sha256(" ".join(t for t, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = [(high(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in window_dedup.remove_repeated_windows(spark, docs).collect()]
    assert sorted(got) == sorted(want)
    assert window_dedup.remove_repeated_windows(spark, none).count() == 0


def test_jaccard(spark, docs, rows, none):
    sets = {}
    for x in rows:
        w = split(re.sub("[A-Z]", lambda m: m.group().lower(), x[1] or ""))
        sets[high(x[0])] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    want = sorted((high(x[0]), len(sets[high(x[0])]), top(high(x[0]))) for x in rows)
    got = sorted((high(r.doc_id), r.n_shingles, high(r.component_id)) for r in jaccard_join.jaccard_components(spark, docs).collect())
    assert got == want
    assert jaccard_join.jaccard_components(spark, none).count() == 0


def test_personal_data(spark, docs, rows, none):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in pii.find_personal_data(spark, docs, steps=20).collect():
        text = next((x[1] for x in rows if x[0] == r.doc_id), "") or ""
        base = [(0, *m.span()) for m in email.finditer(text)] + [(1, *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        base += [(2, *m.span()) for m in pii.CARD.finditer(text) if pii.valid("card", m.group())] + [(3, *m.span()) for m in pii.PHONE.finditer(text) if pii.valid("phone", m.group())]
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))
    assert pii.find_personal_data(spark, none).count() == 0


def test_tagger_gradients():
    t = pii.Tagger()
    r = np.random.default_rng(0)
    x, y = r.integers(1, pii.CLASSES, (3, 7)).astype(np.int8), r.integers(0, pii.TAGS, (3, 7)).astype(np.int8)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}

    def loss():
        e = t.emissions(x)[0].astype(np.float64)
        total = 0.0
        for n in range(3):
            a, s = e[0, n] + t.p["begin"], e[0, n, y[n, 0]] + t.p["begin"][y[n, 0]]
            for i in range(1, 7):
                a = np.log(np.exp(a[:, None] + t.p["move"]).sum(0)) + e[i, n]
                s += t.p["move"][y[n, i - 1], y[n, i]] + e[i, n, y[n, i]]
            total += np.log(np.exp(a).sum()) - s
        return total / 3

    g = t.gradients(x, y)
    for k in ("xf", "hb", "out", "move", "begin", "cf"):
        i = tuple(r.integers(0, n) for n in t.p[k].shape)
        if k == "xf":
            i = (int(x[0, 0]), i[1])
        t.p[k][i] += 1e-3
        high_ = loss()
        t.p[k][i] -= 2e-3
        low = loss()
        t.p[k][i] += 1e-3
        assert abs((high_ - low) / 2e-3 - g[k][i]) < 2e-3


def test_nearest(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(600, 16)) + r.integers(0, 5, (600, 1))
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(600 + i, v[3].tolist(), 1) for i in range(40)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [None] + [1.0] * 15, 1), (703, [float("nan")] * 16, 1), (704, [float("inf")] * 16, 1), (300, v[300].tolist(), 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for x in nearest.nearest_neighbours(spark, t, t.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    good = {i: np.array(e) for i, e, _ in rows if e and i < 700}
    assert sorted(got) == [0, 100, 200, 300, 400, 500, 600]
    hit = 0
    for q, found in got.items():
        want = sorted((float(np.sqrt(((good[q] - e) ** 2).sum())), i) for i, e in good.items() if i != q)[:10]
        assert found == sorted(found) and len(found) == 10 and q not in [i for _, i in found]
        hit += len({i for _, i in want} & {i for _, i in found})
    assert hit >= 63
    assert [i for _, i in got[600]] == [3, *range(601, 610)]
    assert nearest.nearest_neighbours(spark, t.limit(0), t.limit(0)).count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as C

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = C.run(spark, str(tmp_path)).toPandas()
    read, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in C.STAGES[:-1]:
        read = stage(spark, read, str(tmp_path)).cache()
        assert read.columns == docs.columns
        kept.append(read.count())
    assert kept[0] >= kept[1] >= kept[2] > 0
    ids = {r.doc_id for r in read.collect()}
    assert {63, 64, 65, 66, 61, 62}.isdisjoint(ids)
    assert out.groupby("doc_id")["length"].sum().sum() == out[out["start"] == 0]["doc_tokens"].sum()


def test_counts_follow_a_growing_cache():
    import pyarrow as pa

    from quillspark.llm.tokens import WordEncoder

    texts = pa.array([" ".join(f"w{i + j}x" for i in range(100_000)) for j in (0, 100_000, 200_000)] + [None, ""])
    counts = WordEncoder(None).count(texts)
    ids, ends = WordEncoder(None).encode(texts)
    assert list(counts) == list(np.diff(ends)) and len(ids) == ends[-1] and list(counts[3:]) == [0, 0]


def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    import corpus_pipeline as C

    text = lambda seed: " ".join(f"w{random.Random(seed * 1000 + i).randint(0, 10**6)}" for i in range(60))
    near = text(1) + " end"
    rows = [(5, text(1)), (None, near), (None, text(2)), (None, text(3)), (6, text(4)), (6, text(5)), (6, text(5))]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t), 7, "", "") for i, t in rows], SCHEMA)
    kept = C.jaccard_join(spark, docs, str(tmp_path)).collect()
    assert sorted((high(r.doc_id), r.text) for r in kept) == sorted({(high(i), t) for i, t in rows if t != near})

    mixed = C.source_mix(spark, docs, str(tmp_path)).collect()
    want = mixing.mix_sources(spark, docs).agg(F.sum("copies")).first()[0]
    assert len(mixed) == want and {r.text for r in mixed} <= {t for _, t in rows}


def test_jaccard_gives_no_partial_count_of_links(spark, none):
    assert jaccard_join.jaccard_components(spark, none).columns == ["doc_id", "n_shingles", "component_id", "rk"]


def test_mixing_ranks_no_sure_copies(spark, monkeypatch):
    saved = {}

    class Kept(mixing.Scratch):
        def save(self, df, name):
            saved[name] = super().save(df, name)
            return saved[name]

    monkeypatch.setattr(mixing, "Scratch", Kept)
    monkeypatch.setattr(mixing, "BUCKET", 10)
    docs = spark.createDataFrame([(i, "five words in every text", "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    out = mixing.mix_sources(spark, docs)
    assert {r.copies for r in out.where("source = 'a'").collect()} == {2} and out.count() == 600
    assert saved["ranked"].groupBy("source", "bucket").count().agg(F.max("count")).first()[0] < 60


def plain_languages(rows):
    """The contract of language ID, letter by letter: ``[(predicted, score)]`` of rows ``(doc_id, text, lang)``."""
    def bundle(text):
        total, t = np.zeros(language_id.DIMS), [c if c.isalpha() else " " for c in f" {(text or '').lower()} "]
        one = lambda c: np.ones(language_id.DIMS) if c == " " else language_id._letter(ord(c)).astype(float)
        for a, b, c in zip(t, t[1:], t[2:]):
            if b != " ":
                total += np.roll(one(a), 2) * np.roll(one(b), 1) * one(c)
        return total if any(c != " " for c in t) else None

    vectors = [bundle(t) for _, t, _ in rows]
    sums = {}
    for (i, _, lang), v in zip(rows, vectors):
        held = i is not None and zlib.crc32(str(i).encode()) % 3 == 1
        if lang is not None and not held and v is not None and np.linalg.norm(v) > 0:
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    langs = sorted(sums)
    p = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in langs])
    p = p - p.mean(0)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    out = []
    for v in vectors:
        cos = p @ v / max(np.linalg.norm(v), 1e-12) if v is not None else None
        out.append(("und", 0.0) if v is None else (langs[int(cos.argmax())], float(np.clip(cos.max(), 0, 1))))
    return out


def test_language_against_a_plain_version(spark, docs, rows):
    some = [(x[0], x[1], x[2]) for x in rows if len(x[1] or "") < 2000]
    frame = spark.createDataFrame(some, "doc_id long, text string, lang string")
    got = sorted((high(r.doc_id), r.lang_pred, round(r.score, 4)) for r in language_id.identify_languages(spark, frame).collect())
    want = sorted((high(i), lang, round(score, 4)) for (i, _, _), (lang, score) in zip(some, plain_languages(some)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 2e-3 for a, b in zip(got, want))


def test_samples_never_vanish():
    from quillspark.llm.common import RANGE, share_of

    for n in (1, 4_000, 4_001, 10**10, 10**14):
        share = share_of(4_000, n)
        assert 0 < share <= RANGE and abs(share / RANGE * n - min(n, 4_000)) <= max(1, 1e-6 * n)


def test_ip_parts_are_numbers():
    assert pii.valid("ip", "1.2.3.0000000255") and not pii.valid("ip", "1.2.3.0000000999") and not pii.valid("ip", "1.2.3.256")
    assert pii.valid("ip", "0.0.0." + "0" * 5000) and not pii.valid("ip", "1.2.3.²")


def test_words_with_hard_letters_are_encoded_whole():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillspark.llm.tokens import WordEncoder

    t, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    texts = ["BİRİ, DEĞİL", "TÜRKÇESİ. ΟΔΟΣ, straße! ŉ. ǰ? ﬁre; don't x-y e\u0301. ½, 10%"]
    texts += ["".join(r.choice("aİIıSſßΣσςéÅ .,!-'ǅŉ\u0307\u030812 ") for _ in range(40)) for _ in range(400)]
    ids, ends = WordEncoder(None).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_letters_are_encoded_once_whatever_their_case_and_punctuation():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillspark.llm.tokens import WordEncoder

    t, e = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), WordEncoder(None)
    letters, tails = [f"étre{a}{b}ow" for a in "abcdefgh" for b in "klmnopqr"], ["", ",", "!?", "..."]
    texts = [" ".join(case(w) + tail for w in letters) for tail in tails for case in (str, str.title, lambda w: w[:4] + w[4:].upper())]
    size = lambda parts: sum(len(t.encode(x, add_special_tokens=False).ids) for x in parts)
    for _ in range(2):
        ids, ends = e.encode(pa.array([*texts, None, "..."]))
        for i, text in enumerate([*texts, "", "..."]):
            assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text
        # what the cache holds: the words (once more with a capital É, as only ASCII case is folded) and the tails
        assert e.used == 2 * size(letters) + size(tails)


def registered(spark, rows, tmp_path, name):
    """A registered query over the small table as ``documents``."""
    from quillspark.llm.registry import queries

    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return queries()[name](spark, str(tmp_path)).collect()


def test_personal_data_query_whole(spark, rows, tmp_path):
    """Counts, digest and spans of every text; what the tagger adds overlaps no base span and is of the form of its kind."""
    extra = [(100, "ip 1.2.3.0000000999 and 255.255.255.255.1, c 4111-1111 1111 1111x a.b@c.d+e@f.g-h +12 (34) 567-89.0"), (101, None), (102, "a@b.c" * 400), (103, "1.2.3.4" + " 5500 0000 0000 0004" * 50)]
    rows = [*rows, *[(i, t, "en", "s0", 0, 0, "", "") for i, t in extra]]
    texts = {}
    for x in rows:
        texts.setdefault(high(x[0]), x[1] or "")
    patterns = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), pii.IP, pii.CARD, pii.PHONE]
    for r in registered(spark, rows, tmp_path, "op7_personal_data"):
        text = texts[high(r.doc_id)]
        good = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(pii.digits(s)) <= 19 and pii.luhn(pii.digits(s)), lambda s: 9 <= len(pii.digits(s)) <= 15]
        base = [(k, *m.span()) for k in range(4) for m in patterns[k].finditer(text) if good[k](m.group())]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in range(4))
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert set(shown) <= {":".join(x) for x in spans}
        for kind, a, b in spans:
            if f"{kind}:{a}:{b}" not in shown:
                a, b = int(a), int(b)
                assert pii.plausible(pii.KINDS.index(kind), text[a:b]) and all(b <= y or a >= z for _, y, z in base)


def test_windows_and_suffixes_queries(spark, rows, tmp_path):
    got = registered(spark, rows, tmp_path, "op10_window_dedup")
    want = window_dedup.remove_repeated_windows(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), texts=False).collect()
    key = lambda r: (high(r.doc_id), r.n_words, r.n_removed, r.kept_sha256)
    assert sorted(map(key, got)) == sorted(map(key, want)) and any(r.n_removed for r in got)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_bytes(spark, spark.createDataFrame(rows, SCHEMA), length=39)


def test_texts_longer_than_a_chunk(spark):
    """Two texts of five million bytes that share their middle, and a copy of one: chunks and partitions are smaller."""
    words = lambda seed, n: " ".join(f"{random.Random(seed * 10**7 + i).randrange(10**6)}w" for i in range(n))
    middle = words(9, 60_000)
    texts = [words(1, 300_000) + " " + middle + " " + words(2, 300_000), words(3, 300_000) + " " + middle + " " + words(4, 300_000)]
    docs = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, texts[0])], "doc_id long, text string")
    out = {r.doc_id: r for r in window_dedup.remove_repeated_windows(spark, docs, texts=False).collect()}
    assert [out[i].n_removed for i in range(3)] == [660_000, 60_000, 660_000]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeated_bytes(spark, docs, texts=False).collect()}
    assert out[0].n_removed == 0 and out[2].n_removed == out[2].n_bytes and len(middle) <= out[1].n_removed <= len(middle) + 8 and out[1].n_spans == 1


def test_nearest_with_clashing_rows(spark):
    r = np.random.default_rng(7)
    v = r.normal(size=(60, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, [1.0] * 6), (5, v[5].tolist()), (7, (v[7] + 1).tolist()), (200, []), (None, v[0].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [x for x in nearest.nearest_neighbours(spark, t, t.where("vec_id % 100 = 0")).collect()]
    assert {x.query_id for x in got} == {0}  # vectors of six components take no part
    seven = min(v[7].tolist(), (v[7] + 1).tolist())
    own = {i: np.array(e) for i, e in enumerate(v)} | {7: np.array(seven)}
    want = sorted((float(np.sqrt(((own[0] - e) ** 2).sum())), i) for i, e in own.items() if i)[:10]
    assert [(x.vec_id, round(x.score, 9)) for x in sorted(got, key=lambda x: x.rank)] == [(i, round(d, 9)) for d, i in want]
    many = nearest.nearest_neighbours(spark, t, t.where("vec_id < 20"), leaf=4, probes=10**6)
    assert many.count() == 200


def test_mixing_by_preference(spark):
    """Unequal inclusion: what is preferred is taken more often; null counts as 1, 0 is never taken beyond need."""
    rows = [(i, "five words in every text", "a" if i < 400 else "b", [None, 4.0, 0.0][i % 3]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, liking double")
    out = mixing.mix_sources(spark, docs, preference="liking").toPandas()
    b = out[out["source"] == "b"]
    share = [b[b["doc_id"] % 3 == k]["copies"].mean() for k in range(3)]
    assert share[1] > share[0] > share[2] and abs(b["taken"].sum() - b["target"].iloc[0]) <= 5 and (out["taken"] <= 2 * out["size"]).all()


def test_pipeline_against_plain_versions(spark, rows, tmp_path):
    """Values after every stage against the five contracts run one by one in plain Python and DuckDB, with clashing columns."""
    import duckdb

    import corpus_pipeline as C
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [x for x in rows if len(x[1] or "") < 3000]
    schema = SCHEMA + ", digest string, key string, found string, row string, copies int"
    docs = spark.createDataFrame([(*x, "d", "k", "f", "r", 3) for x in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same = lambda frame: sorted((high(r.doc_id), r.text or "", r.source or "", r.score, r.digest, r.key, r.found, r.row, r.copies) for r in frame.collect())
    full = lambda xs: sorted((high(x[0]), x[1] or "", x[3] or "", "clash", "d", "k", "f", "r", 3) for x in xs)

    left = [x for x, (lang, score) in zip(rows, plain_languages([(x[0], x[1], x[2]) for x in rows])) if lang != "und" and score >= C.LEAST_SCORE]
    stage = C.language_id(spark, docs, str(tmp_path))
    assert same(stage) == full(left) and stage.columns == docs.columns

    best = {}
    for x in left:
        best.setdefault(squeezed(x[1]), []).append(x)
    left = [min(g, key=lambda x: high(x[0])) for g in best.values()]
    stage = C.exact_dedup(spark, stage, str(tmp_path)).cache()
    assert same(stage) == full(left)

    sets = [(x, {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}) for x in left for w in [split(re.sub("[A-Z]", lambda m: m.group().lower(), x[1]))]]
    up = list(range(len(sets)))
    top = lambda i: i if up[i] == i else top(up[i])
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            up[top(j)] = top(i)
    near = {}
    for i, (x, _) in enumerate(sets):
        near.setdefault(top(i), []).append(x)
    left = [min(g, key=lambda x: high(x[0])) for g in near.values()]
    stage = C.jaccard_join(spark, stage, str(tmp_path)).cache()
    assert same(stage) == full(left)

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(x[0], x[1], x[3]) for x in left])
    taken = {high(i): t // s if s else 0 for i, s, _, _, t in con.sql(mixing.OP3_SQL).fetchall()}
    left = [x for x in left for _ in range(taken[high(x[0])])]
    stage = C.source_mix(spark, stage, str(tmp_path)).cache()
    assert same(stage) == full(left)

    t, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for x in left:
        ids.setdefault(high(x[0]), []).append([*t.encode(x[1], add_special_tokens=False).ids, 1])
    out = C.run(spark, str(tmp_path)).toPandas()
    assert sorted(out.groupby(out["doc_id"].fillna(2**63))["length"].sum().astype(int)) == sorted(sum(map(len, v)) for v in ids.values())
    for p in out.itertuples():
        own = ids[2**63 if p.doc_id != p.doc_id else int(p.doc_id)]
        assert any(zlib.crc32(np.array(i[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for i in own)
    for _, q in out.sort_values("offset").groupby("sequence_id"):
        assert list(q["offset"]) == [0, *q["length"].cumsum()[:-1]] and q["length"].sum() <= 2048


def test_queries_that_open_many_leaves_are_dealt_in_bounded_pieces(monkeypatch):
    import pandas as pd

    from quillspark.llm.common import unpack

    monkeypatch.setattr(nearest, "OPENED", 256)
    r = np.random.default_rng(2)
    points = r.normal(size=(512, 8))
    forest = nearest.Forest(points, 4, 2)
    n = 100
    f = pd.DataFrame({"embedding": list(r.normal(size=(n, 8))), "query": np.arange(n)})
    rows = [sum(len(unpack(b)[1]) for b in out["blob"]) for out in nearest._open(forest, 10**6, 1, 1)(iter([f]))]
    assert sum(rows) == n * 32 and max(rows) <= nearest.OPENED
    assert nearest.merge_parts(6_000, 2_000, 11) * nearest.FINDS_PER_PART >= 6_000 * 2_000 * 11
