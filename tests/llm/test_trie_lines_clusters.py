"""Conversation tries, line quality and centroid clusters against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import line_quality, prefix_trie, registry, va_clusters

EMPTY = hashlib.sha256(b"").hexdigest()


# --- conversations


def plain_trie(rows, heads):
    """Every node by what the contract says, from ``(conv_id, turn, role, text)``."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        built[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    r = random.Random(5)
    turns = [("user", "a" * i) for i in range(4)] + [("assistant", f"é{i}") for i in range(4)] + [("", "x"), ("user", "")]
    rows = []
    for c in [*range(130), *range(195, 230), 305, -7, -100]:
        for t in range(r.choice([1, 1, 2, 3, 5, 9, 14]) if c != 200 else 2):
            role, text = r.choice(turns[: r.choice([2, 10])])
            rows.append((c, t * r.choice([1, 1, 300]), role, text))
    rows += [(400, t, "user", "long" + str(t % 7)) for t in range(700)] + [(401, t, "user", "long" + str(t % 7)) for t in range(650)]  # one deep path
    rows += [(100 * k + 3, 0, "user", "common") for k in range(10, 60)]
    rows += [(501, None, None, None), (501, None, "user", "b"), (501, 3, "user", None), (502, 1, "user", "same"), (502, 1, "user", "same"), (None, 0, "user", "nobody")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, upper int"


def nodes(frame):
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()]
    return sorted(rows, key=str)


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many shards, whose upper nodes are merged
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("heads", "segment"), [(True, 64), (False, 64), (True, 3), (True, 1)])
def test_trie(spark, small_batches, heads, segment):
    rows = conversations()
    if segment == 1:
        rows = [x for x in rows if x[0] not in (400, 401)]
    frame = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA).repartition(3)
    assert nodes(prefix_trie.conversation_trie(spark, frame, heads, segment)) == plain_trie(rows, heads)


def test_trie_in_one_shard_and_empty(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert nodes(registry.queries()["op11_conversation_trie"](spark, str(tmp_path))) == plain_trie(rows, True)
    assert prefix_trie.conversation_trie(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_array():
    r = np.random.default_rng(2)
    lengths = r.integers(0, 9, 3000)
    codes = np.where(np.arange(8)[None] < lengths[:, None], r.integers(0, 40, (3000, 8)) ** 2 // 40, -1)
    trie = prefix_trie.DoubleArray(codes, lengths)
    paths = {tuple(row[:d].tolist()) for row, n in zip(codes, lengths, strict=True) for d in range(1, n + 1)}
    assert sum(map(len, trie.levels)) == len(paths)  # every node once
    seen = {}
    for path in paths:
        at = np.zeros(1, np.int64)
        for code in path:
            at = trie.step(at, np.array([code]))
            assert at[0] > 0
        assert seen.setdefault(int(at[0]), path) == path
    assert trie.step(np.zeros(1, np.int64), np.array([10_000]))[0] == -1
    assert len(paths) / trie.used.sum() > 0.99 and trie.used.mean() > 0.3


def test_ids_of_one_node_in_pieces(spark):
    ids = [i * 37 - 5000 for i in range(9000)]
    rows = spark.createDataFrame([(b"k", i) for i in ids] + [(b"other", 3)], "key binary, c long").repartition(5)
    found = {bytes(r.key): r.ends_sha256 for r in prefix_trie.ends_of(rows).collect()}
    assert found == {b"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"other": hashlib.sha256(b"3").hexdigest()}


# --- lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def texts():
    r = random.Random(8)
    good = lambda n: " ".join(r.choice(["the", "of", "house", "river", "walking", "déjà", "green", "it", "was"]) + r.choice(["", "", "s", ",", "."]) for _ in range(n)).capitalize()
    rows, labels = [], []
    for i in range(160):
        lines = [good(r.randint(8, 30)) for _ in range(r.randint(2, 8))]
        if i % 2:
            lines = [r.choice([" | ".join(x.split()), "### ".join(x.split()) + "$$$", (x + "!!").upper()]) for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1 - i % 2))
    hard = [None, "", " \n\t\n ", "one", good(25) + "\n" + good(3) + "\n\n" + good(25), "\n".join([good(12)] * 4 + [good(30)] * 2), good(200_000), "x y z\r\nx y z\n x y z\nx y z", "a " * 500, "\x85 \xa0   é " * 9, "&" * 3000]
    rows += [(200 + i, t) for i, t in enumerate(hard)] + [(3, rows[3][1]), (None, good(40))]
    return rows, [*labels, (1, 0), (3, None), (None, 1), (999, 0), (5, 7)]


DOCS = "doc_id long, text string, quality string, kept long, h long"


def test_lines(spark, tmp_path):
    rows, labels = texts()
    docs = spark.createDataFrame([(*x, "clash", 5, 5) for x in rows], DOCS).repartition(4)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    out = line_quality.line_quality(spark, docs, labelled)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == Counter((i, *plain_counts(t)) for i, t in rows)
    for r in out.collect():
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id < 160 and not r.base_failed:
            assert r.kept == (r.doc_id % 2 == 0)
            assert (r.content_text == dict(rows)[r.doc_id]) == r.kept
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labelled.write.parquet(str(tmp_path / "labels.parquet"))
    again = registry.queries()["op12_line_quality"](spark, str(tmp_path))
    assert Counter((r.doc_id, r.kept) for r in again.collect()) == Counter((r.doc_id, r.kept) for r in out.collect())


def test_lines_without_labels_or_rows(spark):
    rows, _ = texts()
    docs, none = spark.createDataFrame([(*x, "clash", 5, 5) for x in rows[:20]], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed and r.content_share == 1 for r in line_quality.line_quality(spark, docs, none).collect())
    assert line_quality.line_quality(spark, spark.createDataFrame([], DOCS), none).count() == 0


def test_viterbi_finds_the_best_of_all_paths():
    import itertools

    r = np.random.default_rng(4)
    field = line_quality.Field(np.zeros(2), np.ones(2), r.normal(size=(3, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    x, starts = r.normal(size=(30, 2)), np.array([0, 0, 7, 8, 17, 17, 30])
    states, emit = field.decode(x, starts), field.scores(x)
    for a, z in zip(starts[:-1], starts[1:], strict=True):
        if z > a:
            score = lambda p: field.begin[p[0]] + sum(emit[a + i, s] for i, s in enumerate(p)) + sum(field.moves[s, t] for s, t in itertools.pairwise(p))  # noqa: E731, B023
            assert tuple(states[a:z]) == max(itertools.product((0, 1), repeat=z - a), key=score)


def test_a_fitted_field_tells_sequences_apart():
    """A fitted field tells labelled sequences apart."""
    r = np.random.default_rng(0)
    pieces = [(r.normal(size=(r.integers(1, 9), 3)) + [2 * k, 0, 0], k) for k in (0, 1) for _ in range(80)]
    field = line_quality.fit(pieces)
    starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in pieces])])
    states = field.decode(np.concatenate([x for x, _ in pieces]), starts)
    assert np.mean([(states[a:z].mean() > 0.5) == k for (_, k), a, z in zip(pieces, starts[:-1], starts[1:], strict=True)]) > 0.85
    assert line_quality.fit(pieces[:80]) is None


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    codes = np.array([1, 2, 3, 4, 1, 2, 3, 5, 1, 2])
    want = line_quality.repeated_words(codes, np.array([0, 10]), 2)
    assert want.tolist() == [True, True, True, False, True, True, True, False, True, True]
    monkeypatch.setattr(line_quality, "rolling", lambda h, w: np.zeros(len(h) - w + 1, np.uint64))
    assert (line_quality.repeated_words(codes, np.array([0, 10]), 2) == want).all()


# --- vectors


def plain_clusters(rows, dims, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) < 2**21 for x in v)]
    name = lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1])
    cs = [v for _, v in sorted(kept, key=name)[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(cs)), key=lambda c: (dist(v, cs[c]), c)) for _, v in kept]
        if step < rounds:
            for c in range(len(cs)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                cs[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else cs[c]
    ds = [dist(v, cs[o]) for (_, v), o in zip(kept, own, strict=True)]
    each = Counter()
    for o, d in zip(own, ds, strict=True):
        each[o] += d
    return Counter((i, o, d, each[o], sum(ds), hashlib.sha256(",".join(map(str, cs[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, ds, strict=True))


VECTORS = "vec_id long, embedding array<double>, cells string, code string"


@pytest.mark.parametrize(("dims", "bits", "sample"), [(64, 6, 16_384), (64, 3, 40), (8, 2, 10)])
def test_clusters(spark, tmp_path, dims, bits, sample):
    r = np.random.default_rng(dims)
    rows = [(i, (r.normal(size=dims) * 0.2 + (i % 5) * 0.1).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [rows[9], rows[9], (None, rows[11][1])]  # equal vectors, equal rows
    rows += [(600, None), (601, []), (602, [0.5] * (dims - 1)), (603, [None, *[0.1] * (dims - 1)]), (604, [float("nan")] * dims), (605, [float("inf"), *[0.0] * (dims - 1)]), (606, [0.0] * dims), (607, [1e6, -2e6, *[0.0] * (dims - 2)]), (608, [1e30] * dims)]
    frame = spark.createDataFrame([(*x, "clash", "clash") for x in rows], VECTORS).repartition(3)
    out = va_clusters.centroid_clusters(spark, frame, dims=dims, bits=bits, sample=sample)
    assert Counter(tuple(x) for x in out.collect()) == plain_clusters(rows, dims)
    if bits == 6:
        frame.write.parquet(str(tmp_path / "embeddings.parquet"))
        assert Counter(tuple(x) for x in registry.queries()["op13_centroid_clusters"](spark, str(tmp_path)).collect()) == plain_clusters(rows, dims)


def test_few_vectors_and_none(spark):
    rows = [(i, [i * 0.1] * 64) for i in range(3)]
    frame = spark.createDataFrame([(*x, "clash", "clash") for x in rows], VECTORS)
    assert Counter(tuple(x) for x in va_clusters.centroid_clusters(spark, frame).collect()) == plain_clusters(rows, 64)
    assert va_clusters.centroid_clusters(spark, spark.createDataFrame([], VECTORS)).count() == 0


def test_intervals_hold_the_distance_and_decide_most():
    r = np.random.default_rng(1)
    v = np.floor(r.normal(size=(3000, 16)) * 12 + (np.arange(3000) % 4)[:, None] * 30).astype(np.int64)
    cells = va_clusters.Cells(v[:500], v.min(0), v.max(0), 5)
    own, centroids = cells.of(v), v[:4]
    assert (cells.unpack(cells.pack(own)) == own).all()
    near, far = cells.tables(centroids)
    exact = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    low, high = (np.stack([t[np.arange(16), own].sum(1) for t in table], 1) for table in (near, far))
    assert (low <= exact).all() and (exact <= high).all()
    said = va_clusters.by_intervals(own, (near, far))
    assert (said == va_clusters.UNDECIDED).mean() < 0.5 and (said == exact.argmin(1))[said >= 0].all()
