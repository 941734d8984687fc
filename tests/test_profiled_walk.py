"""Walks by the profile of each query, against a plain version."""

import math
import random

from quillspark.operators import graphs

PROFILE = "query_id long, damping double, hops int, rounds int, seeds int, neighbours int, references int, topic_edges int"


def plain_walk(seeds, profiles, edges, asked, members, walks):
    out = {}
    for q, damping, hops, rounds, most, near, refs, topical in profiles:
        own = sorted(((w, i) for k, i, w in seeds if k == q and w and w > 0), key=lambda x: (-x[0], x[1]))[:most]
        if len(own) < 3:
            continue
        total = sum(w for w, _ in own)
        home = {i: w / total for w, i in own}
        ways, seen, frontier = {}, set(home), list(home)
        for _ in range(hops):
            further = []
            for v in frontier:
                to = {}
                for kind, src, dst, w, n in edges:
                    if src == v and w > 0 and n <= (near if kind == "near" else refs):
                        to[dst] = max(to.get(dst, 0), w)
                for t in {t for k, t in asked if k == q} & {t for i, t in members if i == v}:
                    for _, dst, score in sorted((r, i, s) for name, i, s, r in walks if name == t and i != v)[:topical]:
                        to[dst] = max(to.get(dst, 0), 0.55 * math.sqrt(score))
                ways[v] = to
                new = [x for x in to if x not in seen]
                seen.update(new)
                further += new
            frontier = further
        state = dict(home)
        for _ in range(rounds):
            new = {i: (1 - damping) * s for i, s in home.items()}
            for v, to in ways.items():
                for dst, w in to.items():
                    new[dst] = new.get(dst, 0) + damping * state.get(v, 0) * w / sum(to.values())
            state = new
        best = max(state.values())
        out |= {(q, i): round(s / best, 6) for i, s in state.items() if s > 0}
    return out


def frames(spark, seeds, profiles, edges, asked, members, walks):
    make = spark.createDataFrame
    return (make(seeds, "query_id long, id long, weight double"), make(profiles, PROFILE), make(edges, "kind string, src long, id long, w double, n int"),
            make(asked, "query_id long, topic string"), make(members, "item long, topic string"), make(walks, "topic string, item long, score double, rank int"))


def test_profiles_in_one_plan(spark):
    r = random.Random(5)
    profiles = [(1, 0.72, 1, 3, 5, 8, 4, 0), (2, 0.76, 1, 3, 6, 8, 5, 2), (3, 0.8, 2, 4, 7, 10, 6, 2), (4, 0.83, 2, 4, 8, 10, 6, 4), (5, 0.84, 2, 5, 8, 12, 6, 2), (6, 0.78, 1, 3, 5, 8, 4, 0), (7, 0.8, 0, 2, 5, 3, 3, 0), (8, 0.8, 2, 4, 7, 10, 6, 2)]
    seeds = [(q, i, round(r.uniform(0.1, 1), 3)) for q in range(1, 8) for i in r.sample(range(60), 9)] + [(8, 1, 0.5), (8, 2, 0.5), (9, 1, 1.0), (9, 2, 1.0), (9, 3, 1.0)]
    edges = [("near", i, j, round(r.uniform(-0.1, 1), 3), n + 1) for i in range(50) for n, j in enumerate(r.sample(range(60), 14))]
    edges += [("reference", i, (i + n) % 60, 0.74 * math.exp(-0.12 * (n - 1)), n) for i in range(55) for n in range(1, 8)]
    members = [(i, f"t{i % 4}") for i in range(60)] * 2
    walks = [(f"t{t}", i, round(r.uniform(0.01, 1), 3), n + 1) for t in range(4) for n, i in enumerate(r.sample(range(60), 12))]
    asked = [(q, f"t{t}") for q in range(1, 7) for t in range(q % 3 + 1)] * 2
    found = {(x["query_id"], x["id"]): x["score"] for x in graphs.profiled_walk(*frames(spark, seeds, profiles, edges, asked, members, walks)).collect()}
    wanted = plain_walk(seeds, profiles, edges, asked, members, walks)
    assert found.keys() == wanted.keys() and {q for q, _ in found} == set(range(1, 8))
    assert all(abs(found[k] - wanted[k]) <= 1e-6 for k in wanted)


def test_nothing_to_walk(spark):
    none = graphs.profiled_walk(*frames(spark, [], [], [], [], [], []))
    assert none.columns == ["query_id", "id", "score"] and none.count() == 0
    alone = graphs.profiled_walk(*frames(spark, [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 2.0)], [(1, 0.8, 2, 3, 5, 3, 3, 1)], [], [], [], []))
    assert {r["id"]: r["score"] for r in alone.collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
