"""Graphs as edge tables: topic links, PageRank, personalised walks, related items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..lineage import keep, small


def topic_index(bridge: DataFrame) -> DataFrame:
    """``item, topics, n``: the topics of each item in order. Rows without an item, null or -1, are left out."""
    return bridge.where("item IS NOT NULL AND item <> -1").distinct().groupBy("item").agg(F.array_sort(F.collect_list("topic")).alias("topics"), F.count("*").alias("n"))


def shared_edges(bridge: DataFrame) -> DataFrame:
    """``src, dst, w, p``: items that share topics, how many, and the share of all that go out of src.

    The result holds every such pair, so a topic of m items costs m * m rows: for topics of bounded
    size. ``personalised_pagerank`` and ``topic_pagerank`` walk over the bridge itself instead.
    """
    b = bridge.distinct()
    pairs = b.join(b.withColumnRenamed("item", "dst"), "topic").where("item <> dst").groupBy(F.col("item").alias("src"), "dst").agg(F.count("*").alias("w"))
    return pairs.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("src")))


def topic_pagerank(bridge: DataFrame, iterations: int = 25, damping: float = 0.85) -> DataFrame:
    """``item, pagerank``: each topic hands its members the mean rank of the others; ranks sum to 1 after each round.

    A round joins the bridge with the ranks, never pairs of items, and is written. An empty bridge gives no rows.
    """
    b = bridge.distinct()
    size = b.agg(F.count_distinct("item").alias("n"), F.count_distinct("topic").alias("t")).first()
    pr = b.select("item").distinct().withColumn("pr", F.lit(1.0 / max(size["n"], 1)))
    b = keep(b.join(b.groupBy("topic").agg(F.count("*").alias("m")), "topic").where("m >= 2"), "bridge")
    for _ in range(iterations if size["n"] else 0):
        # a topic's sum goes to all its members, less what each brought itself
        sums = b.join(pr, "item").groupBy("topic", "m").agg(F.sum("pr").alias("s"))
        given = b.join(pr, "item").join(sums.drop("m"), "topic").groupBy("item").agg(F.sum((F.col("s") - F.col("pr")) / (F.col("m") - 1)).alias("g"))
        new = keep(pr.join(given, "item", "left").select("item", ((1 - damping) / size["n"] + damping * F.coalesce("g", F.lit(0.0)) / size["t"]).alias("pr")), "ranks")
        total = new.agg(F.sum("pr").alias("all"))
        pr = new.join(F.broadcast(total)).select("item", (F.col("pr") / F.col("all")).alias("pr"))
    return pr.select("item", F.col("pr").alias("pagerank"))


def _until_settled(state: DataFrame, step, rounds: int, tolerance: float) -> DataFrame:
    """``seed, item, score`` after so many steps, or after the first that moves a seed's scores by less than ``tolerance`` in all.

    Every step is a written table; seeds that have settled are set aside.
    """
    done = None
    for i in range(rounds):
        new = keep(step(state), "walk")
        signed = new.select("seed", "item", "score").unionByName(state.select("seed", "item", (-F.col("score")).alias("score")))
        moved = signed.groupBy("seed", "item").agg(F.sum("score").alias("d")).groupBy("seed").agg(F.sum(F.abs("d")).alias("d"))
        settled = keep(moved.where(F.col("d") < tolerance).select("seed"), "settled")
        if i < rounds - 1:
            state, new = new.join(settled, "seed", "left_anti"), new.join(settled, "seed", "left_semi")
        done = new if done is None else done.unionByName(new)
        if i < rounds - 1 and state.isEmpty():
            break
    return done


def personalised_pagerank(bridge: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float = 1e-4, least: float = 1e-8, k: int = 200) -> DataFrame:
    """``seed, item, score, rank``: walks that return to each seed's items, all seeds in one table.

    ``seeds(seed, item, bias)`` with biases summing to 1. A step goes to an item by the number of
    topics shared; it is walked over ``bridge(item, topic)``: what an item holds is dealt to its topics, and
    every topic gives its sum to each member, less the member's own parts. So no pairs of items are made, and what
    is shuffled are sums by seed and topic and one row for each seed and item.
    """
    b = bridge.distinct()
    b = b.withColumn("m", F.count("*").over(W.partitionBy("topic"))).where("m >= 2")
    b = keep(b.select("item", "topic", "m"), "bridge")
    own = keep(b.groupBy("item").agg(F.sum(F.col("m") - 1).alias("out"), F.count("*").alias("n")), "out")
    home = seeds.select("seed", "item", ((1 - damping) * F.col("bias")).alias("score"))

    def step(state: DataFrame) -> DataFrame:
        # Merged on purpose: compressed, these tables look small enough to be broadcast through the driver.
        given = keep(state.join(own.hint("merge"), "item").select("seed", "item", (F.col("score") / F.col("out")).alias("part"), "n"), "given")
        sums = keep(given.join(b.select("item", "topic").hint("merge"), "item").groupBy("seed", "topic").agg(F.sum("part").alias("all")), "sums")
        # dealt by item before it meets the sums, so that what an item gets is added up where it is
        reach = b.select("item", "topic").repartition("item").join(small(sums), "topic").groupBy("seed", "item").agg(F.sum("all").alias("got"))
        back = given.select("seed", "item", (-F.col("part") * F.col("n")).alias("got"))
        moved = reach.unionByName(back).groupBy("seed", "item").agg(F.sum("got").alias("got")).select("seed", "item", (damping * F.greatest("got", F.lit(0.0))).alias("score"))
        return moved.unionByName(home.join(state.select("seed").distinct(), "seed", "left_semi")).groupBy("seed", "item").agg(F.sum("score").alias("score"))

    found = _until_settled(seeds.select("seed", "item", F.col("bias").alias("score")), step, rounds, tolerance)
    rows = found.where(F.col("score") > least).withColumn("score", F.round("score", 8))
    place = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("score"), "item"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def random_walk_with_restart(edges: DataFrame, sources: DataFrame, rounds: int = 15, restart: float = 0.85, prune: float = 1e-7, tolerance: float = 1e-5, k: int = 20) -> DataFrame:
    """``src, dst, score, rank``: where walks from each source are, with small steps pruned, which bounds the state; the source itself left out.

    ``edges(src, dst, p)``; sources without edges have no walk.
    """
    edges = keep(edges.select("src", "dst", "p"), "edges")
    return _restarting_walk(sources, edges.groupBy("src").agg(F.max("p").alias("most")), lambda items: edges, rounds, restart, prune, tolerance, k)


def bridge_walk_with_restart(bridge: DataFrame, rounds: int = 15, restart: float = 0.85, prune: float = 1e-7, tolerance: float = 1e-5, k: int = 20, pairs: int = 20_000_000) -> DataFrame:
    """``random_walk_with_restart`` from every item over the edges of ``shared_edges``, which are never all there at once.

    Items are dealt into slices of about ``pairs`` pairs. A first pass finds the heaviest edge of each item, a second one
    walks from the items of a slice; edges are counted anew for the items that a step goes on from. Each slice is a written table.
    """
    b = bridge.distinct()
    lists = keep(b.where("item IS NOT NULL AND topic IS NOT NULL").groupBy("topic").agg(F.collect_list("item").alias("items")).where(F.size("items") >= 2).select("items"), "lists")
    each = lambda kept: lists.select(F.explode(kept).alias("src"), "items")
    out = keep(each(F.col("items")).groupBy("src").agg(F.sum(F.size("items") - 1).alias("out")), "out")
    slices = max(1, -(-(out.agg(F.sum("out")).first()[0] or 0) // pairs))
    slice_of = lambda c: F.pmod(F.xxhash64(c), F.lit(slices))

    def weighed(rows: DataFrame) -> DataFrame:
        counted = rows.select("src", F.explode("items").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
        return counted.join(out.hint("merge"), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p"))

    def part(i: int) -> DataFrame:
        return keep(weighed(each(F.filter("items", lambda x: slice_of(x) == i))), "edges")

    def walked(i: int) -> DataFrame:
        mine = whole or part(i)

        def edges_of(items: DataFrame) -> DataFrame:
            far = keep(items.where(slice_of("item") != i), "far")
            return mine if far.isEmpty() else mine.unionByName(weighed(each(F.col("items")).join(small(far), F.col("src") == F.col("item"), "left_semi")))

        mine_only = b.select("item").distinct().where(slice_of("item") == i)
        return keep(_restarting_walk(mine_only, most, edges_of, rounds, restart, prune, tolerance, k), "walked")

    whole = part(0) if slices == 1 else None
    most = reduce(DataFrame.unionByName, [keep((whole or part(i)).groupBy("src").agg(F.max("p").alias("most")), "most") for i in range(slices)])
    return reduce(DataFrame.unionByName, [walked(i) for i in range(slices)])


def _restarting_walk(sources: DataFrame, most: DataFrame, edges_of, rounds: int, restart: float, prune: float, tolerance: float, k: int) -> DataFrame:
    """Pruned walks. Items none of whose edges would pass, by the heaviest in ``most(src, most)``, are left out before the others meet their edges."""
    start = sources.select(F.col("item").alias("seed"), "item", F.lit(1.0).alias("score"))
    part = lambda p: (1 - restart) * F.col("score") * F.col(p)

    def step(state: DataFrame) -> DataFrame:
        goes = state.where(F.col("score") >= prune).join(most, state.item == most.src).where(part("most") > prune).select("seed", "item", "score")
        goes = keep(goes, "goes")
        moved = goes.join(edges_of(goes.select("item").distinct()), F.col("item") == F.col("src")).select("seed", F.col("dst").alias("item"), part("p").alias("score")).where(F.col("score") > prune)
        home = state.select("seed").distinct().select("seed", F.col("seed").alias("item"), F.lit(restart).alias("score"))
        return moved.unionByName(home).groupBy("seed", "item").agg(F.sum("score").alias("score"))

    rows = _until_settled(start, step, rounds, tolerance).where(F.col("score") > 1e-8)
    rows = rows.where("seed <> item").select(F.col("seed").alias("src"), F.col("item").alias("dst"), F.round("score", 8).alias("score"))
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def query_walk(seeds: DataFrame, relations: list[DataFrame], alpha: float = 0.8, iterations: int = 2) -> DataFrame:
    """``query_id, id, score``: a walk from a query's results over several relations, the greatest score 1.

    ``seeds(query_id, id, weight)``; each relation is ``(src, id, w)``, and of parallel edges the heaviest counts.
    """
    edges = relations[0]
    for r in relations[1:]:
        edges = edges.unionByName(r)
    edges = edges.groupBy("src", "id").agg(F.max("w").alias("w"))
    edges = edges.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("src"))).select("src", F.col("id").alias("to"), "p")
    start = seeds.withColumn("s", F.col("weight") / F.sum("weight").over(W.partitionBy("query_id"))).select("query_id", "id", "s")
    state = start
    for _ in range(iterations):
        moved = state.join(edges, state.id == edges.src).select("query_id", F.col("to").alias("id"), (alpha * F.col("s") * F.col("p")).alias("s"))
        state = moved.unionByName(start.withColumn("s", (1 - alpha) * F.col("s"))).groupBy("query_id", "id").agg(F.sum("s").alias("s"))
    best = F.max("s").over(W.partitionBy("query_id"))
    return state.select("query_id", "id", F.round(F.col("s") / best, 6).alias("score"))


def profiled_walk(seeds: DataFrame, profiles: DataFrame, edges: DataFrame, asked: DataFrame, members: DataFrame, walks: DataFrame, least: int = 3) -> DataFrame:
    """``query_id, id, score``: a walk from each query's results by that query's own profile, the greatest score 1; all queries in one table.

    ``profiles(query_id, damping, hops, rounds, seeds, neighbours, references, topic_edges)``; ``seeds(query_id, id, weight)``, of
    which the heaviest ``seeds`` count; with fewer than ``least`` a query does not walk, nor without a profile.
    ``edges(kind, src, id, w, n)``: the n-th edge of an item, ``near`` or ``reference``, as far as the profile asks for. Topics that
    a query asks for, ``asked(query_id, topic)``, lead from their ``members(item, topic)`` to the first items of
    ``walks(topic, item, score, rank)``. Of parallel edges the heaviest counts. The frontier of a query grows by its hops; what
    lies beyond has no way out. A query rests after its rounds. Each hop and round is a written table.
    """
    p = keep(profiles, "profiles")
    most = p.agg(F.coalesce(F.max("hops"), F.lit(0)), F.coalesce(F.max("rounds"), F.lit(0))).first()
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "id"))
    per = W.partitionBy("query_id")
    start = seeds.where("weight > 0").withColumn("place", place).join(p.select("query_id", "seeds"), "query_id").where("place <= seeds")
    start = start.withColumn("count", F.count("*").over(per)).where(F.col("count") >= least)
    start = keep(start.select("query_id", "id", (F.col("weight") / F.sum("weight").over(per)).alias("s")), "seeds")
    edges, walks, members = keep(edges.where("w > 0"), "edges"), keep(walks, "walks"), members.select(F.col("item").alias("src"), "topic").distinct()

    def out_of(frontier: DataFrame) -> DataFrame:
        f = frontier.withColumnRenamed("id", "src").join(p, "query_id")
        plain = f.join(edges, "src").where(F.col("n") <= F.when(F.col("kind") == "near", F.col("neighbours")).otherwise(F.col("references"))).select("query_id", "src", "id", "w")
        first = walks.where(F.col("score") > 0).select("topic", F.col("item").alias("id"), (0.55 * F.sqrt("score")).alias("w"), "rank")
        by = f.where("topic_edges > 0").join(asked.distinct(), "query_id").join(members, ["src", "topic"]).join(first, "topic").where("rank <= topic_edges + 1 AND id <> src")
        nth = F.row_number().over(W.partitionBy("query_id", "src", "topic").orderBy("rank"))
        topical = by.withColumn("nth", nth).where("nth <= topic_edges").select("query_id", "src", "id", "w")
        found = plain.unionByName(topical).groupBy("query_id", "src", "id").agg(F.max("w").alias("w"))
        return found.select("query_id", "src", F.col("id").alias("to"), (F.col("w") / F.sum("w").over(W.partitionBy("query_id", "src"))).alias("p"))

    visited = frontier = start.select("query_id", "id")
    ways = None
    for hop in range(most[0]):
        frontier = frontier.join(p.where(F.col("hops") > hop).select("query_id"), "query_id", "left_semi")
        found = keep(out_of(frontier), "ways")
        ways = found if ways is None else ways.unionByName(found)
        frontier = found.select("query_id", F.col("to").alias("id")).distinct().join(visited, ["query_id", "id"], "left_anti")
        if hop < most[0] - 1:
            frontier = keep(frontier, "frontier")
            visited = visited.unionByName(frontier)
    moving = start.join(p.select("query_id", "damping", "rounds"), "query_id")
    home = moving.select("query_id", "id", "damping", "rounds", ((1 - F.col("damping")) * F.col("s")).alias("s"))
    state, rested = moving.select("query_id", "id", "damping", "rounds", "s"), None
    for i in range(most[1] + 1):
        still = state.where(F.col("rounds") <= i).select("query_id", "id", "s")
        rested = still if rested is None else rested.unionByName(still)
        if i == most[1]:
            break
        goes = state.where(F.col("rounds") > i)
        new = home.where(F.col("rounds") > i)
        if ways is not None:
            moved = goes.withColumnRenamed("id", "src").join(ways, ["query_id", "src"])
            new = new.unionByName(moved.select("query_id", F.col("to").alias("id"), "damping", "rounds", (F.col("damping") * F.col("s") * F.col("p")).alias("s")))
        state = keep(new.groupBy("query_id", "id", "damping", "rounds").agg(F.sum("s").alias("s")), "walk")
    best = F.max("s").over(per)
    return rested.where("s > 0").select("query_id", "id", F.round(F.col("s") / best, 6).alias("score"))


def related(similar: DataFrame, walks: DataFrame, shared: DataFrame, sizes: DataFrame, group: DataFrame, ranks: DataFrame, topic_walks: DataFrame, k: int = 10) -> DataFrame:
    """``src, dst, score, rank``: similarity, walks, shared sets, topic walks and rank in one score, items of the same group left out.

    ``similar(src, dst, similarity)``, ``walks(src, dst, score)``, ``shared(src, dst, w)``: how many topics two items share, none if absent, ``sizes(item, n)``: of how many, ``group(item, g)``,
    ``ranks(item, pagerank)``, ``topic_walks(src, dst, ppr)``: the best walk from one of the source's topics. What only a walk reaches counts by the walk.
    """
    rows = similar.join(walks.select("src", "dst", F.col("score").alias("walk")), ["src", "dst"], "full").join(topic_walks, ["src", "dst"], "left")
    # Counts, not the sets themselves: a row of two sets would be as wide as both.
    side = lambda x, y: sizes.select(F.col("item").alias(x), F.col("n").alias(y))
    rows = rows.join(shared.select("src", "dst", F.col("w").alias("both")), ["src", "dst"], "left").join(side("src", "a"), "src", "left").join(side("dst", "b"), "dst", "left").join(ranks.withColumnRenamed("item", "dst"), "dst", "left")
    both = F.coalesce("both", F.lit(0))
    union = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) - both
    jaccard = F.when(union > 0, both / union).otherwise(0.0)
    walk = F.coalesce("walk", F.lit(0.0))
    shared = 0.15 * both + 0.5 * jaccard + 2000.0 * F.coalesce("pagerank", F.lit(0.0))
    score = F.when(F.col("similarity").isNull(), 3 * walk + shared).otherwise(F.col("similarity") + 2 * walk + shared + 0.5 * F.coalesce("ppr", F.lit(0.0)))
    rows = rows.select("src", "dst", F.round(score, 6).alias("score"))
    of = lambda c, x: group.select(F.col("item").alias(c), F.col("g").alias(x))
    rows = rows.join(of("src", "g"), "src", "left").join(of("dst", "h"), "dst", "left").where("g IS NULL OR h IS NULL OR g <> h").drop("g", "h")
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def affinity(history: DataFrame, member: DataFrame, prior: DataFrame, topics: DataFrame, walks: DataFrame, last: int = 100, top: int = 5, near: int = 30, k: int = 20) -> DataFrame:
    """``session, item, score, rank``: unread items of the groups and topics that a session read most of late, and by prior.

    ``history(session, item, ts)``, ``member(item, g, distance)``: of a group the ``near`` nearest to its middle count,
    by 0.6 of the group's share; ``topics(item, topic)`` and ``walks(topic, item, score)`` give 0.4 of the walks from
    the topics of the last 30 items; ``prior(item, prior)`` fills up with 0.2.
    """
    w = W.partitionBy("session")
    seen = history.groupBy("session", "item").agg(F.max("ts").alias("ts")).withColumn("n", F.row_number().over(w.orderBy(F.desc("ts"), "item")))
    seen = keep(seen, "seen")
    groups = seen.where(F.col("n") <= last).join(member.select("item", "g"), "item").groupBy("session", "g").agg(F.count("*").alias("c"))
    groups = groups.withColumn("r", F.row_number().over(w.orderBy(F.desc("c"), "g"))).where(F.col("r") <= top).withColumn("share", F.col("c") / F.max("c").over(w))
    middle = member.withColumn("m", F.row_number().over(W.partitionBy("g").orderBy("distance", "item"))).where(F.col("m") <= near)
    by_group = groups.join(middle, "g").select("session", "item", (0.6 * F.col("share") * F.greatest(F.lit(0.0), 1 - F.col("distance"))).alias("part"))
    named = seen.where("n <= 30").join(topics.distinct(), "item").select("session", "topic").distinct()
    by_topic = named.join(walks, "topic").groupBy("session", "item").agg((0.4 * F.sum("score")).alias("part"))
    filler = seen.select("session").distinct().join(small(prior.orderBy(F.desc("prior"), "item").limit(100))).select("session", "item", (0.2 * F.col("prior")).alias("part"))
    rows = by_group.unionByName(by_topic).join(seen.select("session", "item"), ["session", "item"], "left_anti").groupBy("session", "item").agg(F.sum("part").alias("score"))
    filler = filler.join(seen.select("session", "item"), ["session", "item"], "left_anti").join(rows, ["session", "item"], "left_anti").withColumnRenamed("part", "score")
    rows = rows.unionByName(filler).withColumn("score", F.round("score", 9))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)
