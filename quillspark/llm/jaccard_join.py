"""N-gram Jaccard join with vertical partitioning.

A document is the set of its word shingles. All shingles have one global order, rare ones first.
Sets that can have a partner at all (three quarters of their shingles occur elsewhere) are cut by
the fragments of that order, and each fragment of a set is a row of its own. A candidate pair meets
fragment by fragment, each in its own place of the cluster: partial overlaps are counted there and
summed by pair. No task needs a whole set of a pair.

Candidates share a shingle of their prefixes, as usual. They are not all written out: in the first
rounds every shingle's documents are paired with a pivot only, which joins most groups of near
copies; then what shares a prefix shingle, is of like size and is not known to hang together is
paired. Pairs known to hang together cannot change the result and are never made, so links are
complete between components and the components are exact. Equal sets are one node.

A shingle that ``HOT`` texts of one map chunk share is called hot and comes last in the order, by
value. Its documents learn that from the chunk itself, so its partition counts chunks, not documents.

Shingles are 64-bit hashes: two sets of n and m shingles take two different ones for one with a chance
of n * m / 2**64, which then counts as one more in common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOB, Scratch, blob_batch, blob_frame, by_key, chunks, column, connected, deal, dealt, keyed, mix, numbers, parts_for, rolling, scatter, tidily, to_rows, unpack, word_hashes

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
FRAGMENTS = 8
#: Texts of a map chunk that share a hot shingle, at least, and what its count is taken for.
HOT, HOT_COUNT = 8, 2**31 - 1
#: Characters of text behind a partition of shingles; its reducer holds them all, with their documents.
CHARS_PER_PART = 8_000_000
PIVOT_ROUNDS = 2
PROFILE = "rk long, doc_id long, n long, class_a long, class_b long, tokens binary, orders binary"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text; of a text with fewer words, the hash of all of them."""
    hashes, starts = word_hashes(pc.ascii_lower(texts))
    rolled = mix(rolling(hashes, size))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield mix(rolling(hashes[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield hashes[:0]


def _deal(size: int, parts: int):
    """Shingles go to the parts below ``parts`` by value; hot ones and the documents to the others, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                sets = list(shingle_sets(column(batch, "text"), size))
                n = np.array([len(s) for s in sets], np.int64)
                keys, checks = numbers(batch, "rk"), numbers(batch, "rc").astype(np.int8)  # 72 bits tell rows apart here
                ids = column(batch, "doc_id").fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(n)), n)
                if len(flat):
                    order = np.argsort(flat, kind="stable")
                    cuts = np.flatnonzero(np.diff(flat[order], prepend=flat[order[0]] ^ np.uint64(1)))
                    many = np.diff(np.append(cuts, len(flat)))
                    hot, mark = np.zeros(len(flat), bool), np.zeros(len(flat), np.uint8)
                    hot[order] = np.repeat(many >= HOT, many)
                    mark[order[cuts[many >= HOT]]] = 1
                    out, none = ~hot | (mark > 0), np.zeros(len(flat), np.int64)
                    yield blob_batch(deal((flat[out] >> np.uint64(33)).astype(np.int64) % parts, owner[out], none[out], keys, checks, flat[out], mark[out]))
                    if hot.any():
                        yield blob_batch(deal(parts + keys[owner[hot]] % parts, owner[hot], none[hot], keys, checks, flat[hot], np.full(hot.sum(), HOT_COUNT, np.int32)))
                yield blob_batch(scatter(parts + keys % parts, keys, checks, n, ids))

    return run


def _count(parts: int):
    """Shingles of more than one document go on to their documents, with how many have them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        if part >= parts:  # documents and hot shingles pass through
            return blob_frame([(part - parts, blob) for blob in frame["blob"]])
        keys, checks, place, values, mark = dealt(frame["blob"])
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.diff(values[order], prepend=values[order[0]] ^ np.uint64(1)))
        n = np.diff(np.append(cuts, len(values)))
        total = np.where(np.maximum.reduceat(mark[order], cuts) > 0, HOT_COUNT, n)
        count = np.zeros(len(values), np.int32)
        count[order] = np.repeat(total, n)
        tell = (count > 1) & (mark == 0)
        return blob_frame(to_rows(parts, keys[tell], checks[tell], place[tell], values[tell], count[tell]) if tell.any() else [])

    return run


def _profile(percent: int):
    """One row per document; with its repeated shingles, rarest first, if a partner can exist, and the binary orders of their counts."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs, have = [], []
        for blob in frame["blob"]:
            arrays = unpack(blob)
            if len(arrays) == 4:
                docs.append(arrays)
            else:
                have.append(blob)
        at, rows, none = by_key(*dealt(have)) if have else {}, [], (None, np.zeros(0, np.uint64), np.zeros(0, np.int32))
        for key, check, size, doc in (x for d in docs for x in zip(*d, strict=True)):
            _, own, counts = at.get((int(key), int(check)), none)
            if size and 100 * len(own) >= percent * size:
                order = np.lexsort((own, counts))
                own, counts = own[order], counts[order]
                first = np.ones(len(own), bool)  # rows that share a key bring every shingle once each
                first[1:] = own[1:] != own[:-1]
                own, counts = own[first], counts[first]
            if size and 100 * len(own) >= percent * size:
                full = len(own) == size  # only then an equal set can exist
                h = [mix(own ^ np.uint64(x)).sum().astype(np.int64) for x in (1, 2)] if full else [np.int64(key), np.int64(doc)]
                rows.append((key, doc, size, h[0], h[1], own.tobytes(), np.log2(counts).astype(np.uint8).tobytes()))
            else:
                rows.append((key, doc, size, np.int64(key), np.int64(doc), None, None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PROFILE.split(", ")])

    return run


def _postings(percent: int):
    """The prefix of each set: shingles of which a partner must have one. Those that are nowhere else come first and need no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for node, n, raw in zip(f["node"], f["n"], f["tokens"], strict=True):
                tokens = np.frombuffer(raw, np.int64)
                prefix = n - -(-percent * n // 100) + 1 - (n - len(tokens))
                own = tokens[: max(prefix, 0)]
                out.append(pd.DataFrame({"token": own, "node": node, "n": n, "shared": len(tokens), "place": n - len(tokens) + np.arange(len(own))}))
            yield pd.concat(out) if out else pd.DataFrame({"token": [], "node": [], "n": [], "shared": [], "place": []})

    return run


def _fragments(cuts: list[int]):
    """Each set cut at the places ``cuts`` of the global order, a row for each fragment that holds some of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for node, raw, orders in zip(f["node"], f["tokens"], f["orders"], strict=True):
                tokens = np.frombuffer(raw, np.int64)
                piece = np.searchsorted(np.array(cuts), _place(tokens, np.frombuffer(orders, np.uint8)), "right")
                out += [(node, p, tokens[piece == p]) for p in np.unique(piece)]
            yield pd.DataFrame(out, columns=["node", "fragment", "own"])

    return run


def _place(tokens: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """A coarse place in the global order: the binary order of the count, then the first bits of the shingle."""
    return (orders.astype(np.int64) << 6) + (tokens.view(np.uint64) >> np.uint64(58)).astype(np.int64)


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(64 << 6, np.int64)
    for f in batches:
        for raw, orders in zip(f["tokens"], f["orders"], strict=True):
            total += np.bincount(_place(np.frombuffer(raw, np.int64), np.frombuffer(orders, np.uint8)), minlength=len(total))
    has = np.flatnonzero(total)
    yield pd.DataFrame({"place": has, "tokens": total[has]})


def _labels(links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node within two links, and that one's. Nodes of one label hang together; not all that do have one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    far = both.join(near.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("label")).alias("label"))
    return far.join(far.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS, by_row: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, rk``.

    A document's links are not counted: pairs inside a component are never made. Texts without
    words, empty and null have no shingles and link with nothing. Rows that share a doc_id are one vertex of the links; a null doc_id comes after all
    others. With ``by_row`` a vertex is a row, known by its ``row_key`` ``rk``: different texts under
    one or no doc_id stay apart, and ``component_id`` is the smallest key of the component.
    Other columns are not looked at. An empty table gives no rows.
    """
    scratch = Scratch(spark, "jaccard")
    docs = keyed(docs)
    parts = parts_for(docs, CHARS_PER_PART)
    sent = docs.mapInArrow(tidily(_deal(size, parts)), BLOB).groupBy("part").applyInPandas(tidily(_count(parts)), BLOB)
    counted = scratch.save(sent, "counted")
    scratch.tidy()  # all shingles are behind it, what goes on is a third of them
    profiles = scratch.save(counted.groupBy("part").applyInPandas(tidily(_profile(percent)), PROFILE), "profiles").withColumn("vertex", F.col("rk" if by_row else "doc_id"))
    scratch.drop("counted")
    scratch.tidy()

    can = profiles.where("tokens IS NOT NULL")
    classes = can.groupBy("class_a", "class_b", "n").agg(F.min("vertex").alias("node"), F.count("*").alias("k"), F.min_by(F.struct("tokens", "orders"), "vertex").alias("s"))
    classes = scratch.save(classes.select("class_a", "class_b", "n", "node", "k", "s.tokens", "s.orders"), "classes")
    member = can.select("vertex", "class_a", "class_b", "n").join(classes.where("k > 1").select("class_a", "class_b", "n", "node"), ["class_a", "class_b", "n"])
    member = scratch.save(member.select("vertex", "node").where("vertex <> node").distinct(), "members")
    rows = scratch.save(profiles.select("rk", "doc_id", "vertex", F.col("n").alias("n_shingles")), "rows")
    scratch.drop("profiles")  # shingles live on in the classes, once for equal sets
    nodes = classes.select("node", "n", "tokens", "orders")

    postings = scratch.save(nodes.mapInPandas(tidily(_postings(percent)), "token long, node long, n long, shared long, place long"), "postings")
    histogram = nodes.mapInPandas(tidily(_places), "place long, tokens long").groupBy("place").agg(F.sum("tokens").alias("tokens")).orderBy("place").collect()  # 4096 rows at most
    run, cuts = np.cumsum([r["tokens"] for r in histogram]), []
    if len(run):
        cuts = sorted({int(histogram[int(np.searchsorted(run, run[-1] * i / fragments))]["place"]) for i in range(1, fragments)})
    pieces = scratch.save(nodes.mapInPandas(tidily(_fragments(cuts)), "node long, fragment int, own array<long>"), "fragments")
    scratch.drop("classes")
    scratch.tidy()

    def overlaps(pairs: DataFrame, name: str) -> DataFrame:
        """``a, b, na, nb, same``: what candidate pairs share, counted in each fragment by itself and summed."""
        left, right = pieces.select(F.col("node").alias("a"), "fragment", F.col("own").alias("left")), pieces.select(F.col("node").alias("b"), "fragment", F.col("own").alias("right"))
        partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).alias("same"))
        return scratch.save(partial.groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same")), name)

    def enough(same: F.Column) -> F.Column:
        return same * 100 >= percent * (F.col("na") + F.col("nb") - same)

    def ordered(pairs: DataFrame) -> DataFrame:
        """Each pair once, the smaller node first."""
        up = F.col("a") < F.col("b")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(up, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()

    # Linked sets share so many that their first common shingle lies early in both.
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    early = (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need)
    sized = early & (F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
    links, shared = None, []
    mine = postings.withColumn("own", F.col("node"))
    for i in range(PIVOT_ROUNDS):  # the documents of a shingle against one of them
        alone = (F.col("n") - F.col("shared")) / F.col("n")  # what copies are made of has few shingles to itself and is near to all of them
        rank = F.struct(alone, "node") if i == 0 else F.struct(-F.col("own"), alone, "node")
        pivot = mine.groupBy("token").agg(F.min(F.struct(rank, F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"), F.col("own").alias("oa"), F.col("place").alias("pa"))).alias("p"), F.count("*").alias("k"))
        pivot = scratch.save(pivot.where("k > 1").select("token", F.col("p.a").alias(f"pivot{i}"), "p.na", "p.sa", "p.oa", "p.pa"), f"pivots{i}")
        met = scratch.save(mine.join(pivot, "token"), f"met{i}")  # a shingle of one node pairs nothing, now or later
        for old in (f"pivots{i}", "postings" if i == 0 else f"own{i - 1}"):
            scratch.drop(old)
        pairs = met.where(f"pivot{i} <> node AND own <> oa").select(F.col(f"pivot{i}").alias("a"), F.col("node").alias("b"), "na", F.col("n").alias("nb"), "sa", F.col("shared").alias("sb"), "pa", F.col("place").alias("pb"))
        same = overlaps(ordered(pairs.where(sized & enough(F.least("sa", "sb")))), f"overlaps{i}")
        shared.append(same)
        found = same.where(enough(F.col("same"))).select("a", "b")
        links = found if links is None else links.union(found)
        label = scratch.save(_labels(links), f"labels{i}")
        mine = met.drop("own", "na", "sa", "oa", "pa").join(label, "node", "left").withColumn("own", F.coalesce("label", "node")).drop("label")
        mine = scratch.save(mine, f"own{i}")
        scratch.drop(f"met{i}")

    # What is left: what two sets share lies in a pivot, of which each has a known part, or outside it.
    split = mine.groupBy("token").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("token")
    open_ = mine.join(split, "token", "left_semi")
    for i in range(PIVOT_ROUNDS):
        known = shared[i].select("a", "b", F.col("same").alias(f"with{i}"))
        open_ = open_.withColumn("a", F.least("node", f"pivot{i}")).withColumn("b", F.greatest("node", f"pivot{i}"))
        open_ = open_.join(known, ["a", "b"], "left").withColumn(f"with{i}", F.when(F.col("node") == F.col(f"pivot{i}"), F.col("shared")).otherwise(F.col(f"with{i}"))).drop("a", "b", f"pivot{i}")
    band = F.floor(F.log("n") / (math.log(100 / percent) + 1e-9))  # linked sets are of one band or of neighbours
    open_ = scratch.save(open_.withColumn("band", band.cast("long")), "open")
    scratch.drop(f"own{PIVOT_ROUNDS - 1}")
    scratch.tidy()
    side = lambda x, bands: open_.select(F.col("token"), bands.alias("band"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}"), F.col("own").alias(f"o{x}"), F.col("place").alias(f"p{x}"), *[F.col(f"with{i}").alias(f"{x}{i}") for i in range(PIVOT_ROUNDS)])
    through = [F.least(F.col(f"a{i}") + F.col("sb") - F.col(f"b{i}"), F.col(f"b{i}") + F.col("sa") - F.col(f"a{i}")) for i in range(PIVOT_ROUNDS)]
    most = F.least("sa", "sb", *through)  # of those that are known
    left, right = side("a", F.col("band")), side("b", F.explode(F.array(*[F.col("band") + x for x in (-1, 0, 1)])))
    pairs = left.join(right, (left.token == right.token) & (left.band == right.band) & (F.col("a") < F.col("b")) & (F.col("oa") != F.col("ob")) & sized & enough(most))
    late = overlaps(ordered(pairs), "overlaps").where(enough(F.col("same"))).select("a", "b")
    of = label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))  # most links are in a label already
    edges = of.union(links).union(late).union(member.select(F.col("vertex").alias("a"), F.col("node").alias("b")))
    component = connected(edges, Scratch(spark, "components"))

    out = rows.join(component.withColumnRenamed("node", "vertex"), "vertex", "left")
    real = lambda c: F.nullif(c, F.lit(2**63 - 1))
    named = F.coalesce("component", "vertex")
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", (named if by_row else real(named)).alias("component_id"), "rk")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
