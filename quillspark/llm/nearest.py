"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits at the median of its sample's projections onto
the difference of two of its points. Every vector of the table is dealt to one leaf of each tree.
A query walks all trees through one priority queue: the branch passed over with the smallest
margin comes next, whichever tree it is in, until enough leaves are opened. How many that takes is
measured on the sample, whose exact neighbours are known: as many as reach ``RECALL``. The
candidates in those leaves are ranked exactly. Equal vectors are one candidate that keeps as many of its
smallest ids as a result can show, so copies weigh nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import BLOB, RANGE, Scratch, blob_frame, gather, mix, scatter, share_of, together, unpack

K = 10
TREES = 6
#: Vectors in a leaf, about; as far as the sample allows.
LEAF = 256
#: The share of true neighbours that the opened leaves are to hold, on as many queries drawn from the sample.
RECALL, TRIALS = 0.97, 96
#: Vectors that the trees are fitted on, at most, and how many of them a leaf needs.
SAMPLE, SAMPLE_LEAF = 65_536, 16
SEED = 5
QUERY_EVERY = 100
#: Finds, a few of each query for each part of a leaf that it opens, that are merged at once, about.
FINDS_PER_PART = 500_000
#: Copies of query vectors, one for each part of a leaf that is opened, made at once.
OPENED = 131_072
#: Vectors of a leaf in one task, about; larger leaves are dealt to several, and their queries to all of these.
LEAF_ROWS = 20_000
#: Queries that meet a leaf's vectors in one task, about; if more open a leaf, its vectors go to several tasks.
LEAF_QUERIES = 50_000


class Forest:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED):
        r = np.random.default_rng(seed)
        inner, dims = 2**depth - 1, sample.shape[1]
        self.depth = depth
        self.planes, self.cuts = np.zeros((trees, inner, dims)), np.zeros((trees, inner))
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                own = members.pop(node)
                plane = r.normal(size=dims)
                for _ in range(5):
                    if len(own) > 1:
                        a, b = sample[r.choice(own, 2, replace=False)]
                        if (a != b).any():
                            plane = a - b
                            break
                plane /= np.linalg.norm(plane)
                at = sample[own] @ plane
                cut = float(np.median(at)) if len(own) else 0.0
                self.planes[t, node], self.cuts[t, node] = plane, cut
                members[2 * node + 1], members[2 * node + 2] = own[at < cut], own[at >= cut]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("nd,nd->n", x, self.planes[tree, node]) >= self.cuts[tree, node])
        return node - (2**self.depth - 1)

    def search(self, x: np.ndarray, probes: int) -> list[int]:
        """The parts (tree by leaf) that one query opens, nearest margin first over all trees."""
        inner, out = 2**self.depth - 1, []
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        while queue and len(out) < probes:
            margin, t, node = heapq.heappop(queue)
            while node < inner:
                off = float(x @ self.planes[t, node] - self.cuts[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if off >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(margin, abs(off)), t, far))
                node = near
            out.append(t * 2**self.depth + node - inner)
        return out


def probes_for(forest: Forest, points: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """How many leaves a query must open to find this share of its k nearest neighbours among the sample."""
    trees, size = len(forest.planes), 2**forest.depth
    leaf = np.stack([t * size + forest.leaves(points, t) for t in range(trees)])
    found = []
    for q in np.random.default_rng(SEED).permutation(len(points))[:trials]:
        near = np.argsort(((points - points[q]) ** 2).sum(1), kind="stable")[: k + 1]
        near = near[near != q][:k]
        turn = np.empty(trees * size, np.int64)
        turn[forest.search(points[q], trees * size)] = np.arange(trees * size)
        found.append(turn[leaf[:, near]].min(0) + 1)
    turns = np.sort(np.concatenate(found))
    return int(turns[min(len(turns) - 1, math.ceil(recall * len(turns)) - 1)]) if len(turns) else trees * size


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def _index(forest: Forest, trees: int, keep: int, salts: int, blocks: int):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, ids = _matrix(f["embedding"]), np.full((len(f), keep), -1, np.int64)
                for i, own in enumerate(f["ids"]):
                    ids[i, : len(own)] = sorted(own)
                for t in range(trees):
                    part = (t * 2**forest.depth + forest.leaves(x, t)) * salts + ids[:, 0] % salts
                    for block in range(blocks):
                        yield blob_frame(scatter(part * blocks + block, x, ids))

    return go


def _open(forest: Forest, probes: int, salts: int, blocks: int):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_once = max(1, OPENED // (min(probes, len(forest.planes) * 2**forest.depth) * salts))
        for whole in frames:
            for start in range(0, len(whole), at_once):
                f = whole.iloc[start : start + at_once]
                x, ids = _matrix(f["embedding"]), f["query"].to_numpy(np.int64)
                opened = [forest.search(v, probes) for v in x]
                row = np.repeat(np.arange(len(f)), [len(o) * salts for o in opened])
                part = (np.concatenate(opened)[:, None] * salts + np.arange(salts)).ravel()
                yield blob_frame(scatter(part * blocks + (mix(ids[row].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64), x[row], ids[row]))

    return go


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, from the differences themselves: exact for equal vectors, and the same whatever else is in the leaf."""
    return np.sqrt(((x - q) ** 2).sum(1))


def _rank(dims: int, keep: int, parts: int):
    """The best of a leaf for each query that opened it, packed by the part of the query."""

    def go(queries: pd.DataFrame, leaf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(leaf):
            blobs = [unpack(b) for b in leaf["blob"]]
            x, ids = np.concatenate([b[0].reshape(-1, dims) for b in blobs]), np.concatenate([b[1].reshape(-1, keep) for b in blobs])
            for blob in queries["blob"]:
                flat, names = unpack(blob)
                for q, name in zip(flat.reshape(-1, dims), names, strict=True):
                    d = distances(q, x)
                    best = np.lexsort((ids[:, 0], d))[:keep]
                    each = (ids[best] >= 0).sum(1)
                    own, score = ids[best][ids[best] >= 0], np.repeat(d[best], each)
                    first = np.lexsort((own, score))[:keep]
                    found.append((np.full(len(first), name), own[first], score[first]))
        if not found:
            return blob_frame([])
        query, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return blob_frame(scatter(query % parts, query, vec, score))

    return go


def _merge(keep: int):
    """Of what the leaves found for each query, every vector once, the best first."""

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        query, vec, score = gather(frame["blob"])
        order = np.lexsort((vec, score, query))
        query, vec, score = query[order], vec[order], score[order]
        new = np.ones(len(query), bool)  # copies of a candidate have one distance, so they are neighbours
        new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
        query, vec, score = query[new], vec[new], score[new]
        head = np.flatnonzero(np.diff(query, prepend=query[0] - 1))
        nth = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
        return pd.DataFrame({"query": query[nth < keep], "vec_id": vec[nth < keep], "score": score[nth < keep]})

    return go


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding``: vectors that are neither null, empty nor zero, all components finite; one for each vec_id.

    Of rows that share a vec_id the one that comes first by its components counts.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def commonest_length(vectors: DataFrame) -> int:
    """The number of components that most vectors have, the larger of equals; 0 without vectors."""
    found = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def query_blocks(queries: int, probes: int, leaves: int, most: int) -> int:
    """Into how many blocks queries are dealt, so that about ``most`` of them are in a group that holds a part of a leaf."""
    return max(1, math.ceil(queries * min(probes, leaves) / leaves / most))


def merge_parts(queries: int, opened: int, keep: int) -> int:
    """Into how many parts queries go whose finds are merged, when each finds ``keep`` in every part of a leaf that it opens."""
    return max(1, math.ceil(queries * opened * keep / FINDS_PER_PART))


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, probes: int | None = None, sample: int = SAMPLE, leaf_queries: int = LEAF_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found for each query, nearest first, ties to the smaller vec_id.

    ``probes`` is the number of leaves that a query opens, by default what the sample asks for.
    ``queries`` are rows of the same table; a query is no candidate of its own. Unusable vectors
    (see ``usable``), and vectors and queries of another length than most vectors have, take no part. Rows that share
    a vec_id are one vector. Other columns are not looked at. No usable vector: no rows.
    """
    scratch, keep = Scratch(spark, "nearest"), k + 1
    v = scratch.save(usable(vectors), "usable")
    dims = commonest_length(v)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    first = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    distinct = v.where(F.size("embedding") == dims).withColumn("nth", first).where(F.col("nth") <= keep).groupBy("embedding").agg(F.collect_list("vec_id").alias("ids"))
    distinct = scratch.save(distinct, "distinct")
    n = distinct.count()
    chance = F.pmod(F.xxhash64(F.array_min("ids")), F.lit(RANGE)) < share_of(sample, n)
    drawn = distinct.where(chance).select("embedding", F.array_min("ids").alias("id")).toPandas().sort_values("id")  # about ``sample`` rows, whatever the table's size
    if not len(drawn):
        return spark.createDataFrame([], schema)
    points = _matrix(drawn["embedding"])
    depth = max(0, min(math.ceil(math.log2(max(1, n / leaf))), int(math.log2(max(1, len(points) / SAMPLE_LEAF)))))
    forest, salts = Forest(points, depth, trees), max(1, math.ceil(n / 2**depth / LEAF_ROWS))
    probes = probes or probes_for(forest, points, k)

    asked = scratch.save(usable(queries).where(F.size("embedding") == dims), "asked")
    of = asked.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    blocks = query_blocks(of.count(), probes, trees * 2**depth, leaf_queries)
    opened = of.mapInPandas(_open(forest, probes, salts, blocks), BLOB)
    index = distinct.mapInPandas(_index(forest, trees, keep, salts, blocks), BLOB)
    parts = merge_parts(asked.count(), min(probes, trees * 2**depth) * salts, keep)
    found = together(opened, index, "part", _rank(dims, keep, parts), BLOB)
    near = found.groupBy("part").applyInPandas(_merge(keep), "query long, vec_id long, score double")
    out = asked.join(of, "embedding").select(F.col("vec_id").alias("query_id"), "query").join(near, "query").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(spark, v, v.where(F.col("vec_id") % QUERY_EVERY == 0))
