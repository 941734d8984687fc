"""Vector search and reduction. Vectors are arrays of floats; sums are in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import cosine, distance
from ..lineage import keep, small


#: The percentiles of a spread.
SHARES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def blocks(vectors: DataFrame, rows: int = 2_000) -> tuple[DataFrame, int]:
    """Vectors packed as ``components, block, rows``: a matrix of about so many rows each, all of one length; and how many blocks there are. Null vectors are left out."""
    v = vectors.where(F.col("v").isNotNull())
    n = max(1, v.count() // rows)
    keyed = v.select(F.size("v").alias("components"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "v")
    return keyed.groupBy("components", "block").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows")), n


def _sides(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Of batches ``left, right``, blocks of rows, the named columns of both: an array as a matrix of doubles."""

    def columns(block: pa.StructArray) -> list[np.ndarray]:
        parts = [block.field(n) for n in names]
        return [x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False) for x in parts]

    for batch in batches:
        for i in range(batch.num_rows):
            yield columns(batch.column(0)[i].values), columns(batch.column(1)[i].values)


def _block_pairs(queries: DataFrame, vectors: DataFrame, rows: int) -> DataFrame:
    """``left, right``: every block of queries with every block of vectors of the same length. ``v`` and whatever else beside ``id`` is kept."""
    def packed(frame: DataFrame, n: int) -> DataFrame:
        keyed = frame.select(F.size("v").alias("components"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), F.struct(*frame.columns).alias("row"))
        return keyed.groupBy("components", "block").agg(F.collect_list("row").alias("rows"))

    a, b = queries.where("v IS NOT NULL AND size(v) > 0"), vectors.where("v IS NOT NULL AND size(v) > 0")
    n = max(1, b.count() // rows)
    left = packed(a, max(1, a.count() // rows)).select("components", F.col("rows").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    return left.join(packed(b, n).select("components", "block", F.col("rows").alias("right")), ["components", "block"]).select("left", "right")


def similarity_counts(queries: DataFrame, vectors: DataFrame, rows: int = 8_000) -> DataFrame:
    """``value, n``: how many pairs of a query and another vector have a cosine of so many millionths.

    All pairs are looked at, two blocks at a time; a task hands on counts of at most 2,000,001 values, never pairs.
    """
    top = 1_000_001

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * top + 1, np.int64)
        unit = lambda m: m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) > 0, norm, 1)
        for (qi, q), (vi, v) in _sides(batches, ("id", "v")):
            q, v = unit(q), unit(v)
            step = max(1, 1_000_000 // len(v))
            for at in range(0, len(q), step):
                s = np.rint(np.round(q[at : at + step] @ v.T, 6) * 1e6)
                s = s[(qi[at : at + step, None] != vi[None, :]) & np.isfinite(s)].astype(np.int64) + top
                counts += np.bincount(s, minlength=len(counts))
        found = np.flatnonzero(counts)
        for at in range(0, len(found), 100_000):
            some = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((some - top).astype(np.int32)), pa.array(counts[some])], ["value", "n"])

    pairs = _block_pairs(queries.selectExpr("query_id AS id", "v"), vectors.select("id", "v"), rows)
    return pairs.mapInArrow(count, "value int, n long").groupBy("value").agg(F.sum("n").alias("n"))


def counted_spread(counts: DataFrame, unit: float = 1e6) -> DataFrame:
    """``spread`` of a column of which ``value``, in so many parts of one, and its number ``n`` are given: percentiles are interpolated as there."""
    c = counts.withColumn("end", F.sum("n").over(W.orderBy("value"))).withColumn("x", F.col("value") / unit)  # as many rows as there are values
    c = c.join(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    at = lambda i: F.max(F.when((F.col("end") - F.col("n") <= i) & (i < F.col("end")), F.col("x")))
    found = []
    for name, p in SHARES.items():
        place = F.lit(p) * (F.col("all") - 1)
        low, high = F.floor(place), F.ceil(place)
        share = F.max(place - low)
        found.append(F.round(at(low) * (1 - share) + at(high) * share, 6).alias(name))
    return c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.min("x"), 6).alias("least"), *found, F.round(F.max("x"), 6).alias("most"))


def top_similar(queries: DataFrame, vectors: DataFrame, k: int = 20, least: float | None = None, digits: int = 6) -> DataFrame:
    """``query_id, id, similarity, rank``: the k vectors of greatest cosine for each query, itself left out.

    Both sides are cut into blocks. A query block goes to every block of vectors; each pair is one matrix
    product, of which each query keeps its k best before anything else is shuffled. Memory is that of two blocks;
    the work is queries times vectors, so give a stated set of queries. Null vectors take no part, and
    vectors of different lengths are never compared.
    """
    a, _ = blocks(queries.selectExpr("query_id AS id", "v"))
    b, n = blocks(vectors)

    def unit(rows):
        m = np.array([np.asarray(r["v"], np.float64) for r in rows])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.array([r["id"] for r in rows]), m / np.where(norm > 0, norm, 1)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for left, right in zip(f["left"], f["right"], strict=True):
                (qi, q), (vi, v) = unit(left), unit(right)
                s = np.round(q @ v.T, digits)
                s[qi[:, None] == vi[None, :]] = -np.inf
                kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                i, j = np.nonzero((s >= kth[:, None]) & np.isfinite(s))  # k of each query, and their ties
                order = np.lexsort((vi[j], -s[i, j], i))
                i, j = i[order], j[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[nth < k], j[nth < k]
                yield pd.DataFrame({"query_id": qi[i], "id": vi[j], "similarity": s[i, j]})

    each = a.select("components", F.col("rows").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    pairs = each.join(b.select("components", "block", F.col("rows").alias("right")), ["components", "block"]).select("left", "right")
    found = pairs.mapInPandas(best, "query_id long, id long, similarity double")
    found = found.where(F.col("similarity") > least) if least is not None else found
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mean_vector(rows: DataFrame, key: str, v: str = "v", unit: bool = True) -> DataFrame:
    """The mean vector of each key, of length 1 if asked: components are averaged each by itself."""
    parts = rows.select(key, F.posexplode(v).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    made = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))
    if unit:
        norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x))
        made = made.withColumn("_norm", norm).withColumn("centroid", F.when(F.col("_norm") > 0, F.transform("centroid", lambda x: x / F.col("_norm"))).otherwise(F.col("centroid"))).drop("_norm")
    return made


def assign(vectors: DataFrame, centroids: DataFrame, k: int = 1) -> DataFrame:
    """``id, label, distance, rank``: the k nearest centroids of each vector. There are some thousands of centroids at most."""
    d = F.round(distance(F.col("v"), F.col("centroid")), 6)
    rows = vectors.select("id", "v").join(small(centroids.select("label", "centroid"), 5_000)).select("id", "label", d.alias("distance"))
    place = F.row_number().over(W.partitionBy("id").orderBy("distance", "label"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def expand(parents: DataFrame, edges: DataFrame, least: float = 0.25, direct: float = 0.2, k: int = 30) -> DataFrame:
    """``query_id, id, score, rank``: neighbours of a query's results, their edges damped by rank and averaged.

    ``parents(query_id, id, similarity)``, ``edges(src, id, similarity, rank)``; what is a parent already is left out.
    """
    p = parents.where(F.col("similarity") >= least).select("query_id", F.col("id").alias("src"))
    reach = p.join(edges, "src").where(F.col("similarity") >= direct).withColumn("w", F.col("similarity") * F.exp(-0.15 * (F.col("rank") - 1)))
    mean = reach.groupBy("query_id", "id").agg(F.round(F.avg("w"), 6).alias("score"))
    mean = mean.join(parents.select("query_id", "id"), ["query_id", "id"], "left_anti")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return mean.withColumn("rank", place).where(F.col("rank") <= k)


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How far two encodings of the same rows agree: cosine at its least, mean and 5th percentile."""
    c = rows.select(cosine(F.col(a), F.col(b)).alias("c"))
    return c.agg(F.count("*").alias("n"), F.round(F.min("c"), 6).alias("least"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.percentile("c", 0.05), 6).alias("p5"))


def neighbour_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """``query_id, shared, jaccard, same_first, same_order``: how far two encoders rank alike.

    Both sides are neighbours as ``top_similar`` gives them, over the same rows in two encodings. A query
    that one side lacks shares nothing; empty sides give no rows.
    """
    sides = first.select("query_id", "id", F.col("rank").alias("x"), F.lit(None).cast("int").alias("y")).union(second.select("query_id", "id", F.lit(None).cast("int"), "rank"))
    met = sides.groupBy("query_id", "id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    return met.groupBy("query_id").agg(
        both.alias("shared"),
        F.round(both / F.count("*"), 6).alias("jaccard"),
        F.coalesce(F.bool_or(same & (F.col("x") == 1)), F.lit(False)).alias("same_first"),
        F.bool_and(same).alias("same_order"),
    )


def spread(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, least, greatest and five percentiles of a column."""
    return rows.agg(F.count("*").alias("n"), F.round(F.min(value), 6).alias("least"), *[F.round(F.percentile(value, p), 6).alias(n) for n, p in SHARES.items()], F.round(F.max(value), 6).alias("most"))


def explained(vectors: DataFrame, marks: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64)) -> DataFrame:
    """``k, share``: how much of the variance the first k principal directions hold."""
    _, c, n = covariance(vectors)
    w = np.sort(np.linalg.eigvalsh(c))[::-1] if n else np.zeros(0)
    total = max(float(w.sum()), 1e-12)
    rows = [(k, round(float(w[:k].sum()) / total, 6)) for k in marks if k <= len(w)]
    return vectors.sparkSession.createDataFrame(rows, "k int, share double")


def as_ml(vectors: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))


def clusters(vectors: DataFrame, k: int, iterations: int = 30, seed: int = 42) -> DataFrame:
    """``id, cluster, distance``: k-means started from k-means||."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    rows = as_ml(vectors)
    model = KMeans(k=k, maxIter=iterations, seed=seed, initMode="k-means||").fit(rows)
    centres = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    out = model.transform(rows).withColumnRenamed("prediction", "cluster").join(F.broadcast(centres), "cluster")
    return out.select("id", F.col("cluster"), F.round(distance(vector_to_array("features"), F.col("centre")), 6).alias("distance"))


def covariance(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count; each task returns one d x d matrix, so what the driver sums does not grow with rows."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = c = None
        n = 0
        for f in frames:
            if len(f):
                m = np.array([np.asarray(v, np.float64) for v in f["v"]])
                s, c, n = m.sum(0) + (0 if s is None else s), m.T @ m + (0 if c is None else c), n + len(m)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "c": [c.tobytes()]})

    parts = vectors.where(F.col("v").isNotNull()).select("v").mapInPandas(partial, "n long, s binary, c binary")
    merged = parts.coalesce(64).mapInPandas(_add, "n long, s binary, c binary").collect()
    n = sum(r["n"] for r in merged)
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0
    s = sum(np.frombuffer(r["s"]) for r in merged)
    d = len(s)
    c = sum(np.frombuffer(r["c"]) for r in merged).reshape(d, d)
    mean = s / n
    return mean, c / n - np.outer(mean, mean), n


def _add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [f for f in frames if len(f)]
    if rows:
        f = pd.concat(rows)
        yield pd.DataFrame({"n": [int(f["n"].sum())], "s": [sum(np.frombuffer(x) for x in f["s"]).tobytes()], "c": [sum(np.frombuffer(x) for x in f["c"]).tobytes()]})


def projected(vectors: DataFrame, matrix: np.ndarray, mean: np.ndarray, unit: bool = True) -> DataFrame:
    """``id, v``: the vectors less the mean, times a matrix."""
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = (np.array([np.asarray(v, np.float64) for v in f["v"]]) - mean) @ matrix
                if unit:
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"id": f["id"].to_numpy(), "v": list(m)})

    return vectors.where(F.col("v").isNotNull()).select("id", "v").mapInPandas(go, "id long, v array<double>")


def whitened(vectors: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """Vectors turned so that their components are uncorrelated and of equal spread (ZCA), of length 1."""
    mean, c, n = covariance(vectors)
    if not n:
        return projected(vectors, c, mean)
    w, u = np.linalg.eigh(c)
    return projected(vectors, u @ np.diag(1 / np.sqrt(np.maximum(w, 0) + epsilon)) @ u.T, mean)


def principal(vectors: DataFrame, k: int) -> DataFrame:
    """Vectors in their first k principal directions, scaled as they are and of length 1 after."""
    mean, c, n = covariance(vectors)
    if not n:
        return projected(vectors, c, mean)
    w, u = np.linalg.eigh(c)
    return projected(vectors, u[:, np.argsort(-w)[:k]], mean)


def spectral(edges: DataFrame, k: int, iterations: int = 12, seed: int = 3) -> DataFrame:
    """``id, v``: the leading directions of the normalised adjacency matrix, rows of length 1.

    ``edges(a, b, w)`` symmetric. Subspace iteration: each step multiplies the edge table with a table
    of k-vectors (a join and a sum by node) and orthonormalises it with the k x k Gram matrix.
    """
    from pyspark.sql import types as T

    degree = edges.groupBy("a").agg(F.sum("w").alias("d"))
    scaled = edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))
    scaled = keep(scaled, "scaled")
    start = [((F.pmod(F.xxhash64("a", F.lit(seed + i)), F.lit(2_000_001)) / 1_000_000.0) - 1.0) for i in range(k)]
    x = degree.select(F.col("a").alias("id"), F.array(*start).alias("v"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    for _ in range(iterations):
        spread = scaled.join(x.withColumnRenamed("id", "b"), "b").select("a", F.posexplode(F.transform("v", lambda c: c * F.col("w"))).alias("i", "y"))
        y = spread.groupBy("a", "i").agg(F.sum("y").alias("y")).groupBy(F.col("a").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("v"))
        y = y.join(x.select("id", F.col("v").alias("old")), "id").select("id", F.zip_with("v", "old", lambda p, q: (p + q) / 2).alias("v"))
        y = keep(y, "spread")
        mean, c, n = covariance(y)
        if not n:
            break
        gram = (c + np.outer(mean, mean)) * n
        w, u = np.linalg.eigh(gram)
        x = projected(y, u @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ u.T, np.zeros(k), unit=False)
    x = projected(x, np.eye(k), np.zeros(k))
    return x.to(schema)


def item_vectors(sessions: DataFrame, size: int = 64, window: int = 2, rate: float = 0.025, seed: int = 1) -> DataFrame:
    """``word, vector``: skip-gram vectors of the items of ``sessions(items array<string>)``."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, stepSize=rate, minCount=1, maxIter=1, seed=seed, inputCol="items", outputCol="o").fit(sessions)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def hashed_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, width: float = 1.0, seed: int = 9) -> DataFrame:
    """``query_id, id, distance, rank``: approximate neighbours by random-projection hashing, ranked exactly.

    Candidates share a bucket with the query in one of the tables. Hashes travel with blocks of vectors, and a query keeps its best of two
    blocks before anything is shuffled: buckets hold many vectors, and pairs of them would be as many as a join of all.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import vector_to_array

    rows = as_ml(vectors.where("v IS NOT NULL"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(rows)
    hashed = lambda frame: model.transform(frame).select("id", F.col("v").cast("array<double>").alias("v"), F.transform("h", lambda x: vector_to_array(x)[0]).alias("h"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (qi, q, qh), (vi, v, vh) in _sides(batches, ("id", "v", "h")):
            step = max(1, 1_000_000 // len(v))
            for at in range(0, len(q), step):
                x, own = q[at : at + step], qi[at : at + step]
                met = np.zeros((len(x), len(v)), bool)
                for n in range(vh.shape[1]):
                    met |= qh[at : at + step, n, None] == vh[None, :, n]
                met &= own[:, None] != vi[None, :]
                size = (x * x).sum(1)[:, None] + (v * v).sum(1)[None, :]
                near = np.where(met, size - 2 * (x @ v.T), np.inf)
                last = min(k, len(v)) - 1
                kth = np.partition(near, last, axis=1)[:, last]
                i, j = np.nonzero(met & (near <= kth[:, None] + 1e-5 * (1 + size)))  # all that rounding may bring level
                d = np.round(np.sqrt(((x[i] - v[j]) ** 2).sum(1)), 6)
                order = np.lexsort((vi[j], d, i))
                i, j, d = i[order], j[order], d[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, d = i[nth < k], j[nth < k], d[nth < k]
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(vi[j]), pa.array(d)], ["query_id", "id", "distance"])

    pairs = _block_pairs(hashed(as_ml(queries.where("v IS NOT NULL").withColumnRenamed("query_id", "id"))), hashed(rows), 4_000)
    out = pairs.mapInArrow(best, "query_id long, id long, distance double")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
