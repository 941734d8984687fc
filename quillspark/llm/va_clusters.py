"""Clustering around centroids over a VA-file.

Every vector of integers is stored beside its approximation: a cell of ``BITS`` bits for each
dimension. For each centroid, dimension and cell a table holds the least and the greatest squared
difference; summed over the dimensions they give an interval for the distance. Where one centroid's
interval lies below all others, the vector is assigned without being looked at. Full vectors are
fetched where intervals overlap, and where a vector's centroid is another than before: sums by
cluster are kept up by what moves. A vector lies in the row of its cells, so that fetching
it costs a read in the same task and no join of the table with itself; only the fetched ones go to Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RANGE, Scratch, column, columns_or_null, share_of

#: Bits of a cell. Of 51,282 vectors with components of some 80 values, intervals overlapped for a few in a hundred with 6 bits, for nearly all with 5.
BITS = 6
#: Vectors, about, from which the edges of cells are taken. All vectors get cells, and the outermost cells reach to the least and greatest of all.
SAMPLE = 16_384
#: Components are below this, so that squared distances fit in 64 bits.
MOST = 2**21
UNDECIDED = -1


class Cells:
    """Cell i of a dimension holds the integers ``low[i] .. high[i]``."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS):
        self.bits, self.low, self.high, self.edges = bits, [], [], []
        for j in range(sample.shape[1]):
            found, n = np.unique(sample[:, j], return_counts=True)
            if len(found) > 2**bits:  # narrow where values are dense: the best cells for a squared error go by the cube root of the density
                weight = np.cbrt(n * np.diff(found, append=found[-1] + 1) ** 2.0)
                found = found[np.flatnonzero(np.diff(np.floor((np.cumsum(weight) - weight) / weight.sum() * 2**bits), prepend=-1))]
            edges = found[found > least[j]].astype(np.int64)[: 2**bits - 1]
            self.edges.append(edges)
            self.low.append(np.concatenate([[least[j]], edges]))
            self.high.append(np.concatenate([edges - 1, [most[j]]]))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, vectors[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> list[bytes]:
        wide = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [x.tobytes() for x in np.packbits(wide.reshape(len(cells), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        d = len(self.edges)
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(raw, axis=1, count=d * self.bits).reshape(len(packed), d, self.bits)
        return bits @ (1 << np.arange(self.bits)[::-1]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared difference by centroid, dimension and cell."""
        k, d = centroids.shape
        near, far = np.zeros((k, d, 2**self.bits), np.int64), np.zeros((k, d, 2**self.bits), np.int64)
        for j in range(d):
            low, high, c = self.low[j][None], self.high[j][None], centroids[:, j][:, None]
            gap = np.maximum(np.maximum(low - c, c - high), 0)
            near[:, j, : low.shape[1]] = gap**2
            far[:, j, : low.shape[1]] = np.maximum(np.abs(c - low), np.abs(c - high)) ** 2
        return near, far


def by_intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The centroid whose interval lies below all others; ``UNDECIDED`` where some overlap, ends included."""
    dims = np.arange(cells.shape[1])
    near, far = (np.stack([t[dims, cells].sum(1) for t in table], 1) for table in tables)
    best = far.min(1)
    touch = near <= best[:, None]
    return np.where(touch.sum(1) == 1, touch.argmax(1), UNDECIDED)


def by_distance(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid by the vectors themselves; ties: the smaller number."""
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1).argmin(1)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.int64)


def _decide(cells: Cells, *centroids: np.ndarray):
    """A column of what the cells say under each set of centroids, packed as ``256 * (first + 1) + second + 1``."""
    tables = [cells.tables(c) for c in centroids]

    @F.pandas_udf("int")
    def decide(packed: pd.Series) -> pd.Series:
        own = cells.unpack(packed.tolist())
        out = np.zeros(len(own), np.int64)
        for t in tables:
            out = out * 256 + by_intervals(own, t) + 1
        return pd.Series(out.astype(np.int32))

    return decide.asNondeterministic()  # else it is evaluated again in the filter


def _moved(before: np.ndarray | None, now: np.ndarray):
    """What the sums of each centroid's vectors gain and lose; one row for a centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for b in batches:
            vectors, code = _matrix(column(b, "vec")), column(b, "code").to_numpy(zero_copy_only=False)
            if not len(code):
                continue
            for sign, said, centroids in ((1, code % 256 - 1, now), (-1, code // 256 - 1, before)):
                if centroids is not None:
                    unclear = np.flatnonzero(said == UNDECIDED)
                    said[unclear] = by_distance(vectors[unclear], centroids)
                    np.add.at(sums, said, sign * vectors)
                    np.add.at(n, said, sign)
        yield pa.record_batch([pa.array(np.arange(len(now)), pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _measured(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vectors, own = _matrix(column(b, "vec")), column(b, "code").to_numpy(zero_copy_only=False) - 1
                unclear = np.flatnonzero(own == UNDECIDED)
                own[unclear] = by_distance(vectors[unclear], centroids)
                yield pa.record_batch([column(b, "vec_id"), pa.array(own, pa.int32()), pa.array(((vectors - centroids[own]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def _edges(dims: int, bound: int):
    """The least and greatest of every dimension in a task, and the vectors below the bound on their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.int32())
        ends = None
        for b in batches:
            if b.num_rows:
                vectors = _matrix(column(b, "vec"))
                now = np.stack([vectors.min(0), vectors.max(0)])
                ends = now if ends is None else np.stack([np.minimum(ends[0], now[0]), np.maximum(ends[1], now[1])])
                mine = column(b, "vec").filter(pa.array(column(b, "h").to_numpy(zero_copy_only=False) < bound))
                yield pa.record_batch([pa.array(["sample"] * len(mine)), mine.cast(kinds)], ["kind", "vec"])
        if ends is not None:
            yield pa.record_batch([pa.array(["least", "most"]), pa.array(list(ends.astype(np.int32)), kinds)], ["kind", "vec"])

    return run


def centroid_clusters(spark: SparkSession, embeddings: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per vector that takes part.

    These are vectors of exactly ``dims`` components, none null, not finite or of ``MOST`` or more (their squared
    distances would not fit in 64 bits). Components become integers, floor(scale * x). The first centroids are the ``k``
    vectors with the smallest SHA-256 of ``seed:vec_id`` (a null vec_id is written as nothing; ties by the
    vector); all, if there are fewer. Each round assigns and averages as exact integers. Repeated
    rows are vectors of their own. Inertias that do not fit in 64 bits are null. No vectors: no rows.
    """
    scratch = Scratch(spark, "clusters")
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = columns_or_null(embeddings, vec_id="long", embedding="array<double>")
    rows = rows.where((F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST)))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("vec"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = np.array([r.vec for r in rows.select("vec", name.alias("name")).orderBy("name", "vec").limit(k).collect()], np.int64)
    if not len(start):
        return spark.createDataFrame([], schema)
    bound = share_of(sample, rows.count())
    found = rows.withColumn("h", F.pmod(F.xxhash64(F.lit("cells"), "vec_id", "vec"), F.lit(RANGE))).select("vec", "h").mapInArrow(_edges(dims, bound), "kind string, vec array<int>").toPandas()
    ends = {kind: np.array(own["vec"].tolist(), np.int64) for kind, own in found.groupby("kind")}
    least, most = ends["least"].min(0), ends["most"].max(0)
    cells = Cells(ends.get("sample", np.stack([least, most])), least, most, bits)

    @F.pandas_udf("binary")
    def packed(vec: pd.Series) -> pd.Series:
        return pd.Series(cells.pack(cells.of(np.array(vec.tolist(), np.int64).reshape(-1, dims))))

    table = scratch.save(rows.withColumn("cells", packed("vec")), "vectors")
    now, before = start, None
    sums, n = [[0] * dims for _ in start], [0] * len(start)
    for _ in range(rounds):
        sets = [now] if before is None else [before, now]
        said = table.select("vec", _decide(cells, *sets)("cells").alias("code"))
        if before is not None:  # what is decided both times for the same centroid is not fetched
            said = said.where("code DIV 256 = 0 OR code % 256 = 0 OR code DIV 256 <> code % 256")
        moved = said.mapInArrow(_moved(before, now), "cluster int, n long, sums array<long>")
        for r in moved.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dims)]).collect():
            n[r.cluster] += r.n
            sums[r.cluster] = [s + r[f"s{j}"] for j, s in enumerate(sums[r.cluster])]
        before, now = now, np.array([[s // n[c] for s in sums[c]] if n[c] else now[c].tolist() for c in range(len(now))], np.int64)
    out = scratch.save(table.select("vec_id", "vec", _decide(cells, now)("cells").alias("code")).mapInArrow(_measured(now), "vec_id long, cluster int, distance long"), "assigned")
    sums_of = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 2**63 else None
    whole = fits(sum(sums_of.values()))
    sides = [(c, fits(d), whole, hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for c, d in sums_of.items()]
    return out.join(F.broadcast(spark.createDataFrame(sides, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    parts = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, j, floor(64 * e[j]::DOUBLE)::BIGINT AS x FROM v, unnest(range(1, 65)) AS t(j))",
        "first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM v QUALIFY k < 16)",
        "c0 AS MATERIALIZED (SELECT k, j, x AS c FROM first JOIN x USING (r))",
    ]
    for i in range(4):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{i} USING (j) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < 3:
            parts.append(f"m{i} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY k, j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.k, o.j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{i} o LEFT JOIN m{i} USING (k, j))")
    parts.append("h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY j)) AS h FROM c3 GROUP BY k)")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a3 JOIN v USING (r) JOIN h USING (k)"


OP13_SQL = _sql()
