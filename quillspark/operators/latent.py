"""Truncated factors of a sparse matrix whose cells are rows of a table. No dense row of the vocabulary's width is made."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..lineage import keep

#: Ids of one side in a block: a tile meets so many rows of a tall matrix at once.
BLOCK = 4_096

#: Cells that a task multiplies at a time.
CHUNK = 50_000


@dataclass(frozen=True)
class Factors:
    """``rows(id, v)`` and ``cols(key, v)``: left and right singular vectors, one array of k components each; the singular values, greatest first."""

    rows: DataFrame
    cols: DataFrame
    values: np.ndarray


def _numbered(cells: DataFrame, key: str, blocks: int) -> DataFrame:
    """``key, number``: distinct numbers, each block of a hash counts by itself."""
    one = cells.select(key).distinct().withColumn("b", F.pmod(F.xxhash64(key), F.lit(blocks)))
    return one.select(key, (F.row_number().over(W.partitionBy("b").orderBy(key)) * F.lit(blocks) + F.col("b")).cast("long").alias("number"))


def _sums(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Arrays of one length added up, by key or all; Spark adds within a task before it shuffles."""
    added = vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")
    return rows.groupBy(key).agg(added) if key else rows.agg(added)


def _times(tiles: DataFrame, tall: DataFrame, inner: str, outer: str, blocks: int) -> DataFrame:
    """The cells times a tall matrix ``(id, v)`` whose ids are of the inner side: ``(id, v)`` of the outer side."""
    packed = tall.groupBy(F.pmod("id", F.lit(blocks)).alias(f"{inner}_block")).agg(F.collect_list(F.struct("id", "v")).alias("matrix"))

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cells, matrix in zip(f["cells"], f["matrix"], strict=True):
                ids = np.array([m["id"] for m in matrix])
                at = np.argsort(ids)
                dense, ids = np.array([matrix[i]["v"] for i in at], np.float64), ids[at]
                o, i, w = (np.array([c[n] for c in cells]) for n in (outer, inner, "w"))
                order = np.argsort(o, kind="stable")
                o, i, w = o[order], np.searchsorted(ids, i[order]), w[order]
                for k in range(0, len(o), CHUNK):
                    part, first = np.unique(o[k : k + CHUNK], return_index=True)
                    made = np.add.reduceat(dense[i[k : k + CHUNK]] * w[k : k + CHUNK, None], first, axis=0)
                    yield pd.DataFrame({"id": part, "v": list(made)})

    met = tiles.join(packed, f"{inner}_block").select("cells", "matrix")
    return _sums(met.mapInPandas(product, "id long, v array<double>"), "id")


def _by(tall: DataFrame, m: np.ndarray) -> DataFrame:
    """Every row of a tall matrix times a small square or narrow one."""

    def turned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "v": list(np.stack(f["v"].to_numpy()) @ m)})

    return tall.mapInPandas(turned, "id long, v array<double>")


def _gram(tall: DataFrame, width: int) -> np.ndarray:
    """The products of a tall matrix's columns: width * width numbers, whatever its height."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((width, width))
        for f in frames:
            if len(f):
                m = np.stack(f["v"].to_numpy())
                g += m.T @ m
        yield pd.DataFrame({"v": [g.ravel()]})

    return np.array(_sums(tall.mapInPandas(own, "v array<double>")).first()["v"]).reshape(width, width)


def _straight(tall: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The matrix with orthogonal columns of length 1 over the same space, through its Gram matrix; columns that hold nothing go."""
    tall = keep(tall, "tall")
    e, u = np.linalg.eigh(_gram(tall, width))
    full = e > max(e[-1], 0.0) * 1e-13
    return _by(tall, u[:, full] / np.sqrt(e[full])), int(full.sum())


def factor(cells: DataFrame, k: int = 100, extra: int = 10, rounds: int = 2, seed: int = 42) -> Factors | None:
    """The k greatest singular directions of a sparse matrix, by a randomised range finder with power iterations.

    ``cells(row, col, w)`` are its cells, of any types that can be ordered; null ones and zeros count as absent, of
    repeated cells the sum counts. Cells are packed once into tiles of a block of rows and a block of columns. Each
    product is a join of the tiles with a tall matrix of k + extra columns, whose partial sums Spark adds; it is made
    orthogonal by its Gram matrix. How near the directions come depends on the gap after the k-th value: where the values
    fall slowly, two rounds find the values well and the last directions roughly, and more rounds help. Only such small matrices reach the driver. None where there is no cell; fewer
    than k directions where the matrix has fewer.
    """
    cells = cells.where("row IS NOT NULL AND col IS NOT NULL AND w IS NOT NULL AND NOT isnan(w)").groupBy("row", "col").agg(F.sum(F.col("w").cast("double")).alias("w")).where("w <> 0")
    cells = keep(cells, "cells")
    n, m = cells.agg(F.count_distinct("row"), F.count_distinct("col")).first()
    if not n:
        return None
    across, down = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    row, col = keep(_numbered(cells, "row", across), "rows"), keep(_numbered(cells, "col", down), "cols")
    placed = cells.join(row.withColumnRenamed("number", "i"), "row").join(col.withColumnRenamed("number", "j"), "col")
    sides = F.pmod("i", F.lit(across)).alias("i_block"), F.pmod("j", F.lit(down)).alias("j_block")
    tiles = keep(placed.groupBy(*sides).agg(F.collect_list(F.struct("i", "j", "w")).alias("cells")), "tiles")
    width = min(k + extra, n, m)
    unit = lambda salt, x: (F.pmod(F.xxhash64("number", x, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda x: F.sqrt(-2 * F.log(unit(0, x))) * F.cos(2 * np.pi * unit(1, x))
    tall = col.select(F.col("number").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), normal).alias("v"))
    left, width = _straight(_times(tiles, tall, "j", "i", down), width)
    for _ in range(rounds):
        right, width = _straight(_times(tiles, left, "i", "j", across), width)
        left, width = _straight(_times(tiles, right, "j", "i", down), width)
    left, right = keep(left, "left"), keep(_times(tiles, left, "i", "j", across), "right")
    e, u = np.linalg.eigh(_gram(right, width))
    best = [x for x in np.argsort(-e)[:k] if e[x] > max(e.max(), 0.0) * 1e-13]
    u = u[:, best] * np.sign(u[np.abs(u[:, best]).argmax(axis=0), best])
    values = np.sqrt(e[best])
    back = lambda t, names: t.withColumnRenamed("number", "id").join(names, "id")
    return Factors(back(row, _by(left, u)).select(F.col("row").alias("id"), "v"), back(col, _by(right, u / values)).select(F.col("col").alias("key"), "v"), values)


def embedded(found: Factors) -> DataFrame:
    """``id, v``: rows of the matrix among its directions, each weighted by its singular value, of length 1."""
    scaled = F.zip_with("v", F.array(*map(F.lit, found.values.tolist())), lambda x, s: x * s)
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return found.rows.select("id", scaled.alias("_v")).select("id", F.when(norm > 0, F.transform("_v", lambda x: x / norm)).otherwise(F.col("_v")).alias("v"))


def folded(found: Factors, cells: DataFrame) -> DataFrame:
    """``id, v``: rows that the factors were not made from, such as queries, set among the same directions, of length 1. ``cells(row, col, w)``; a row without a known column is left out."""
    part = cells.join(found.cols.withColumnRenamed("key", "col"), "col").select(F.col("row").alias("id"), F.transform("v", lambda x: x * F.col("w").cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return _sums(part, "id").withColumn("v", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")))
