"""Packing token sequences by cutting-stock column generation.

Documents become token ids; what exceeds whole sequences is a piece of its own. Piece lengths,
rounded up to ``STEP`` tokens, form a histogram of a fixed number of classes. A linear program
over patterns (how many pieces of each class one sequence holds) is solved by column generation:
a knapsack dynamic program prices new patterns with the duals of the classes. Patterns are rounded
down, the few pieces left over are filled greedily. Pieces, ranked within their class, take the
slots of the patterns. Only the histogram, at most ``CAPACITY / STEP`` rows, comes to the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import Scratch, chunks, column, columns_or_null, row_key, tidily
from .tokens import CHUNK, WordEncoder

CAPACITY = 2048
STEP = 8
END_ID = 1
PIECES = "doc_id long, rk long, start long, length long, ids_crc32 long, doc_tokens long"


def best_pattern(price: np.ndarray, width: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The unbounded knapsack: how many of each item to take for the highest price within ``room``."""
    by_width = np.zeros(room + 1)
    by_width[width] = price
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        worth = best[c - 1 :: -1] + by_width[1 : c + 1]
        w = int(worth.argmax())
        best[c], last[c] = worth[w], w + 1
    counts, c = np.zeros(room + 1, np.int64), room
    while c > 0 and best[c] > 0:
        counts[last[c]] += by_width[last[c]] > 0
        c -= last[c]
    return counts[width], float(best[room])


def cutting_stock(demand: dict[int, int], room: int, tolerance: float = 1e-4, most: int = 4000) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)`` that hold the demanded items of each width in few bins of ``room``.

    Revised simplex over patterns: starts with one pattern for each width, stops when the bound
    that the best price gives lies within ``tolerance`` of the value (or, still feasible, after
    ``most`` columns).
    """
    width = np.array(sorted(w for w, n in demand.items() if n > 0), np.int64)
    if not len(width):
        return []
    need = np.array([demand[int(w)] for w in width], float)
    basis = np.diag(room // width).astype(float)
    inverse, x = np.diag(1.0 / (room // width)), need / (room // width)
    for _ in range(most):
        price = inverse.sum(0)
        pattern, worth = best_pattern(np.maximum(price, 0), width, room)
        if worth <= 1 + 1e-9 or x.sum() * (1 - 1 / worth) <= max(0.5, tolerance * x.sum()):
            break
        step = inverse @ pattern
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(x[rows] / step[rows])]
        amount = x[out] / step[out]
        x -= amount * step
        x[out] = amount
        x = np.maximum(x, 0)
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[:, out] = pattern
    times = np.floor(x + 1e-9).astype(np.int64)
    left = need.astype(np.int64) - (basis @ times).round().astype(np.int64)
    plan = [({int(w): int(a) for w, a in zip(width, basis[:, i].astype(int), strict=True) if a}, int(n)) for i, n in enumerate(times) if n]
    left = np.maximum(left, 0)
    while left.any():  # at most a few for each pattern
        space, take = room, {}
        for i in np.flatnonzero(left)[::-1]:
            if n := min(int(left[i]), space // int(width[i])):
                take[int(width[i])], space = n, space - n * int(width[i])
        n = min(int(left[np.searchsorted(width, w)]) // a for w, a in take.items())
        plan.append((take, n))
        for w, a in take.items():
            left[np.searchsorted(width, w)] -= n * a
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each class, which sequences its ranked pieces go to: from rank ``low`` on, ``each`` a sequence, from ``first``."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for take, n in plan:
        for w, a in take.items():
            rows.append((w, used.get(w, 0), a, first))
            used[w] = used.get(w, 0) + a * n
        first += n
    at = np.array(sorted(rows) or [(0, 0, 1, 0)], np.int64)
    return {"key": (at[:, 0] << 48) + at[:, 1], "low": at[:, 1], "each": at[:, 2], "first": at[:, 3]}


def cut(tokenizer: str | None):
    """A function for mapInArrow: the pieces of each document, with the checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for whole in batches:
            for batch in chunks(whole, CHUNK):
                ids, ends = encoder.encode(column(batch, "text"))
                doc_ids, keys = column(batch, "doc_id"), column(batch, "rk")
                docs, start, length, crc, tokens = [], [], [], [], []
                raw = memoryview(ids.astype("<u4").tobytes())
                for i in range(batch.num_rows):
                    at, n = int(ends[i]), int(ends[i + 1] - ends[i])
                    for s in range(0, n + 1, CAPACITY):
                        e = min(s + CAPACITY, n + 1)
                        c = zlib.crc32(raw[4 * (at + s) : 4 * (at + min(e, n))])
                        docs.append(i), start.append(s), length.append(e - s), tokens.append(n + 1)
                        crc.append(zlib.crc32(END_ID.to_bytes(4, "little"), c) if e == n + 1 else c)
                pick = pa.array(docs, pa.int64())
                yield pa.record_batch([doc_ids.take(pick), keys.take(pick), *[pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]], ["doc_id", "rk", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.forget()

    return run


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the vocabulary file, by default the public word BPE with 49k entries. Null and
    empty texts are a single end id. A long text is cut at whole sequences. Repeated rows are packed
    as often as they are there. Other columns are not looked at. An empty table gives no rows.
    """
    scratch = Scratch(spark, "pack")
    docs = columns_or_null(docs, doc_id="long", text="string").withColumn("rk", row_key())
    pieces = scratch.save(docs.mapInArrow(tidily(cut(tokenizer)), PIECES), "pieces").withColumn("cls", F.ceil(F.col("length") / STEP))
    found = {r["cls"]: r["count"] for r in pieces.groupBy("cls").count().collect()}  # CAPACITY / STEP rows at most
    table = slots(cutting_stock(found, CAPACITY // STEP))

    # a class of n pieces is ranked in about sqrt(n) salted parts of sqrt(n) pieces, whose sizes are then added up
    salts = F.create_map(*[F.lit(x) for c, n in found.items() for x in (c, math.isqrt(n))]) if found else F.create_map(F.lit(0).cast("long"), F.lit(1))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("rk", "start"), salts[F.col("cls")]))
    ahead = pieces.groupBy("cls", "salt").count()
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("count").over(W.partitionBy("cls").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = F.row_number().over(W.partitionBy("cls", "salt").orderBy("rk", "start")) - 1
    ranked = pieces.withColumn("nth", nth).join(ahead, ["cls", "salt"]).withColumn("rank", F.col("nth") + F.col("ahead"))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = f["rank"].to_numpy()
            at = np.searchsorted(table["key"], (f["cls"].to_numpy() << 48) + rank, "right") - 1
            yield f.drop(columns="rank").assign(sequence_id=table["first"][at] + (rank - table["low"][at]) // table["each"][at])

    placed = ranked.select("doc_id", "rk", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank").mapInPandas(tidily(assign), f"{PIECES}, cls long, sequence_id long")
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), "rk", "start").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
