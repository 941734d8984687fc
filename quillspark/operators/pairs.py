"""How many documents hold two items together, and for each item those that are most bound to it.

Items are numbers. A band of them is one group, which counts in a matrix of the band by all others; a
document sends a band the numbers it has there with those that they are paired with, not the pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Cells of a band's matrix, of two bytes where no item is in more than 65,535 documents.
CELLS = 100_000_000
#: Found pairs are thinned out to the best of each item when so many have come together.
AT_ONCE = 2_000_000
#: Mutual information may differ by so much between engines, and is rounded to six places.
SLACK = 2e-6


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers in one compressed blob."""
    sizes = np.array([len(arrays), *map(len, arrays)], np.int32)
    return zlib.compress(b"".join(np.ascontiguousarray(x, np.int32).tobytes() for x in (sizes, *arrays)), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(zlib.decompress(blob), np.int32)
    ends = np.cumsum(flat[1 : flat[0] + 1]) + flat[0] + 1
    return np.split(flat[: ends[-1]], np.append(flat[0] + 1, ends[:-1]))[1:]


def numbered(items: DataFrame, key: str, blocks: int = 64) -> DataFrame:
    """The rows with ``number``: distinct and nearly gapless from 0; each block of a hash counts by itself."""
    b = F.pmod(F.xxhash64(key), F.lit(blocks))
    nth = F.row_number().over(W.partitionBy("_b").orderBy(key))
    return items.withColumn("_b", b).withColumn("number", ((nth - 1) * F.lit(blocks) + F.col("_b")).cast("int")).drop("_b")


def bands(rows: int, columns: int, same: bool, cells: int = CELLS) -> np.ndarray:
    """Where bands of rows begin, and the end. With ``same`` a row is paired with greater numbers alone."""
    out = [0]
    while out[-1] < rows:
        out.append(min(rows, out[-1] + max(1, cells // max(1, columns - (out[-1] if same else 0)))))
    return np.array(out)


def _deal(cuts: np.ndarray, places: tuple[np.ndarray, np.ndarray], same: bool):
    """Batches ``a, b`` of numbers go to the bands: for each document its rows there, and its columns."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, list] = {}
            for a, b in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                a, b = np.sort(places[0][a.values.to_numpy()]), np.sort(places[1][b.values.to_numpy()])
                at = np.searchsorted(a, cuts)
                for band in np.flatnonzero(np.diff(at)):
                    own = a[at[band] : at[band + 1]]
                    others = b[np.searchsorted(b, own[0], "right") :] if same else b
                    if len(others):
                        out.setdefault(int(band), []).append((own, others))
            rows = []
            for band, found in out.items():
                own, others = zip(*found, strict=True)
                rows.append((band, pack(np.array([len(x) for x in own], np.int32), np.array([len(x) for x in others], np.int32), np.diff(np.concatenate(own), prepend=0).astype(np.int32), np.diff(np.concatenate(others), prepend=0).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["band", "blob"])

    return go


def _best(key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their key, or so near the last of these that rounding may bring them level."""
    order = np.lexsort((-score, key))
    head = np.flatnonzero(np.diff(key[order], prepend=-1))
    size = np.diff(np.append(head, len(order)))
    last = score[order][head + np.minimum(size, k) - 1]
    return order[score[order] >= np.repeat(last, size) - SLACK]


def _count(cuts: np.ndarray, columns: int, same: bool, dfs: tuple[np.ndarray, np.ndarray], n: int, together: int, k: int):
    """A band's pairs in at least ``together`` documents: those best for their row, and those best for their column."""

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        band = int(frame["band"].iloc[0])
        start, left = int(cuts[band]), int(cuts[band]) if same else 0
        counts = np.zeros((int(cuts[band + 1]) - start, columns - left), np.uint16 if max(dfs[0].max(), dfs[1].max()) < 2**16 else np.uint32)
        for blob in frame["blob"]:
            sizes, widths, own, others = unpack(blob)
            own, others = np.cumsum(own), np.cumsum(others)
            i = j = 0
            for size, width in zip(sizes.tolist(), widths.tolist(), strict=True):
                counts[(own[i : i + size] - start)[:, None], others[j : j + width] - left] += 1
                i, j = i + size, j + width
        rows, held, high = [], [], max(1, AT_ONCE // counts.shape[1])
        for top in range(0, counts.shape[0], high):
            t, u = np.nonzero(counts[top : top + high] >= together)
            t, u = t + top, u
            c = counts[t, u].astype(np.int64)
            t, u = t + start, u + left
            keep = t < u if same else np.ones(len(t), bool)
            t, u, c = t[keep], u[keep], c[keep]
            if not len(t):
                continue
            p = c / n
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.nan_to_num(np.log2(p / ((dfs[0][t] / n) * (dfs[1][u] / n))) / -np.log2(p), nan=0.0, posinf=2.0, neginf=-2.0)
            best = _best(t, score, k)
            rows.append((t[best], u[best], c[best], np.zeros(len(best), bool)))
            held.append((u, t, c, score))
            if sum(len(h[0]) for h in held) > AT_ONCE:
                held = [_thinned(held, k)]
        if held:
            u, t, c, _ = _thinned(held, k)
            rows.append((u, t, c, np.ones(len(u), bool)))
        a, b, c, turned = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        return pd.DataFrame({"key": a.astype(np.int32), "other": b.astype(np.int32), "cooccur": c, "turned": turned})

    return go


def _thinned(held: list, k: int) -> tuple[np.ndarray, ...]:
    merged = [np.concatenate(x) for x in zip(*held, strict=True)]
    best = _best(merged[0], merged[3], k)
    return tuple(x[best] for x in merged)


def best_pairs(docs: DataFrame, dfs: tuple[np.ndarray, np.ndarray], n: int, together: int, k: int, same: bool, cells: int = CELLS) -> DataFrame:
    """``key, other, cooccur, turned``: of documents ``(a, b)``, arrays of distinct numbers, the pairs that can be among the k most bound to an item.

    ``dfs`` are the documents of each number of either side. ``turned``: key is of ``b`` and other of ``a``. With ``same`` both
    sides are one, and a pair is counted once. A pair that is left out is beaten by k others of its key by more than rounding.
    """
    # Places by falling frequency: common items fill few bands, and a rare one is paired with few that are rarer.
    orders = tuple(np.argsort(-d, kind="stable") for d in dfs)
    places = tuple(np.argsort(o).astype(np.int32) for o in orders)
    dfs, cuts = tuple(d[o] for d, o in zip(dfs, orders, strict=True)), bands(len(dfs[0]), len(dfs[1]), same, cells)
    dealt = docs.select("a", "b").mapInArrow(_deal(cuts, places, same), "band int, blob binary")
    count = _count(cuts, len(dfs[1]), same, dfs, n, together, k)

    def named(frame: pd.DataFrame) -> pd.DataFrame:
        f = count(frame)
        turned, key, other = f["turned"].to_numpy(bool), f["key"].to_numpy(), f["other"].to_numpy()
        if len(f):
            back = lambda x, of_b: np.where(of_b, orders[1][np.minimum(x, len(orders[1]) - 1)], orders[0][np.minimum(x, len(orders[0]) - 1)]).astype(np.int32)
            f = f.assign(key=back(key, turned), other=back(other, ~turned))
        return f

    return dealt.groupBy("band").applyInPandas(named, "key int, other int, cooccur long, turned boolean")
