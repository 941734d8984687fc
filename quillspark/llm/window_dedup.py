"""Substring dedup by Rabin-Karp hashes of every window of words, counted by Spark.

Map tasks hash every window of ``WINDOW`` consecutive words twice, with independent hashes of the
words. The second deals the windows to partitions and adds 8 bits to the 64 of the first. A partition
holds about m = 2.7 million windows at any size of the input, so of n windows about n * m / 2**73
pairs are taken for equal by chance: 3 in a thousand runs over 10**13 windows. Each partition counts
its hashes and sends the places of repeated windows to
their document, where they merge into maximal intervals that are cut out. What repeats within the
texts that a map task holds at once is known there: it goes to its documents straight away, and one
of each such window is enough for the count. So a window that a third of all texts share makes
an item for each map chunk in its partition, not for each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BLOB, blob_batch, blob_frame, by_key, chunks, column, covered, deal, dealt, keyed, mix, numbers, parts_for, rolling, text_blobs, texts_of, to_rows, together, window_starts, word_hashes

WINDOW = 35
#: The second hash's base.
BASE = 0xD6E8FEB86659FD93


def equal_neighbours(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs ``(a, b)`` together, and whether each equals the one before it in that order."""
    order = np.argsort(a, kind="stable")
    same = np.zeros(len(a), bool)
    same[1:] = a[order[1:]] == a[order[:-1]]
    if (same[1:] & (b[order[1:]] != b[order[:-1]])).any():  # the first hash collides: sort by both
        order = np.lexsort((b, a))
        same[1:] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    return order, same


def repeated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs occur at least twice, and of each of these the first."""
    order, same = equal_neighbours(a, b)
    again = np.append(same[1:], False)[: len(same)]
    hit, first = np.zeros(len(a), bool), np.zeros(len(a), bool)
    hit[order[same | again]] = True
    first[order[~same & again]] = True
    return hit, first


def _hash_windows(window: int, parts: int):
    """Windows go to the parts below ``parts`` by value; places known to repeat go to the others, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                one, two, starts = word_hashes(column(batch, "text"), 2)
                place, doc = window_starts(starts, window)
                if len(place):
                    a, b = mix(rolling(one, window)[place]), mix(rolling(two, window, BASE)[place])
                    keys, checks, place = numbers(batch, "rk"), numbers(batch, "rc"), place - starts[doc]
                    known, first = repeated(a, b)
                    out = ~known | first
                    yield blob_batch(deal((b[out] >> np.uint64(33)).astype(np.int64) % parts, doc[out], place[out], keys, checks, a[out], b[out].astype(np.uint8)))
                    if known.any():
                        yield blob_batch(deal(parts + keys[doc[known]] % parts, doc[known], place[known], keys, checks))

    return run


def _count(parts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        if part >= parts:
            return blob_frame([(part - parts, blob) for blob in frame["blob"]])
        keys, checks, place, a, b = dealt(frame["blob"])
        hit = repeated(a, b)[0]
        return blob_frame(to_rows(parts, keys[hit], checks[hit], place[hit]) if hit.any() else [])

    return run


def _cut(window: int, texts: bool):
    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        at = by_key(*dealt(found["blob"])) if len(found) else {}
        out = []
        for key, doc_id, text in texts_of(docs):
            own = text.split()
            gone = covered(len(own), at[key][0], window) if key in at else np.zeros(len(own), bool)
            kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g) if gone.any() else b" ".join(own)
            out.append((doc_id, len(own), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if texts else None))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
        return frame.astype({"doc_id": "Int64"})

    return run


def remove_repeated_windows(spark: SparkSession, docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept_text`` (null unless ``texts``).

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in
    another or the same document. Repeated rows are repeats of each other. Null and empty texts
    have no words; shorter texts lose none. Other columns are not looked at. An empty table gives no rows.
    """
    docs = keyed(docs)
    parts = parts_for(docs)
    found = docs.mapInArrow(_hash_windows(window, parts), BLOB).groupBy("part").applyInPandas(_count(parts), BLOB)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return together(text_blobs(docs, parts), found, "part", _cut(window, texts), schema)


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS content FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
hits AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY content) > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM hits, unnest(range(0, 35)) AS t(k)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.i) AS kept, count(*) AS n FROM words w ANTI JOIN gone g ON w.rid = g.rid AND w.i = g.i GROUP BY w.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.rid = k.rid
"""
