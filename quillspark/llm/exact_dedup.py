"""Exact deduplication through a minimal perfect hash over the historical distinct digests.

The history (documents up to the middle doc_id, in a production run what was ingested before) is
reduced to its distinct digests. These are dealt by their first bytes into shards; every shard
builds a minimal perfect hash (hash, displace and rank: levels of bit arrays, each taking the
keys that fall alone on a bit) whose slots hold the full digest and the winner's doc_id. Newer
digests, grouped first, look themselves up; a slot whose 32 bytes differ is no match. Matches take
the historical winner, all others group among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, together

#: Distinct historical digests in a shard, on average.
KEYS_PER_SHARD = 50_000
#: Stands for a null doc_id, after all others.
LAST = 2**63 - 1
#: Bits of a level for each key still without a slot.
GAMMA = 2


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests (uint8, n x 32): every key gets its own slot below n."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = keys
        while len(left):
            at = self._place(left, len(self.levels), GAMMA * len(left))
            hits = np.bincount(at, minlength=GAMMA * len(left))
            self.levels.append(hits == 1)
            left = left[hits[at] > 1]
        self.before = np.cumsum([0, *[x.sum() for x in self.levels]])
        self.ranks = [np.cumsum(x) - 1 for x in self.levels]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        part = np.ascontiguousarray(keys).view("<u8")
        with np.errstate(over="ignore"):
            h = (part[:, 1] + np.uint64(level) * part[:, 2]) * np.uint64(0x9E3779B97F4A7C15) ^ (part[:, 3] >> np.uint64(level % 32))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key; -1 if no level takes it. A key outside the set can get any slot."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(keys[open_], i, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out


def _digests(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


def _look_up(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    keys, seek = _digests(old["digest"]), _digests(new["digest"])
    found = np.full(len(new), -1)
    if len(keys) and len(seek):
        table = PerfectHash(keys)
        slot_of = table.slots(keys)
        row = np.empty(len(keys), np.int64)  # the slots: full digest and winner, by way of the row
        row[slot_of] = np.arange(len(keys))
        slot = table.slots(seek)
        at = row[np.maximum(slot, 0)]
        found = np.where((slot >= 0) & (keys[at] == seek).all(1), at, -1)
    member = found >= 0
    extra = np.zeros(len(old), np.int64)
    np.add.at(extra, found[member], new["n"].to_numpy(np.int64)[member])
    alone = new[~member]
    return pd.DataFrame({
        "digest": [*old["digest"], *alone["digest"]],
        "keep_id": np.concatenate([old["winner"].to_numpy(np.int64), alone["winner"].to_numpy(np.int64)]),
        "group_size": np.concatenate([old["n"].to_numpy(np.int64) + extra, alone["n"].to_numpy(np.int64)]),
    })


def with_digest(docs: DataFrame) -> DataFrame:
    """Adds ``digest``: SHA-256 of the text with every run of ``[\\x20\\x09-\\x0D]`` as one space. Null text: empty."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.withColumn("digest", F.unhex(F.sha2(text, 256)))


def classes(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents with digests ``(doc_id, digest)`` and the classes ``(digest, keep_id, group_size)``."""
    rows = scratch.save(with_digest(columns_or_null(docs, doc_id="long", text="string")).select("doc_id", "digest"), "digests")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = None if low is None else (low + high) // 2
    is_old = F.coalesce(F.col("doc_id") <= middle, F.lit(False)) if middle is not None else F.lit(False)
    shards = max(1, n // KEYS_PER_SHARD)
    dealt = (F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % shards).cast("int").alias("shard")
    group = lambda part: part.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("winner"), F.count("*").alias("n")).select(dealt, "digest", "winner", "n")
    old, new = group(rows.where(is_old)), group(rows.where(~is_old))
    found = together(old, new, "shard", _look_up, "digest binary, keep_id long, group_size long")
    return rows, found


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the smallest doc_id stays; null doc_ids lose against any other, and if a whole
    group has none, or a row is repeated with its doc_id, exactly the rows with that doc_id are kept
    (repeated rows are one document written twice). Empty and null texts are equal. An empty table gives no rows.
    The join back is a plain equality join, whose hot digests Spark splits at run time.
    """
    rows, found = classes(spark, docs, Scratch(spark, "exact"))
    out = rows.join(found.withColumn("keep_id", F.nullif("keep_id", F.lit(LAST))), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
