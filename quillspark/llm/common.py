"""What the operators share: scratch tables, packed blobs and word or byte hashes.

Large intermediate data moves between stages as *blobs*: a task packs what it sends to one
partition into a few compressed numpy arrays, so that a shuffled item costs its own bytes and no
row overhead. A blob row is ``(part int, blob binary)``; Spark shuffles the rows by ``part``.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import math
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB = "part int, blob binary"
#: Characters of text behind one partition of blobs. Reducers hold one such partition at a time.
CHARS_PER_PART = 16_000_000
#: Characters that a map task works on at once.
CHUNK = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one set on the context.

    Only where neither is set and driver and executors are one process, a temporary folder is made and
    set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's setting for removing an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut lineage, written under the shared folder; they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table. Its shuffle files go as soon as it is complete: nothing is computed from them again."""
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Removes a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Lets Spark's cleaner remove the shuffle files behind finished tables now: it follows the collection of the driver's objects."""
        self.spark._jvm.System.gc()


def give_back() -> None:
    """Hands freed memory back to the system. Spark keeps Python workers for later stages, and what they hold counts for the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidily(run: Callable) -> Callable:
    """The function of a map or group, after which memory is given back: of a map at the end of the task."""

    @functools.wraps(run)
    def over_batches(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    @functools.wraps(run)
    def over_group(frame: pd.DataFrame) -> pd.DataFrame:
        out = run(frame)
        give_back()
        return out

    return over_batches if inspect.isgeneratorfunction(run) else over_group


def columns_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """Exactly the named columns, cast; a missing one is null. Extra columns cannot clash afterwards."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or what is not the name of a column yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """A key of the row's identity and text. Rows equal in both share it and get equal results."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def row_check() -> Column:
    """32 more bits on the same: what two rows of one key, by chance, are told apart by."""
    return F.hash(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, rk, rc``: the documents with both parts of their key."""
    return columns_or_null(docs, doc_id="long", text="string").withColumn("rk", row_key()).withColumn("rc", row_check())


#: Hashes that samples are drawn by lie below this.
RANGE = 2**62


def share_of(wanted: int, n: int) -> int:
    """The bound on a hash below RANGE that draws about ``wanted`` of ``n`` rows: never 0, all of them if there are no more."""
    return RANGE if n <= wanted else max(1, RANGE * wanted // n)


def drawn(bound: Column | int) -> Column:
    """Whether a document, by a hash of its doc_id and text, lies below the bound."""
    h = F.xxhash64(F.lit("drawn"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.pmod(h, F.lit(RANGE)) < bound


def parts_for(docs: DataFrame, chars: int = CHARS_PER_PART) -> int:
    """How many partitions of blobs the texts need; follows the whole input's size."""
    total = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / chars))


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Compresses arrays of equal or different lengths into one value; see ``unpack``."""
    head = struct.pack("<H", len(arrays)) + b"".join(struct.pack("<3sQ", a.dtype.str[1:].encode().ljust(3, b"\0"), a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<H", raw)
    at, out = 2 + 11 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<3sQ", raw, 2 + 11 * i)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def gather(blobs: Iterable[bytes]) -> list[np.ndarray]:
    """The arrays of many blobs, each concatenated."""
    return [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]


def scatter(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Splits arrays by partition number; the order within a partition stays."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        mine = order[a:b]
        yield int(part[mine[0]]), pack(*[x[mine] for x in arrays])


def deal(part: np.ndarray, owner: np.ndarray, place: np.ndarray, keys: np.ndarray, checks: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Splits items by partition number. Item i is at ``place[i]`` of row ``owner[i]``, which has a key and a check; items come row by row.

    A row's key is sent once for all its items in a partition, places as gaps; ``dealt`` undoes it.
    """
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        mine = order[a:b]
        yield int(part[mine[0]]), pack(*told_apart(owner[mine], keys, checks), gaps(owner[mine], place[mine]), *[x[mine] for x in values])


def dealt(blobs: Iterable[bytes]) -> list[np.ndarray]:
    """Keys, checks, places and values of all items of many blobs."""
    out = []
    for blob in blobs:
        keys, checks, n, gap, *values = unpack(blob)
        out.append((*spread(keys, checks, n), places(gap, n), *values))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def to_rows(parts: int, keys: np.ndarray, checks: np.ndarray, place: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Deals items to the partitions of their rows."""
    order = np.lexsort((place, checks, keys))
    keys, checks, place = keys[order], checks[order], place[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return deal(keys % parts, np.cumsum(new) - 1, place, keys[new], checks[new], *[v[order] for v in values])


def blob_batch(rows: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "blob"])


def blob_frame(rows: Iterable[tuple[int, bytes]]) -> pd.DataFrame:
    rows = list(rows)
    return pd.DataFrame({"part": np.array([p for p, _ in rows], np.int32), "blob": [b for _, b in rows]})


def chunks(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``size`` bytes; a longer text is a slice of its own."""
    text = batch.column(batch.schema.get_field_index("text"))
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's begin (one entry more). Null: none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False).astype(bool)
    starts = np.concatenate([[0], np.cumsum(keep)])[ends.astype(np.int64)]
    return flat.filter(full).dictionary_encode(), starts


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Keys of the word hashes, as many as there are.
HASH_KEYS = ("0123456789123456", "another key of16")


def word_hashes(texts: pa.Array, n: int = 1) -> tuple[np.ndarray, ...]:
    """``n`` independent 64-bit hashes for each word of all texts, and where each text's begin."""
    coded, starts = words(texts)
    if not len(coded):
        return *[np.zeros(0, np.uint64)] * n, starts
    distinct, at = np.array(coded.dictionary.to_pylist(), dtype=object), coded.indices.to_numpy(zero_copy_only=False)
    return *[pd.util.hash_array(distinct, hash_key=k, categorize=False)[at] for k in HASH_KEYS[:n]], starts


def rolling(h: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes of every window of ``length`` values, by doubling; ``len(h) - length + 1`` of them."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out, have, part, width, power = None, 0, h, 1, base & (2**64 - 1)
    powers = {1: power}
    rest = length
    while rest:
        if rest & 1:  # what is there, shifted by this part's width, then this part
            n = len(h) - have - width + 1
            out = part[:n] if out is None else out[:n] * np.uint64(powers[width]) + part[have : have + n]
            have += width
        rest >>= 1
        if rest:
            n = len(part) - width
            part = part[:n] * np.uint64(powers[width]) + part[width : width + n]
            powers[2 * width] = powers[width] * powers[width] % 2**64
            width *= 2
    return out[: len(h) - length + 1]


def window_starts(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows inside single texts: their place in the concatenation, and their text's number."""
    n = np.maximum(np.diff(starts) - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return starts[:-1][doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), doc


def text_blobs(docs: DataFrame, parts: int) -> DataFrame:
    """Texts dealt by row key, as blobs of ``texts_of``: the columns are rk, rc, doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 4 * CHUNK):
                keys, checks, ids, text = numbers(batch, "rk"), numbers(batch, "rc"), column(batch, "doc_id"), pc.cast(column(batch, "text"), pa.binary())
                known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                part, out = keys % parts, []
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    mine = order[a:b]
                    own = [x or b"" for x in text.take(pa.array(mine)).to_pylist()]
                    size = np.array([len(x) for x in own], np.int64)
                    out.append((int(part[mine[0]]), pack(keys[mine], checks[mine], ids[mine].astype(np.int64), known[mine].astype(np.int8), size, np.frombuffer(b"".join(own), np.uint8), level=3)))
                yield blob_batch(out)

    return docs.select("rk", "rc", "doc_id", "text").mapInArrow(run, BLOB)


def texts_of(frame: pd.DataFrame) -> Iterator[tuple[tuple[int, int], int | None, bytes]]:
    """Key and check of the row, doc_id and the text's bytes of every document in a frame of ``text_blobs``. Null text: empty."""
    for blob in frame["blob"]:
        keys, checks, ids, known, size, data = unpack(blob)
        ends = np.cumsum(size)
        raw = data.tobytes()
        for i in range(len(keys)):
            yield (int(keys[i]), int(checks[i])), int(ids[i]) if known[i] else None, raw[ends[i] - size[i] : ends[i]]


def by_key(keys: np.ndarray, checks: np.ndarray, *values: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    """For each key with its check the values it has, in their order."""
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    cuts = np.flatnonzero(first)
    return {(int(keys[a]), int(checks[a])): tuple(v[order[a:b]] for v in values) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)}


def told_apart(owner: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items that belong to rows and come row by row: each row's key and check once, and how many items follow it.

    Thus a shuffled item costs no key of its own; ``spread`` undoes it.
    """
    cuts = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
    rows = owner[cuts]
    return keys[rows], checks[rows], np.diff(np.append(cuts, len(owner))).astype(np.uint32)


def spread(keys: np.ndarray, checks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(keys, n), np.repeat(checks, n)


def gaps(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places as differences to the one before in the same row; the first of a row as it is. ``places`` undoes it."""
    out = place.astype(np.int64)
    same = owner[1:] == owner[:-1]
    out[1:] -= np.where(same, place[:-1], 0)
    return out.astype(np.uint16) if len(out) and out.max() < 2**16 and out.min() >= 0 else out


def places(gap: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.cumsum(gap.astype(np.int64))
    first = np.cumsum(n.astype(np.int64)) - n
    return total - np.repeat(np.concatenate([[0], total])[first], n) if len(n) else total


def together(left: DataFrame, right: DataFrame, key: str, function, schema: str) -> DataFrame:
    """Cogroups two frames. The right one's columns are renamed apart first: columns that both
    sides take from the same table would otherwise be dropped from it."""
    return left.groupBy(key).cogroup(right.toDF(*right.columns).groupBy(key)).applyInPandas(function, schema)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of an undirected edge list ``(a, b)``; a component is named by its smallest node.

    Alternates the large-star and small-star steps until nothing changes: every edge moves to its
    node's smallest neighbour, so chains shorten by half a round. Each round is a written table.
    """
    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.where("b < a") if small else both
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = both.join(least, "a").where("b <> m" if small else "b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = least.where("m <> a").select("a", F.col("m").alias("b"))
        return moved.union(kept).where("a <> b").distinct()

    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges0")
    mark, i = None, 0
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if size == mark:
            break
        mark, i = size, i + 1
        now = scratch.save(star(star(now, False), True), f"edges{i}")
        if i > 1:
            scratch.drop(f"edges{i - 1}")
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(now.select("b", "b").distinct())
