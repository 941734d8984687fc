"""Prefix tries of conversations as double arrays, one for each shard of prefixes.

A turn is known by 128 bits of the SHA-256 of its role and text, so texts are never shuffled. Every
conversation is cut into *segments* of ``SEGMENT`` turns; equal segments after equal prefixes
are one row with a count. The rows are sorted by prefix and turns and cut into shards: what a
task gets in one Arrow batch. A shard numbers its turns densely, packs BASE and CHECK arrays
(child ``code`` of ``s`` is at ``BASE[s] + code``, which is its own if ``CHECK`` there says ``s``) and
traverses them with every row to count members.

As shards are ranges of sorted rows, only nodes on the first or last row's path, or above a
segment that goes on, can have a part elsewhere. These *upper* nodes are merged globally: their
counts are summed by key, their subtrees by doubling ancestors, as many rounds as the depth has bits.
All other nodes are settled in their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import Scratch, column, columns_or_null, numbers

#: Turns in a segment. A conversation of any length is rows of at most so many turns.
SEGMENT = 64
#: Turns whose ``turn`` lies in one range of this width are numbered together.
SPAN = 256
#: Range of conv_ids that are joined into one text before hashing.
IDS = 2000
#: Slots that are tried before children are put behind all others.
TRIES = 32
ROOT = bytes(16)
LOCAL = "upper boolean, key binary, parent binary, depth long, n long, least long, parent_least long, children long, leaves long, saved long, size long"


class DoubleArray:
    """A trie over rows of dense codes. Slot 0 is the root; ``levels[d]`` are the slots at depth d + 1."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """``codes[i, :lengths[i]]`` is row i; codes are from 0."""
        self.base, self.check, self.code = (np.full(1, x, np.int64) for x in (0, -1, -1))
        self.used = np.ones(1, bool)
        self.levels: list[np.ndarray] = []
        self._low = 1  # no slot below is free
        at = np.zeros(len(codes), np.int64)
        span = int(codes.max()) + 1 if codes.size else 1
        for d in range(codes.shape[1]):
            rows = np.flatnonzero(lengths > d)
            if not len(rows):
                break
            pairs, back = np.unique(at[rows] * span + codes[rows, d], return_inverse=True)
            slots = self._place(pairs // span, pairs % span)
            self.levels.append(slots)
            at[rows] = slots[back]

    def _grow(self, n: int) -> None:
        if n > len(self.used):
            more = max(n, 2 * len(self.used)) - len(self.used)
            self.base, self.check, self.code = (np.concatenate([a, np.full(more, x, np.int64)]) for a, x in ((self.base, 0), (self.check, -1), (self.code, -1)))
            self.used = np.concatenate([self.used, np.zeros(more, bool)])

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        found = self._low + np.flatnonzero(~self.used[self._low :])[:n]
        if len(found) < n:
            self._grow(len(self.used) + n)
            found = self._low + np.flatnonzero(~self.used[self._low :])[:n]
        return found

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Gives all children of one level their slots; they come by parent, then code."""
        cuts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(np.append(cuts, len(parents)))
        slots = np.empty(len(parents), np.int64)
        for a, n in zip(cuts[sizes > 1], sizes[sizes > 1], strict=True):
            own = codes[a : a + n]
            shape = own - own[0]
            for start in self._free(TRIES):
                self._grow(start + shape[-1] + 1)
                if not self.used[start + shape].any():
                    break
            else:
                start = int(np.flatnonzero(self.used)[-1]) + 1
                self._grow(start + shape[-1] + 1)
            slots[a : a + n] = start + shape
            self._take(slots[a : a + n], int(parents[a]), own)
        single = cuts[sizes == 1]
        slots[single] = self._free(len(single))
        self.base[parents[single]] = slots[single] - codes[single]
        self.used[slots[single]], self.check[slots[single]], self.code[slots[single]] = True, parents[single], codes[single]
        free = np.flatnonzero(~self.used[self._low :])
        self._low = self._low + int(free[0]) if len(free) else len(self.used)
        return slots

    def _take(self, slots: np.ndarray, parent: int, codes: np.ndarray) -> None:
        self.base[parent] = slots[0] - codes[0]
        self.used[slots], self.check[slots], self.code[slots] = True, parent, codes

    def step(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children by these codes; -1 where there is none."""
        to = self.base[at] + codes
        there = (to >= 0) & (to < len(self.check))
        return np.where(there & (self.check[np.where(there, to, 0)] == at), to, -1)


def _next_key(key: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(key + turn).digest()[:16]


def _chained(start: Column, turns: Column) -> Column:
    """The same as ``_next_key`` over all turns, on the JVM."""
    return F.aggregate(turns, start, lambda k, t: F.substring(F.unhex(F.sha2(F.concat(k, t), 256)), 1, 16))


def _shards(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _shard(b, segment)

    return run


def _shard(b: pa.RecordBatch, segment: int) -> pa.RecordBatch:
    """All nodes of one shard with what is known of them there; columns of ``LOCAL``."""
    turns, pres, sizes = column(b, "turns"), column(b, "pre").dictionary_encode(), column(b, "sizes").flatten().to_numpy(zero_copy_only=False)
    lengths = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dense = turns.flatten().dictionary_encode()
    digests, flat = dense.dictionary.to_pylist(), dense.indices.to_numpy(zero_copy_only=False)
    codes = np.full((b.num_rows, 1 + int(lengths.max())), -1, np.int64)
    codes[:, 0] = len(digests) + pres.indices.to_numpy(zero_copy_only=False)  # the prefix is a row's first symbol
    first = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(b.num_rows), lengths)
    codes[row, 1 + np.arange(len(flat)) - first[row]] = flat
    size_of = np.zeros(max(1, len(digests)), np.int64)
    size_of[flat] = sizes
    trie = DoubleArray(codes, lengths + 1)

    total, members, least = len(trie.used), numbers(b, "n"), numbers(b, "least")
    n, low = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    upper = np.zeros(total, bool)
    goes_on, at = numbers(b, "goes_on").astype(bool), np.zeros(b.num_rows, np.int64)
    edge = goes_on.copy()
    edge[[0, -1]] = True
    for d in range(codes.shape[1]):
        rows = np.flatnonzero(lengths + 1 > d)
        at[rows] = to = trie.step(at[rows], codes[rows, d])
        np.add.at(n, to, members[rows])
        np.minimum.at(low, to, least[rows])
        upper[to[edge[rows]]] = True
    upper[trie.levels[0]] = True

    keys: dict[int, bytes] = {}
    starts, level = pres.dictionary.to_pylist(), np.zeros(total, np.int64)
    band = np.zeros(total, np.int64)
    ends = lengths == segment  # what a full segment leads to is called by what the next one starts from
    after = dict(zip(at[ends].tolist(), column(b, "post").filter(pa.array(ends)).to_pylist(), strict=True))
    number = dict(zip(codes[:, 0].tolist(), numbers(b, "s").tolist(), strict=True))
    for d, slots in enumerate(trie.levels):
        level[slots] = d
        for s, parent, code in zip(slots.tolist(), trie.check[slots].tolist(), trie.code[slots].tolist(), strict=True):
            keys[s] = after[s] if s in after else _next_key(keys[parent], digests[code]) if d else starts[code - len(digests)]
            band[s] = band[parent] if d else number[code]

    parent = trie.check
    leaves, saved, children, size = (np.zeros(total, np.int64) for _ in range(4))
    below = np.zeros(total, np.int64)
    for slots in trie.levels[1:]:
        size[slots] = size_of[trie.code[slots]]
        np.add.at(below, parent[slots], 1)
        np.add.at(children, parent[slots[~upper[slots]]], 1)
    for slots in trie.levels[:0:-1]:
        own = slots[~upper[slots]]
        leaves[own] += below[own] == 0
        saved[own] += (n[own] - 1) * size[own]
        np.add.at(leaves, parent[own], leaves[own])
        np.add.at(saved, parent[own], saved[own])

    nodes = np.concatenate(trie.levels)
    again = (level[nodes] == 0) & (band[nodes] > 0)  # counted as the end of the segment before
    above = parent[nodes]
    none = level[nodes] == 0
    show = ~none & (upper[nodes] | upper[above])
    long = lambda x, gone=None: pa.array(x, pa.int64(), mask=gone)
    return pa.record_batch(
        [
            pa.array(upper[nodes]),
            pa.array([keys[s] for s in nodes.tolist()], pa.binary()),
            pa.array([keys[s] if k else None for s, k in zip(above.tolist(), show.tolist(), strict=True)], pa.binary()),
            long(band[nodes] * segment + level[nodes], again),
            long(np.where(again, 0, n[nodes])),
            long(low[nodes], again),
            long(low[above], none),
            long(children[nodes]),
            long(leaves[nodes]),
            long(saved[nodes]),
            long(size[nodes]),
        ],
        [x.split()[0] for x in LOCAL.split(", ")],
    )


def rebuilt(spark: SparkSession, conversations: DataFrame, scratch: Scratch, heads: bool, segment: int) -> DataFrame:
    """``c, s, total, turns, sizes``: conversations, with other ones' first turns if ``heads``, in segments of at most ``segment`` turns.

    Of a conversation only turns within one range of ``turn`` are sorted together; what is before them is counted.
    """
    rows = columns_or_null(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    span = F.coalesce(F.expr(f"floor(turn / {SPAN})"), F.lit(-(2**63)))
    rows = rows.select(F.col("conv_id").alias("c"), span.alias("b"), "turn", digest.alias("d"), F.length(text).alias("size"))
    counts = scratch.save(rows.groupBy("c", "b").agg(F.count("*").alias("m")), "counts")
    h = F.crc32(F.col("c").cast("string")) % 6 if heads else F.lit(0)
    convs = counts.groupBy("c").agg(F.sum("m").alias("m")).withColumn("h", h).withColumn("head", F.col("c") - F.col("c") % 100)
    others = convs.select(F.col("c").alias("head"), F.col("m").alias("head_m"))
    convs = convs.join(others, "head", "left").withColumn("k", F.least("h", F.coalesce("head_m", F.lit(0))))
    convs = scratch.save(convs.select("c", "head", "h", "k", (F.col("k") + F.greatest(F.col("m") - F.col("h"), F.lit(0))).alias("total")), "convs")
    before = F.coalesce(F.sum("m").over(W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("c", "b", before.alias("before")).join(convs.select("c", "h", "k"), "c")
    place = F.row_number().over(W.partitionBy("c", "b").orderBy(F.col("turn").asc_nulls_first(), "d"))
    placed = scratch.save(rows.withColumn("i", place).join(offsets, ["c", "b"]).select("c", (F.col("i") + F.col("before")).alias("i"), "h", "k", "d", "size"), "placed")
    own = placed.where("i > h").select("c", (F.col("k") + F.col("i") - F.col("h")).alias("p"), "d", "size")
    taken = placed.where("c % 100 = 0 AND i <= 5").select(F.col("c").alias("head"), F.col("i").alias("p"), "d", "size")
    taken = taken.join(convs.where("k > 0").select("c", "head", "k"), "head").where("p <= k").select("c", "p", "d", "size")
    none = convs.where("total = 0").select("c", F.lit(0).cast("long").alias("p"), F.lit(None).cast("binary").alias("d"), F.lit(None).cast("int").alias("size"))
    cut = own.union(taken).union(none).withColumn("s", F.expr(f"greatest(p - 1, 0) DIV {segment}"))
    turns = cut.groupBy("c", "s").agg(F.array_sort(F.collect_list(F.when(F.col("p") > 0, F.struct("p", "d", "size")))).alias("t"))
    return turns.join(convs.select("c", "total"), "c").select("c", "s", "total", F.col("t.d").alias("turns"), F.col("t.size").alias("sizes"))


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(digest, at, 8)), 16, -10).cast("long")


def _whole(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def with_prefixes(segments: DataFrame, segment: int) -> DataFrame:
    """Adds ``pre`` and ``post``: what identifies the turns before a segment, and those up to its end (null if it isn't full).

    They are 128 bits of the number and turns of every full segment, added without carry.
    """
    digest = F.substring(F.unhex(F.sha2(F.concat(F.col("s").cast("string").cast("binary"), _chained(F.lit(ROOT), F.col("turns"))), 256)), 1, 16)
    short = segments.withColumn("pre", F.lit(ROOT)).withColumn("post", F.when(F.size("turns") == segment, digest))
    long = segments.where("only = false").withColumn("digest", digest).select("c", "s", _half(F.col("digest"), 1).alias("x"), _half(F.col("digest"), 9).alias("y"))
    upto = W.partitionBy("c").orderBy("s")
    sums = {f"{x}{k}": F.expr(f"bit_xor({x})").over(upto.rowsBetween(W.unboundedPreceding, k)) for x in "xy" for k in (-1, 0)}
    sums = long.select("c", "s", *[F.coalesce(v, F.lit(0)).alias(k.replace("-1", "_pre").replace("0", "_post")) for k, v in sums.items()])
    named = sums.select("c", "s", _whole(F.col("x_pre"), F.col("y_pre")).alias("pre"), _whole(F.col("x_post"), F.col("y_post")).alias("post"))
    named = segments.where("only = false").join(named, ["c", "s"]).withColumn("post", F.when(F.size("turns") == segment, F.col("post")))
    return short.where("only").select(*named.columns).union(named)


def _below(scratch: Scratch, upper: DataFrame) -> DataFrame:
    """``key, leaves, saved``: the sums over all upper nodes of a subtree, by ancestors 1, 2, 4, ... above."""
    most = upper.agg(F.max("depth")).first()[0] or 0
    now = scratch.save(upper.select("key", F.col("parent").alias("above"), "leaves", "saved"), "below0")
    for i in range(int(most).bit_length()):
        given = now.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("v"))
        further = now.select(F.col("key").alias("above"), F.col("above").alias("next"))
        new = now.join(further, "above", "left").join(given, "key", "left")
        now = scratch.save(new.select("key", F.col("next").alias("above"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("v", F.lit(0))).alias("saved")), f"below{i + 1}")
    return now.select("key", "leaves", "saved")


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids, which come in order and in pieces."""
    key, state = None, hashlib.sha256()
    for b in batches:
        keys, found = [], []
        for k, ids in zip(column(b, "key").to_pylist(), column(b, "ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def ends_of(rows: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from ``key, c``: the hash of a node's ids in order. Ranges of ids become texts first; a node's texts are hashed as a stream."""
    texts = rows.groupBy("key", F.expr(f"floor(c / {IDS})").alias("g")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    texts = texts.select("key", "g", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return texts.repartition("key").sortWithinPartitions("key", "g").select("key", "ids").mapInArrow(_hash_ids, "key binary, ends_sha256 string")


def conversation_trie(spark: SparkSession, conversations: DataFrame, heads: bool = False, segment: int = SEGMENT) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of first turns; the root has none. With ``heads``, a conversation c
    starts with the first crc32(c) % 6 turns of conversation c - c % 100 in place of as many of its own.
    Turns come by ``turn``, null first; turns of one number by the digest of their role and text; equal
    ones count as often as they are there. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation and are left out. Other columns are not looked at. An empty table has no nodes.
    """
    scratch = Scratch(spark, "trie")
    segments = scratch.save(rebuilt(spark, conversations, scratch, heads, segment).withColumn("only", F.col("total") <= segment), "segments")
    for name in ("counts", "placed"):
        scratch.drop(name)
    named = with_prefixes(segments, segment)
    goes_on = F.col("total") > (F.col("s") + 1) * segment
    last = F.coalesce("post", _chained(F.col("pre"), F.col("turns")))
    ends = scratch.save(ends_of(named.where(~goes_on).select(last.alias("key"), "c")), "ends")
    same = named.groupBy("s", "pre", "turns").agg(F.first("post", True).alias("post"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("c").alias("least"), F.bool_or(goes_on).alias("goes_on"))
    distinct = scratch.save(same, "distinct")
    order = ["s", "pre", "turns"]
    local = scratch.save(distinct.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shards(segment), LOCAL), "local")

    merged = local.where("upper").groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("size").alias("size"))
    merged = scratch.save(merged, "merged")
    more = merged.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    upper = merged.join(more, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    upper = upper.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size"))
    upper = scratch.save(upper.select("key", "parent", "depth", "n", "least", "children", "leaves", "saved"), "upper")
    sums = _below(scratch, upper)
    parents = upper.select(F.col("key").alias("parent"), F.col("least").alias("above"))
    names = ["key", "least", "depth", "above", "n", "children", "leaves", "saved"]
    inner = local.where("NOT upper")
    nodes = inner.where("parent IS NULL").withColumnRenamed("parent_least", "above").select(*names)
    nodes = nodes.union(inner.where("parent IS NOT NULL").join(parents, "parent").select(*names))
    nodes = nodes.union(upper.drop("leaves", "saved").join(sums, "key").join(parents, "parent", "left").select(*names))
    out = nodes.join(ends, "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("least").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), heads=True)


OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS u FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(u ORDER BY i) AS us,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda g: ascii(g)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h FROM t GROUP BY c),
built AS (SELECT o.c, list_concat(coalesce(b.us[1:o.h], []), o.us[o.h + 1:]) AS us FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100),
paths AS (SELECT c, len(us) AS n, d, sha256(to_json(us[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(us[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN length(us[d].x) ELSE 0 END AS size FROM built, unnest(range(0, len(us) + 1)) AS r(d)),
nodes AS (SELECT k, any_value(d) AS depth, any_value(up) AS up, any_value(size) AS size, min(c) AS least, count(*) AS n,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM paths GROUP BY k),
kids AS (SELECT up, count(*) AS m FROM nodes WHERE up IS NOT NULL GROUP BY up),
links AS (SELECT DISTINCT p.k AS top, q.k AS sub FROM paths p JOIN paths q ON p.c = q.c AND p.d <= q.d),
sums AS (SELECT top, sum(CASE WHEN m IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved FROM links JOIN nodes ON sub = k LEFT JOIN kids ON kids.up = sub GROUP BY top)
SELECT v.least AS conv_id, v.depth, p.least AS parent_conv_id, v.n AS n_convs, coalesce(m, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN sums ON top = v.k LEFT JOIN nodes p ON p.k = v.up LEFT JOIN kids ON kids.up = v.k
"""
