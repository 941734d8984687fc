"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share of the mix, filled up to a ceiling of copies. Every document gets
the whole copies that its expected number of copies holds for certain; the rest is its inclusion
probability. Within a source, documents are ranked by the odds of their random number divided by
the odds of their inclusion, and are taken in that order while they fit what the source still
needs; one more document then closes the gap that is left, if one comes closer than none.

The running total along a ranking is cut into buckets of the rank, summed first, so that a source
with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents of a source in a bucket of the ranking, on average.
BUCKET = 2_000


def word_count(text: str = "text") -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: str) -> Column:
    """A number between 0 and 1, exclusive, from doc_id and a seed: the same in every run and every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``(source, source_size, n, target)`` from sizes by source.

    Weights go round the sources by code point, null last. Targets stop at ``most`` times the
    source's size. The excess goes to the others by weight: sources whose ceiling lies lowest for
    their weight stop first, so a running sum in that order tells which ones stop.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("ceiling", F.col("source_size") * most)
    by_ratio = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    s = s.withColumn("total", share * F.sum("source_size").over(everything))
    room = (F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("full", room * F.col("weight") >= F.col("ceiling"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(everything), F.lit(0.0))
    unit = left / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return s.withColumn("target", F.when(F.col("full"), F.col("ceiling")).otherwise(unit * F.col("weight"))).select("source", "source_size", "n", "target")


def _scaled(d: DataFrame, scratch: Scratch, most: float) -> DataFrame:
    """Adds ``scale``: what liking is multiplied by, so that expected copies, none above ``most``, fill the source's target.

    Documents that reach ``most`` stop there and the others share the rest, until no more of them do.
    """
    first = F.when(F.col("liked") > 0, F.col("target") / F.col("liked")).otherwise(0.0)
    scales, stopped = d.groupBy("source").agg(F.max(first).alias("scale")), None
    while True:
        scales = scales.withColumnRenamed("source", "source_")
        at = d.join(scales, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
        full = F.col("scale") * F.col("liking") >= most
        sums = at.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.when(full, F.col("size")).otherwise(0)).alias("stopped"), F.sum(F.when(~full, F.col("size") * F.col("liking")).otherwise(0.0)).alias("open"), F.max("scale").alias("scale"))
        sums = scratch.save(sums, f"scales{stopped}")
        now = sums.agg(F.coalesce(F.sum("stopped"), F.lit(0))).first()[0]
        if now == stopped:
            return at
        stopped = now
        scales = sums.select("source", F.when(F.col("open") > 0, F.greatest("scale", (F.col("target") - most * F.col("stopped")) / F.col("open"))).otherwise(F.col("scale")).alias("scale"))


def mix_sources(spark: SparkSession, docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES, seed: str = "mix", preference: str | None = None, key: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``, and ``key``.

    ``preference`` names a column that raises or lowers a document's expected copies
    against the others of its source: null counts as 1, 0 and less is never taken. A source whose liked documents,
    taken as often as they may, do not fill its target stays below it. ``key`` names a column that tells rows apart and is returned
    with them. Null texts have size 0 and, like empty ones, take no room.
    Repeated rows are ranked one after the other, in any order. An empty table gives no rows.
    """
    scratch = Scratch(spark, "mix")
    liking = F.greatest(F.lit(0.0), F.coalesce(F.col(preference).cast("double"), F.lit(1.0))) if preference else F.lit(1.0)
    own = [key] if key else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), liking.alias("liking"), *own)
    d = scratch.save(d, "sizes")
    size = F.col("size") * F.col("liking")
    s = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.sum(size).alias("liked"))
    s = targets(s, weights, share, most_copies).join(s.select(F.col("source").alias("source_"), "liked"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    s = scratch.save(s, "targets").withColumnRenamed("source", "source_")
    d = d.join(s, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = mean
    if preference:
        d = _scaled(d, scratch, most_copies)
        expected = F.least(F.lit(float(most_copies)), F.col("scale") * F.col("liking"))
    d = d.withColumn("expected", expected).withColumn("sure", F.floor("expected")).withColumn("p", F.col("expected") - F.col("sure"))
    odds = lambda x: x / (1 - x)
    d = d.withColumn("u", uniform(seed)).withColumn("q", F.when(F.col("p") > 0, odds(F.col("u")) / odds(F.col("p"))))
    typical = mean - F.floor(mean)
    level = F.when(typical > 0, F.col("q") * odds(typical)).otherwise(F.col("q"))  # about an even spread of level / (1 + level)
    d = d.withColumn("bucket", F.floor(level / (1 + level) * F.ceil(F.col("n") / BUCKET)))
    sure = d.where("p <= 0").withColumn("copies", F.col("sure"))  # whole copies only: nothing to rank
    total = scratch.save(d.groupBy("source").agg(F.sum(F.col("size") * F.col("sure")).alias("sure_size")), "sure").withColumnRenamed("source", "source_")

    place = W.partitionBy("source", "bucket").orderBy("q", "doc_id", "size", *own)
    d = d.where("p > 0").withColumn("nth", F.row_number().over(place)).withColumn("run", F.sum("size").over(place.rowsBetween(W.unboundedPreceding, 0)))
    d = scratch.save(d.drop("u", "liking", "liked", "expected"), "ranked")
    b = d.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).join(total, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    each = W.partitionBy("source")
    b = b.withColumn("need", -F.col("sure_size")).withColumn("base", F.coalesce(F.sum("in_bucket").over(each.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    b = b.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), "need", "base")
    d = d.join(b, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_"))).drop("source_", "bucket_")
    d = d.withColumn("need", F.col("target") + F.col("need")).withColumn("fits", F.col("base") + F.col("run") <= F.col("need"))

    gaps = d.groupBy("source").agg((F.max("need") - F.coalesce(F.max(F.when(F.col("fits"), F.col("base") + F.col("run"))), F.lit(0))).alias("gap"))
    gaps = scratch.save(gaps, "gaps").withColumnRenamed("source", "source_")
    off = F.abs(F.col("gap") - F.col("size"))
    last = d.where(~F.col("fits")).join(gaps, F.col("source").eqNullSafe(F.col("source_"))).where(off < F.col("gap"))
    last = last.groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("bucket"), F.col("nth"))).alias("pick"))
    last = last.select(F.col("source").alias("source_"), F.col("pick.bucket").alias("pick_bucket"), F.col("pick.nth").alias("pick_nth"))
    d = d.join(last, F.col("source").eqNullSafe(F.col("source_")), "left")
    chosen = F.col("fits") | F.coalesce((F.col("bucket") == F.col("pick_bucket")) & (F.col("nth") == F.col("pick_nth")), F.lit(False))
    d = d.withColumn("copies", F.col("sure") + F.when(chosen, 1).otherwise(0))
    out = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return d.select(*out, *own).union(sure.select(*out, *own)).select(*out, (F.col("copies") * F.col("size")).alias("taken"), *own)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sizes GROUP BY source),
weighted AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS ceiling, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM by_source),
stops AS (SELECT *, (total - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight >= ceiling AS is_full FROM weighted),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN ceiling ELSE (total - coalesce(sum(ceiling) FILTER (is_full) OVER (), 0))
            / sum(weight) FILTER (NOT is_full) OVER () * weight END AS target FROM stops),
drawn AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected
          FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (SELECT *, floor(expected) AS sure, expected - floor(expected) AS p FROM drawn),
ranked AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS q FROM odds),
runs AS (SELECT *, row_number() OVER w AS nth, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS run,
         target - sum(size * sure) OVER (PARTITION BY source) AS need FROM ranked WINDOW w AS (PARTITION BY source ORDER BY q NULLS FIRST, doc_id, size)),
fitting AS (SELECT *, p > 0 AND run <= need AS fits FROM runs),
gaps AS (SELECT *, need - coalesce(max(run) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM fitting),
closers AS (SELECT source, arg_min(nth, (abs(gap - size), nth)) AS nth FROM gaps WHERE p > 0 AND NOT fits AND abs(gap - size) < gap GROUP BY source)
SELECT g.doc_id, g.size, g.source_size, g.target, ((g.sure + (g.fits OR g.nth IS NOT DISTINCT FROM c.nth)::INT) * g.size)::BIGINT AS taken
FROM gaps g LEFT JOIN closers c ON g.source IS NOT DISTINCT FROM c.source
"""
