"""Entities: an index of mentions, scoring and assigning candidates, splitting and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..lineage import small


def index(rows: DataFrame, item: str, names: Column) -> DataFrame:
    """``name, item``: where each name, trimmed and in lower case, is mentioned."""
    return rows.select(F.explode(names).alias("name"), F.col(item).alias("item")).select(F.lower(F.trim("name")).alias("name"), "item").where("name <> ''").distinct()


def ambiguous(mentions: DataFrame, groups: DataFrame, volumes: int = 2, books: int = 5, most: int = 100, least: int = 3) -> DataFrame:
    """``name, n, n_books, n_volumes, ambiguous``: names in several volumes or many books or items. ``groups(item, book, volume)``."""
    a = mentions.join(groups, "item").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("book").alias("n_books"), F.count_distinct("volume").alias("n_volumes"))
    return a.where(F.col("n") >= least).withColumn("ambiguous", (F.col("n_volumes") >= volumes) | (F.col("n_books") >= books) | (F.col("n") > most))


def score(candidates: DataFrame) -> DataFrame:
    """Candidates with ``score`` from ``sim``, ``prior`` (a count), ``away`` and ``span`` (distance, and what it is out of)."""
    prior = F.log(1.0 + F.col("prior"))
    near = F.exp(-3.0 * F.col("away") / F.col("span"))
    # The weights.
    s = 0.40 * F.col("sim") + 0.10 * prior + 0.20 * near + 0.15 * F.col("sim") * near + 0.05 * F.col("sim") * prior + 0.05 * near * prior + 0.05 * F.col("sim") * near * prior
    return candidates.withColumn("score", F.round(s, 6))


def assign(scored: DataFrame, key: str, candidate: str, margin: float = 0.15) -> DataFrame:
    """The best candidate of each key, and whether the second is so near that it needs a look."""
    w = W.partitionBy(key)
    r = scored.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), candidate))).where("r <= 2")
    both = r.groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col(candidate))).alias(candidate), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    return both.withColumn("queued", F.coalesce(F.col("score") - F.col("second") < margin, F.lit(False))).drop("second")


def split(mentions: DataFrame, name: str, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Mentions of a name under new names by range of the item; the first that fits counts, the rest goes to the first."""
    new = F.lit(None).cast("string")
    for n, low, high in reversed(ranges):
        new = F.when(F.col("item").between(low, high), n).otherwise(new)
    return mentions.withColumn("name", F.when(F.col("name") == name, F.coalesce(new, F.lit(ranges[0][0]))).otherwise(F.col("name"))).distinct()


def merge(mentions: DataFrame, renames: DataFrame) -> DataFrame:
    """``name, item`` after renames ``(old, new)``; doubles go."""
    return mentions.join(renames.withColumnRenamed("old", "name"), "name", "left").select(F.coalesce("new", "name").alias("name"), "item").distinct()


# The types that an extracted entity can have.
TYPES = ("person", "place", "group", "coin", "object", "title")


def validated(rows: DataFrame) -> DataFrame:
    """Extracted entities that can be used: named, of a known type, with a uid that begins with it, and verses within bounds.

    ``rows(name, type, uid, verses, most)``, verses as text; those that are no number from 1 to ``most`` go, and so do rows left without any.
    """
    rows = rows.where(F.col("name").isNotNull() & (F.col("name") != "") & F.col("uid").isNotNull() & F.col("verses").isNotNull() & F.col("type").isin(*TYPES))
    uid = F.regexp_replace(F.regexp_replace(F.lower("uid"), r"\s+", "_"), "[^a-z0-9_:]", "")
    own = F.concat(F.col("type"), F.lit(":"))
    uid = F.when(uid.startswith(own), uid).otherwise(F.concat(own, F.regexp_replace(uid, "^[^:]*:", "")))
    verses = F.filter(F.transform("verses", lambda v: v.try_cast("int")), lambda v: v.between(1, F.col("most")))
    return rows.withColumn("name", F.trim("name")).withColumn("uid", uid).withColumn("verses", verses).where(F.size("verses") > 0)


def nearest(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """``chapter, at, away``: how far each place is from the nearest mention in its chapter; null without one.

    Both ``(chapter, at)``. The last mention before and the first after are carried along the places, so no pairs are made.
    """
    both = rows.select("chapter", "at").distinct().withColumn("m", F.lit(None).cast("long")).unionByName(mentions.select("chapter", "at", F.col("at").cast("long").alias("m")))
    order = W.partitionBy("chapter").orderBy("at", F.col("m").isNull())
    back = W.partitionBy("chapter").orderBy(F.desc("at"), F.col("m").isNull())
    far = both.withColumn("a", F.last("m", True).over(order)).withColumn("b", F.last("m", True).over(back)).where("m IS NULL")
    return far.select("chapter", "at", F.least(F.col("at") - F.col("a"), F.col("b") - F.col("at")).alias("away"))


def search(queries: DataFrame, mentions: DataFrame, groups: DataFrame, page: int = 0, size: int = 10) -> DataFrame:
    """``query_id, name, stage, n_items, volume, n, first_item``: a page of the items of the name that a query means, by volume.

    The same name (stage 0) comes before names that begin with it (1) and names that hold it (2); of several the one with most
    items. Notes in brackets are not part of a name. ``queries(query_id, name)``, ``mentions(name, item)``, ``groups(item, volume)``.
    """
    wanted = F.lower(F.trim(F.regexp_replace("name", r"\s*\([^)]*\)\s*", "")))
    q = small(queries.select("query_id", wanted.alias("wanted")).where("wanted <> ''"))
    names = mentions.groupBy("name").agg(F.count("*").alias("n_items"))
    stage = F.when(F.col("name") == F.col("wanted"), 0).when(F.startswith("name", "wanted"), 1).when(F.contains("name", "wanted"), 2)
    hits = names.join(q).withColumn("stage", stage).where("stage IS NOT NULL")
    best = hits.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("stage", F.desc("n_items"), "name"))).where("r = 1").select("query_id", "name", "stage", "n_items")
    items = mentions.join(small(best.select("name").distinct()), "name").withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("item"))).where(F.col("r").between(page * size + 1, page * size + size))
    rows = best.join(items, "name").join(groups.select("item", "volume"), "item")
    return rows.groupBy("query_id", "name", "stage", "n_items", "volume").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


def concepts(lists: dict[str, DataFrame]) -> DataFrame:
    """``phrase, source``: phrases of several lists ``(phrase)``, in lower case and of two letters at least, each from the first list that has it."""
    rows = None
    for i, (name, df) in enumerate(lists.items()):
        part = df.select(F.lower(F.trim("phrase")).alias("phrase"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("source")).alias("from"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where(F.length("phrase") > 1).groupBy("phrase").agg(F.min("from")["source"].alias("source"))
