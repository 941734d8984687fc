"""Browsing and lookup: hierarchies, references, suggestions, overlays, neighbours, pages, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def lookup(rows: DataFrame, title: str, wanted: str, order: str, exact_first: bool = True) -> DataFrame:
    """Rows whose title equals the wanted one, whatever its case; if there is none, rows whose title contains it."""
    t = F.lower(F.col(title))
    hits = rows.withColumn("match", F.when(t == wanted.lower(), 0).when(t.contains(wanted.lower()), 1)).where("match IS NOT NULL")
    best = hits.agg(F.min("match").alias("best"))
    return hits.join(F.broadcast(best)).where(F.col("match") == F.col("best") if exact_first else F.lit(True)).drop("best")


def lookup_any(rows: DataFrame, aliases: DataFrame, key: str, title: str, alias: str, wanted: str) -> DataFrame:
    """Rows with ``match``: those titled as wanted (0), else those whose title holds it (1), else those known by it under another name (2)."""
    other = aliases.where(F.lower(F.col(alias)) == wanted.lower()).select(key).distinct().withColumn("_other", F.lit(2))
    t = F.lower(F.col(title))
    hits = rows.join(other, key, "left").withColumn("match", F.when(t == wanted.lower(), 0).when(t.contains(wanted.lower()), 1).otherwise(F.col("_other"))).where("match IS NOT NULL").drop("_other")
    return hits.join(F.broadcast(hits.agg(F.min("match").alias("best"))), F.col("match") == F.col("best")).drop("best")


# The four years' readings, and names of languages and versions.
READINGS = ("ot", "nt", "bom", "dc")
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
VERSIONS = {"en": "KJV", "fr": "LSG", "de": "LUT", "es": "RV"}
VOLUMES = {3: "BoM", 4: "D&C", 5: "PGP"}


def reading_group(year: Column) -> Column:
    """What is read in a year: one of four in turn, from 2026 on."""
    return F.get(F.array(*map(F.lit, READINGS)), F.pmod(year - 2026, F.lit(4)))


def in_group(volume: Column, book: Column, group: Column) -> Column:
    """Whether a book belongs to a year's reading, by its volume, or by its title."""
    b = F.lower(book)
    matthew, history = b.rlike(r"joseph smith\s*[—-]?\s*matthew|\bjs[-\s]?m\b"), b.rlike(r"joseph smith\s*[—-]?\s*history|\bjs[-\s]?h\b")
    return (F.when(group == "ot", (volume == 1) | b.rlike(r"\bmoses\b|\babraham\b")).when(group == "nt", (volume == 2) | matthew).when(group == "bom", volume == 3)
            .when(group == "dc", (volume == 4) | history | b.rlike(r"articles?\s+of\s+faith")).otherwise(False))


def citation(lang: Column, volume: Column, second: Column) -> Column:
    """How a version is cited: by version for the first two volumes, else by language; two of them as one against the other."""
    of = lambda m: F.create_map(*[F.lit(x) for p in m.items() for x in p])
    named, version = F.coalesce(F.try_element_at(of(LANGUAGES), lang), F.lit("English")), F.coalesce(F.try_element_at(of(VERSIONS), lang), F.upper(lang), F.lit(""))
    two = F.when(volume >= 3, F.concat(named, F.lit(" vs "), F.coalesce(F.try_element_at(of(LANGUAGES), second), second))).otherwise(F.concat(version, F.lit(" vs "), F.coalesce(F.try_element_at(of(VERSIONS), second), F.upper(second))))
    book = F.try_element_at(of(VOLUMES), volume)
    return F.when(second.isNotNull(), two).when(volume >= 3, F.coalesce(F.concat(book, F.lit(", "), named), F.lit(""))).otherwise(version)


def in_range(rows: DataFrame, spans: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with ``share``: 1 where the value lies between ``low`` and ``high`` of its key, 0 where it does not, a half where the key has no span."""
    return rows.join(spans, key, "left").withColumn("share", F.when(F.col("low").isNull() | F.col("high").isNull(), 0.5).when(F.col(value).between(F.col("low"), F.col("high")), 1.0).otherwise(0.0))


def cursor_of(key: Column, offset: Column) -> Column:
    """A cursor: base64 of JSON, with the signs that addresses allow."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(F.to_json(F.struct(key.alias("k"), offset.alias("o"))), "UTF-8")), r"\s", ""), "+/", "-_"), F.lit("="))


def cursor_parts(cursor: Column) -> Column:
    """``struct<k, o>`` of a cursor; null if it is none."""
    text = F.translate(cursor, "-_", "+/")
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.decode(F.unbase64(padded), "UTF-8"), "struct<k:string,o:bigint>")


def holds_all(columns: list[Column], words: list[str]) -> Column:
    """Whether each word is in at least one of the columns, whatever its case."""
    one = lambda w: reduce(lambda a, b: a | b, [F.lower(c).contains(w.lower()) for c in columns])
    return reduce(lambda a, b: a & b, [one(w) for w in words])


def literal_first(rows: DataFrame, text: str, phrase: str, then: Column, limit: int) -> DataFrame:
    """The first rows, those that hold the phrase before the others."""
    priority = F.when(F.lower(F.col(text)).contains(phrase.lower()), 0).otherwise(1)
    return rows.withColumn("priority", priority).orderBy("priority", then).limit(limit)


def suggest(vocab: DataFrame, titles: DataFrame, prefix: str, limit: int = 10, n_titles: int = 5) -> DataFrame:
    """``suggestion, source, rank``: frequent terms with the prefix, then titles that contain it; a suggestion once."""
    terms = vocab.where(F.col("term").startswith(prefix) & (F.length("term") > 2)).orderBy(F.desc("df"), "term").limit(limit)
    terms = terms.select(F.col("term").alias("suggestion"), F.lit("term").alias("source"), F.lit(0).alias("p"), F.row_number().over(W.orderBy(F.desc("df"), "term")).alias("i"))
    found = titles.where(F.lower("title").contains(prefix)).select("title").distinct().orderBy("title").limit(n_titles)
    found = found.select(F.col("title").alias("suggestion"), F.lit("title").alias("source"), F.lit(1).alias("p"), F.row_number().over(W.orderBy("title")).alias("i"))
    return first_of_each(terms.union(found), ["suggestion"], ["p", "i"]).select("suggestion", "source", F.row_number().over(W.orderBy("p", "i")).alias("rank"))


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with one key the first; what comes from several lists keeps the place in the first of them."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def overlay(base: DataFrame, other: DataFrame, key: list[str], text: str) -> DataFrame:
    """Base rows with the other's text where it has one, and which of the two it is."""
    o = other.groupBy(*key).agg(F.min(text).alias("_other"))
    joined = base.join(o, key, "left")
    return joined.withColumn("from_overlay", F.col("_other").isNotNull()).withColumn(text, F.coalesce("_other", text)).drop("_other")


def adjacent(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Each row with the ids before and after it in its group."""
    w = W.partitionBy(group).orderBy(order)
    return rows.withColumn("previous", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def sharing(bridge: DataFrame, item: str, topic: str, k: int = 8) -> DataFrame:
    """``item, other, shared, rank``: the k items that share most topics with each item.

    The self-join meets on the topic; a topic of m items costs m * m rows, so give topics of a bounded size.
    """
    b = bridge.select(F.col(item).alias("item"), F.col(topic).alias("topic")).distinct()
    pairs = b.join(b.withColumnRenamed("item", "other"), "topic").where("item <> other").groupBy("item", "other").agg(F.count("*").alias("shared"))
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("shared"), "other"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k)


def page(ranked: DataFrame, order: list, size: int, offset: int = 0) -> DataFrame:
    """A page of a ranking, with whether more follows and the cursor of the next page (base64 of JSON)."""
    rows = ranked.orderBy(*order).offset(offset).limit(size + 1)
    n = F.count("*").over(W.partitionBy())
    more = n > size
    cursor = F.rtrim(F.translate(F.base64(F.encode(F.to_json(F.struct(F.lit(offset + size).alias("o"))), "UTF-8")), "+/", "-_"), F.lit("="))
    return rows.withColumn("more", more).withColumn("cursor", F.when(more, cursor)).withColumn("_n", F.row_number().over(W.orderBy(*order))).where(F.col("_n") <= size).drop("_n")


def passages(texts: DataFrame, asked: DataFrame, id: str, size: int, offset: int = 0) -> DataFrame:
    """A page of what each reference names: ``query_id, <id>, place, n``, n being the size of the whole.

    ``texts`` have ``book, chapter, verse``, ``asked`` has ``query_id, ref`` as ``functions.text.reference`` gives it.
    Books are known whatever their case; a reference without a verse takes its chapter. What cannot be read or is
    nowhere has no rows. Sizes are summed before the shuffle, and a page's rows are all that a window sees.
    """
    ref = asked.select("query_id", F.lower("ref.book").alias("b"), F.col("ref.chapter").alias("c"), F.col("ref.verse").alias("v"))
    met = (F.lower("book") == F.col("b")) & (F.col("chapter") == F.col("c")) & (F.col("v").isNull() | (F.col("verse") == F.col("v")))
    hits = texts.join(ref.where("b IS NOT NULL"), met).select("query_id", id)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(id))
    shown = hits.withColumn("place", place).where(F.col("place") <= offset + size).where(F.col("place") > offset)
    return shown.join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")


def upsert(base: DataFrame, change: DataFrame, key: list[str], policy: str = "replace") -> DataFrame:
    """Base rows under changes. ``replace``: the change wins; ``ignore``: the base wins; ``fill``: each column of the
    change that is not null wins; ``max``: each column's greater value. Rows on one side stay as they are."""
    values = [c for c in base.columns if c not in key]
    if policy == "replace":
        return base.join(change.select(*key), key, "left_anti").unionByName(change.select(*base.columns))
    if policy == "ignore":
        return base.unionByName(change.select(*base.columns).join(base.select(*key), key, "left_anti"))
    b, c = base.alias("b"), change.alias("c")
    on = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key])
    pick = (lambda v: F.coalesce(f"c.{v}", f"b.{v}")) if policy == "fill" else (lambda v: F.greatest(f"b.{v}", f"c.{v}"))
    return b.join(c, on, "full").select(*[F.coalesce(f"b.{k}", f"c.{k}").alias(k) for k in key], *[pick(v).alias(v) for v in values])


def checks(spark, tables: dict[str, tuple[DataFrame | None, int, str]]) -> DataFrame:
    """``artifact, n_rows, least, status``: whether tables are there and hold enough rows; the level says what a lack is."""
    parts = None
    for name, (df, least, level) in tables.items():
        n = df.agg(F.count("*").alias("n_rows")) if df is not None else spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        status = F.when(F.col("n_rows") >= least, "ok").otherwise(level)
        part = n.select(F.lit(name).alias("artifact"), "n_rows", F.lit(least).alias("least"), status.alias("status"))
        parts = part if parts is None else parts.union(part)
    return parts


def status_step(rows: DataFrame, result: str, attempts: int = 3) -> DataFrame:
    """One step of the states pending, ai-ok, ai-verified: a result moves a row on, a failure counts an attempt."""
    return rows.withColumn("attempts", F.col("attempts") + F.when((F.col("status") == "pending") & F.col(result).isNull(), 1).otherwise(0)).withColumn(
        "status", F.when((F.col("status") == "pending") & F.col(result).isNotNull(), "ai-ok").when((F.col("status") == "ai-ok") & (F.col(result) == 1), "ai-verified").when(F.col("attempts") >= attempts, "failed").otherwise(F.col("status"))
    )


def any_overlap(rows: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """``key, overlaps``: whether a key has any of the wanted items, a short list that is one row for the join. Null items are none of them.

    It is decided row by row before rows are grouped, so a key's items are never gathered.
    """
    list_ = F.broadcast(wanted.agg(F.collect_set(item).alias("_wanted")))
    return rows.join(list_).groupBy(key).agg(F.coalesce(F.bool_or(F.array_contains("_wanted", F.col(item))), F.lit(False)).alias("overlaps"))


def histograms(rows: DataFrame, columns: list[str], who: str) -> DataFrame:
    """``field, value, n, users``: for every value of some columns, its rows and how many of ``who`` they have; null is a value, null ``who`` none.

    All columns are counted in one pass; values are shown as strings.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")
    return rows.select(F.col(who).alias("who"), each).groupBy("f.field", "f.value").agg(F.count("*").alias("n"), F.count_distinct("who").alias("users"))
