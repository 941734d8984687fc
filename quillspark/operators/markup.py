"""Sections of markup and the notes that their anchors lead to, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import stripped

#: What is read: a heading and its level, an anchor within the page, an element with an id up to the first end of a block.
HEADING = r"(?is)^<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>"
ANCHOR = r'(?i)<a\b[^>]*\bhref="#([^"]+)"'
TARGET = r'(?is)<[a-z][a-z0-9]*\b[^>]*\bid="([^"]+)"[^>]*>(.*?)</(?:li|p|div|aside|dd|td|section)\s*>'


def _plain(html):
    """Markup without scripts, styles and comments."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")


def _parts(pages: DataFrame) -> DataFrame:
    """``id, section, level, part``: pages cut before every heading. A blank before the first keeps a piece that is empty."""
    cut = F.split(F.concat(F.lit(" "), _plain("html")), r"(?i)(?=<h[1-6]\b[^>]*>)")
    rows = pages.where("html IS NOT NULL").select("id", F.posexplode(cut).alias("section", "part"))
    return rows.withColumn("level", F.when(F.col("section") == 0, 0).otherwise(F.regexp_extract("part", r"(?i)^<h([1-6])", 1).cast("int")))


def sections(pages: DataFrame) -> DataFrame:
    """``id, section, level, parent, title, body``: pages cut before every heading, in order.

    ``pages(id, html)``, ids distinct. Section 0 is what stands before the first heading, of level 0 and without a title; it is there
    also if empty. ``parent`` is the nearest section before of a smaller level. A heading that is never closed has an
    empty title and its text in the body. Scripts, styles and comments go first; null markup has no sections.
    """
    rows = _parts(pages).select("id", "section", "level", stripped(F.regexp_extract("part", HEADING, 2)).alias("title"), F.regexp_replace("part", HEADING, "").alias("body"))
    before = W.partitionBy("id").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    parent = F.coalesce(*[F.when(F.col("level") == n, F.max(F.when(F.col("level") < n, F.col("section"))).over(before)) for n in range(1, 7)])
    return rows.select("id", "section", "level", parent.alias("parent"), "title", "body")


def notes(pages: DataFrame) -> DataFrame:
    """``id, section, level, nth, anchor, note``: every anchor within a page, in order, with the text of the element that it leads to.

    Anchors of titles belong to their section and come first. Of elements with one id the first counts; an anchor to nothing has a null note.
    """
    anchors = _parts(pages).select("id", "section", "level", F.posexplode(F.regexp_extract_all("part", F.lit(ANCHOR), 1)).alias("nth", "anchor"))
    plain = _plain("html")
    ids, texts = F.regexp_extract_all(plain, F.lit(TARGET), 1), F.regexp_extract_all(plain, F.lit(TARGET), 2)
    targets = pages.where("html IS NOT NULL").select("id", F.posexplode(F.arrays_zip(ids.alias("anchor"), texts.alias("text"))).alias("place", "t"))
    first = targets.groupBy("id", F.col("t.anchor").alias("anchor")).agg(stripped(F.min_by("t.text", "place")).alias("note"))
    return anchors.join(first, ["id", "anchor"], "left").select("id", "section", "level", "nth", "anchor", "note")
