"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram binds three of
them: the first rotated by two, the second by one, the third as it is, multiplied. A document
bundles (adds) its trigrams, a language the directions of its training documents. Documents are
compared with the languages' prototypes, less what all prototypes share, by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, free_name, give_back, share_of

DIMS = 1024
SEED = 7
#: Training documents drawn for each language, about; the classifier is fitted on this bounded sample.
SAMPLE_PER_LANGUAGE = 4_000
#: Tasks that the sample is dealt to; each returns one vector for each language.
TRAINERS = 24
UNKNOWN = "und"
CHUNK = 1_000_000


@cache
def _letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else 0: the boundary of words."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


@cache
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMS, np.int8) * 2 - 1).astype(np.int8)


def bundles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray | None]]:
    """Each text's number and vector; None if it has no letter. Every letter counts once, with its neighbours."""
    at = 0
    while at < len(texts):
        size, to = len(texts[at] or ""), at + 1
        while to < len(texts) and size + len(texts[to] or "") <= CHUNK:
            size, to = size + len(texts[to] or ""), to + 1
        lowered = [(t or "").lower() for t in texts[at:to]]
        codes = _letter_table()[np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), "<u4")]
        doc = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])
        doc = np.concatenate([[0], doc])  # the separator before a text is the previous one's
        distinct, own = np.unique(codes, return_inverse=True)
        if distinct[0] != 0:
            distinct, own = np.concatenate([[0], distinct]), own + 1
        mid = np.flatnonzero(codes[1:-1]) + 1
        k = len(distinct)
        gram, owner = (own[mid - 1] * k + own[mid]) * k + own[mid + 1], doc[mid]
        if k**3 <= 20_000_000:
            there = np.flatnonzero(np.bincount(gram, minlength=k**3))
            number = np.zeros(k**3, np.int32)
            number[there] = np.arange(len(there))
            gram = number[gram]
        else:
            there, gram = np.unique(gram, return_inverse=True)
        letters = np.stack([np.zeros(DIMS, np.int8) + 1, *[_letter(int(c)) for c in distinct[1:]]])
        first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
        vectors = (first[there // (k * k)] * second[there // k % k] * letters[there % k]).astype(np.float32) if len(there) <= 30_000 else None
        ends = np.searchsorted(owner, np.arange(len(lowered) + 1))
        for i in range(len(lowered)):
            mine = gram[ends[i] : ends[i + 1]]
            if not len(mine):
                yield at + i, None
                continue
            counts = np.bincount(mine)
            has = np.flatnonzero(counts)
            if vectors is not None:
                yield at + i, counts[has].astype(np.float32) @ vectors[has]
                continue
            total = np.zeros(DIMS, np.float32)
            for s in range(0, len(has), 8192):  # a script of many letters: bound in parts
                g = there[has[s : s + 8192]]
                total += counts[has[s : s + 8192]].astype(np.float32) @ (first[g // (k * k)] * second[g // k % k] * letters[g % k]).astype(np.float32)
            yield at + i, total
        at = to


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for i, v in bundles(b.column(1).to_pylist()):
            if v is not None and (norm := float(np.linalg.norm(v))) > 0:
                sums[langs[i]] = sums.get(langs[i], 0) + v.astype(np.float64) / norm
    yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])


def is_held_out() -> Column:
    """Documents whose crc32 of doc_id, as text, leaves 1 when divided by 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their prototypes (unit rows), from the text and lang of documents not held out.

    A bounded sample is drawn by a hash of the row, about ``per_language`` documents of each language.
    """
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return [], np.zeros((0, DIMS), np.float32)
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, share_of(per_language, n))])
    parts = rows.where(drawn(bound[F.col("lang")])).select("lang", "text").repartition(TRAINERS).mapInArrow(_profiles, "lang string, vector binary").collect()
    sums: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], r["vector"])):
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["vector"])
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((0, DIMS), np.float32)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    p = unit(np.stack([sums[x] for x in langs]))
    return langs, unit(p - p.mean(0)).astype(np.float32) if len(langs) > 1 else p.astype(np.float32)


def predictor(langs: list[str], prototypes: np.ndarray):
    """A pandas UDF of the text: ``struct<lang_pred string, score double>``."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, v in bundles(texts.tolist()):
                if v is not None and langs:
                    cos = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(cos.argmax())
                    pred[i], score[i] = langs[best], min(1.0, max(0.0, float(cos[best])))
            yield pd.DataFrame({"lang_pred": pred, "score": score})
        give_back()

    return predict


def identify_languages(spark: SparkSession, docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The documents with ``held_out, lang_pred, score`` added.

    Null texts and texts without letters are ``und`` with score 0, and so is everything where no
    document has a language. Ties go to the first language by code point. Learns from labelled
    documents that are not held out; repeated rows count as often as they are there. Columns of the
    input that have one of the three names are replaced, all others stay as they are. An empty table gives no rows.
    """
    langs, prototypes = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), per_language)
    rest = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    found = free_name(docs, "found")
    rows = docs.withColumn(found, predictor(langs, prototypes)(F.col("text").cast("string")))
    return rows.select(*[F.col(f"`{c}`") for c in rest], is_held_out().alias("held_out"), F.col(f"{found}.lang_pred").alias("lang_pred"), F.col(f"{found}.score").alias("score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify_languages(spark, docs).select("doc_id", "held_out", "lang_pred", "score")
