"""Quality rules over lines: a linear-chain conditional random field marks content and boilerplate.

A line is described by what its words look like and by whether they come again in the text. The
field has one weight for each feature and state, for each pair of neighbouring states and for the
first state; it is fitted in numpy by its likelihood's gradient, on lines of documents whose
quality is known (each line has its document's label). Viterbi decoding finds the best states of
all lines of a text; a document stays if at least half of its characters in words are content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, RANGE, Scratch, chunks, column, columns_or_null, covered, rolling, share_of, window_starts, words

#: Labelled documents of each quality that a field is fitted on, about; and pieces of them of so many lines.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE = 1_500, 1_500, 32
#: Windows of so many words are looked for again in the same text.
WINDOW = 8
LEAST_WORDS, MOST_REPEATED, LEAST_CONTENT = 20, 30, 0.5
CONTENT, BOILERPLATE = 0, 1
#: What a word counts for, by patterns.
KINDS = {"symbols": r"[#*$%&|<>]", "upper": r"\p{Lu}", "letters": r"\p{L}", "digits": r"\p{Nd}", "marks": r"[!?]", "stops": r"[.,;:]$"}
FEATURES = ("words", "word_length", "symbols", "upper", "not_letters", "digits", "marks", "stops", "short_words", "distinct", "repeated", "same_line", "lower_first", "bare_marks")


@dataclass
class Texts:
    """A chunk of texts by words and lines; lines without a word are left out."""

    lines_of: np.ndarray  # first line of each text, one more
    words_of: np.ndarray  # first word of each text, one more
    word_at: np.ndarray  # first word of each line, one more
    chars: np.ndarray  # code points in the words of each line
    symbols: np.ndarray
    again: np.ndarray  # whether a line equals an earlier one of its text
    repeated: np.ndarray  # which words are in windows that come again
    features: np.ndarray
    lines: pa.Array


def repeated_words(codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words are covered by a window that is in their text at least twice. Windows are compared word by word where hashes agree."""
    place, doc = window_starts(starts, window)
    if not len(place):
        return np.zeros(len(codes), bool)
    h = rolling((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), window)[place]
    order = np.lexsort((place, h, doc))
    place, h, doc = place[order], h[order], doc[order]
    same = np.zeros(len(place), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lead = place[np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))]
    true = np.ones(len(place), bool)
    for k in range(window):
        true &= codes[place + k] == codes[lead + k]
    if not true.all():  # unlike windows of one hash: sort by the words themselves
        order = np.lexsort((*[codes[place + k] for k in range(window)], doc))
        place, doc = place[order], doc[order]
        same[1:] = doc[1:] == doc[:-1]
        for k in range(window):
            same[1:] &= codes[place[1:] + k] == codes[place[:-1] + k]
    hit = same | np.append(same[1:], False)
    return covered(len(codes), place[hit], window)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def described(texts: pa.Array) -> Texts:
    """Words, lines and features of all texts. Null: none."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    lines = split.flatten()
    coded, starts = words(lines)
    full = np.diff(starts) > 0
    lines_of = np.concatenate([[0], np.cumsum(full)])[ends]
    word_at = np.append(starts[:-1][full], starts[-1]).astype(np.int64)
    words_of = word_at[lines_of]
    lines = lines.filter(pa.array(full))
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    of_word = {k: pc.count_substring_regex(distinct, p).to_numpy(zero_copy_only=False).astype(np.int64) if len(distinct) else np.zeros(0, np.int64) for k, p in KINDS.items()}
    of_word["chars"] = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    by_line = {k: _sums(v[codes], word_at) for k, v in of_word.items()}
    doc_of = np.repeat(np.arange(len(texts)), np.diff(lines_of))
    seen = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    pairs = doc_of * (int(seen.max()) + 1 if len(seen) else 1) + seen
    again = np.ones(len(seen), bool)
    again[np.unique(pairs, return_index=True)[1]] = False
    repeated = repeated_words(codes, words_of, WINDOW)

    n, chars, letters = np.maximum(np.diff(word_at), 1), np.maximum(by_line["chars"], 1), np.maximum(by_line["letters"], 1)
    line_of = np.repeat(np.arange(len(seen)), np.diff(word_at))
    kinds = _sums(np.isin(np.arange(len(codes)), np.unique(line_of * max(1, len(distinct)) + codes, return_index=True)[1]), word_at)
    first = codes[word_at[:-1]] if len(seen) else codes[:0]
    lower = (of_word["upper"][first] == 0) & (of_word["letters"][first] > 0)
    bare = _sums((of_word["letters"] == 0)[codes], word_at)
    features = np.stack(
        [np.log1p(n), np.minimum(by_line["chars"] / n, 20) / 5, by_line["symbols"] / chars * 5, by_line["upper"] / letters, 1 - by_line["letters"] / chars, by_line["digits"] / chars,
         by_line["marks"] / n, by_line["stops"] / n * 5, _sums((of_word["chars"] <= 3)[codes], word_at) / n, kinds / n, _sums(repeated, word_at) / n, again, lower, bare / n],
        1,
    )
    return Texts(lines_of, words_of, word_at, by_line["chars"], by_line["symbols"], again, repeated, features, lines)


def base_failed(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text fails, its words, and those in repeated windows."""
    n, repeat = np.diff(t.words_of), _sums(t.repeated, t.words_of)
    return (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n), n, repeat


@dataclass
class Field:
    """A linear-chain conditional random field with two states."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # features and a constant, by state
    moves: np.ndarray  # from, to
    begin: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.concatenate([(features - self.mean) / self.spread, np.ones((len(features), 1))], 1) @ self.weights

    def decode(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best states of all sequences, which lie one after the other; all are decoded line by line together."""
        emit, n = self.scores(features), np.diff(starts)
        states = np.zeros(len(features), np.int8)
        order = np.argsort(-n, kind="stable")
        live = int((n > 0).sum())
        if not live:
            return states
        at, n = starts[:-1][order[:live]], n[order[:live]]
        best, back = self.begin + emit[at], np.zeros((len(features), 2), np.int8)
        alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # how many have more than t lines
        for t in range(1, n[0]):
            m = alive[t]
            ways = best[:m, :, None] + self.moves
            back[at[:m] + t] = ways.argmax(1)
            best[:m] = ways.max(1) + emit[at[:m] + t]
        now = best.argmax(1).astype(np.int8)
        for t in range(n[0] - 1, -1, -1):
            m = alive[t]
            states[at[:m] + t] = now[:m]
            now[:m] = back[at[:m] + t, now[:m]]
        return states


def fit(pieces: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field | None:
    """The field that gives the labels' states the greatest likelihood. None if one of the two labels is not there."""
    if {label for _, label in pieces} != {CONTENT, BOILERPLATE}:
        return None
    flat = np.concatenate([x for x, _ in pieces])
    mean, spread = flat.mean(0), np.maximum(flat.std(0), 1e-3)
    longest, count = max(len(x) for x, _ in pieces), len(pieces)
    x, there, y = np.zeros((longest, count, flat.shape[1] + 1)), np.zeros((longest, count), bool), np.array([label for _, label in pieces])
    for i, (own, _) in enumerate(pieces):
        x[: len(own), i, :-1], x[: len(own), i, -1], there[: len(own), i] = (own - mean) / spread, 1, True
    balance = np.where(y == CONTENT, 0.5 / (y == CONTENT).sum(), 0.5 / (y == BOILERPLATE).sum()) / np.maximum(there.sum(0), 1)
    hot = np.eye(2)[y]
    theta = [np.zeros((flat.shape[1] + 1, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for step in range(1, steps + 1):
        weights, moves, begin = theta
        emit = x @ weights
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[0] = begin + emit[0]
        for t in range(1, longest):
            alpha[t] = np.where(there[t][:, None], np.logaddexp.reduce(alpha[t - 1][:, :, None] + moves, 1) + emit[t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            on = np.logaddexp.reduce((beta[t + 1] + emit[t + 1])[:, None, :] + moves, 2)
            beta[t] = np.where(there[t + 1][:, None], on, beta[t + 1])
        whole = np.logaddexp.reduce(alpha[-1], 1)
        own = np.exp(alpha + beta - whole[None, :, None]) * there[:, :, None]
        off = (hot[None] * there[:, :, None] - own) * balance[None, :, None]
        pair = np.zeros((2, 2))
        for t in range(1, longest):
            p = np.exp(alpha[t - 1][:, :, None] + moves + (beta[t] + emit[t])[:, None, :] - whole[:, None, None])
            pair += ((hot[:, :, None] * hot[:, None, :] - p) * (there[t] * balance)[:, None, None]).sum(0)
        grads = [np.einsum("tnf,tns->fs", x, off) - ridge * weights, pair - ridge * moves, off[0].sum(0) - ridge * begin]
        for i, g in enumerate(grads):  # Adam, upwards
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g**2
            theta[i] = theta[i] + rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Field(mean, spread, *theta)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of every piece of ``PIECE`` lines, with the document's label. What the base rules fail is not for the field to judge."""
    for whole in batches:
        for b in chunks(whole):
            t, quality, key = described(column(b, "text")), column(b, "quality").to_pylist(), column(b, "h").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            failed = base_failed(t)[0]
            for i, (a, z) in enumerate(zip(t.lines_of[:-1], t.lines_of[1:], strict=True)):
                for s in range(a, a if failed[i] else z, PIECE):
                    out[0].append(key[i] ^ (s - a))
                    out[1].append(quality[i])
                    out[2].append(t.features[s : min(s + PIECE, z)].ravel())
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.float64()))], ["h", "quality", "features"])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Field | None:
    """Fits a field on about ``SAMPLE_PIECES`` pieces of about ``SAMPLE_DOCS`` documents of either quality, drawn by hashes.

    A document with several labels has the worst; labels other than 0 and 1, or without a document, count for nothing.
    """
    label = columns_or_null(labels, doc_id="long", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    label = label.withColumn("h", F.pmod(F.xxhash64(F.lit("lines"), "doc_id"), F.lit(RANGE)))
    bounds = {r.quality: share_of(SAMPLE_DOCS, r.n) for r in label.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    some = [F.col("h").__lt__(b) & (F.col("quality") == q) for q, b in bounds.items()]
    if len(some) < 2:
        return None
    rows = docs.join(F.broadcast(label.where(some[0] | some[1])), "doc_id").select("text", "quality", "h")  # some 4,000 ids
    rows = scratch.save(rows.mapInArrow(_pieces, "h long, quality int, features array<double>"), "pieces")
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.lit("pieces"), "h", "features"), F.lit(RANGE)))
    bounds = {r.quality: share_of(SAMPLE_PIECES, r.n) for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    found = [(np.array(r.features).reshape(-1, len(FEATURES)), BOILERPLATE if r.quality == 0 else CONTENT) for q, b in bounds.items() for r in rows.where((F.col("quality") == q) & (F.col("h") < b)).orderBy("h").collect()]
    return fit(found)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate_lines long, content_text string"


def _judge(field: Field | None, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, CHUNK // 2):
                t = described(column(b, "text"))
                states = field.decode(t.features, t.lines_of) if field else np.zeros(len(t.chars), np.int8)
                failed, n_words, repeat = base_failed(t)
                chars, content = _sums(t.chars, t.lines_of), _sums(np.where(states == CONTENT, t.chars, 0), t.lines_of)
                share = content / np.maximum(chars, 1)
                kept = ~failed & (share >= LEAST_CONTENT)
                if texts:
                    lines = t.lines.to_pylist()
                    shown = pa.array(["\n".join(lines[i] for i in range(a, z) if states[i] == CONTENT) for a, z in zip(t.lines_of[:-1], t.lines_of[1:], strict=True)], pa.string())
                else:
                    shown = pa.nulls(b.num_rows, pa.string())
                counts = [n_words, chars, _sums(t.symbols, t.lines_of), _sums(t.again, t.lines_of), repeat]
                more = [np.diff(t.lines_of), _sums(states == BOILERPLATE, t.lines_of)]
                long = lambda x: pa.array(x.astype(np.int64))
                yield pa.record_batch([column(b, "doc_id"), *map(long, counts), pa.array(failed), pa.array(kept), pa.array(share), *map(long, more), shown], [x.split()[0] for x in OUT.split(", ")])

    return run


def line_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, texts: bool = True) -> DataFrame:
    """One row per document with the columns of ``OUT``; ``content_text`` (its content lines) is null unless ``texts``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A document fails the base rules with fewer than 20 words, or with more than 30 % of
    its words in windows of 8 words that come again in it. Null and empty texts have no words and fail. Without documents of
    both qualities that pass the base rules every line is content. Repeated rows are judged alike, each for itself. Other columns
    are not looked at. An empty table gives no rows.
    """
    rows = columns_or_null(docs, doc_id="long", text="string")
    field = train(rows, labels, Scratch(spark, "lines"))
    return rows.mapInArrow(_judge(field, texts), OUT)


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), texts=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines", "n_boilerplate_lines")
