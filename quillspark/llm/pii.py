"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find the base spans. The tagger is trained in numpy from windows of a bounded sample,
labelled with base spans and with variants of them that the patterns miss (a phone number without
its plus sign). It reads every text in overlapping windows around digits and at signs, without
which no kind can occur; windows are decoded with Viterbi and reconciled over the whole text: each
character takes its tag from the window in whose middle it lies most. Tagged spans that are valid
and touch no other span are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_or_null, drawn, share_of

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
WINDOW, STRIDE, REACH = 96, 48, 40
#: The tagger is fitted on windows of about this many documents, and on no more than so many windows.
SAMPLE_DOCS, SAMPLE_WINDOWS = 20_000, 3_000
HIDDEN, STEPS, BATCH, SEED = 16, 240, 48, 11
#: Windows decoded at once.
AT_ONCE = 2048
TAGS = 1 + 2 * len(KINDS)
MARKS = "@.+-()%_/:,#\"'=\n "
CLASSES = 5 + len(MARKS)


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    n = len(digits(s))
    if kind == "ip":
        return [p.isdigit() and p.isascii() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split(".")] == [True] * 4
    if kind == "card":
        return 13 <= n <= 19 and luhn(digits(s))
    if kind == "phone":
        return 9 <= n <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the pattern matches that are valid: by kind, leftmost, without overlap."""
    out, last, p = [], 0, text.find("@")
    while p >= 0:  # every match has one at sign, and starts as far left of it as it can
        s = p
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        if s < p and (m := DOMAIN.match(text, p + 1)):
            out.append((0, s, last := m.end()))
        p = text.find("@", p + 1)
    if not SIGN.search(text):
        return out
    for run in DOTTED.finditer(text):
        if text.count(".", *run.span()) >= 3:
            out += [(1, *m.span()) for m in IP.finditer(text, *run.span()) if valid("ip", m.group())]
    out += [(2, *m.span()) for m in CARD.finditer(text) if valid("card", m.group())]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if valid("phone", m.group())]
    return out


def char_classes(text: str) -> np.ndarray:
    """A small number for each character: digit, letter case, one of MARKS, or other; 0 pads."""
    table = char_classes.table
    if table is None:
        table = np.full(256, 4, np.int8)
        for i in range(256):
            c = chr(i)
            table[i] = 5 + MARKS.index(c) if c in MARKS else 1 if c in "0123456789" else 2 if c.islower() else 3 if c.isupper() else 4
        char_classes.table = table
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return table[np.minimum(codes, 255)]


char_classes.table = None


def windows_of(text: str) -> list[int]:
    """The starts of overlapping windows that hold every character within reach of a digit or at sign."""
    out: list[int] = []
    to = -1
    for m in SIGN.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if a > to:
            out.append(a)
        while out[-1] + WINDOW < b:
            out.append(out[-1] + STRIDE)
        to = max(b, out[-1] + WINDOW - STRIDE)
    return out


def labels_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for kind, a, b in reversed(spans):
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


class Tagger:
    """A bidirectional LSTM over character classes, a linear layer, and a CRF over the tags."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        w = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": w(CLASSES, 4 * HIDDEN), f"h{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
        self.p |= {"out": w(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "begin": np.zeros(TAGS, np.float32)}

    def _lstm(self, x: np.ndarray, d: str):
        """Hidden states of all steps, and what the way back needs. Gates in order: input, forget, output, new."""
        n, steps = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = self.p[f"x{d}"][x[:, t]] + h @ self.p[f"h{d}"] + self.p[f"c{d}"]
            s, new = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN])), np.tanh(g[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            kept.append((t, before_h, before_c, i, f, o, new, squashed))
        return out, kept

    def emissions(self, x: np.ndarray):
        f, kf = self._lstm(x, "f")
        b, kb = self._lstm(x, "b")
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["bias"], both, kf, kb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag path of each window (Viterbi)."""
        e = self.emissions(x)[0]
        score, back = e[0] + self.p["begin"], np.zeros((len(e), len(x), TAGS), np.int8)
        for t in range(1, len(e)):
            all_ = score[:, :, None] + self.p["move"]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        path = np.zeros(x.shape, np.int8)
        path[:, -1] = score.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(len(x)), path[:, t]]
        return path

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the tag paths ``y``."""
        e, both, kf, kb = self.emissions(x)
        steps, n = len(e), len(x)
        move, begin = self.p["move"], self.p["begin"]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0] + begin
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        for t in range(steps):
            de[t][rows, y[:, t]] -= 1
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
                np.add.at(pair, (y[:, t - 1], y[:, t]), -1)
                g["move"] += pair / n
        de /= n
        g["begin"], g["bias"] = de[0].sum(0), de.sum((0, 1))
        g["out"] = np.einsum("tnh,tnk->hk", both, de)
        dh = de @ self.p["out"].T
        for d, kept, own in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            later_h, later_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, before_h, before_c, i, f, o, new, squashed in reversed(kept):
                h = own[t] + later_h
                c = later_c + h * o * (1 - squashed**2)
                gate = np.concatenate([c * new * i * (1 - i), c * before_c * f * (1 - f), h * squashed * o * (1 - o), c * i * (1 - new**2)], 1)
                np.add.at(g[f"x{d}"], x[:, t], gate)
                g[f"h{d}"] += before_h.T @ gate
                g[f"c{d}"] += gate.sum(0)
                later_h, later_c = gate @ self.p[f"h{d}"].T, c * f
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.02) -> Tagger:
        """Adam over random batches; the same for the same windows."""
        r = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = r.integers(0, len(x), BATCH)
            g = self.gradients(x[pick], y[pick])
            size = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            for k in self.p:
                a = g[k] * min(1.0, 5 / max(size, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a**2
                step = rate * (1 - t / steps) + rate / 20
                self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _training_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for doc_id, text in zip(f["h"], f["text"], strict=True):
            text = text or ""
            spans, starts = base_spans(text), windows_of(text)
            variants = [(text, spans)]
            if starts and (phones := [s for s in spans if s[0] == 3]):  # the same without its plus sign
                _, a, b = phones[0]
                cut = text[:a] + text[a + 1 :]
                variants.append((cut, [(3, a, b - 1)] + [s for s in base_spans(cut) if s[2] <= a or s[1] >= b]))
            for k, (t, own) in enumerate(variants):
                x, y = char_classes(t), labels_of(len(t), own)
                for s in starts:
                    out.append((f"{doc_id:x}:{k}:{s}", x[s : s + WINDOW].tobytes(), y[s : s + WINDOW].tobytes()))
        yield pd.DataFrame(out, columns=["name", "x", "y"])


def train(docs: DataFrame, steps: int = STEPS) -> dict[str, np.ndarray] | None:
    """The tagger's parameters, from windows of a sample of documents bounded by SAMPLE_DOCS and SAMPLE_WINDOWS."""
    n = docs.count()
    sample = docs.where(drawn(share_of(SAMPLE_DOCS, n))).where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    rows = sample.mapInPandas(_training_windows, "name string, x binary, y binary").orderBy(F.md5("name"), "name").limit(SAMPLE_WINDOWS).collect()
    if not rows:
        return None
    x, y = (np.zeros((len(rows), WINDOW), np.int8) for _ in range(2))
    for i, r in enumerate(rows):
        x[i, : len(r["x"])], y[i, : len(r["y"])] = np.frombuffer(r["x"], np.int8), np.frombuffer(r["y"], np.int8)
    return Tagger().fit(x, y, steps).p


def reconcile(n: int, starts: list[int], paths: np.ndarray) -> np.ndarray:
    """One tag for each character of a text: of the windows over it, the one whose middle is nearest (ties: the earlier)."""
    tags, near = np.zeros(n, np.int8), np.full(n, WINDOW)
    off = np.abs(np.arange(WINDOW) * 2 - WINDOW + 1) // 2
    for s, path in zip(starts, paths, strict=True):
        e = min(n, s + WINDOW)
        better = off[: e - s] < near[s:e]
        tags[s:e][better], near[s:e][better] = path[: e - s][better], off[: e - s][better]
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, at, n = [], 0, len(tags)
    places = np.flatnonzero(tags)
    i = 0
    while i < len(places):
        at = int(places[i])
        kind, end = (int(tags[at]) - 1) // 2, at + 1
        while end < n and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((kind, at, end))
        i = int(np.searchsorted(places, end))
    return out


def plausible(kind: int, s: str) -> bool:
    """Whether a tagged string can be of its kind at all."""
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", s)) and s[-1].isalnum()
    if not s or not (s[0].isdigit() or s[0] in "(+") or not s[-1].isdigit() or not s.isascii():
        return False
    if kind == 3 and (not re.search(r"[ ().-]", s) or not re.fullmatch(r"[0-9+() .-]+", s)):
        return False
    return valid(KINDS[kind], s)


def _show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _find(params: dict[str, np.ndarray] | None):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger()
        tagger.p = params
        for f in frames:
            texts = [t or "" for t in f["text"]]
            base, starts = [base_spans(t) for t in texts], [windows_of(t) if params else [] for t in texts]
            cut = [(i, s) for i, own in enumerate(starts) for s in own]
            paths = np.zeros((len(cut), WINDOW), np.int8)
            for a in range(0, len(cut), AT_ONCE):
                x = np.zeros((min(AT_ONCE, len(cut) - a), WINDOW), np.int8)
                for j, (i, s) in enumerate(cut[a : a + AT_ONCE]):
                    own = char_classes(texts[i][s : s + WINDOW])
                    x[j, : len(own)] = own
                paths[a : a + len(x)] = tagger.decode(x)
            rows, at = [], 0
            for i, text in enumerate(texts):
                spans = list(base[i])
                if starts[i]:
                    own = spans_of(reconcile(len(text), starts[i], paths[at : at + len(starts[i])]))
                    at += len(starts[i])
                    for kind, a, b in own:
                        if plausible(kind, text[a:b]) and all(b <= s[1] or a >= s[2] for s in spans):
                            spans.append((kind, a, b))
                counts = [sum(s[0] == k for s in base[i]) for k in range(4)]
                rows.append((*counts, hashlib.sha256(_show(base[i]).encode()).hexdigest(), _show(sorted(spans))))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            yield pd.concat([f[["doc_id"]].reset_index(drop=True), out], axis=1)

    return go


def find_personal_data(spark: SparkSession, docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are of the base spans; ``spans`` has the tagger's as well. Null and empty
    texts have none; repeated rows are judged each by itself. Without a document that holds a digit
    or at sign there is no tagger and nothing to tag. Other columns are not looked at. An empty table gives no rows.
    """
    docs = columns_or_null(docs, doc_id="long", text="string")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.mapInPandas(_find(train(docs, steps)), schema)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
