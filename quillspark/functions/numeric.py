"""Scores and vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def confidence(top: Column, n: Column) -> Column:
    """How sure a result list is, from the best score's size and the number of hits."""
    return F.sqrt(sigmoid(2.0 * (F.abs(top) - 5.0)) * sigmoid(0.15 * (n - 15.0)))


def meaning(p: Column, specificity: Column) -> Column:
    return 0.82 * p + 0.18 * sigmoid(3.2 * (specificity - 3.0))


def relevance_logit(**f: Column) -> Column:
    """The logit of the relevance probability; the features are named as in the argument list below."""
    above = lambda c, at: F.greatest(F.lit(0.0), c - at)
    # The weights.
    return (
        -4.7 + 1.18 * f["spec"] + 0.38 * F.greatest(F.lit(0.0), 5.0 - f["tier"]) + 2.05 * f["sim"] + 2.0 * f["lex"] + 1.0 * f["window"] + 1.15 * f["seq"]
        + 0.55 * f["phrase"] + 0.42 * f["walk"] + 4.5 * f["prior"] + 0.12 * F.least(f["sources"], F.lit(4)) + 0.28 * f["anchor"] + 0.08 * f["topical"] + 0.65 * f["confidence"]
        + 1.9 * above(f["lex"], 0.72) + 1.1 * above(f["seq"], 0.28) + 0.9 * above(f["spec"], 1.55)
    )


def npmi(together: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information of two terms from their document counts."""
    p = together / n
    return F.log2(p / ((a / n) * (b / n))) / -F.log2(p)


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def two_cell_g(observed: Column, expected: Column, total: Column) -> Column:
    """The log-likelihood ratio of the cells observed and not observed."""
    part = lambda o, e: F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)
    return 2.0 * (part(observed, expected) + part(total - observed, total - expected))


def lcg(seed: Column) -> Column:
    """One step of the 32-bit linear congruential generator."""
    return F.pmod(F.lit(1664525).cast("long") * seed.cast("long") + 1013904223, F.lit(2**32))


def park_miller(seed: Column) -> Column:
    return seed.cast("long") * 16807 % 2147483647


def _times(x: Column, y: Column) -> Column:
    """The product of two numbers below 2**32, modulo 2**32, without leaving 64 bits."""
    low, high = x.bitwiseAND(0xFFFF), F.shiftright(x, 16)
    return (low * y + (high * y).bitwiseAND(0xFFFF) * 65536).bitwiseAND(0xFFFFFFFF)


def mulberry(seed: Column) -> Column:
    """The first number between 0 and 1 of the 32-bit generator mulberry32 from a seed."""
    a = (seed.cast("long") + 0x6D2B79F5).bitwiseAND(0xFFFFFFFF)
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1))
    t = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(0xFFFFFFFF).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def gaussian(u: Column, v: Column) -> Column:
    """A normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2.0 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2.0 * F.pi() * v)
