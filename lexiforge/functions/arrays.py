"""Arithmetic on arrays and probabilities, in the JVM (M1-M6)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LN_BILLION = math.log(1e9)
#: Quantised log probabilities are steps of 1/SCALE, as 16-bit numbers.
SCALE = 4096


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, also where f uses it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def mean(v: Column) -> Column:
    return total(doubles(v)) / F.greatest(F.size(v), F.lit(1))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    def scaled(m: Column) -> Column:
        var = total(F.transform(doubles(v), lambda x: (x - m) * (x - m))) / F.greatest(F.size(v), F.lit(1))
        return let(F.sqrt(var + eps), lambda s: F.transform(doubles(v), lambda x: (x - m) / s))

    return let(mean(v), scaled)


def gelu(x: Column) -> Column:
    """By a polynomial for erf with an error below 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = (1 - poly * F.exp(-z * z)) * F.signum(x)
    return 0.5 * x * (1 + erf)


def log_sum_exp(v: Column) -> Column:
    return let(F.array_max(v), lambda top: top + F.ln(total(F.transform(v, lambda x: F.exp(x - top)))))


def softmax_top(v: Column) -> Column:
    """(0-based place of the first highest value, its softmax probability); null for an empty array."""
    def best(top: Column) -> Column:
        return F.struct((F.array_position(v, top) - 1).cast("int").alias("at"), (1 / total(F.transform(v, lambda x: F.exp(x - top)))).alias("p"))

    return F.when(F.size(v) > 0, let(F.array_max(v), best))


def quantise(p: Column) -> Column:
    """M2: -ln p in steps of 1/SCALE, within 16 bits; null without a positive p."""
    return F.when(p > 0, F.least(F.greatest(F.round(-F.ln(p) * SCALE), F.lit(0)), F.lit(65535)).cast("long"))


def dequantise(q: Column) -> Column:
    return F.exp(-q / SCALE)


def ratio(a: Column, b: Column) -> Column:
    """M6."""
    return a / F.greatest(b, F.lit(1))


def char_grams(word: Column, most: int = 3, cap: int = 40) -> Column:
    """M4: the runs of one to `most` letters of <word>, and <word> itself, at most `cap`."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    n = F.char_length(w)
    out = F.array(w)
    for k in range(most, 0, -1):
        out = F.concat(_runs_of(w, n, k), out)
    return F.slice(out, 1, cap)


def _runs_of(w: Column, n: Column, k: int) -> Column:
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def buckets(grams: Column, n: int = 65536) -> Column:
    return F.transform(grams, lambda g: F.crc32(g.cast("binary")) % n)
