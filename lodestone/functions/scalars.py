"""Row-wise measures of probability vectors and representations, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308  # smallest normal double


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    """exp(x - max) over their sum; the maximum and the sum are computed once for each row."""
    shifted = F.transform(F.array(F.array_max(logits)), lambda m: F.transform(logits, lambda x: F.exp(x - m)))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(F.array(total(e)), lambda s: F.transform(e, lambda x: x / s))[0])[0]


def valid_probabilities(p: Column) -> Column:
    """Finite, within 0 and 1, and adding up to 1 within 1.1e-5."""
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)) & (F.abs(total(p) - 1) <= 1.1e-5)


def _log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(TINY)))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats; a zero adds nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * _log(x)).otherwise(0.0)))


def kl_divergence(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (_log(a) - _log(b))).otherwise(0.0)))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, held within 0 and ln 2; a value further than 1e-5 outside (from what are no probabilities) is an error."""
    side = lambda x, m: F.when(x > 0, x * (_log(x) - _log(m))).otherwise(0.0)
    both = total(F.zip_with(p, q, lambda a, b: side(a, (a + b) / 2) + side(b, (a + b) / 2))) / 2
    top = F.ln(F.lit(2.0))
    outside = lambda v: F.raise_error(F.concat(F.lit("divergence outside its bounds: "), v.cast("string"))).cast("double")
    return once(both, lambda v: F.when((v < -1e-5) | (v > top + 1e-5), outside(v)).otherwise(F.least(F.greatest(v, F.lit(0.0)), top)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a null vector; vectors of different lengths, or without a norm, are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    undefined = F.raise_error(F.lit("cosine of a zero vector or of different lengths")).cast("double")
    found = once(norms, lambda n: F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n).otherwise(undefined))
    return F.when(a.isNotNull() & b.isNotNull(), found)


def argmax(p: Column) -> Column:
    """Index from 0; the first of equal maxima."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def sigmoid(z: Column, bound: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-bound)), F.lit(bound))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without observations."""
    p = F.try_divide(successes.cast("double"), n)
    scale, middle = 1 + z * z / n, p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (middle - half) / scale), F.when(n > 0, (middle + half) / scale)


def warmup_cosine(step: Column, warmup: int, steps: int) -> Column:
    """Learning-rate factor: linear to 1 over warmup steps, then a half cosine to 0."""
    share = (step - warmup) / max(steps - warmup, 1)
    return F.when(step < warmup, (step + 1) / warmup).otherwise((1 + F.cos(F.least(share, F.lit(1.0)) * 3.141592653589793)) / 2)


def difference_bits(vector: Column) -> Column:
    """Text of 0 and 1: whether each element exceeds the one before it."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(vector) - 1), lambda i: F.when(F.get(vector, i) > F.get(vector, i - 1), "1").otherwise("0")), "")
