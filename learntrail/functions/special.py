"""The logarithm of the gamma function and its first two derivatives as column expressions.

From 8 on by their asymptotic series, below by the recurrence from ``x + 8``, and below 1/2 by reflection. Null, as is the
result, at 0 and the negative whole numbers, where they have poles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bernoulli numbers B2 to B16 (fixed values).
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6, -3617 / 510)
SHIFT = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, so that expressions stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _of(x: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of ``x`` as a double without poles, what stands in for it from 1/2 on, and that or its shift to 8 and above."""
    x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    plain = _let(x, lambda x: F.when((x > 0) | (x != F.floor(x)), x))
    return _let(plain, lambda x: _let(F.when(x < 0.5, 1 - x).otherwise(x), lambda z: _let(F.when(z < SHIFT, z + SHIFT).otherwise(z), lambda w: body(x, z, w))))


def _sum(terms) -> Column:
    terms = list(terms)
    return terms[0] + _sum(terms[1:]) if len(terms) > 1 else terms[0]


def _series(w: Column, of: Callable[[int, float], float]) -> Column:
    """The sum over k of ``of(k, B2k)`` times the 2k-th power of 1 / w, by Horner's rule."""
    square, out = 1 / (w * w), F.lit(0.0)
    for k, b in reversed(list(enumerate(BERNOULLI, 1))):
        out = (out + of(k, b)) * square
    return out


def log_gamma(x: Column) -> Column:
    """ln |gamma(x)|."""

    def body(x: Column, z: Column, w: Column) -> Column:
        whole = (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + w * _series(w, lambda k, b: b / (2 * k * (2 * k - 1)))
        product = z
        for k in range(1, SHIFT):
            product = product * (z + k)
        whole = whole - F.when(z < SHIFT, F.ln(product)).otherwise(0.0)
        return F.when(x < 0.5, F.ln(math.pi / F.abs(F.sin(math.pi * (x - 2 * F.floor(x / 2))))) - whole).otherwise(whole)

    return _of(x, body)


def digamma(x: Column) -> Column:
    """The derivative of ``log_gamma``."""

    def body(x: Column, z: Column, w: Column) -> Column:
        whole = F.ln(w) - 0.5 / w - _series(w, lambda k, b: b / (2 * k))
        whole = whole - F.when(z < SHIFT, _sum(1 / (z + k) for k in reversed(range(SHIFT)))).otherwise(0.0)
        return F.when(x < 0.5, whole - math.pi / F.tan(math.pi * (x - F.floor(x)))).otherwise(whole)

    return _of(x, body)


def trigamma(x: Column) -> Column:
    """The derivative of ``digamma``."""

    def body(x: Column, z: Column, w: Column) -> Column:
        whole = 1 / w + 0.5 / (w * w) + _series(w, lambda k, b: b) / w
        whole = whole + F.when(z < SHIFT, _sum(1 / ((z + k) * (z + k)) for k in reversed(range(SHIFT)))).otherwise(0.0)
        return F.when(x < 0.5, F.pow(math.pi / F.sin(math.pi * (x - F.floor(x))), F.lit(2.0)) - whole).otherwise(whole)

    return _of(x, body)
