"""Collision and failure probabilities of hash families, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, formula 7.1.26
_P = 0.3275911
_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function of x >= 0 with an error of at most 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_P) * x)
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + F.lit(a)) * t
    return F.lit(1.0) - poly * F.exp(-x * x)


def simhash_collision(cosine_distance: Column) -> Column:
    """Probability that one sign symbol agrees, from 1 - cosine."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.lit(1.0) - cosine_distance))
    return F.lit(1.0) - F.acos(c) / F.lit(math.pi)


def e2lsh_collision(distance: Column, width: float) -> Column:
    """Probability that one bucket symbol of the given width agrees, from the Euclidean distance."""
    u = F.lit(width) / distance
    inside = erf(u / F.lit(math.sqrt(2.0)))
    tail = F.lit(2.0) / (F.lit(math.sqrt(2.0 * math.pi)) * u) * (F.lit(1.0) - F.exp(-u * u / F.lit(2.0)))
    return F.when(distance <= 0, F.lit(1.0)).otherwise(inside - tail)


def binomial(n: Column | int, k: Column | int) -> Column:
    """Number of ways to choose ``k`` of ``n``; 0 if ``k`` isn't from 0 to ``n``. Exact up to n = 20."""
    n, k = (v.cast("int") if isinstance(v, Column) else F.lit(v) for v in (n, k))
    ways = F.factorial(n) / (F.factorial(k) * F.factorial(n - k))
    return F.when((k >= 0) & (k <= n), F.round(ways)).otherwise(F.lit(0)).cast("long")


def minhash_collision(jaccard_distance: Column) -> Column:
    return F.lit(1.0) - jaccard_distance


def failure(p: Column, prefix: Column | int, seen: Column | int, repetitions: Column | int, depth: int) -> Column:
    """Probability that a pair with symbol probability ``p`` was not met after ``seen`` of ``repetitions`` tables
    at this prefix and the rest one symbol deeper (nothing deeper at full depth)."""
    prefix, seen, total = (v if isinstance(v, Column) else F.lit(v) for v in (prefix, seen, repetitions))
    here = F.pow(F.lit(1.0) - F.pow(p, prefix), seen)
    deeper = F.pow(F.lit(1.0) - F.pow(p, prefix + F.lit(1)), total - seen)
    return F.when(prefix >= F.lit(depth), here).otherwise(here * deeper)
