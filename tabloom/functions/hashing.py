"""Row-hash randomness: the same row draws the same number in any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 2**52


def uniform(*keys: Column | str, seed: int = 42) -> Column:
    """A number in (0, 1) decided by the key columns and the seed."""
    h = F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(int(seed)))
    return (F.pmod(h, F.lit(_BITS)) + F.lit(0.5)) / F.lit(float(_BITS))


def normal(*keys: Column | str, seed: int = 42) -> Column:
    """A standard normal draw (Box-Muller on two hash uniforms)."""
    u1 = uniform(*keys, seed=seed)
    u2 = uniform(*keys, seed=seed + 7919)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def poisson_one(*keys: Column | str, seed: int = 42) -> Column:
    """A Poisson(1) draw by inverting its distribution function."""
    u = uniform(*keys, seed=seed)
    out, cdf, term = F.lit(0), 0.0, math.exp(-1.0)
    for k in range(1, 12):
        cdf += term
        term /= k
        out = out + (u > F.lit(cdf)).cast("int")
    return out
