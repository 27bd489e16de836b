"""Seeded random draws computed from a row id.

Each draw depends only on (seed, stream, id), so a lost task recomputes exactly the same rows
whatever the partitioning. One md5 digest yields four independent 32-bit uniforms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def digest(row_id: Column, seed: int, stream: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{stream}:"), row_id.cast("string")))


def uniform(hex_digest: Column, part: int) -> Column:
    """Uniform in [0, 1) from the given eight-digit part (0..3) of a digest."""
    word = F.conv(F.substring(hex_digest, 8 * part + 1, 8), 16, 10).cast("double")
    return word / F.lit(4294967296.0)


def integer(u: Column, low: int, high: int) -> Column:
    """Integer in [low, high)."""
    return (F.floor(u * F.lit(float(high - low))) + F.lit(low)).cast("int")


def normal(hex_digest: Column, first_part: int = 0) -> Column:
    """Standard normal by the Box-Muller transform of two parts of a digest."""
    u1 = uniform(hex_digest, first_part) + F.lit(1.0 / 8589934592.0)
    u2 = uniform(hex_digest, first_part + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def choice(u: Column, values: list) -> Column:
    """One of equally likely values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), integer(u, 1, len(values) + 1))


def weighted_choice(u: Column, values: list[str], weights: list[float]) -> Column:
    """One of several values by weight."""
    total, picked = 0.0, None
    for value, weight in list(zip(values, weights))[:-1]:
        total += weight
        test = u < F.lit(round(total, 10))
        picked = F.when(test, F.lit(value)) if picked is None else picked.when(test, F.lit(value))
    return F.lit(values[-1]) if picked is None else picked.otherwise(F.lit(values[-1]))


def uuid_text(hex_digest: Column) -> Column:
    """A digest laid out like a UUID."""
    spans = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex_digest, a, n) for a, n in spans])
