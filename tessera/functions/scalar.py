"""Column functions: hashing, masks, clamps, unordered comparisons, and the pair physics of the particle plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multiplier of the multiplicative hash and its modulus.
MULTIPLIER, MODULUS = 2654435769, 1 << 32


def multiplicative_hash(key: Column, shift: int) -> Column:
    """The top 32 - shift bits of key * MULTIPLIER modulo MODULUS; negative keys are legal, null gives null."""
    return F.shiftright(F.pmod(key.cast("long") * F.lit(MULTIPLIER), F.lit(MODULUS)), shift)


def masked(mask: Column, value: Column, old: Column) -> Column:
    """value where mask holds, else old; a null mask keeps old."""
    return F.when(mask, value).otherwise(old)


def saturating_add(a: Column, b: Column, low: int = -(2**31), high: int = 2**31 - 1) -> Column:
    return F.least(F.greatest(a.cast("long") + b.cast("long"), F.lit(low)), F.lit(high))


def saturating_sub(a: Column, b: Column, low: int = -(2**31), high: int = 2**31 - 1) -> Column:
    return F.least(F.greatest(a.cast("long") - b.cast("long"), F.lit(low)), F.lit(high))


def unordered(a: Column, b: Column) -> Column:
    """Whether either is not a number; ordered() is its opposite."""
    return F.isnan(a) | F.isnan(b)


def ordered(a: Column, b: Column) -> Column:
    return ~unordered(a, b)


def not_less(a: Column, b: Column) -> Column:
    """Not a < b in IEEE terms: true where unordered."""
    return unordered(a, b) | (a >= b)


def not_less_equal(a: Column, b: Column) -> Column:
    return unordered(a, b) | (a > b)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.when(b != 0, b)


def minimum_image(delta: Column, side: float) -> Column:
    """The periodic difference of least size for positions within one box."""
    half = side / 2
    return F.when(delta < -half, delta + side).when(delta > half, delta - side).otherwise(delta)


def wrap(position: Column, side: float) -> Column:
    """A position at most one box outside, back in the box."""
    return F.when(position < 0, position + side).when(position > side, position - side).otherwise(position)


def squared_distance(*deltas: Column) -> Column:
    total = deltas[0] * deltas[0]
    for d in deltas[1:]:
        total = total + d * d
    return total


def pair_force(rd: Column) -> Column:
    """The force over distance of a pair at squared distance rd: rd**-7 - rd**-4 / 2; null for coinciding particles."""
    inverse = F.lit(1.0) / F.when(rd != 0, rd)
    cube = inverse * inverse * inverse
    return cube * cube * inverse - F.lit(0.5) * cube * inverse


def pair_energy(rd: Column) -> Column:
    inverse = F.lit(1.0) / F.when(rd != 0, rd)
    cube = inverse * inverse * inverse
    return cube * cube - cube


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length."""
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def uniform(seed: str, *key: Column) -> Column:
    """A reproducible draw in [0, 1) for each key, the same in any partitioning and engine: from an md5 digest."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
