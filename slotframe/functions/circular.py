"""Circular arithmetic of unsigned 64-bit slot offsets, on DECIMAL(38,0) columns.

``less`` is no total order: at a distance of exactly 2^63 each of two offsets is less than the other. So it is for
predicates only, never for sorting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 64
HALF = 1 << 63
MAX_DISTANCE = HALF - 1


def _wide(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _wrap(x: Column) -> Column:
    return F.pmod(x.cast("decimal(38,0)"), _wide(WORD)).cast("decimal(38,0)")


def less(a: Column, b: Column) -> Column:
    return _wrap(b - a - 1) < _wide(HALF)


def slot_min(a: Column, b: Column) -> Column:
    return F.when(less(a, b), a).otherwise(b)


def slot_max(a: Column, b: Column) -> Column:
    return F.when(less(a, b), b).otherwise(a)


def difference(a: Column, b: Column) -> Column:
    """b - a as a signed 64-bit value."""
    d = _wrap(b - a)
    return F.when(d >= _wide(HALF), d - _wide(WORD)).otherwise(d).cast("decimal(38,0)")


def distance(a: Column, b: Column) -> Column:
    return F.when(less(b, a), _wrap(a - b)).otherwise(_wrap(b - a))


def clamp_distance(a: Column, b: Column) -> Column:
    """From a to b; 0 where b comes before a."""
    return F.when(less(b, a), F.lit(0)).otherwise(_wrap(b - a)).cast("decimal(38,0)")


def relative_min(a: Column) -> Column:
    return _wrap(a - _wide(MAX_DISTANCE))


def relative_max(a: Column) -> Column:
    return _wrap(a + _wide(MAX_DISTANCE))


def range_less(a_upper: Column, b_lower: Column) -> Column:
    """Order of slot ranges: a lies before b; ranges that overlap are neither way less."""
    return (a_upper == b_lower) | less(a_upper, b_lower)
