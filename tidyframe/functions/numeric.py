"""Numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_even(c: Column, decimals: int = 0) -> Column:
    if decimals == 0:
        return F.rint(c)
    scale = F.lit(float(10 ** abs(decimals)))
    return F.rint(c * scale) / scale if decimals > 0 else F.rint(c / scale) * scale


def _whole(c: Column, step: Column) -> Column:
    """The step's result as a double; from 2**53 on doubles are whole numbers, or none at all, and stay."""
    d = c.cast("double")
    return F.when((F.abs(d) >= 2.0**53) | F.isnan(d), d).otherwise(step.cast("double"))


def floor(c: Column) -> Column:
    return _whole(c, F.floor(c))


def ceiling(c: Column) -> Column:
    return _whole(c, F.ceil(c))


def scaled(c: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """(c - low) / (high - low) carried to the new range; null where all values are equal."""
    return F.try_divide(c - low, high - low) * F.lit(float(to_high) - float(to_low)) + F.lit(float(to_low))
