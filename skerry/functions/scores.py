"""Score arithmetic: reciprocal ranks, normalisation, blending."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

FLAT = 1e-12


def reciprocal(rank: Column) -> Column:
    """1 / rank; null or non-positive ranks give 0."""
    return F.coalesce(F.when(rank > 0, 1.0 / rank), F.lit(0.0))


def normalize(value: Column, mode: str, by: list[str]) -> Column:
    """Scores normalised inside the groups ``by``: none, minmax or zscore
    (population deviation); a flat group becomes 0."""
    over = Window.partitionBy(*by)
    if mode == "none":
        return value
    if mode == "minmax":
        low, high = F.min(value).over(over), F.max(value).over(over)
        return F.when(F.abs(high - low) <= FLAT, 0.0).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))
    if mode == "zscore":
        sd = F.stddev_pop(value).over(over)
        return F.when(sd <= FLAT, 0.0).otherwise((value - F.avg(value).over(over)) / F.nullif(sd, F.lit(0.0)))
    raise ValueError(f"unknown normalisation {mode!r}")


def adaptive_lambda(used: Column, most: int, low: float, high: float) -> Column:
    """Grows from ``low`` to ``high`` with the share of passages used."""
    if most <= 0:
        return F.lit(float(low))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), used / F.lit(float(most))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(float(low)) + (float(high) - float(low)) * share))


def clamp01(x: float) -> float:
    return min(1.0, max(0.0, x))


def place(score: Column) -> Column:
    """Scores to six places: summation order must not decide a ranking."""
    return F.round(score, 6)


def place_again(score: Column) -> Column:
    """Six places of arithmetic on values that have six places already.

    Their means and blends often lie exactly between two results; a nudge far
    below the last place sends those upward, whatever the summation order.
    """
    return F.round(score + F.lit(1e-9), 6)
