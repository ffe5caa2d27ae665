"""Ratios and logarithms with every corner defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: log2 fold change of 0 against 0 and of 0 against something.
ZERO_BY_ZERO = 5.0
ZERO_BY_SOME = -5.0


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def log2_or_null(x: Column) -> Column:
    return F.log2(F.nullif(x, F.lit(0.0)))


def log2_fold_change(fraction: Column, baseline: Column) -> Column:
    """0 against 0 is +5, 0 against some is -5, some against 0 is +infinity; null for null."""
    return (
        F.when(fraction.isNull() | baseline.isNull(), F.lit(None).cast("double"))
        .when((fraction == 0) & (baseline == 0), F.lit(ZERO_BY_ZERO))
        .when(fraction == 0, F.lit(ZERO_BY_SOME))
        .when(baseline == 0, F.lit(float("inf")))
        .otherwise(F.log2(safe_ratio(fraction, baseline)))
    )


def clamp(x: Column, low: float, high: float) -> Column:
    """Null for null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clamped_log2(fraction: Column, baseline: Column, low: float = -5.0, high: float = 5.0) -> Column:
    """log2 of the ratio, drawn into [low, high]; a baseline of 0 gives ``high``, unless both are 0: null."""
    return (
        F.when((baseline == 0) & (fraction == 0), F.lit(None).cast("double"))
        .when(baseline == 0, F.lit(high))
        .when(fraction == 0, F.lit(low))
        .otherwise(clamp(F.log2(safe_ratio(fraction, baseline)), low, high))
    )


def log10_floor(x: Column, floor: float) -> Column:
    return F.log10(F.greatest(x, F.lit(floor)))
