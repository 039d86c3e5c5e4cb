"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is not above zero."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def sample_sd(value: Column) -> Column:
    """Standard deviation with n - 1, and 0.0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def not_nan(value: Column) -> Column:
    """Null for NaN, which minima and maxima then leave out."""
    return F.when(~F.isnan(value), value)

