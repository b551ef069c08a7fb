"""Column helpers for NULL-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_double() -> Column:
    return F.lit(None).cast("double")


def safe_div(left: Column, right: Column) -> Column:
    """NULL where the divisor is zero or NULL; never an infinity or an ANSI error."""
    return F.when(right != 0, left / right)


def finite_or_null(x: Column) -> Column:
    return F.nanvl(x, null_double())


def correlation(x: Column, y: Column, over=lambda c: c) -> Column:
    """Pearson correlation of the complete pairs, NULL where either side has no spread (the built-in raises there); over puts an aggregate on a window."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = over(F.stddev_pop(a)) * over(F.stddev_pop(b))
    return F.when(spread > 0, over(F.covar_pop(a, b)) / spread)
