"""Expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column | str, y: Column | str) -> Column:
    """x over y; null where y is 0 or either is null."""
    return F.try_divide(x, y)


def signed(side: Column | str, quantity: Column | str) -> Column:
    """The quantity with a minus for sells."""
    side, quantity = (F.col(c) if isinstance(c, str) else c for c in (side, quantity))
    return F.when(side == "SELL", -quantity).otherwise(quantity)
