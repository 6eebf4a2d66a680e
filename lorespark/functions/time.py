"""Time arithmetic; every operator takes its "now" as a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(as_of: datetime | str) -> Column:
    """A timestamp without time zone."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def ago(as_of: datetime | str, days: float = 0, hours: float = 0) -> Column:
    return at(as_of) - F.expr(f"INTERVAL '{int(days * 86_400 + hours * 3_600)}' SECOND")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def since(column: str, as_of: datetime | str, days: float) -> Column:
    """The last so many days, the boundary included."""
    return F.col(column) >= ago(as_of, days)


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 1/2) / 10^digits: halves go towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def ordinal(column: str, order: dict[str, int], other: int | None = None) -> Column:
    out = F.lit(len(order) if other is None else other)
    for value, k in order.items():
        out = F.when(F.col(column) == value, k).otherwise(out)
    return out
