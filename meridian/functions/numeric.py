"""Numeric helpers that give the same values on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int = 6) -> Column:
    """Round half up on the binary value: floor(x * 10^k + 0.5) / 10^k."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def r(expr: str, places: int = 6) -> str:
    """The same as SQL text."""
    return f"(floor(({expr})*1e{places}+0.5)/1e{places})"


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
