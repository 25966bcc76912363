"""Integer arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(c: str | Column, n) -> Column:
    """Integral division of longs (exact for any long, unlike ``floor(a / b)``
    which goes through double)."""
    col = F.col(c) if isinstance(c, str) else c
    den = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", col.cast("long"), den.cast("long"))
