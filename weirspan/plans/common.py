"""Small helpers of the query definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decimals kept in query results, and the SQL text of the same rounding.
PLACES = 6


def r(col: Column | str, places: int = PLACES) -> Column:
    """Rounded, with negative zero turned into zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), places) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = PLACES) -> DataFrame:
    return df.withColumns({n: r(n, places) for n in names})


def day(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def rd(expr: str, places: int = PLACES) -> str:
    """SQL counterpart of ``r``."""
    return f"round(CAST({expr} AS double), {places}) + 0.0e0"


def chain(src: str, steps: list[str]) -> str:
    """Lay select lists over ``src``, each reading the columns of the one before."""
    for s in steps:
        src = f"SELECT *, {s} FROM ({src})"
    return src
