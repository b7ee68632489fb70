"""Missing values are NULL inside the engine. NaN stops at every boundary: here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float column with NaN as NULL."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def number(c: str | Column) -> Column:
    """A number from text, NULL where it is none or not finite."""
    c = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(top: Column, bottom: Column, least: float = 0.0) -> Column:
    """``top / bottom`` where the size of ``bottom`` is over ``least``, else NULL."""
    return F.when(F.abs(bottom) > least, top / F.when(F.abs(bottom) > least, bottom))
