"""Roles of a container's channels: its time axis, references, and why others are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a key by which a series is a rating's bound rather than a measurement.
REFERENCE_MARKS = ("acceptable", "good", "marginal", "poor", "upper_bound", "lower_bound", "bound")


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def time_rank(key: str = "series_key", name: str = "series_name", group: str = "source_group", unit: str = "unit") -> Column:
    """How well a series would do as the time axis, 0 best; NULL if it is none."""
    raw, axis, seconds = _lower(group).contains("raw"), _lower(name).startswith("time axis"), (_lower(unit) == "s") & _lower(key).contains("time")
    rules = [_lower(key).endswith("_raw_data_time_axis"), _lower(key).contains("_raw_data_time_axis_"), (_lower(name) == "time axis") & raw, axis & raw, _lower(name) == "time axis", axis, seconds & raw, seconds]
    return reduce(lambda out, r: F.when(r[1], r[0]).otherwise(out), reversed(list(enumerate(rules))), F.lit(None).cast("int"))


def time_axes(series: DataFrame, case: str) -> DataFrame:
    """(case, time_key): of each container the best time axis, the first key of equals; containers without one have no row."""
    return series.withColumn("_r", time_rank()).filter("_r IS NOT NULL").groupBy(case).agg(F.min(F.struct("_r", "series_key")).getField("series_key").alias("time_key"))


def is_time_like() -> Column:
    return (_lower("series_name") == "time axis") | ((_lower("unit") == "s") & _lower("series_key").contains("time"))


def is_reference_like() -> Column:
    key, group = _lower("series_key"), _lower("source_group")
    return group.contains("corridor") | key.contains("corridor") | (group == "analysis") | key.startswith("analysis_") | reduce(lambda a, b: a | b, (key.contains(m) for m in REFERENCE_MARKS))


def roles(series: DataFrame, case: str, present: str = "is_present", numeric: str = "is_numeric") -> DataFrame:
    """``series`` with ``role``: why a series is left out, ``reference`` or ``signal``."""
    role = F.when(F.col("series_key") == F.col("time_key"), "primary_time_axis").when(~F.col(present), "column_missing_in_parquet").when(~F.col(numeric), "non_numeric").when(is_time_like(), "auxiliary_time_axis").when(is_reference_like(), "reference").otherwise("signal")
    return series.join(time_axes(series, case), case, "left").withColumn("role", role).drop("time_key")
