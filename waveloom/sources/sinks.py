"""Writers: partitioned lakes, idempotent replacement, exports and the learning tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lake(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has: running again gives the same lake."""
    df.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def series_catalog(long: DataFrame, keys: list[str]) -> DataFrame:
    """What a written series is catalogued with: counts, range, times and statistics as JSON."""
    from waveloom.operators.signal import peaks

    stats = long.groupBy(*keys).agg(F.count("*").alias("samples"), F.count("v").alias("present"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))
    full = stats.join(peaks(long, keys).drop("n"), keys, "left")
    parts = [c for c in full.columns if c not in keys]
    return full.select(*keys, "samples", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("stats_json"))


def export_csv(df: DataFrame, path: str, order: list, bom: bool = False) -> None:
    """One ordered file for people; with a byte-order mark on the first header if asked."""
    names = {df.columns[0]: F.col(df.columns[0]).alias("﻿" + df.columns[0])} if bom else {}
    ordered = df.orderBy(*order).coalesce(1)
    ordered.select(*(names.get(c, F.col(c)) for c in df.columns)).write.mode("overwrite").csv(path, header=True)


def tensor(long: DataFrame, case: str, channel: str, channels: list[str]) -> DataFrame:
    """(case, values, mask): arrays by channel and sample on a common grid; raises when read if grids differ.

    One row a case and no array on the driver: readers of the table stack what they need.
    """
    grid = F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t", "v"))), lambda x: x["t"])), 256)
    per = long.groupBy(case, channel).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t", "v"))), lambda x: x["v"].cast("float")).alias("x"), grid.alias("grid"))
    rows = per.groupBy(case).agg(F.map_from_entries(F.collect_list(F.struct(channel, "x"))).alias("m"), F.count_distinct("grid").alias("grids"))
    whole = rows.withColumn("ok", F.when(F.col("grids") > 1, F.raise_error(F.lit("the channels of a case have different grids"))).otherwise(F.lit(True)))
    values = F.array(*(F.col("m")[c] for c in channels))
    return whole.filter("ok").select(case, F.transform(values, lambda x: F.transform(x, lambda v: F.coalesce(v, F.lit(0.0).cast("float")))).alias("values"), F.transform(values, lambda x: F.transform(x, lambda v: v.isNotNull().cast("tinyint"))).alias("mask"))


def manifest_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; missing fields are written as null."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
