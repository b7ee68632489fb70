"""Order statistics of many groups at once, exact, however large a group is.

Values are counted, so ties cost one row, and laid out by ranges of (group, column, value): a group that holds most of the rows is
shared by many ranges. A range's total and the totals of the ranges before it in the same group give every value the ranks
it covers; quantiles, medians and average ranks are read off those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveloom.session import kept


def ranked_values(tall: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., value, n, start, total): each distinct value of a group that is not null, how often it is there, how many are less, and the size of the group."""
    counts = tall.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    # The partition number is written down with the rows, so it stays what it is.
    laid = kept(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranked-values")
    parts = laid.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_part")) - F.col("_n")
    parts = parts.select(*by, "_part", before.alias("_before"), F.sum("_n").over(group).alias("total"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    joined = laid.alias("l").join(parts.alias("r"), same).select(*(F.col(f"l.{c}") for c in [*by, value, "n", "_part"]), "_before", "total")
    within = F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(value)) - F.col("n")
    return joined.select(*by, value, "n", (F.col("_before") + within).alias("start"), "total")


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], by: list[str]) -> DataFrame:
    """One row a group of ``df`` with a column for each entry (column, probability): the exact quantile, linear between neighbours, null for a
    group without values. Null keys are a group. All columns share the passes."""
    columns = sorted({c for c, _ in wanted.values()})
    keys = [f"_k{i}" for i in range(len(by))]
    tall = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("m")).select(*keys, "m.c", "m.v")
    ranks = ranked_values(tall.withColumnsRenamed({"c": "_c", "v": "_v"}), [*keys, "_c"], "_v")
    start, end, last = F.col("start"), F.col("start") + F.col("n"), F.col("total") - 1
    shares = sorted({p for _, p in wanted.values()})
    of_column = []
    for i, p in enumerate(shares):
        place = last * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        at = lambda rank: F.max(F.when((start <= rank) & (rank < end), F.col("_v")))
        of_column.append((at(low) + (at(high) - at(low)) * F.max(place - low)).alias(f"_q{i}"))
    each = ranks.groupBy(*keys, "_c").agg(*of_column)
    found = each.groupBy(*keys).agg(*(F.max(F.when(F.col("_c") == columns.index(c), F.col(f"_q{shares.index(p)}"))).alias(name) for name, (c, p) in wanted.items()))
    if not by:
        return found
    # Groups without a value in any column are kept.
    groups = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).distinct()
    joined = groups.alias("g").join(found.alias("f"), [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left")
    return joined.select(*(F.col(f"g.{k}").alias(c) for c, k in zip(by, keys, strict=True)), *wanted)


def average_ranks(df: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """``df`` with the ranks of ``value`` in its group from 1, equal values sharing the mean of theirs; null where the value is."""
    ranks = ranked_values(df.select(*by, value), by, value).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])), (F.col("start") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, value])], "left").drop(*(f"_k{i}" for i in range(len(by) + 1)))
