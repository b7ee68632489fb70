"""Relational operators over catalogs: work queues, key lookups, pivots, totals and joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def passes(df: DataFrame, equals: Mapping[str, object] | None = None, within: Mapping[str, Iterable] | None = None, keyword: str | None = None, search: Iterable[str] = ()) -> DataFrame:
    """All given conditions at once; ``keyword`` is looked for in the joined text of ``search``, missing parts skipped."""
    tests = [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    tests += [F.col(c).isin(list(v)) for c, v in (within or {}).items() if v]
    if keyword:
        tests.append(F.lower(F.concat_ws(" ", *search)).contains(keyword.lower()))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def not_equal(column: str, value: object) -> Column:
    """Null-safe: a missing value is not equal."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def coverage_at_least(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Rows in which at least ``share`` of the columns are present."""
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.filter(present / len(columns) >= share)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; the order must be total for a fixed result."""
    place = rank or "_place"
    out = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= n)
    return out if rank else out.drop(place)


def pending(jobs: DataFrame, status: str = "status", states: tuple[str, ...] = ("pending", "error"), order: list | None = None, limit: int | None = None, include_done: bool = False, key: str | None = None, ids: list | None = None) -> DataFrame:
    """Jobs still to do, in order; ``include_done`` takes all, ``ids`` those alone whatever their state."""
    if ids:
        out = jobs.filter(F.col(key).isin(ids))
    else:
        out = jobs if include_done else jobs.filter(F.col(status).isin(*states))
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit else out


def case_set(cases: DataFrame, key: str, ids: list | None, others: DataFrame) -> DataFrame:
    """The cases of the given ids, or, where there are none, those that ``others`` names."""
    return cases.filter(F.col(key).isin(ids)) if ids else cases.join(others.select(key).distinct(), key, "left_semi")


def pending_sets(wanted: DataFrame, done: DataFrame, key: str, mode: str, modes: Iterable[str]) -> DataFrame:
    """Keys whose set of done modes is not the wanted set; keys with nothing done are pending."""
    goal = F.array_sort(F.array(*map(F.lit, sorted(set(modes)))))
    sets = done.filter(F.col(mode).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(mode)).alias("_done"))
    return wanted.select(key).distinct().join(sets, key, "left").filter(~F.coalesce(F.col("_done") == goal, F.lit(False))).select(key)


def anti(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def first_values(df: DataFrame, key: str, name: str, value: str, order: str, names: list[str]) -> DataFrame:
    """One column for each of ``names``: its first value that is not missing, in ``order``."""
    wanted = [F.min(F.when((F.col(name) == n) & F.col(value).isNotNull(), F.struct(order, value))).getField(value).alias(n) for n in names]
    return df.groupBy(key).agg(*wanted)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def pivot(df: DataFrame, keys: list[str], column: str, values: list, agg: Column) -> DataFrame:
    """``values`` is explicit, so no extra pass finds them and the schema is fixed."""
    return df.groupBy(*keys).pivot(column, values).agg(agg)


def with_total(df: DataFrame, key: str, entity: str, aggs: list[Column], label: str = "[all]") -> DataFrame:
    """Aggregates for each key and a total over distinct (key, entity) rows, which has ``label`` as key."""
    once = df.dropDuplicates([key, entity])
    grouped = once.groupingSets([[F.col(key)], []], F.col(key)).agg(*aggs, F.grouping(key).alias("_all"))
    return grouped.withColumn(key, F.when(F.col("_all") == 1, label).otherwise(F.coalesce(F.col(key), F.lit("[unclassified]")))).drop("_all")


def share_of_total(df: DataFrame, by: list[str], out: str = "share") -> DataFrame:
    """Counts and their share of all rows; the total is one row."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_total")))).withColumn(out, F.col("n") / F.col("_total")).drop("_total")


def preferred_text(df: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """The most frequent text, then the shortest, then the first in lower-case order."""
    counts = df.filter(F.col(text).isNotNull()).groupBy(*keys, text).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("a"), F.length(text).alias("b"), F.lower(text).alias("c"), F.col(text).alias("d"))).getField("d").alias(out))


def first_distinct(df: DataFrame, keys: list[str], value: str, order: list[str], n: int, out: str) -> DataFrame:
    """The first n distinct values in order of appearance, joined by commas."""
    seen = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    top = first_per_key(seen, keys, ["_at", value], n, "_place")
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", value))), lambda x: x[value].cast("string")), ", ").alias(out))


def top_share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the first of equals, and its share."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_best"), F.sum("_n").alias("_all")).select(*keys, F.col("_best.v").alias(value), (-F.col("_best.n")).alias("n"), (-F.col("_best.n") / F.col("_all")).alias("share"))


def extreme_pairs(df: DataFrame, family: str, side: str, value: str, ident: str, year: str, ratio: str, most: int = 12) -> DataFrame:
    """The ``most`` pairs with the widest gap between the lowest and the highest row of a family and side, by (value, year, id).

    A family no side of which has two rows pairs over all its rows, as ``mixed`` if their sides differ. Rows without
    family, value or ratio take no part; a pair counts once.
    """
    usable = df.dropna(subset=[family, value, ratio]).withColumns({"_row": F.struct(F.col(value).alias("v"), F.col(year).alias("y"), F.col(ident).alias("id"), F.col(side).alias("side"), F.col(ratio).alias("r"))})
    ends = [F.count("*").alias("n"), F.min("_row").alias("lo"), F.max("_row").alias("hi")]
    by_side = usable.filter(F.col(side).isNotNull()).groupBy(family, side).agg(*ends).filter("n >= 2").drop(side)
    whole = usable.groupBy(family).agg(*ends).filter("n >= 2").join(by_side.select(family).distinct(), family, "left_anti")
    both = by_side.unionByName(whole).filter("lo.id != hi.id").dropDuplicates([family, "lo", "hi"])
    named = F.when(F.col("lo.side").eqNullSafe(F.col("hi.side")), F.col("lo.side")).otherwise("mixed")
    out = both.select(family, named.alias(side), F.col("lo.id").alias("low_id"), F.col("lo.v").alias("low_value"), F.col("hi.id").alias("high_id"), F.col("hi.v").alias("high_value"), (F.col("hi.v") - F.col("lo.v")).alias("gap"), (F.col("hi.r") - F.col("lo.r")).alias("ratio_gap"))
    return out.orderBy(F.desc("gap"), F.desc("ratio_gap"), family, "low_id").limit(most)


def complement(df: DataFrame, column: str, value: object, out: str = "is_rest") -> DataFrame:
    """Whether a row is in the complement of those that equal ``value``; rows without a value are."""
    return df.withColumn(out, not_equal(column, value))


def merged_with_fallback(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which a column of both sides takes the right one's value where the left one's is missing. Missing keys equal one another."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    right = right.select(*(F.col(c).alias(f"_r_{c}") for c in right.columns))
    joined = left.join(right, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on)), "left")
    own = [F.coalesce(c, f"_r_{c}").alias(c) if c in shared else F.col(c) for c in left.columns]
    return joined.select(*own, *(F.col(c).alias(c[3:]) for c in right.columns if c[3:] not in (*on, *shared)))


def case_rank(c: str, order: list[str]) -> Column:
    """The place of a value in a fixed order; others come last."""
    out = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        out = F.when(F.col(c) == v, k).otherwise(out)
    return out


def asset_flags(files: DataFrame, key: str, path: str, prefixes: Mapping[str, str], extensions: Mapping[str, str]) -> DataFrame:
    """For each case a flag for every prefix and extension (any case) that one of its files' paths has."""
    tests = {n: F.lower(path).startswith(p.lower()) for n, p in prefixes.items()} | {n: F.lower(path).endswith(e.lower()) for n, e in extensions.items()}
    return files.groupBy(key).agg(*(F.max(F.coalesce(t, F.lit(False)).cast("int")).alias(n) for n, t in tests.items()))


def summary_rows(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, value): one row for each aggregate, whatever its type, as text."""
    return df.agg(*(m.cast("string").alias(n) for n, m in metrics.items())).unpivot([], list(metrics), "metric", "value")


def capped(df: DataFrame, test: Column, order: list, most: int = 25) -> DataFrame:
    """The first ``most`` rows that pass, in a total order."""
    return df.filter(test).orderBy(*order).limit(most)


def resolved(wanted: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Channels for standard names, and the names without one.

    ``wanted`` (standard_name, alias, place) lists aliases by preference, ``channels`` (case_id, group_name,
    channel_name, is_raw) what a case has. Both are matched on letters and digits alone; not raw first, then the alias's
    place, the shorter name, group and channel.
    """
    from waveloom.functions.text import key

    hits = channels.withColumn("_k", key("channel_name")).join(wanted.withColumn("_k", key("alias")), "_k")
    order = [F.col("is_raw").cast("int"), "place", F.length("channel_name"), "group_name", "channel_name"]
    best = first_per_key(hits, ["case_id", "standard_name"], order).select("case_id", "standard_name", "group_name", "channel_name", "is_raw")
    every = channels.select("case_id").distinct().join(F.broadcast(wanted.select("standard_name").distinct()))  # a fixed catalog of names
    return best, every.join(best, ["case_id", "standard_name"], "left_anti")


def rule_join(rows: DataFrame, rules: list[dict], text: str, value: str) -> DataFrame:
    """The first row of each case that a rule fits: a prefix or terms that all occur; ``how`` is abs or plain, the largest value wins."""
    out = []
    for r in rules:
        test = F.lower(text).startswith(r["prefix"]) if r.get("prefix") else reduce(lambda a, b: a & b, (F.lower(text).contains(t) for t in r["terms"]))
        out.append(F.max(F.when(test, F.abs(value) if r.get("how") == "abs" else F.col(value))).alias(r["name"]))
    return rows.groupBy("case_id").agg(*out)


def rating(c: str | Column, good: float, fair: float, poor: float) -> Column:
    """Four bands: up to good, up to fair, up to poor, beyond."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), None).when(c <= good, "good").when(c <= fair, "acceptable").when(c <= poor, "marginal").otherwise("poor")


def stage_gaps(stages: list[str]) -> Column:
    """The names of the flag columns that are not set, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(F.col(s).cast("int"), F.lit(0)) == 0, F.lit(s)) for s in stages))), ",")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of equal keys and adds the rest; columns of either side that the other lacks are NULL there."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
