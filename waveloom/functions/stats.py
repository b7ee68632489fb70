"""Statistics as one-pass aggregates over the cluster. Rows with a missing side are dropped before any of these is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions.order import average_ranks, quantiles


def max_abs(c: str, where: Column | None = None) -> Column:
    value = F.abs(F.col(c))
    return F.max(value if where is None else F.when(where, value))


def min_positive(c: str, where: Column | None = None) -> Column:
    fit = F.col(c) >= 0
    return F.min(F.when(fit if where is None else fit & where, F.col(c)))


def row_mean(*names: str) -> Column:
    """Mean of the columns that are not NULL; NULL if all are."""
    n = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0)) / F.nullif(n, F.lit(0)))


def completeness(*names: str) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0)) / F.lit(len(names))


def pearson(x: str, y: str) -> Column:
    """Correlation of complete pairs; NULL where a side does not vary (``corr`` raises there)."""
    a, b = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return quantiles(df, {"q1": (value, 0.25), "q3": (value, 0.75)}, by)


def robust_z(df: DataFrame, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """For each name: (x - median) / population deviation of its column over ``by`` or all rows; the plain difference where
    the deviation is nil. However many columns there are, all medians share their passes."""
    by = by or []
    mids = quantiles(df, {f"_mid{i}": (c, 0.5) for i, c in enumerate(columns.values())}, by)
    devs = df.groupBy(*by).agg(*(F.stddev_pop(c).alias(f"_dev{i}") for i, c in enumerate(columns.values())))
    stats = devs.join(mids, by) if by else devs.crossJoin(F.broadcast(mids))  # one row a side
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row of two numbers a column
    z = {out: (F.col(c) - F.col(f"_mid{i}")) / F.when(F.col(f"_dev{i}") > 1e-9, F.col(f"_dev{i}")).otherwise(1.0) for i, (out, c) in enumerate(columns.items())}
    return joined.withColumns(z).drop(*(f"_{s}{i}" for s in ("mid", "dev") for i in range(len(columns))))


def robust_scale(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and scale of each group: IQR / 1.349, else MAD x 1.4826, else the deviation, else 1."""
    first = quantiles(df, {"mid": (value, 0.5), "q1": (value, 0.25), "q3": (value, 0.75)}, by).join(df.groupBy(*by).agg(F.stddev_pop(value).alias("dev")), by)
    off = df.join(first.select(*by, "mid"), by).withColumn("_off", F.abs(F.col(value) - F.col("mid")))
    mad = quantiles(off, {"mad": ("_off", 0.5)}, by)
    iqr, spread = (F.col("q3") - F.col("q1")) / 1.349, F.col("mad") * 1.4826
    return first.join(mad, by).withColumn("scale", F.when(iqr > 1e-9, iqr).when(spread > 1e-9, spread).when(F.col("dev") > 1e-9, F.col("dev")).otherwise(1.0)).select(*by, "mid", "scale", "mad")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_ranks(average_ranks(pairs, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(pearson("_rx", "_ry").alias("spearman"))


def quartile_gap(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Mean of y over the top quarter of x minus that over the bottom quarter, ends included."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cut = pairs.join(quartiles(pairs, x, by), by)
    return cut.groupBy(*by).agg((F.avg(F.when(F.col(x) >= F.col("q3"), F.col(y))) - F.avg(F.when(F.col(x) <= F.col("q1"), F.col(y)))).alias("gap"))


def eta_squared(df: DataFrame, label: str, value: str, by: list[str]) -> DataFrame:
    """Share of the value's sum of squares that lies between labels."""
    per = df.filter(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = per.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))).alias("sq"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("between"))
    return total.select(*by, F.try_divide(F.col("between") - F.col("n") * F.col("mean") * F.col("mean"), F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")).alias("eta_squared"))


def _names_of_sums(p: int) -> list[str]:
    return [f"x{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)] + [f"y{i}" for i in range(p + 1)] + ["yy"]


def solved(sums: DataFrame, by: list[str], p: int, least: int = 12) -> DataFrame:
    """(by, n, r2, adj_r2, b0, b1, ...) from the sums of the normal equations; NULL under max(least, p + 5) rows.

    A row is one system of p + 1 equations; the systems of a batch are solved together.
    """
    import pandas as pd

    def solve(frames):
        import numpy as np

        for frame in frames:
            if not len(frame):
                continue
            get = lambda c: frame[c].to_numpy(float)
            a = np.stack([np.stack([get(f"x{min(i, j)}_{max(i, j)}") for j in range(p + 1)], -1) for i in range(p + 1)], -2)
            b, yy, n = np.stack([get(f"y{i}") for i in range(p + 1)], -1), get("yy"), a[:, 0, 0]
            # Scaled to a unit diagonal, so that predictors of any size are told apart from those that depend on others.
            scale = np.sqrt(np.where(np.diagonal(a, axis1=1, axis2=2) > 0, np.diagonal(a, axis1=1, axis2=2), 1.0))
            beta = (np.linalg.pinv(a / (scale[:, :, None] * scale[:, None, :]), hermitian=True) @ (b / scale)[:, :, None])[:, :, 0] / scale
            total = yy - b[:, 0] ** 2 / np.where(n > 0, n, 1)
            rest = yy - 2 * (beta * b).sum(1) + np.einsum("ki,kij,kj->k", beta, a, beta)
            fit = (n >= max(least, p + 5)) & (total > 0)
            r2 = 1 - rest / np.where(fit, total, 1)
            columns = {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / np.where(fit, n - p - 1, 1), **{f"b{i}": beta[:, i] for i in range(p + 1)}}
            yield pd.DataFrame({**{c: frame[c] for c in by}, "n": n.astype("int64"), **{c: pd.Series(pd.arrays.FloatingArray(np.where(fit, v, 0.0), ~fit), index=frame.index) for c, v in columns.items()}})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*by).schema)
    schema = ", ".join(x for x in (keys, "n long, r2 double, adj_r2 double", ", ".join(f"b{i} double" for i in range(p + 1))) if x)
    return sums.mapInPandas(solve, schema)


def least_squares(df: DataFrame, predictors: list[str], target: str, by: list[str]) -> DataFrame:
    """(by, n, r2, adj_r2, b0, b1, ...) of each group with at least max(12, p + 5) complete rows, else NULL.

    The normal equations' sums are one aggregate over the cluster; what is solved is one matrix of (p + 1)^2 numbers a group.
    """
    rows, p = df.dropna(subset=[*predictors, target]).withColumn("_one", F.lit(1.0)), len(predictors)
    terms = ["_one", *predictors]
    products = [(a, b) for i, a in enumerate(terms) for b in terms[i:]] + [(a, target) for a in terms] + [(target, target)]
    return solved(rows.groupBy(*by).agg(*(F.sum(F.col(a) * F.col(b)).alias(n) for n, (a, b) in zip(_names_of_sums(p), products, strict=True))), by, p)


#: Cumulative Poisson(1) probabilities.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def bootstrap_r2(df: DataFrame, predictors: list[str], target: str, by: list[str], ident: list[str], rounds: int = 300, seed: int = 42) -> DataFrame:
    """Median, 10th and 90th percentile of adjusted R2 over resamples, and the share of positive first slopes; groups of
    fewer than max(20, p + 5) complete rows have none.

    ``ident`` tells rows apart: each draws a Poisson(1) weight for each round, seeded by it, so equal rows draw apart and a
    task that runs twice draws the same. A task adds up the weighted sums of all rounds as matrix products; what is
    shuffled is one row a task, group and round.
    """
    import pyarrow as pa

    p, names = len(predictors), _names_of_sums(len(predictors))
    complete = df.dropna(subset=[*predictors, target])
    rows = complete.select(F.struct(*by).alias("k"), F.xxhash64(*ident, F.lit(seed)).alias("s"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*predictors, target])))

    def add(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = pa.Table.from_batches([batch]).column("k").combine_chunks()
            keys = coded.to_pylist()
            place: dict[tuple, int] = {}
            group = np.array([place.setdefault(tuple(k.values()), len(place)) for k in keys])
            x = np.stack([np.ones(len(keys)), *(np.asarray(batch.column(f"c{i}")) for i in range(p + 1))], axis=1)
            y, x = x[:, -1], x[:, :-1]
            products = np.stack([*(x[:, i] * x[:, j] for i in range(p + 1) for j in range(i, p + 1)), *(x[:, i] * y for i in range(p + 1)), y * y], axis=1)
            h = np.asarray(batch.column("s")).view(np.uint64)[:, None] + np.arange(rounds, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            weight = np.searchsorted(POISSON, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53, side="right").astype(np.float64)
            first = {g: i for i, g in reversed(list(enumerate(group.tolist())))}
            for g in range(len(place)):
                mine = group == g
                sums = weight[mine].T @ products[mine]
                yield pa.RecordBatch.from_arrays([coded.take(pa.array([first[g]] * rounds)), pa.array(np.arange(rounds), pa.int32()), *(pa.array(sums[:, c]) for c in range(sums.shape[1]))], names=["k", "round", *names])

    kind = rows.schema["k"].dataType.simpleString()
    parts = rows.mapInArrow(add, f"k {kind}, round int, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("k", "round").agg(*(F.sum(n).alias(n) for n in names)).select("k.*", "round", *names)
    fits = solved(sums, [*by, "round"], p)
    large = complete.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(20, p + 5)).drop("_n")
    return fits.filter("adj_r2 IS NOT NULL").join(large, by).groupBy(*by).agg(F.count("*").alias("rounds"), F.median("adj_r2").alias("adj_r2_median"), F.percentile("adj_r2", 0.1).alias("adj_r2_p10"), F.percentile("adj_r2", 0.9).alias("adj_r2_p90"), F.avg((F.col("b1") > 0).cast("double")).alias("positive_share"))


def quantile_band(df: DataFrame, value: str, by: list[str], out: str = "band") -> DataFrame:
    """high from the third quartile up, low up to the first, else mid; missing values are mid."""
    cut = df.join(quartiles(df, value, by), by, "left")
    return cut.withColumn(out, F.when(F.col(value) >= F.col("q3"), "high").when(F.col(value) <= F.col("q1"), "low").otherwise("mid")).drop("q1", "q3")


def enrichment(df: DataFrame, label: str, dimensions: list[str]) -> DataFrame:
    """Share of each category in a label over its share in all rows; a missing category is one of its own."""
    tall = df.select(label, F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("[missing]")).alias("category")) for d in dimensions))).alias("d")).select(label, "d.*")
    counts = tall.groupBy(label, "dimension", "category").agg(F.count("*").alias("n"))
    per_label = counts.groupBy(label, "dimension").agg(F.sum("n").alias("n_label"))
    per_category = counts.groupBy("dimension", "category").agg(F.sum("n").alias("n_category"))
    total = counts.groupBy("dimension").agg(F.sum("n").alias("n_total"))
    joined = counts.join(per_label, [label, "dimension"]).join(per_category, ["dimension", "category"]).join(total, "dimension")
    share, overall = F.col("n") / F.col("n_label"), F.col("n_category") / F.col("n_total")
    return joined.select(label, "dimension", "category", "n", share.alias("share"), (share / overall).alias("enrichment"))
