"""Order statistics of many groups against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.functions import order


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", i % 2, float(rng.integers(0, 400)), float(rng.normal())) for i in range(3000)]
    rows += [(g, 1, float(v), None if v < 2 else float(v) ** 2) for g in ("a", None) for v in range(7)] + [("none", 0, None, None), ("one", 0, 5.0, None), ("two", 1, 1.0, -1.0), ("two", 1, 1.0, 3.0)]
    return rows, spark.createDataFrame(rows, "g string, h int, x double, start double").repartition(6)


@pytest.mark.parametrize("parts", ["1", "13"])
def test_quantiles(spark, data, parts):
    rows, df = data
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    wanted = {"q1": ("x", 0.25), "mid": ("x", 0.5), "q3": ("x", 0.75), "top": ("start", 1.0), "m2": ("start", 0.5), "p": ("x", 0.37)}
    for by in (["g"], ["g", "h"], []):
        got = {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in order.quantiles(df, wanted, by).collect()}
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[("g", "h").index(c)] for c in by), []).append(r)
        assert got.keys() == groups.keys()
        for g, mine in groups.items():
            for value, (c, p) in zip(got[g], wanted.values(), strict=True):
                have = [r[2 if c == "x" else 3] for r in mine if r[2 if c == "x" else 3] is not None]
                assert value is None if not have else value == pytest.approx(np.quantile(have, p), abs=1e-12)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_average_ranks(data):
    rows, df = data
    got = order.average_ranks(df, "x", "rank", ["g"]).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        have = np.array([r[2] for r in rows if r[0] == g and r[2] is not None])
        for r in got:
            if r.g == g:
                assert r["rank"] is None if r.x is None else r["rank"] == (have < r.x).sum() + ((have == r.x).sum() + 1) / 2


def test_a_hot_group_is_shared(spark, data):
    """No range holds much more than its share of a group with most of the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    counts = data[1].filter("x IS NOT NULL").groupBy("g", "x").count().repartitionByRange(8, "g", "x").withColumn("p", F.spark_partition_id())
    assert max(r["n"] for r in counts.filter("g = 'hot'").groupBy("p").agg(F.count("*").alias("n")).collect()) < 200
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
