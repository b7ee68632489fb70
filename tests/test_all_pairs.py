"""Scores of all pairs of cases, block against block, against those of pairs that are joined; and what they shuffle."""

import numpy as np
import pytest

from tests.test_sizes import shuffled
from waveloom.operators import similarity


@pytest.fixture
def long(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CASES", 7)
    rng = np.random.default_rng(9)
    rows = []
    for case in range(40):
        for channel, n in (("p", rng.integers(0, 30)), ("q", rng.integers(0, 30)), ("r", 700 if case < 3 else 2)):
            flat = channel == "q" and case % 9 == 0
            rows += [(case, channel, i, None if rng.random() < 0.1 else 1.5 if flat else 1e3 + float(rng.normal())) for i in range(n)]
    rows += [(50, "p", i, v) for c, k, i, v in rows if c == 4 and k == "p"]  # a copy
    return spark.createDataFrame(rows, "case long, channel string, idx long, v double").repartition(5)


def test_waveforms(spark, long):
    pairs = similarity.block_pairs(long.select("case").distinct(), "case", [])
    want = {(r.a, r.b): r for r in similarity.weighted_waveforms(pairs, long, {"p": 1.3}, 4).collect()}
    got = {(r.a, r.b): r for r in similarity.all_waveforms(long, {"p": 1.3}, 4).collect()}
    assert got.keys() == want.keys() and len(want) > 500
    for key, r in want.items():
        assert got[key].overlap == r.overlap
        for part in ("correlation", "rmse"):
            assert (got[key][part] is None) == (r[part] is None) and got[key][part] == pytest.approx(r[part], abs=1e-9)
    assert got[4, 50].rmse == 0
    assert similarity.all_waveforms(long.limit(0), {}).count() == 0


def test_availability(spark, long):
    pairs = similarity.block_pairs(long.select("case").distinct(), "case", [])
    assert sorted(similarity.all_availability(long, 12).collect()) == sorted(similarity.availability(long, pairs, 12).collect())
    assert similarity.all_availability(long.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["waveform_scores", "availability_overlap"])
def test_no_pair_is_shuffled(spark, sf_dir, name, tmp_path):
    """124,750 pairs of 500 cases: what is shuffled grows with the cases."""
    from waveloom.plans import registry, registry_more  # noqa: F401

    events = spark.range(10_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 500 AS user_id", "'click' AS event_type", "cast(id * 37 % 101 AS double) AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to broadcast
    try:
        before = shuffled(spark)
        assert registry.QUERIES[name](spark, str(tmp_path)).count() == 124_750
        assert shuffled(spark) - before < (80_000 if name == "availability_overlap" else 1_000_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
