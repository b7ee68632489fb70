"""Behaviours on small literal inputs: missing values, ties, windows, landmarks, clusters, linkage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.functions import missing, stats
from waveloom.functions import text as T
from waveloom.operators import documents, marts, relational, signal, similarity

WAVE = "case_id long, idx long, t double, vehicle_longitudinal_accel_g double, vehicle_lateral_accel_g double, vehicle_vertical_accel_g double, vehicle_resultant_accel_g double, seat_mid_deflection_mm double, seat_inner_deflection_mm double, foot_left_x_accel_g double, foot_left_z_accel_g double, foot_right_x_accel_g double, foot_right_z_accel_g double, side string, v0 double"


def wave(case, side, ax=(-5, -5, -5, -5, 0, 0)):
    ay, az, r = (2, 2, 2, 2, 0, 0), (1, 1.5, 2, 2.5, 0.5, 0), (5.5, 5.6, 5.9, 6.3, 0.5, 0)
    mid, inner = (0, 0.5, 1, 2, 3, 3.5), (0, 1, 2.5, 4, 5.5, 6.5)
    lx, lz, rx, rz = (0, 3, 6, 15, 9, 3), (0, 1, 2, 6, 3, 1), (0, 2, 4, 9, 6, 2), (0, 0.5, 1, 3, 2, 0.5)
    return [(case, i, i * 0.02, *map(float, (ax[i], ay[i], az[i], r[i], mid[i], inner[i], lx[i], lz[i], rx[i], rz[i])), side, 17.0) for i in range(6)]


def test_running_delta_v(spark):
    df = spark.createDataFrame([(1, i, i * 0.02, -5.0 if i < 4 else 0.0) for i in range(6)], "c long, idx long, t double, v double")
    got = [r["delta_v"] for r in signal.cumulative_delta_v(df, ["c"]).orderBy("idx").collect()]
    assert got == pytest.approx([0, -0.980665, -1.96133, -2.941995, -2.941995, -2.941995])


def test_window_metrics(spark):
    rows = [*wave(1, "driver"), *wave(2, "passenger"), *wave(3, "driver", (0,) * 6)]
    out = {r["case_id"]: r for r in signal.default_metrics(signal.window_metrics(spark.createDataFrame(rows, WAVE), ["case_id"], "side", "v0"), ["case_id"]).collect()}
    a, b, flat = out[1], out[2], out[3]
    assert a["window_100_delta_vy_away_mps"] > 0 > b["window_100_delta_vy_away_mps"]
    assert a["window_100_delta_vy_away_mps"] == pytest.approx(-b["window_100_delta_vy_away_mps"])
    assert flat["ri"] is None and a["ri"] == a["window_060_ri"]
    assert a["window_100_max_abs_az_g"] == 2.5 and a["max_abs_resultant_g"] == 6.3
    assert a["window_100_foot_resultant_left_g"] == pytest.approx(math.hypot(15, 6))
    assert a["quality_score"] == 1 and a["cluster_input_flag"] == 1


def test_missing_feet_count_as_zero(spark):
    df = spark.createDataFrame(wave(1, "driver"), WAVE).withColumns({c: F.lit(None).cast("double") for c in ("foot_left_x_accel_g", "foot_left_z_accel_g")})
    assert signal.window_metrics(df, ["case_id"], "side", "v0").first()["window_150_foot_resultant_left_g"] == 0


def test_family(spark):
    df = spark.createDataFrame([("2013 Honda Accord 4-door (R&D) - Small Overlap",), (None,)], "x string")
    assert [r[0] for r in df.select(T.family("x")).collect()] == ["Honda Accord 4 door", None]


def test_numbers(spark):
    tokens = ["1,234", "45%", "3-5", "--", "n/a", "±2.5", "12°", "VIII", None, ""]
    df = spark.createDataFrame([(t,) for t in tokens], "x string")
    rows = df.select(T.plain_number("x").alias("p"), T.loose_number("x").alias("l"), T.share("x").alias("s"), T.version_number("x").alias("v")).collect()
    assert [r["p"] for r in rows] == [1234, 45, None, None, None, 2.5, 12, None, None, None]
    assert [r["l"] for r in rows] == [None, None, 4, None, None, 2.5, 12, None, None, None]
    assert rows[1]["s"] == 0.45 and rows[7]["v"] == 8


def test_nan_is_missing(spark):
    df = missing.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.agg(F.max("x"), F.count("x")).first() == (1.0, 1)


def test_locator_and_unit(spark):
    df = spark.createDataFrame([("sheet:A|row:1",), ("sheet:A",), ("page:1",)], "x string")
    assert [r[0] for r in df.select(T.locator_sheet("x")).collect()] == ["A", "A", ""]
    assert spark.range(1).select(T.unit_of(F.lit("Head (mm)"), "g"), T.unit_of(F.lit("Head"), "g")).first() == ("mm", "g")


def test_robust_z_and_line(spark):
    z = stats.robust_z(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double"), {"z": "x"}).filter("x = 3").first()
    assert z["z"] == 0
    line = spark.createDataFrame([(1, float(x), 1 + 2.0 * x) for x in range(12)], "g long, x double, y double")
    fit = stats.least_squares(line, ["x"], "y", ["g"]).first()
    assert fit["r2"] > 0.99 and fit["adj_r2"] > 0.99 and fit["b1"] == pytest.approx(2)
    assert stats.least_squares(line.filter("x < 11"), ["x"], "y", ["g"]).first()["r2"] is None
    assert line.agg(stats.pearson("x", "g")).first()[0] is None


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(stats.row_mean("a", "b")).collect()] == [1.0, None, 4.0]


def test_coverage_and_bands(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, None, None, 1.0)], "id long, a double, b double, c double")
    assert [r["id"] for r in relational.coverage_at_least(df, ["a", "b", "c"], 0.65).collect()] == [1]
    bands = stats.quantile_band(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, None)], "g long, v double"), "v", ["g"])
    assert [r["band"] for r in bands.orderBy(F.asc_nulls_last("v")).collect()] == ["low", "mid", "high", "mid"]


def test_outcomes(spark):
    rows = [(1, "intrusion", "footrest", None, -7.0, None, None, None, None), (1, "leg_foot_injury", "index", "ok", None, 5.1, 5.0, None, None), (1, "intrusion", "footrest", "review", 99.0, None, None, None, None),
            (1, "restraint_kinematics", "pretensioner fires", None, None, None, None, -3.0, None), (1, "restraint_kinematics", "pretensioner fires", None, None, None, None, 12.0, None), (2, "intrusion", "x", "review", 1.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "filegroup_id long, table_type string, normalized_label string, quality_status string, resultant_number double, left_number double, right_number double, time_number double, measure_number double").withColumn("result_number", F.lit(None).cast("double"))
    cases = spark.createDataFrame([(1,), (2,)], "filegroup_id long")
    out = {r["filegroup_id"]: r for r in marts.outcome_mart(cases, df).collect()}
    assert out[1]["intrusion_footrest_resultant_cm"] == 7 and out[1]["pretensioner_time_ms"] == 12 and out[1]["restraint_event_count"] == 1
    assert out[1]["leg_foot_index_left"] is None and out[1]["leg_foot_index_right"] == 5
    assert out[2]["intrusion_max_resultant_cm"] is None and out[2]["outcome_quality_score"] == 0


def test_linkage(spark):
    f = spark.createDataFrame([(1, 0.1, 1.0, 2.0, 1.0, 0.5), (2, 0.2, 3.0, 4.0, 2.0, 0.7), (3, 0.3, 5.0, 9.0, 3.0, 0.9)], "filegroup_id long, window_100_ri double, window_100_max_abs_az_g double, window_100_max_abs_resultant_g double, window_100_seat_twist_peak_mm double, window_100_foot_resultant_asymmetry_g double")
    names = [c for parts in marts.DOMAINS.values() for c in parts]
    o = spark.createDataFrame([(i, *[float(i * k) for k in range(len(names))]) for i in (1, 2, 3)], "filegroup_id long, " + ", ".join(f"{c} double" for c in names))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "filegroup_id long, working_mode_label string")
    out = {r["filegroup_id"]: r for r in marts.linkage_frame(f, o, a).collect()}
    assert out[1]["harshness_proxy"] < out[2]["harshness_proxy"] < out[3]["harshness_proxy"] and out[3]["working_mode_label"] is None
    assert out[2]["ri_z"] == 0


def test_sensitivity(spark):
    df = spark.createDataFrame([(float(i), float(i), float(-i), float(i * i)) for i in range(8)], "d double, a double, b double, c double")
    out = {(r["scenario"], r["domain"]): r["r"] for r in marts.sensitivity(df, {"up": ["a", "c"], "down": ["b"]}, "d", [None, "c"]).collect()}
    assert out["c", "up"] == pytest.approx(1) and out["all", "down"] == pytest.approx(-1)
    assert marts.winners(spark.createDataFrame([("s", "x", 1.0), ("s", "y", 3.0)], "s string, d string, v double"), "s", "d", "v").first()["margin"] == 2


def test_series_against_numpy(spark):
    rng = np.random.default_rng(1)
    t, v = np.cumsum(rng.uniform(0.1, 1, 60)), rng.normal(0, 5, 60)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))], "c long, idx long, t double, v double")
    assert [r["slope"] for r in signal.gradient(df, ["c"]).orderBy("idx").collect()] == pytest.approx(list(np.gradient(v, t)))
    grid = spark.createDataFrame([(1, float(x)) for x in np.linspace(-1, t[-1] + 1, 50)], "c long, g double")
    got = signal.interpolated(df, grid, ["c"]).orderBy("g").collect()
    want = np.interp([r["g"] for r in got], t, v, np.nan, np.nan)
    assert [r["v"] is None for r in got] == list(np.isnan(want))
    assert [r["v"] for r in got if r["v"] is not None] == pytest.approx(list(want[~np.isnan(want)]))
    i = signal.integrals(df, ["c"]).first()
    assert i["area"] == pytest.approx(np.trapezoid(v, t)) and i["energy"] == pytest.approx(np.trapezoid(v * v, t))


def test_ties_take_the_first(spark):
    df = spark.createDataFrame([(1, i, float(i), v) for i, v in enumerate([0.0, 2.0, -2.0, 2.0, 0.0, 0.0])], "c long, idx long, t double, v double")
    assert signal.peaks(df, ["c"]).first()["peak_abs_t"] == 1
    assert signal.zero_crossings(df, ["c"]).first()["crossings"] == 2
    assert signal.first_quiet_run(df, ["c"], 0.5, 2).first()["settle_idx"] == 4
    assert signal.first_quiet_run(df, ["c"], 0.5, 3).first()["settle_idx"] == 5


def test_harmonized_rows(spark):
    df = spark.createDataFrame([(1, i, i * 0.01, float(i)) for i in range(20)], "c long, idx long, t double, v double")
    out = signal.interpolated(df, signal.harmonized_grid(df.select("c").distinct()), ["c"])
    assert out.count() == 2501 and out.filter("is_observed").count() == 1901


def test_crop_returns_all_when_empty(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 1.0), (2, 0, 0.1, 1.0), (2, 1, 5.0, 1.0)], "c long, idx long, t double, v double")
    assert [r["c"] for r in signal.cropped(df, ["c"], 0.15).orderBy("c").collect()] == [1, 2]


def test_dtw_and_waveforms(spark):
    rng = np.random.default_rng(3)
    xs = {i: rng.normal(size=30 + i).round(3) for i in range(3)}
    z = spark.createDataFrame([(i, x.tolist()) for i, x in xs.items()], "case long, z array<double>")
    got = {(r["a"], r["b"]): r["dtw"] for r in similarity.dtw(similarity.block_pairs(z.select("case"), "case", []), z, 4).collect()}

    def plain(p, q, band=4):
        w = max(band, abs(len(p) - len(q)))
        d = np.full((len(p) + 1, len(q) + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, len(p) + 1):
            for j in range(max(1, i - w), min(len(q), i + w) + 1):
                d[i, j] = abs(p[i - 1] - q[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        return d[-1, -1] / (len(p) + len(q))

    assert len(got) == 3 and all(v == pytest.approx(plain(xs[a], xs[b])) for (a, b), v in got.items())
    long = spark.createDataFrame([(i, "a", k, float(v)) for i, x in xs.items() for k, v in enumerate(x)] + [(0, "b", 0, 1.0)], "case long, channel string, idx long, v double")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    r = similarity.weighted_waveforms(pairs, long, {"a": 2.0}).first()
    assert r["correlation"] == pytest.approx(np.corrcoef(xs[0][:30], xs[1][:30])[0, 1]) and r["overlap"] == 1
    n = similarity.availability(long, pairs).first()
    assert (n["both"], n["either"]) == (1, 1)


def test_phase_score(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 1.0], [1.0, 2.0]), (None, [1.0])], "x array<double>, y array<double>")
    got = [r[0] for r in df.select(similarity.phase_score("x", "y")).collect()]
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0.31 + 0.38 / (1 + math.sqrt(0.5))) and got[2] is None


def test_resolution(spark):
    wanted = spark.createDataFrame([("x", "Foo 1", 0), ("x", "Bar", 1), ("y", "None", 0)], "standard_name string, alias string, place int")
    channels = spark.createDataFrame([(1, "g", "bar", False), (1, "g", "FOO-1", True), (1, "h", "foo1", False)], "case_id long, group_name string, channel_name string, is_raw boolean")
    best, lost = relational.resolved(wanted, channels)
    assert best.first()["channel_name"] == "foo1" and [r["standard_name"] for r in lost.collect()] == ["y"]


def test_documents(spark):
    pages = spark.createDataFrame([(1, 1, "HEAD INJURY\nHIC 15  250\nbroken\n  label 12\nCHEST\nRib 3.5"), (2, 1, None)], "doc long, page_number int, text string")
    rows = documents.lines(pages, ["doc"])
    found = documents.table_rows(documents.sections(rows, ["doc"], "^[A-Z ]+$"), "single", ["doc", "section", "heading"]).orderBy("line_no").collect()
    assert [(r["heading"], r["label"], r["result_number"]) for r in found] == [("HEAD INJURY", "HIC 15", 250), ("HEAD INJURY", "label", 12), ("CHEST", "Rib", 3.5)]
    joined = documents.joined_lines(rows, ["doc"], F.col("raw").startswith("  ")).filter("doc = 1").orderBy("line_no").collect()
    assert joined[2]["line"] == "broken label 12"
    m = documents.metrics(pages, ["doc"], {"hic": (r"HIC 15\s+(\d+)", None), "none": ("zzz(1)", "g")}).collect()
    assert [(r["metric"], r["value_number"]) for r in m] == [("hic", 250)]
    cells = spark.createDataFrame([("w", "s", 0, 0, "Speed"), ("w", "s", 0, 1, ""), ("w", "s", 0, 2, "64.1")], "workbook string, sheet string, row int, col int, text string")
    assert documents.sheet_metrics(cells, {"speed": "speed_kmh"}).first()["value_number"] == 64.1
    assert documents.fingerprint(pages, "doc").count() == 2


def test_signal_catalog_and_tensor(spark):
    from waveloom.sources import sinks

    long = spark.createDataFrame([(1, "a", i, i * 0.1, float(i)) for i in range(3)] + [(1, "b", i, i * 0.1, None) for i in range(3)], "case long, channel string, idx long, t double, v double")
    row = sinks.tensor(long, "case", "channel", ["a", "b"]).first()
    assert row["values"] == [[0, 1, 2], [0, 0, 0]] and row["mask"] == [[1, 1, 1], [0, 0, 0]]
    assert sinks.series_catalog(long, ["case", "channel"]).count() == 2
    with pytest.raises(Exception, match="different grids"):
        sinks.tensor(long.unionByName(spark.createDataFrame([(1, "b", 3, 0.3, 1.0)], long.schema)), "case", "channel", ["a", "b"]).collect()


@pytest.mark.parametrize("name", ["zero_crossings", "extrema"])
def test_crossings_and_extrema_of_short_and_gappy_series_equal_sql(spark, tmp_path, name):
    import duckdb

    from tests.conftest import same
    from waveloom.plans import registry

    duck = duckdb.connect()
    duck.sql("""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, CASE WHEN i < 6 THEN 10 + i WHEN i < 12 THEN 20 + i // 2 ELSE i % 5 END AS user_id, 'click' AS event_type,
      CASE WHEN i % 5 = 4 OR i % 7 = 0 THEN NULL WHEN i % 11 = 0 THEN 'nan'::DOUBLE WHEN i % 13 = 0 THEN 20 ELSE 20 + (i * 37 % 19) - 9 END AS value FROM range(400) r(i)) TO '""" + f"{tmp_path}/events.parquet'")
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same(registry.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())
