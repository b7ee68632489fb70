"""Queries whose values SQL does not check, against NumPy and plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waveloom.functions import stats
from waveloom.operators import marts, signal
from waveloom.plans import registry, registry_cases, registry_more  # noqa: F401


def fit(x, y):
    """(n, r2, adjusted r2, coefficients) of the complete rows."""
    whole = ~np.isnan(x).any(1) & ~np.isnan(y)
    x, y = np.column_stack([np.ones(whole.sum()), x[whole]]), y[whole]
    n, p = len(y), x.shape[1] - 1
    if n < max(12, p + 5):
        return n, None, None, None
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r2 = 1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    return n, r2, 1 - (1 - r2) * (n - 1) / (n - p - 1), beta


def component_z(frame):
    out = {}
    for name, (columns, sign) in marts.COMPONENTS.items():
        x = np.nanmax(np.where(np.isnan(v := frame[list(columns)].to_numpy(float)), -np.inf, v), axis=1)
        x = np.where(np.isfinite(x), x, np.nan)
        dev = np.nanstd(x)
        out[name] = sign * (x - np.nanmedian(x)) / (dev if dev > 1e-9 else 1.0)
    return pd.DataFrame(out)


def check_fits(rows, wanted, first, second):
    got = {(r[first], r[second]): r for r in rows}
    assert got.keys() == wanted.keys()
    for key, (n, r2, adjusted, beta) in wanted.items():
        r = got[key]
        assert r["n"] == n
        if r2 is None:
            assert r["r2"] is None
            continue
        assert (r["r2"], r["adj_r2"]) == pytest.approx((r2, adjusted), abs=1e-8)
        assert [r[f"b{i}"] for i in range(len(beta))] == pytest.approx(beta.tolist(), rel=1e-5, abs=1e-6)
    for a in {k[0] for k in wanted}:
        ranked = sorted(((-w[2], k[1]) for k, w in wanted.items() if k[0] == a and w[2] is not None))
        for k in wanted:
            if k[0] == a and ranked:
                assert got[k]["winner"] == ranked[0][1] and got[k]["winner_adj_r2"] == pytest.approx(-ranked[0][0], abs=1e-8)
                assert len(ranked) < 2 or got[k]["winner_margin"] == pytest.approx(ranked[1][0] - ranked[0][0], abs=1e-8)


def mean_of(z, parts):
    return z[list(parts)].mean(axis=1, skipna=True).to_numpy()


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(3)
    needed = sorted({c for cols, _ in marts.COMPONENTS.values() for c in cols})
    n = 90
    data = {"case_id": np.arange(n)} | {c: np.where(rng.random(n) < 0.1, np.nan, rng.normal(5, 2, n)) for c in needed} | {f"{d}_score": rng.normal(0, 1, n) for d in marts.DOMAINS} | {p: rng.normal(0, 1, n) for p in ("p1", "p2", "p3")}
    frame = pd.DataFrame(data)
    frame["leg_foot_index_left"] += 2 * frame["p1"]
    frame["test_side"] = np.where(np.arange(n) % 2 == 0, "passenger", "driver")
    frame["era"] = np.where(np.arange(n) % 9 == 0, "2015-2017", "2018-")  # ten cases: too few for a fit
    df = spark.createDataFrame(frame)
    return frame, df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).repartition(4)


def test_domain_scenarios(cases):
    frame, df = cases
    z, x = component_z(frame), frame[["p1", "p2", "p3"]].to_numpy()
    wanted = {(s, d): fit(x, mean_of(z, parts[d]) if d in parts else frame[f"{d}_score"].to_numpy()) for s, parts in marts.SCENARIOS.items() for d in marts.DOMAINS}
    check_fits(marts.domain_scenarios(df, ["p1", "p2", "p3"]).collect(), wanted, "scenario", "domain")


def test_lower_extremity_variants(cases):
    frame, df = cases
    wanted = {}
    for scope, mine in (("overall", frame), ("test_side=passenger", frame[frame.test_side == "passenger"]), ("era=2015-2017", frame[frame.era == "2015-2017"])):
        z, x = component_z(mine), mine[["p1", "p2", "p3"]].to_numpy()
        wanted |= {(scope, v): fit(x, mean_of(z, parts) if parts else mine["lower_extremity_score"].to_numpy()) for v, parts in marts.LOWER_VARIANTS.items()}
    assert wanted["era=2015-2017", "leg_only"][1] is None
    check_fits(marts.lower_extremity_variants(df, ["p1", "p2", "p3"]).collect(), wanted, "scope", "variant")


def test_bootstrap(spark):
    """Resamples by Poisson weights drawn from the same hashes."""
    rng = np.random.default_rng(5)
    rows = [(g, i, float(x), float(2 * x + rng.normal())) for g, n in (("a", 60), ("b", 25), ("few", 15)) for i, x in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "g string, i long, x double, y double").repartition(3)
    seeds = {(r.g, r.i): r.s for r in df.select("g", "i", F.xxhash64("g", "i", F.lit(42)).alias("s")).collect()}
    got = {r.g: r for r in stats.bootstrap_r2(df, ["x"], "y", ["g"], ["g", "i"], rounds=40).collect()}
    assert got.keys() == {"a", "b"}
    mask = (1 << 64) - 1
    for g in got:
        mine = [r for r in rows if r[0] == g]
        adjusted, positive = [], []
        for k in range(40):
            w = []
            for r in mine:
                h = (seeds[g, r[1]] + k * 0x9E3779B97F4A7C15) & mask
                h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
                h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
                w.append(sum(u >= p for p in stats.POISSON) if (u := ((h ^ (h >> 31)) >> 11) / 2**53) else 0)
            again = np.repeat(np.array([(r[2], r[3]) for r in mine]), w, axis=0)
            n, _, a, beta = fit(again[:, :1], again[:, 1])
            adjusted.append(a)
            positive.append(beta[1] > 0)
        r = got[g]
        assert r["rounds"] == 40 and r["positive_share"] == np.mean(positive)
        assert (r["adj_r2_median"], r["adj_r2_p10"], r["adj_r2_p90"]) == pytest.approx((np.median(adjusted), np.quantile(adjusted, 0.1), np.quantile(adjusted, 0.9)), abs=1e-8)


def test_pca(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in v], float)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    share = np.cumsum(s**2 / (s**2).sum())
    k = min(12, int(np.searchsorted(share, 0.93) + 1))
    got = {r.id: r.components for r in registry.QUERIES["pca_reduced"](spark, sf_dir).collect()}
    y = np.array([got[r.vec_id] for r in v])
    want = (x - x.mean(0)) @ vt[:k].T
    assert y.shape == want.shape and np.allclose(np.abs(y), np.abs(want), atol=1e-8)  # components have no sign


def plain_phases(x, y, points):
    """Landmarks and phases of one series, sample by sample."""
    n, top = len(x), max(abs(v) for v in y)
    peak = next(i for i in range(n) if abs(y[i]) == top)
    onset = next(i for i in range(n) if abs(y[i]) >= 0.1 * top)
    rebound = peak
    if peak + 2 < n:
        turn = [i for i in range(peak + 1, n - 1) if (y[i - 1] <= y[i] > y[i + 1] or y[i - 1] >= y[i] < y[i + 1]) and (y[i] < 0) == (y[peak] >= 0) and y[i] != 0 and abs(y[i]) >= 0.15 * top]
        rebound = turn[0] if turn else max(range(peak + 1, n), key=lambda i: (abs(y[i]), -i))
    settle, run = n - 1, 0
    for i in range(max(peak + 1, rebound), n):
        run = run + 1 if abs(y[i]) <= max(0.1 * top, 1e-9) else 0
        if run == 20:
            settle = i - 19
            break
    curves = []
    for lo, hi in ((onset, peak), (peak, rebound), (rebound, max(settle, rebound))):
        px, py = x[lo : max(lo + 1, hi) + 1], y[lo : max(lo + 1, hi) + 1]
        if len(px) < 2 or px[-1] - px[0] <= 1e-12:
            curves.append(None)
            continue
        most, out = max(map(abs, py)), []
        for k in range(points):
            at = k / (points - 1) * (px[-1] - px[0]) + px[0]
            j = max(i for i in range(len(px)) if px[i] <= at + 1e-12)
            v = py[j] if j == len(px) - 1 else py[j] + (py[j + 1] - py[j]) * (at - px[j]) / (px[j + 1] - px[j])
            out.append(v / most if most > 1e-9 else v)
        curves.append(out)
    return [x[i] for i in (onset, peak, rebound, settle)], curves


def test_phase_points(spark):
    rng = np.random.default_rng(9)
    series = {}
    for c in range(40):
        n = int(rng.integers(1, 120))
        t = np.cumsum(rng.random(n) + 0.01)
        series[c] = (t.tolist(), (np.exp(-t / 15) * np.sin(t / rng.uniform(2, 9)) * 30 + rng.normal(0, 0.5 if c % 2 else 0.01, n)).tolist())
    series[100] = ([0.0, 1.0, 2.0], [0.0, 0.0, 0.0])
    rows = [(c, i, t, v) for c, (ts, vs) in series.items() for i, (t, v) in enumerate(zip(ts, vs, strict=True))]
    df = spark.createDataFrame(rows, "case long, idx long, t double, v double").repartition(3)
    got = {r.case: r for r in signal.phase_points(df, ["case"], 8).collect()}
    assert got.keys() == series.keys()
    for c, (t, v) in series.items():
        marks, curves = plain_phases(t, v, 8)
        assert [got[c][m] for m in signal.LANDMARKS] == pytest.approx(marks), c
        for p, curve in zip(signal.PHASES, curves, strict=True):
            found = got[c][f"{p}_curve"]
            assert found is None if curve is None else found == pytest.approx(curve, abs=1e-6), (c, p)
