"""Modes of response: window features made ready, clustered for every window and number of clusters, scored, chosen and named."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveloom.functions import stats
from waveloom.functions.order import quantiles
from waveloom.operators import clusters
from waveloom.operators.signal import WINDOWS_MS
from waveloom.session import kept

#: The features of a window that are clustered; fixed values.
SUFFIXES = (
    "delta_vx_mps", "delta_vy_away_mps", "lr", "ly", "ri", "max_abs_ax_g", "max_abs_ay_g", "max_abs_az_g", "max_abs_resultant_g", "pulse_duration_x_ms", "pulse_duration_y_ms", "pulse_duration_z_ms",
    "seat_twist_peak_mm", "foot_resultant_left_g", "foot_resultant_right_g", "foot_resultant_asymmetry_g", "foot_x_left_right_diff_g", "foot_z_left_right_diff_g",
)
KS = (2, 3, 4)


def ready(features: DataFrame, windows=WINDOWS_MS, coverage: float = 0.65) -> DataFrame:
    """``features`` with a vector z<window> a window: of cases that may be clustered and have ``coverage`` of its features,
    the median for those that are missing, then scaled to mean 0 and deviation 1; else NULL."""
    cols = {ms: [f"window_{ms:03d}_{s}" for s in SUFFIXES] for ms in windows}
    enough = {ms: (F.col("cluster_input_flag") == 1) & (sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0)) / len(names) >= coverage) for ms, names in cols.items()}
    features = kept(features, "window-features")
    given = features.select(*(F.when(enough[ms], F.col(c)).cast("double").alias(c) for ms, names in cols.items() for c in names))
    mid = {c: m or 0.0 for c, m in quantiles(given, {c: (c, 0.5) for c in given.columns}, []).first().asDict().items()}
    filled = features.withColumns({f"_f_{c}": F.when(enough[ms], F.coalesce(F.col(c), F.lit(mid[c]))) for ms, names in cols.items() for c in names})
    moments = filled.agg(*(f(f"_f_{c}").alias(f"{k}{c}") for names in cols.values() for c in names for k, f in (("a", F.avg), ("s", F.stddev_pop)))).first()
    z = {f"z{ms}": F.when(enough[ms], F.array(*((F.col(f"_f_{c}") - F.lit(moments[f"a{c}"] or 0.0)) / F.lit(moments[f"s{c}"] or 1.0) for c in names))) for ms, names in cols.items()}
    return filled.withColumns(z).drop(*(f"_f_{c}" for names in cols.values() for c in names))


def runs(frame: DataFrame, case: str, windows, ks=KS, tries: int = 20, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """``frame`` with a column c<window>_<k> a run, and a row for each: cases, silhouette, cost, sizes and their ratio."""
    frame = kept(frame, "scaled-windows")  # every round reads it
    found = clusters.kmeans_runs(frame, [f"z{ms}" for ms in windows], ks, tries, seed)
    out = kept(clusters.with_nearest_centres(frame, {f"c{view[1:]}_{k}": (view, c) for (view, k), (c, _) in found.items()}), "window-clusters")
    rows, n_blocks = [], clusters.block_count(frame)
    for (view, k), (_, cost) in sorted(found.items(), key=lambda x: (int(x[0][0][1:]), x[0][1])):
        label = f"c{view[1:]}_{k}"
        per = clusters.silhouette(out, case, view, label, n_blocks).groupBy("label").agg(F.count("*").alias("n"), F.sum("silhouette").alias("s")).collect()  # k rows
        sizes = [r["n"] for r in per]
        score = sum(r["s"] for r in per) / sum(sizes) if len(sizes) > 1 else None
        rows.append({"window_ms": int(view[1:]), "k": k, "sample_count": sum(sizes), "silhouette": score, "inertia": cost, "smallest": min(sizes), "largest": max(sizes), "size_ratio": max(sizes) / min(sizes)})
    return out, rows


def chosen(rows: list[dict], uneven: float = 0.035) -> dict:
    """The run with the best silhouette less ``uneven`` times the logarithm of the ratio of sizes; the first of equals."""
    return max(rows, key=lambda r: (r["silhouette"] if r["silhouette"] is not None else -1.0) - uneven * math.log(r["size_ratio"]))


def sweep(frame: DataFrame, case: str, outcome: str, windows=WINDOWS_MS, ks=KS, tries: int = 20) -> list[dict]:
    """Of each window the best run by silhouette, a fifth of eta squared and unevenness; the best window of up to 150 ms is marked."""
    labelled, rows = runs(frame, case, windows, ks, tries)
    for r in rows:
        label = f"c{r['window_ms']}_{r['k']}"
        eta = stats.eta_squared(labelled.withColumn("_g", F.lit(1)), label, outcome, ["_g"]).first()
        r["eta_squared"] = eta["eta_squared"] if eta else None
        r["composite"] = (r["silhouette"] if r["silhouette"] is not None else -1.0) + 0.20 * (r["eta_squared"] or 0.0) - 0.03 * math.log(r["size_ratio"])
    best = [max((r for r in rows if r["window_ms"] == ms), key=lambda r: r["composite"]) for ms in windows if any(r["window_ms"] == ms for r in rows)]
    operating = max((r for r in best if r["window_ms"] <= 150), key=lambda r: r["composite"], default=None)
    return [r | {"operating": r is operating, "robustness": r["window_ms"] == 250} for r in best]


#: Names of three clusters, in the order in which they are given away; fixed values.
MODE_LABELS = {"occupant": "occupant-compartment-response dominant", "harsh": "harsh-pulse dominant", "bulk": "bulk moderate / mixed holding bucket"}


def named(assignments: DataFrame, cluster: str, window: int, k: int) -> DataFrame:
    """``working_mode_label``: of three clusters the one with the greatest seat twist and foot asymmetry, of the others that
    with the greatest longitudinal and lateral peaks and RI, and the rest; other numbers of clusters are numbered."""
    if k != 3:
        return assignments.withColumn("working_mode_label", F.concat(F.lit("mode_"), F.col(cluster).cast("string")))
    p = f"window_{window:03d}_"
    means = assignments.groupBy(cluster).agg(*(F.avg(p + c).alias(c) for c in ("seat_twist_peak_mm", "foot_resultant_asymmetry_g", "max_abs_ax_g", "max_abs_ay_g", "ri"))).orderBy(cluster).collect()  # three rows
    score = lambda r, names: sum(r[c] if r[c] is not None else -math.inf for c in names)
    occupant = max(means, key=lambda r: score(r, ("seat_twist_peak_mm", "foot_resultant_asymmetry_g")))
    rest = [r for r in means if r is not occupant]
    harsh = max(rest, key=lambda r: score(r, ("max_abs_ax_g", "max_abs_ay_g", "ri")))
    kind = {occupant[cluster]: "occupant", harsh[cluster]: "harsh"}
    return assignments.withColumn("working_mode_label", F.coalesce(*(F.when(F.col(cluster) == c, MODE_LABELS[x]) for c, x in kind.items()), F.when(F.col(cluster).isNotNull(), MODE_LABELS["bulk"])))
