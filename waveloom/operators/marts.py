"""Case-level marts: outcomes, the case master, result-row quality and reviews built on them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions import stats
from waveloom.operators.relational import not_equal


@dataclass(frozen=True)
class Metric:
    """One conditional aggregate of an outcome mart: a table type, a test of the label, a measure and a reducer."""

    name: str
    table_type: str
    measure: str
    label: str | None = None
    how: str = "max_abs"
    pattern: bool = False

    def column(self) -> Column:
        where = F.col("table_type") == self.table_type
        if self.label is not None:
            where &= F.col("normalized_label").rlike(self.label) if self.pattern else F.col("normalized_label") == self.label
        return getattr(stats, self.how)(self.measure, where).alias(self.name)


#: The metrics of the outcome mart of version 1; names, table types and labels are fixed values.
OUTCOMES_V1 = (
    Metric("intrusion_max_resultant_cm", "intrusion", "resultant_number"),
    Metric("intrusion_footrest_resultant_cm", "intrusion", "resultant_number", "footrest", pattern=True),
    Metric("intrusion_left_toepan_resultant_cm", "intrusion", "resultant_number", "left toepan|lefttoepan", pattern=True),
    Metric("intrusion_brake_pedal_resultant_cm", "intrusion", "resultant_number", r"\bbrake pedal\b", pattern=True),
    Metric("leg_foot_index_left", "leg_foot_injury", "left_number", "index"),
    Metric("leg_foot_index_right", "leg_foot_injury", "right_number", "index"),
    Metric("foot_resultant_accel_left_g", "leg_foot_injury", "left_number", "vector resultant acceleration g"),
    Metric("foot_resultant_accel_right_g", "leg_foot_injury", "right_number", "vector resultant acceleration g"),
    Metric("head_hic15", "head_injury", "result_number", "hic 15", pattern=True),
    Metric("chest_rib_compression_mm", "chest_injury", "result_number", "rib compression mm"),
    Metric("chest_viscous_criteria_ms", "chest_injury", "result_number", "viscous", pattern=True),
    Metric("neck_tension_extension_nij", "neck_injury", "result_number", "nij tension extension"),
    Metric("thigh_hip_risk_proxy_left_kn", "thigh_hip_injury", "left_number", "femur axial force", pattern=True),
    Metric("thigh_hip_risk_proxy_right_kn", "thigh_hip_injury", "right_number", "femur axial force", pattern=True),
    Metric("pretensioner_time_ms", "restraint_kinematics", "time_number", "pretensioner", "min_positive", True),
    Metric("airbag_first_contact_time_ms", "restraint_kinematics", "time_number", "face begins loading frontal airbag|contacts frontal airbag", "min_positive", True),
    Metric("airbag_full_inflation_time_ms", "restraint_kinematics", "time_number", "frontal airbag fully inflated", "min_positive", True),
    Metric("dummy_clearance_head_to_roof_mm", "dummy_clearance", "measure_number", "head to roof"),
    Metric("dummy_clearance_knee_to_dash_left_mm", "dummy_clearance", "measure_number", "knee to dash left"),
    Metric("dummy_clearance_knee_to_dash_right_mm", "dummy_clearance", "measure_number", "knee to dash right"),
)
REQUIRED_V1 = [m.name for m in OUTCOMES_V1 if not m.name.startswith(("thigh", "dummy"))] + ["restraint_event_count", "thigh_hip_risk_proxy"]


def conditional_metrics(rows: DataFrame, key: str, metrics: tuple[Metric, ...], extra: list[Column] | None = None) -> DataFrame:
    """All metrics as one aggregate: one shuffle however many there are. Rows under review do not count."""
    return rows.filter(not_equal("quality_status", "review") & F.col("table_type").isin(sorted({m.table_type for m in metrics}))).groupBy(key).agg(*(m.column() for m in metrics), *(extra or []))


def outcome_mart(cases: DataFrame, rows: DataFrame, key: str = "filegroup_id", metrics: tuple[Metric, ...] = OUTCOMES_V1) -> DataFrame:
    """Outcomes of each case, derived columns, quality score and version; cases without rows have missing outcomes."""
    events = F.when(F.col("table_type") == "restraint_kinematics", F.when(F.col("time_number").isNotNull(), F.col("normalized_label")))
    present = F.count_if(F.col("table_type").eqNullSafe("restraint_kinematics") & F.col("time_number").isNotNull())
    out = cases.join(conditional_metrics(rows, key, metrics, [F.when(present > 0, F.count_distinct(events)).alias("restraint_event_count")]), key, "left")
    out = out.withColumns({
        "thigh_hip_risk_proxy": F.greatest("thigh_hip_risk_proxy_left_kn", "thigh_hip_risk_proxy_right_kn"),
        "dummy_clearance_min_mm": F.least("dummy_clearance_head_to_roof_mm", "dummy_clearance_knee_to_dash_left_mm", "dummy_clearance_knee_to_dash_right_mm"),
        **{c: F.when(F.col(c) <= 5.0, F.col(c)) for c in ("leg_foot_index_left", "leg_foot_index_right")},
    })
    return out.withColumns({"outcome_quality_score": stats.completeness(*REQUIRED_V1), "outcome_source_version": F.lit("outcomes_v1")})


def case_master(cases: DataFrame, signals: DataFrame, documents: DataFrame, key: str = "filegroup_id") -> DataFrame:
    """Cases with signal flags by mode, document flags, family and cohort."""
    from waveloom.functions.text import cohort, family

    by_mode = signals.groupBy(key).agg(*(F.max(F.when((F.col("mode") == m) & (F.col("status") == "done"), 1).otherwise(0)).alias(f"{m}_flag") for m in ("standard_baseline", "strict_origin")), F.max(F.when(F.col("mode") == "standard_baseline", F.col("preprocessing_case_id"))).alias("preprocessing_case_id"))
    by_kind = documents.groupBy(key).agg(*(F.max((F.col("kind") == k).cast("int")).alias(f"{k}_flag") for k in ("pdf", "excel")))
    out = cases.join(by_mode, key, "left").join(by_kind, key, "left")
    flags = ["standard_baseline_flag", "strict_origin_flag", "pdf_flag", "excel_flag"]
    return out.fillna(0, flags).withColumns({"family": family("title"), "cohort": cohort("era", "test_side", "standard_baseline_flag")})


def coverage_summary(mart: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows in which each column is present."""
    return mart.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns)).unpivot([], columns, "metric", "coverage")


#: Penalties of a result row's flags, and of a cell that cannot be read; fixed values.
ROW_PENALTIES: Mapping[str, float] = {"missing_label": 0.45, "missing_primary_value": 0.35, "label_numeric_prefix": 0.15, "label_table_prefix": 0.15, "residual_ocr_fragment": 0.15}
UNPARSED_PENALTY = 0.1


def row_quality(rows: DataFrame, label: str, normalized: str, values: list[str], cells: Mapping[str, tuple[str, str]], times: tuple[str, ...] = ()) -> DataFrame:
    """Flags, score and status of each row: 1 less the penalties of its flags, at least 0; review if there is any flag.

    ``values`` are the texts of which one must be there; ``cells`` names, for each kind of cell, its text and its number,
    and those in ``times`` hold times.
    """
    from waveloom.functions import labels
    from waveloom.functions.text import collapse

    text = labels.clean_label(label)
    blank = lambda c: collapse(F.coalesce(F.col(c), F.lit(""))) == ""
    tests = {
        "missing_label": blank(normalized),
        "label_numeric_prefix": text.rlike(labels.NUMERIC_PREFIX),
        "label_table_prefix": text.rlike(labels.TABLE_PREFIX),
        "residual_ocr_fragment": text.rlike(labels.RESIDUE),
        "missing_primary_value": reduce(lambda a, b: a & b, (blank(c) for c in values)),
        **{f"unparsed_{kind}": labels.unparsed(*cell, time=kind in times) for kind, cell in cells.items()},
    }
    flags = F.array_sort(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))))
    lost = sum((F.when(test, ROW_PENALTIES.get(name, UNPARSED_PENALTY)).otherwise(0.0) for name, test in tests.items()), F.lit(0.0))
    scored = rows.withColumns({"quality_flags": F.array_join(flags, ","), "quality_score": F.greatest(F.lit(0.0), F.round(1.0 - lost, 3))})
    return scored.withColumn("quality_status", F.when(F.col("quality_flags") != "", "review").otherwise("ok"))


def composites(df: DataFrame, scores: Mapping[str, list[str]], by: list[str] | None = None, alone: Mapping[str, str] | None = None) -> DataFrame:
    """For each score the mean of its components' robust z-scores that are present, over the rows at hand; ``alone`` names
    z-scores of single columns. All are formed from one aggregate."""
    parts = sorted({c for components in scores.values() for c in components})
    z = stats.robust_z(df, {f"_z_{c}": c for c in parts} | dict(alone or {}), by)
    return z.withColumns({out: stats.row_mean(*(f"_z_{c}" for c in components)) for out, components in scores.items()}).drop(*(f"_z_{c}" for c in parts))


#: Domains of outcome components; fixed values.
DOMAINS = {
    "structure_intrusion": ["intrusion_max_resultant_cm", "intrusion_footrest_resultant_cm", "intrusion_left_toepan_resultant_cm", "intrusion_brake_pedal_resultant_cm"],
    "lower_extremity": ["leg_foot_index_left", "leg_foot_index_right", "foot_resultant_accel_left_g", "foot_resultant_accel_right_g", "thigh_hip_risk_proxy"],
    "restraint_kinematics": ["pretensioner_time_ms", "airbag_first_contact_time_ms", "airbag_full_inflation_time_ms"],
    "head_neck_chest": ["head_hic15", "chest_rib_compression_mm", "chest_viscous_criteria_ms", "neck_tension_extension_nij"],
}


def linkage_frame(features: DataFrame, outcomes: DataFrame, assignments: DataFrame, key: str = "filegroup_id", window: int = 100) -> DataFrame:
    """Features, outcomes and mode labels of each case with domain scores, RI z-score, harshness and seat-twist proxies and their products."""
    joined = features.join(outcomes, key).join(assignments, key, "left")
    scores = {f"{domain}_score": [c for c in parts if c in outcomes.columns] for domain, parts in DOMAINS.items()}
    name = f"window_{window:03d}_"
    scores |= {"harshness_proxy": [name + "max_abs_az_g", name + "max_abs_resultant_g"], "seat_response_proxy": [name + "seat_twist_peak_mm", name + "foot_resultant_asymmetry_g"]}
    joined = composites(joined, scores, alone={"ri_z": name + "ri"})
    return joined.withColumns({"ri_x_harshness": F.col("ri_z") * F.col("harshness_proxy"), "ri_x_seat_response": F.col("ri_z") * F.col("seat_response_proxy")})


def winners(scores: DataFrame, scenario: str, domain: str, value: str) -> DataFrame:
    """The best domain of each scenario, the first of equals, and its lead over the second."""
    from pyspark.sql import Window

    order = Window.partitionBy(scenario).orderBy(F.desc(value), domain)
    ranked = scores.filter(F.col(value).isNotNull()).withColumns({"_place": F.row_number().over(order), "second": F.lead(value).over(order)})
    return ranked.filter("_place = 1").select(scenario, F.col(domain).alias("winner"), F.col(value).alias("best"), (F.col(value) - F.col("second")).alias("margin"))


def sensitivity(frame: DataFrame, components: dict[str, list[str]], driver: str, dropped: list[str | None]) -> DataFrame:
    """For each scenario (one component left out, or none) the correlation of each domain's score with ``driver``; scores are formed anew in each scenario."""
    out = None
    for skip in dropped:
        scored = composites(frame, {f"{domain}_s": [c for c in parts if c != skip] for domain, parts in components.items()})
        one = scored.agg(*(stats.pearson(f"{d}_s", driver).alias(d) for d in components)).unpivot([], list(components), "domain", "r").withColumn("scenario", F.lit(skip or "all"))
        out = one if out is None else out.unionByName(one)
    return out


#: Components of domain scores: the columns of which the greatest counts, and the sign of its robust z-score; fixed values.
COMPONENTS = {
    "leg_index_max": (("leg_foot_index_left", "leg_foot_index_right"), 1), "foot_accel_max": (("foot_resultant_accel_left_g", "foot_resultant_accel_right_g"), 1), "thigh_proxy": (("thigh_hip_risk_proxy",), 1),
    "intrusion_max": (("intrusion_max_resultant_cm",), 1), "intrusion_footrest": (("intrusion_footrest_resultant_cm",), 1), "intrusion_toepan": (("intrusion_left_toepan_resultant_cm",), 1), "intrusion_brake": (("intrusion_brake_pedal_resultant_cm",), 1),
    "dummy_clearance_inverse": (("dummy_clearance_min_mm",), -1), "pretensioner_time": (("pretensioner_time_ms",), 1), "airbag_contact_time": (("airbag_first_contact_time_ms",), 1), "airbag_inflation_time": (("airbag_full_inflation_time_ms",), 1),
    "head_hic15": (("head_hic15",), 1), "neck_nij": (("neck_tension_extension_nij",), 1), "chest_rib_compression": (("chest_rib_compression_mm",), 1), "chest_vc": (("chest_viscous_criteria_ms",), 1),
}
#: What each scenario puts in the place of a domain's score; fixed values.
SCENARIOS = {
    "baseline": {},
    "structure_intrusion_only": {"structure_intrusion": ("intrusion_max", "intrusion_footrest", "intrusion_toepan", "intrusion_brake")},
    "structure_no_clearance": {"structure_intrusion": ("intrusion_max", "intrusion_footrest", "intrusion_brake", "dummy_clearance_inverse")},
    "lower_leg_foot_only": {"lower_extremity": ("leg_index_max", "foot_accel_max")},
    "lower_foot_only": {"lower_extremity": ("foot_accel_max",)},
    "restraint_contact_only": {"restraint_kinematics": ("pretensioner_time", "airbag_contact_time")},
    "head_neck_core": {"head_neck_chest": ("head_hic15", "neck_nij", "chest_rib_compression")},
}
#: Variants of the lower-extremity score; the first is the score itself; fixed values.
LOWER_VARIANTS = {
    "current": (), "leg_foot_only": ("leg_index_max", "foot_accel_max"), "leg_thigh_only": ("leg_index_max", "thigh_proxy"), "foot_thigh_only": ("foot_accel_max", "thigh_proxy"),
    "leg_only": ("leg_index_max",), "foot_only": ("foot_accel_max",), "thigh_only": ("thigh_proxy",),
}


def component_scores(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``frame`` with a column z_<name> for each component, over all rows or within ``by``."""
    largest = {f"_m_{n}": F.greatest(*cols) if len(cols) > 1 else F.col(cols[0]) for n, (cols, _) in COMPONENTS.items()}
    z = stats.robust_z(frame.withColumns(largest), {f"z_{n}": f"_m_{n}" for n in COMPONENTS}, by)
    return z.withColumns({f"z_{n}": -F.col(f"z_{n}") for n, (_, sign) in COMPONENTS.items() if sign < 0}).drop(*largest)


def _fits(frame: DataFrame, predictors: list[str], targets: Mapping[tuple[str, str], Column], first: str, second: str) -> DataFrame:
    """One regression for each target, all from one aggregate, with the best by adjusted R2 of each ``first`` and its lead."""
    every = F.array(*(F.struct(F.lit(a).alias(first), F.lit(b).alias(second), t.cast("double").alias("_target")) for (a, b), t in targets.items()))
    tall = frame.select(*predictors, F.explode(every).alias("_x")).select(*predictors, "_x.*")
    return _with_winner(stats.least_squares(tall, predictors, "_target", [first, second]), first, second)


def _with_winner(fits: DataFrame, first: str, second: str) -> DataFrame:
    best = winners(fits, first, second, "adj_r2").withColumnsRenamed({"best": "winner_adj_r2", "margin": "winner_margin"})
    return fits.join(best, first, "left")


def domain_scenarios(frame: DataFrame, predictors: list[str]) -> DataFrame:
    """(scenario, domain, n, r2, adj_r2, b.., winner, winner_adj_r2, winner_margin): each domain's score regressed on the
    predictors in each of seven scenarios that form it in another way. ``frame`` has outcomes and <domain>_score columns."""
    scored = component_scores(frame)
    targets = {(s, d): stats.row_mean(*(f"z_{c}" for c in parts[d])) if d in parts else F.col(f"{d}_score") for s, parts in SCENARIOS.items() for d in DOMAINS}
    return _fits(scored, predictors, targets, "scenario", "domain")


def lower_extremity_variants(frame: DataFrame, predictors: list[str]) -> DataFrame:
    """(scope, variant, n, r2, ..): seven forms of the lower-extremity score over all cases, the passenger side and one era;
    a scope's z-scores are formed within it."""
    scopes = {"overall": F.lit(True), "test_side=passenger": F.col("test_side") == "passenger", "era=2015-2017": F.col("era") == "2015-2017"}
    scoped = frame.withColumn("scope", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in scopes.items())))))
    scored = component_scores(scoped, ["scope"])
    every = F.array(*(F.struct(F.lit(v).alias("variant"), (stats.row_mean(*(f"z_{c}" for c in parts)) if parts else F.col("lower_extremity_score")).cast("double").alias("_target")) for v, parts in LOWER_VARIANTS.items()))
    tall = scored.select("scope", *predictors, F.explode(every).alias("_x")).select("scope", *predictors, "_x.*")
    return _with_winner(stats.least_squares(tall, predictors, "_target", ["scope", "variant"]), "scope", "variant")
