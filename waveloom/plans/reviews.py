"""Reviews of windows and models: how features change from one window to the next, and which outcome a model may speak for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveloom.functions import stats
from waveloom.functions.order import quantiles
from waveloom.session import kept

#: The features whose windows are compared; fixed values.
KEY_FEATURES = ("delta_vx_mps", "delta_vy_away_mps", "ri", "seat_twist_peak_mm", "foot_resultant_asymmetry_g", "max_abs_ax_g", "max_abs_ay_g", "max_abs_az_g", "max_abs_resultant_g")
#: The axes of approval: outcome and role; fixed values.
AXES = (("lower_extremity_score", "primary_domain"), ("head_neck_chest_score", "secondary_domain"), ("structure_intrusion_score", "secondary_domain"), ("restraint_kinematics_score", "supporting_only"))
MODELS = {"ri_only": "ri_only_adj_r2", "ri_plus_proxies": "proxy_adj_r2", "ri_plus_interactions": "interaction_adj_r2"}


def window_stability(features: DataFrame, names=KEY_FEATURES, first: int = 100, second: int = 150) -> DataFrame:
    """(feature_name, paired_count, pearson_r, mean_abs_delta, median_<first>, median_<second>): cases with both windows count for the pairs, all for the medians."""
    pairs = F.array(*(F.struct(F.lit(n).alias("feature_name"), F.col(f"window_{first:03d}_{n}").cast("double").alias("x"), F.col(f"window_{second:03d}_{n}").cast("double").alias("y")) for n in names))
    tall = kept(features.select(F.explode(pairs).alias("p")).select("p.*"), "window-pairs")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    told = tall.groupBy("feature_name").agg(F.sum(both.cast("long")).alias("paired_count"), stats.pearson("x", "y").alias("pearson_r"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("mean_abs_delta"))
    return told.join(quantiles(tall, {f"median_{first}": ("x", 0.5), f"median_{second}": ("y", 0.5)}, ["feature_name"]), "feature_name")


def window_deltas(features: DataFrame, outcomes: DataFrame, case: str, outcome: str, n: int = 25, first: int = 100, second: int = 150) -> DataFrame:
    """The ``n`` cases whose peaks by axis change most between two windows, with the changes: sum of the three peaks' changes, then that of RI, then the smaller case.

    A missing change makes the sum missing, and such cases come last."""
    change = lambda f: F.col(f"window_{second:03d}_{f}") - F.col(f"window_{first:03d}_{f}")
    of = {"ri": "ri", "dvy": "delta_vy_away_mps", "seat_twist": "seat_twist_peak_mm", "ax": "max_abs_ax_g", "ay": "max_abs_ay_g", "az": "max_abs_az_g", "resultant": "max_abs_resultant_g"}
    rows = features.select(case, *(change(f).alias(f"delta_{k}") for k, f in of.items())).join(outcomes.select(case, outcome), case, "left")
    rows = rows.withColumns({"abs_delta_ri": F.abs("delta_ri"), "xyz_l1_delta": F.abs("delta_ax") + F.abs("delta_ay") + F.abs("delta_az")})
    return rows.orderBy(F.desc_nulls_last("xyz_l1_delta"), F.desc_nulls_last("abs_delta_ri"), case).limit(n)


def approval_summary(pooled: DataFrame, domains: DataFrame, subgroups: DataFrame) -> DataFrame:
    """(approval_axis, ri_only_adj_r2, proxy_adj_r2, interaction_adj_r2, recommended_role): the models side by side for all outcomes together, for each domain, and for each subgroup.

    ``pooled`` has (scope, model_name, adj_r2), ``domains`` domain_name besides, ``subgroups`` (group_kind, scope, scope_value, model_name, adj_r2); overall scopes
    count, and of subgroups those that have a model with proxies."""
    r2 = [F.max(F.when(F.col("model_name") == m, F.col("adj_r2"))).alias(c) for m, c in MODELS.items()]
    overall = pooled.filter("scope = 'overall'").groupBy(F.lit("pooled_safety_severity").alias("approval_axis")).agg(*r2).withColumn("recommended_role", F.lit("summary_only"))
    role = F.coalesce(*(F.when(F.col("approval_axis") == a, F.lit(r)) for a, r in AXES))
    each = domains.filter("scope = 'overall'").groupBy(F.col("domain_name").alias("approval_axis")).agg(*r2).withColumn("recommended_role", role).filter("recommended_role IS NOT NULL")
    axis = F.concat(F.lit("subgroup::"), F.col("scope"), F.lit("="), F.col("scope_value").cast("string"))
    some = subgroups.filter("group_kind = 'subgroup'").groupBy(axis.alias("approval_axis")).agg(*r2, F.max((F.col("model_name") == "ri_plus_proxies").cast("int")).alias("has"))
    some = some.filter("has = 1").drop("has").withColumn("ri_only_adj_r2", F.lit(None).cast("double")).withColumn("recommended_role", F.lit("exploratory_hint"))
    return overall.unionByName(each).unionByName(some)
