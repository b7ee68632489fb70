"""Queries of reviews and of injury tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveloom.operators import injuries
from waveloom.plans import reviews
from waveloom.plans.registry import query, rounded, table

_MEASURES = ("l_quantity", "l_discount", "l_tax")


def _window_column(i: int, ms: int) -> tuple[str, int, str]:
    """What stands in for feature i of a window: a name, a line number and a measure; some cases lack one or the other."""
    return f"window_{ms:03d}_{reviews.KEY_FEATURES[i]}", (i + (ms == 150)) % 7 + 1, _MEASURES[i % 3]


def _window_frame(spark, sf_dir):
    names = [_window_column(i, ms) for i in range(len(reviews.KEY_FEATURES)) for ms in (100, 150)]
    flag = F.col("l_returnflag") != "N"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(*(F.avg(F.when((F.col("l_linenumber") == n) & (flag | F.lit("150" not in c)), F.col(m))).alias(c) for c, n, m in names))


_WINDOWS = "f AS (SELECT l_orderkey AS case_id, " + ", ".join(f"avg(CASE WHEN l_linenumber = {n}{' AND l_returnflag <> ' + chr(39) + 'N' + chr(39) if '150' in c else ''} THEN {m} END) AS {c}" for i in range(9) for c, n, m in (_window_column(i, 100), _window_column(i, 150))) + " FROM lineitem GROUP BY 1)"
_PAIRS = " UNION ALL ".join(f"SELECT '{n}' AS feature_name, window_100_{n} AS x, window_150_{n} AS y FROM f" for n in reviews.KEY_FEATURES)


@query(f"""WITH {_WINDOWS}, p AS ({_PAIRS}) SELECT feature_name, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS paired_count, round(corr(x, y), 6) AS pearson_r, round(avg(abs(y - x)), 6) AS mean_abs_delta, round(median(x), 6) AS median_100, round(median(y), 6) AS median_150 FROM p GROUP BY 1""")
def window_stability(spark, sf_dir):
    return rounded(reviews.window_stability(_window_frame(spark, sf_dir)))


_CHANGES = {"ri": "ri", "dvy": "delta_vy_away_mps", "seat_twist": "seat_twist_peak_mm", "ax": "max_abs_ax_g", "ay": "max_abs_ay_g", "az": "max_abs_az_g", "resultant": "max_abs_resultant_g"}


@query(f"""WITH {_WINDOWS}, d AS (SELECT case_id, {", ".join(f"window_150_{f} - window_100_{f} AS delta_{k}" for k, f in _CHANGES.items())} FROM f), o AS (SELECT o_orderkey AS case_id, o_totalprice AS severity FROM orders WHERE o_orderkey % 3 > 0)
 SELECT d.case_id, {", ".join(f"round(delta_{k}, 6) AS delta_{k}" for k in _CHANGES)}, severity, round(abs(delta_ri), 6) AS abs_delta_ri, round(abs(delta_ax) + abs(delta_ay) + abs(delta_az), 6) AS xyz_l1_delta FROM d LEFT JOIN o USING (case_id)
 ORDER BY abs(delta_ax) + abs(delta_ay) + abs(delta_az) DESC NULLS LAST, abs(delta_ri) DESC NULLS LAST, case_id LIMIT 25""")
def window_deltas(spark, sf_dir):
    outcomes = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("severity"))
    return rounded(reviews.window_deltas(_window_frame(spark, sf_dir), outcomes, "case_id", "severity"))


@query("""WITH m AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'ri_only' WHEN 'N' THEN 'ri_plus_proxies' ELSE 'ri_plus_interactions' END AS model FROM lineitem), a(axis, k, role) AS (VALUES ('lower_extremity_score', 0, 'primary_domain'), ('head_neck_chest_score', 1, 'secondary_domain'), ('structure_intrusion_score', 2, 'secondary_domain'), ('restraint_kinematics_score', 3, 'supporting_only')),
 g AS (SELECT 'pooled_safety_severity' AS approval_axis, 'summary_only' AS recommended_role, model, avg(l_discount) AS r2 FROM m WHERE l_linestatus = 'O' GROUP BY 3 UNION ALL SELECT axis, role, model, avg(l_tax) FROM m JOIN a ON k = l_linenumber % 5 WHERE l_linestatus = 'O' GROUP BY 1, 2, 3
  UNION ALL SELECT 'subgroup::line=' || l_linenumber, 'exploratory_hint', model, avg(l_tax) FROM m WHERE l_linenumber < 5 GROUP BY 1, 3)
 SELECT approval_axis, round(max(CASE WHEN model = 'ri_only' AND recommended_role <> 'exploratory_hint' THEN r2 END), 6) AS ri_only_adj_r2, round(max(CASE WHEN model = 'ri_plus_proxies' THEN r2 END), 6) AS proxy_adj_r2, round(max(CASE WHEN model = 'ri_plus_interactions' THEN r2 END), 6) AS interaction_adj_r2, recommended_role FROM g GROUP BY approval_axis, recommended_role""")
def approval_summary(spark, sf_dir):
    n = F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").withColumns({
        "model_name": F.when(F.col("l_returnflag") == "A", "ri_only").when(F.col("l_returnflag") == "N", "ri_plus_proxies").otherwise("ri_plus_interactions"), "scope": F.when(F.col("l_linestatus") == "O", "overall").otherwise("era"),
        "domain_name": F.element_at(F.array(*(F.lit(a) for a, _ in reviews.AXES), F.lit("other_score")), n % 5 + 1), "group_kind": F.when(n < 5, "subgroup").otherwise("rest")})
    pooled = li.groupBy("scope", "model_name").agg(F.avg("l_discount").alias("adj_r2"))
    domains = li.groupBy("scope", "domain_name", "model_name").agg(F.avg("l_tax").alias("adj_r2"))
    subgroups = li.groupBy("group_kind", F.lit("line").alias("scope"), n.alias("scope_value"), "model_name").agg(F.avg("l_tax").alias("adj_r2"))
    return rounded(reviews.approval_summary(pooled, domains, subgroups))


_SECTIONS = ("Upper tibia", "Lower tibia", "Foot")


def _report_lines(spark, sf_dir):
    """Each part as a record of the report of its size: a label, which may run over two lines or go on under its values, and numbers."""
    k = F.col("p_partkey")
    form, name = F.col("p_size") % 4, F.concat(F.upper(F.substring("p_name", 1, 1)), F.substr(F.col("p_name"), F.lit(2)))
    n = F.when(form == 0, 2).when(form == 3, 8).otherwise(4)
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda j: (k * (j + 3) % 97 + 1).cast("string"))
    values = F.concat_ws(" ", F.when(k % 5 == 0, (k % 50 + 100).cast("string")), F.array_join(cells, " "))
    line = lambda j, text: F.struct((k * 8 + j).alias("line_no"), text.alias("raw"))
    section = F.when(k % 7 == 0, F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.floor(k / 7) % 3 + 1).cast("int")))
    body = F.when(k % 3 == 0, F.array(line(1, F.concat_ws(" ", name, values)))).when(k % 3 == 1, F.array(line(1, name), line(2, values))).otherwise(F.array(line(1, F.concat_ws(" ", name, values)), line(2, F.lit("of the row (kN)"))))
    title = F.when(F.col("p_size") % 3 == 0, "Driver report").when(F.col("p_size") % 3 == 1, "Passenger report").otherwise("Report")
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), title.alias("title"), F.explode(F.concat(F.array(line(0, section)), body)).alias("l")).select("page", "title", "l.*").filter("raw IS NOT NULL")
    head = F.when(form == 0, F.lit("Measure Threshold Result Time (ms)")).when(form == 1, F.lit("Measure Threshold Left Time Right Time")).when(form == 2, F.lit("Measure Threshold Driver Passenger")).otherwise(F.lit("Threshold Driver Left Right Passenger Left Right"))
    heads = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), title.alias("title"), F.lit(-1).cast("long").alias("line_no"), head.alias("raw")).distinct()
    return heads.unionByName(parts)


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS page, p_size % 4 AS form, upper(p_name[1]) || p_name[2:] || CASE WHEN p_partkey % 3 = 2 THEN ' of the row (kN)' ELSE '' END AS label, row_number() OVER w AS record, last_value(CASE WHEN p_partkey % 7 = 0 THEN ['Upper Tibia', 'Lower Tibia', 'Foot'][p_partkey // 7 % 3 + 1] END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey) AS section,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 50 + 100 AS DOUBLE) END AS threshold_number, CASE p_size % 3 WHEN 0 THEN 'driver' WHEN 1 THEN 'passenger' END AS side FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)),
 s AS (SELECT *, unnest(CASE WHEN form >= 2 THEN [0, 1] ELSE [0] END) AS seat FROM p), c AS (SELECT *, CASE WHEN form = 3 THEN 4 * seat WHEN form = 2 THEN 2 * seat ELSE 0 END AS j, CASE WHEN form >= 2 THEN ['driver', 'passenger'][seat + 1] ELSE side END AS seat_position FROM s)
 SELECT page, record, seat_position, CASE WHEN form IN (1, 3) THEN section WHEN form = 2 THEN upper(seat_position[1]) || seat_position[2:] ELSE coalesce(section, upper(seat_position[1]) || seat_position[2:]) END AS section, label, CASE WHEN k % 3 = 2 THEN 'kN' END AS unit, threshold_number,
  CASE WHEN form IN (0, 2) THEN CAST(k * (j + 3) % 97 + 1 AS DOUBLE) END AS result_number, CASE WHEN form IN (0, 2) THEN CAST(k * (j + 4) % 97 + 1 AS DOUBLE) END AS time_number, CASE WHEN form IN (1, 3) THEN CAST(k * (j + 3) % 97 + 1 AS DOUBLE) END AS left_number, CASE WHEN form IN (1, 3) THEN CAST(k * (j + 4) % 97 + 1 AS DOUBLE) END AS left_time_number,
  CASE WHEN form IN (1, 3) THEN CAST(k * (j + 5) % 97 + 1 AS DOUBLE) END AS right_number, CASE WHEN form IN (1, 3) THEN CAST(k * (j + 6) % 97 + 1 AS DOUBLE) END AS right_time_number FROM c""")
def injury_tables(spark, sf_dir):
    found = injuries.injury_rows(_report_lines(spark, sf_dir), ["page", "title"], "title")
    return found.select("page", "record", "seat_position", "section", "label", "unit", *(f"{v}_number" for v in ("threshold", *injuries.VALUES)))
