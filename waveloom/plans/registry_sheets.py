"""Queries of sheet metrics, beside their SQL; the cells are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waveloom.operators import sheets
from waveloom.plans.registry import query, rounded, table


def _cells(rows, values: dict[int, object], *keys):
    """A cell for each column of ``values`` that has a text."""
    found = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("col"), v.cast("string").alias("text")) for i, v in values.items()))).alias("c"))
    return found.select(*keys, "c.*").filter("text IS NOT NULL")


def _book(rows, key: str, sheet):
    return rows.withColumns({"workbook": F.col(key), "sheet": sheet})


def _listed(books, code):
    return books.select("workbook", "sheet").distinct().withColumns({"position": F.lit(1), "kind": F.lit("worksheet"), "test_code": code})


_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag")
_NUMBERED = f"row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_ORDER)})"


def _lines(spark, sf_dir, sheet):
    """The lines of each supplier, numbered, as the rows of a sheet."""
    rows = _book(table(spark, sf_dir, "lineitem"), "l_suppkey", sheet)
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*_ORDER)))


@query(f"""WITH g AS (SELECT l_suppkey AS workbook, {_NUMBERED} AS row, 'pillar_' || lower(l_returnflag) AS base, 'Pillar ' || l_returnflag AS label, l_orderkey % 11 = 0 AS head, l_linestatus = 'O' AS newer, l_linenumber AS k, l_quantity AS x0, l_partkey % 50 AS y0, l_orderkey % 40 AS z0, l_orderkey % 47 AS x1, l_quantity + l_linenumber AS y1, l_partkey % 31 AS z1 FROM lineitem),
 d AS (SELECT *, CASE WHEN newer AND k % 3 = 0 THEN 7 ELSE abs(x0 - x1) END AS dx, abs(y0 - y1) AS dy, CASE WHEN newer AND k % 2 = 0 THEN 4 ELSE abs(z0 - z1) END AS dz FROM g WHERE NOT head),
 r AS (SELECT *, CASE WHEN newer AND k % 4 = 0 THEN 9 ELSE sqrt(dx * dx + dy * dy + dz * dz) END AS res FROM d),
 m AS (SELECT workbook, row, unnest([{{'m': 'pre_x_mm', 'v': x0}}, {{'m': 'pre_y_mm', 'v': y0}}, {{'m': 'pre_z_mm', 'v': z0}}, {{'m': 'post_x_mm', 'v': x1}}, {{'m': 'post_y_mm', 'v': y1}}, {{'m': 'post_z_mm', 'v': z1}}, {{'m': 'diff_x_mm', 'v': dx}}, {{'m': 'diff_y_mm', 'v': dy}}, {{'m': 'diff_z_mm', 'v': dz}}, {{'m': 'resultant_mm', 'v': res}}, {{'m': 'longitudinal_x_cm', 'v': CASE WHEN newer AND k % 5 = 0 THEN 2.5 END}}]::STRUCT(m VARCHAR, v DOUBLE)[]) AS s, base FROM r)
 SELECT workbook, row, base || '_' || s.m AS metric, CASE WHEN s.m LIKE '%cm' THEN 'cm' ELSE 'mm' END AS unit, round(s.v, 6) AS value_number, CAST(NULL AS VARCHAR) AS label FROM m WHERE s.v IS NOT NULL UNION ALL SELECT workbook, row, base || '_label', NULL, NULL, label FROM g WHERE NOT head""")
def sheet_geometry(spark, sf_dir):
    """Points of two layouts: lines that are open are of the newer one, of which some lack differences, the resultant or both."""
    k, newer = F.col("l_linenumber"), F.col("l_linestatus") == "O"
    rows = _lines(spark, sf_dir, F.concat(F.lit("cen"), F.col("l_suppkey")))
    label = F.when(F.col("l_orderkey") % 11 == 0, "Measurement").otherwise(F.concat(F.lit("Pillar "), "l_returnflag"))
    after = [F.col("l_orderkey") % 47, F.col("l_quantity") + k, F.col("l_partkey") % 31]
    older = lambda i: F.when(~newer, after[i])
    cells = _cells(rows, {0: F.when(k % 2 == 0, label), 1: F.when(k % 2 == 1, label), 2: F.col("l_quantity"), 3: F.col("l_partkey") % 50, 4: F.col("l_orderkey") % 40, **{5 + i: F.when(newer, after[i]) for i in range(3)},
        8: F.when(newer & (k % 3 == 0), -7), 10: F.coalesce(F.when(newer & (k % 2 == 0), 4), older(0)), 11: F.coalesce(F.when(newer & (k % 4 == 0), -9), older(1)), 12: F.coalesce(F.when(newer & (k % 5 == 0), 2.5), older(2))}, "workbook", "sheet", "row")
    found = sheets.workbook_metrics(cells, _listed(rows, F.concat(F.lit("CEN"), F.col("workbook"))))
    return rounded(found.select("workbook", "row", "metric", "unit", "value_number", F.when(F.col("value_number").isNull(), F.col("value_text")).alias("label")))


@query("""WITH o AS (SELECT o_custkey AS workbook, o_orderkey + 3 AS row, o_totalprice, o_orderkey, replace(lower(o_orderstatus), '#', '') AS label,
  last_value(CASE WHEN o_orderkey % 3 = 0 THEN trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section FROM orders), b AS (SELECT *, concat_ws('_', section, 'value_' || label) AS base FROM o WHERE o_orderkey % 7 > 0)
 SELECT workbook, row, base || '_reference' AS metric, CAST(o_orderkey % 100 AS DOUBLE) AS value_number FROM b UNION ALL SELECT workbook, row, base || '_measured', CAST(o_totalprice AS DOUBLE) FROM b WHERE o_orderkey % 2 = 0""")
def sheet_summary(spark, sf_dir):
    """Values under sections: an order in three names one, which holds for the customer's later orders; others have reference values only."""
    k = F.col("o_orderkey")
    rows = _book(table(spark, sf_dir, "orders"), "o_custkey", F.lit("Test summary")).withColumn("row", k + 3)
    label = F.concat(F.when(k % 7 == 0, "Reference value ").otherwise("Value "), F.col("o_orderstatus"))
    cells = _cells(rows, {0: F.when(k % 3 == 0, F.col("o_orderpriority")), 1: label, 2: k % 100, 3: F.when(k % 2 == 0, F.col("o_totalprice").cast("decimal(18,2)"))}, "workbook", "sheet", "row")
    return sheets.workbook_metrics(cells, _listed(rows, F.lit("none"))).select("workbook", "row", "metric", "value_number")


@query("""WITH s AS (SELECT l_suppkey AS workbook, count(*)::DOUBLE AS n, avg(l_quantity) AS mean, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 100 / 100.0 ELSE 0.5 END) FILTER (l_linenumber % 3 > 0) AS humidity FROM lineitem GROUP BY 1),
 m AS (SELECT workbook, unnest([{'m': 'row_count', 'v': n}, {'m': 'temperature_avg_f', 'v': mean}, {'m': 'temperature_min_f', 'v': least}, {'m': 'temperature_max_f', 'v': most}, {'m': 'humidity_avg_ratio', 'v': humidity}]::STRUCT(m VARCHAR, v DOUBLE)[]) AS s FROM s) SELECT workbook, s.m AS metric, round(s.v, 6) AS value_number FROM m WHERE s.v IS NOT NULL""")
def sheet_environment(spark, sf_dir):
    """Climate by supplier: each line is a reading, its humidity a percentage, a ratio or missing."""
    k = F.col("l_linenumber")
    rows = _lines(spark, sf_dir, F.lit("Log"))
    heads = rows.select("workbook", "sheet").distinct().withColumn("row", F.lit(0))
    humidity = F.when(k % 3 == 0, None).when(k % 2 == 0, F.concat((F.col("l_orderkey") % 100).cast("string"), F.lit("%"))).otherwise("0.5")
    keys = "workbook", "sheet", "row"
    cells = _cells(heads, {0: F.lit("Temperature(F)"), 1: F.lit("Humidity")}, *keys).unionByName(_cells(rows, {0: F.col("l_quantity"), 1: humidity}, *keys))
    return rounded(sheets.environment(cells, _listed(rows, F.lit("none"))).select("workbook", "metric", "value_number"))
