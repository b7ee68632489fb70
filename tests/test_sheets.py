"""Sheet metrics on literal workbooks."""

import math

import pytest

from waveloom.operators import sheets

CELLS = "workbook string, sheet string, row int, col int, text string, sheet_kind string"
LIST = "workbook string, sheet string, position int, kind string, test_code string"


def cells(spark, grids, book="w"):
    return spark.createDataFrame([(book, s, i, j, t, "x") for s, grid in grids.items() for i, line in enumerate(grid) for j, t in enumerate(line)], CELLS)


def listed(spark, names, code="CEN1", book="w", kind="worksheet"):
    return spark.createDataFrame([(book, n, i, kind, code) for i, n in enumerate(names)], LIST)


def values(rows, family=None):
    return {r["metric"]: r["value_text"] if r["value_number"] is None else r["value_number"] for r in rows if family in (None, r["family"])}


GRIDS = {
    "Test Summary": [["Title", None, "", "", "", "2020-01-02"], ["", "A  car"], ["Speed", "64.1 km/h"], ["Head Injury", "HIC-15", "700", "250", "40", "55"], ["", "Peak (g)", None, "61"], ["Neck", ""], ["", "Reference value", "9"], ["", "Tension", "3.3", "n/a"]],
    "Ratings chart data": [["h"] * 10, ["h"], ["", "HIC", "250", "0.4", "", "", "700", "1", "2", "3"], ["Chest", "", "30", "", "60"]],
    "DAS": [["Test Setup Name", "", "setup 7"], ["Test ID", "", "CEN1"], ["other", "", "x"], [], [], [], [], ["serial"] + [""] * 7 + ["10000"] + [""] * 4 + ["8 of 32"], ["M2"] + [""] * 7 + ["20000"] + [""] * 4 + ["none"], ["", "not a module"]],
    "Sensor Channels": [["No"], ["1"], ["2"], ["2b"]],
    "cen1": [["Description"] + [""] + ["1"] * 10, ["Left toepan", "", "1", "2", "3", "2", "4", "5", "-7"], ["", "Pedal", *"123", *"456", *"111", "-9", "2.5"], ["Rail", "", "1", "2", "3", "", "", "", "", "", "4", "6", "3"], ["None", "", "1", "2"]],
    "SEAT INFORMATION": [["", "Adjustment range (mm)", "240"], ["", "Adjustment type", "manual"], ["", "Other", "1"]],
}


@pytest.fixture(scope="module")
def found(spark):
    return sheets.workbook_metrics(cells(spark, GRIDS), listed(spark, list(GRIDS))).collect()


def test_every_sheet(found):
    assert values(found, "excel_summary") == {"summary_title": "Title", "test_date": "2020-01-02", "test_description": "A car", "actual_test_impact_speed_kmh": 64.1, "head_injury_hic_15_reference": 700, "head_injury_hic_15_measured": 250, "head_injury_hic_15_t1": 40, "head_injury_hic_15_t2": 55, "head_injury_peak_g_measured": 61, "head_injury_tension_reference": 3.3, "head_injury_tension_measured": "n/a"}
    assert values(found, "excel_ratings") == {"hic_as_measured": 250, "hic_normalized_iarv": 0.4, "hic_iarv": 700, "hic_boundary_ga": 1, "hic_boundary_am": 2, "hic_boundary_mp": 3, "chest_normalized_iarv": 30, "chest_boundary_ga": 60}
    assert values(found, "excel_das_summary") == {"test_setup_name": 7, "test_id": 1, "module_count": 2, "active_channel_total": 8, "sample_rate_hz": 10000, "sensor_channel_count": 2}
    assert values(found, "excel_umtri") == {"adjustment_range_mm": 240, "adjustment_type": "manual"}


def test_geometry_of_both_layouts(found):
    found = values(found, "excel_intrusion")
    assert (found["left_toepan_diff_x_mm"], found["left_toepan_diff_y_mm"], found["left_toepan_label"]) == (7, 2, "Left toepan")
    assert found["left_toepan_resultant_mm"] == pytest.approx(math.sqrt(49 + 4 + 4))
    assert (found["pedal_diff_x_mm"], found["pedal_resultant_mm"], found["pedal_longitudinal_x_cm"]) == (1, 9, 2.5)
    assert (found["rail_post_y_mm"], found["rail_diff_x_mm"], found["rail_resultant_mm"]) == (6, 3, 5)
    assert "rail_longitudinal_x_cm" not in found and not any(k.startswith(("none", "description")) for k in found)


def test_roles(spark):
    names = ["CEN1 points", "cen1", "Summary b", "Summary a"]
    found = {(r["role"], r["sheet"]) for r in sheets.roles(listed(spark, names)).collect()}
    assert found == {("geometry", "cen1"), ("summary", "Summary b")}
    assert {r["role"] for r in sheets.roles(listed(spark, ["CEN1 points", "Summary"], kind="chartsheet")).collect()} == {"geometry"}
    assert sheets.roles(listed(spark, [None], code=None)).count() == 0


def test_climate(spark):
    grid = [["Date", "Time", "Temperature(F)", "Humidity", "Location"], ["2020-01-02", "10:00:00", "70", "40%", ""], ["2020-01-02", "09:00:00", "x", "0.5", "Lab  1"], ["", "", "72.5", None, "Lab 2"]]
    found = sheets.environment(cells(spark, {"Log": grid, "Second": [["a"]]}), listed(spark, ["Log", "Second"]))
    assert values(found.collect()) == {"row_count": 3, "temperature_avg_f": 71.25, "temperature_min_f": 70, "temperature_max_f": 72.5, "humidity_avg_ratio": 0.45, "timestamp_start": "2020-01-02 09:00:00", "timestamp_end": "2020-01-02 10:00:00", "location": "Lab 1"}


def test_empty_nulls_and_repeats(spark, found):
    none = spark.createDataFrame([], CELLS)
    assert sheets.workbook_metrics(none, listed(spark, list(GRIDS))).count() == sheets.environment(none, listed(spark, ["Log"])).count() == 0
    full = cells(spark, GRIDS)
    assert sheets.workbook_metrics(full, spark.createDataFrame([], LIST)).count() == 0
    twice = full.unionByName(full).unionByName(spark.createDataFrame([(None, None, None, None, None, None), ("w", "cen1", 1, None, "z", None)], CELLS))
    assert sorted(map(str, sheets.workbook_metrics(twice, listed(spark, list(GRIDS))).collect())) == sorted(map(str, found))


def test_numbers_and_texts_of_sheets_are_worked_out_once(spark):
    cells = spark.createDataFrame([(1, "CEN1", 0, 0, "Pillar")], "workbook int, sheet string, row int, col int, text string")
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    wide = sheets.wide_rows(cells)
    rows = spark.createDataFrame(wide.collect(), wide.schema)
    assert count(wide) <= 2 and count(sheets.geometry(rows)) <= 40, (count(wide), count(sheets.geometry(rows)))
