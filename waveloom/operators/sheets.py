"""Metrics of test workbooks, from a table of cells (workbook, sheet, row, col, text; both counted from 0).

A row of a sheet is made wide once, by one partial aggregate over the columns that any layout reads; what else a metric needs
(the section above a row, the sheet's width) comes from one window over the sheet. Cells that are null or blank count as
missing, of cells at one place the greatest text holds, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions import text as T
from waveloom.session import kept

WIDTH = 14
SHEET = ["workbook", "sheet"]
# Labels of sheets, columns of values and suffixes of metrics.
SUMMARY_COLUMNS = {"reference": 2, "measured": 3, "t1": 4, "t2": 5}
RATINGS_WIDE = {"as_measured": 2, "normalized_iarv": 3, "iarv": 6, "boundary_ga": 7, "boundary_am": 8, "boundary_mp": 9}
RATINGS_NARROW = {"as_measured": 1, "normalized_iarv": 2, "iarv": 3, "boundary_ga": 4, "boundary_am": 5, "boundary_mp": 6}
DAS_LABELS = {"test setup name": "test_setup_name", "test description": "test_description", "test id": "test_id", "report date": "report_date", "recording mode": "recording_mode"}
GEOMETRY_HEADS = ("description", "measurement", "target", "origin_start", "origin_finish", "pre_crash_origin", "post_crash_origin", "start", "finish")
SEAT_LABELS = {"Adjustment type": None, "Adjustment range (mm)": "mm"}


def _c(i: int) -> Column:
    return F.col(f"c{i}")


def _number(c: Column | str) -> Column:
    """Sheets have no exponents: ``setup 7`` is 7."""
    return T.plain_number(c, exponent=False)


def _share(c: Column) -> Column:
    return F.when(F.trim(c).endswith("%"), _number(c) / 100).otherwise(_number(c))


def _slug(c: Column | str) -> Column:
    return T.slug(c, percent=True)


def _metric(name: Column | str, text: Column, unit: str | None = None, number: Column | None = None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    number = _number(text) if number is None else number
    return F.struct(name.alias("metric"), text.alias("value_text"), number.cast("double").alias("value_number"), F.lit(unit).cast("string").alias("unit"))


def _measured(name: Column, value: Column, unit: str) -> Column:
    return _metric(name, value.cast("string"), unit, value)


def _long(rows: DataFrame, family: str, metrics: Column, row: str | None = "row") -> DataFrame:
    """A row for each metric that has a text."""
    found = rows.select("workbook", "sheet", (F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.lit(family).alias("family"), F.explode(metrics).alias("m"))
    return found.select("workbook", "sheet", "row", "family", "m.*").filter("value_text IS NOT NULL")


def roles(sheets: DataFrame) -> DataFrame:
    """(workbook, sheet, role) from sheets (workbook, sheet, position, kind, test_code): the first sheet in order that fits each role.

    The sheet of the geometry is named as the test, or else begins with its code."""
    plain, name = F.col("kind") == "worksheet", T.collapse("sheet")
    first = lambda rule: F.min_by("sheet", F.when(rule, F.struct("position", "sheet")))
    slug = _slug("sheet")
    found = sheets.groupBy("workbook").agg(
        first(slug.contains("summary") & plain).alias("summary"), first((slug == "ratings_chart_data") & plain).alias("ratings"), first((slug == "das") & plain).alias("das"), first((slug == "sensor_channels") & plain).alias("sensors"),
        F.coalesce(first(F.upper(name) == F.col("test_code")), first(F.startswith(name, F.col("test_code")))).alias("geometry"), first(F.col("sheet") == "SEAT INFORMATION").alias("seat"))
    return found.unpivot("workbook", ["summary", "ratings", "das", "sensors", "geometry", "seat"], "role", "sheet").filter("sheet IS NOT NULL")


def wide_rows(cells: DataFrame) -> DataFrame:
    """Rows that have any text (workbook, sheet, row, last_col, c0 to c13); columns behind the last one that is read only count for the width."""
    text = F.when(F.length("text") > 0, F.col("text"))
    return cells.select(*SHEET, "row", "col", T.once(T.collapse("text")).alias("text")).groupBy(*SHEET, "row").agg(F.max("col").alias("last_col"), *(F.max(F.when(F.col("col") == i, text)).alias(f"c{i}") for i in range(WIDTH)))


def summary(rows: DataFrame) -> DataFrame:
    """Head lines, then values under sections: a section holds from the row that names it on, for all rows below."""
    head = rows.filter("row < 3").select("*", F.explode(F.array(
        F.when(F.col("row") == 0, _metric("summary_title", _c(0), number=F.lit(None))), F.when(F.col("row") == 0, _metric("test_date", _c(5), number=F.lit(None))),
        F.when(F.col("row") == 1, _metric("test_description", _c(1), number=F.lit(None))), F.when((F.col("row") == 2) & _c(0).isNotNull(), _metric("actual_test_impact_speed_kmh", _c(1), "km/h")))).alias("m"))
    head = head.filter("m.value_text IS NOT NULL").select(*SHEET, F.col("row").cast("long").alias("row"), F.lit("excel_summary").alias("family"), "m.*")
    above = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(_c(1).isNotNull(), _slug("c0")), True).over(above)
    base = _slug(F.concat_ws("_", F.when(F.col("section") != "", F.col("section")), "c1"))
    body = rows.filter("row >= 3").withColumn("section", section).filter(~F.lower("c1").contains("reference value")).withColumn("base", base).filter("base != ''")
    return head.unionByName(_long(body, "excel_summary", F.array(*(_metric(F.concat("base", F.lit(f"_{k}")), _c(i)) for k, i in SUMMARY_COLUMNS.items()))))


def ratings(rows: DataFrame) -> DataFrame:
    """Values and boundaries of ratings; sheets of ten columns or more have the label in the second column, then values stand farther right."""
    body = rows.withColumns({"width": F.max("last_col").over(Window.partitionBy(*SHEET)) + 1, "base": _slug(F.coalesce("c1", "c0"))}).filter("row >= 2 AND base IS NOT NULL")
    at = (F.col("width") > 9) & _c(1).isNotNull()
    return _long(body, "excel_ratings", F.array(*(_metric(F.concat("base", F.lit(f"_{k}")), F.when(at, _c(RATINGS_WIDE[k])).otherwise(_c(RATINGS_NARROW[k]))) for k in RATINGS_WIDE)))


def das(rows: DataFrame, sensors: DataFrame) -> DataFrame:
    """The recorder's head lines, and sums over its modules and sensor channels."""
    name = F.coalesce(*(F.when(F.lower("c0") == k, F.lit(v)) for k, v in DAS_LABELS.items()))
    heads = _long(rows.filter("row < 8").withColumn("name", name).filter("name IS NOT NULL"), "excel_das_summary", F.array(_metric(F.col("name"), _c(2))))
    modules = rows.filter("row >= 7 AND c0 IS NOT NULL").groupBy(*SHEET).agg(F.count("*").alias("modules"), F.sum(F.regexp_extract("c13", r"^(\d+)", 1).try_cast("long")).alias("active"), F.min(_number("c8")).alias("rate"))
    active = F.when(F.col("active") > 0, F.col("active"))
    totals = _long(modules, "excel_das_summary", F.array(_measured(F.lit("module_count"), F.col("modules"), "modules"), _measured(F.lit("active_channel_total"), active, "channels"), _measured(F.lit("sample_rate_hz"), F.col("rate"), "Hz")), None)
    channels = sensors.filter(_c(0).rlike(r"^\d+$")).groupBy(*SHEET).agg(F.count("*").alias("n"))
    return heads.unionByName(totals).unionByName(_long(channels, "excel_das_summary", F.array(_measured(F.lit("sensor_channel_count"), F.col("n"), "channels")), None))


def geometry(rows: DataFrame) -> DataFrame:
    """Intrusion at each measured point, in mm. The newer layout has three values before, three after, three differences, the
    resultant and the lengthwise intrusion side by side; the older one has the values after from the eleventh column on, and
    differences and resultant are worked out. A row that fits neither is none; one that fits both is of the newer layout."""
    numbers = {f"n{i}": _number(_c(i)) for i in range(2, 13)}
    n = [F.col(f"n{i}") for i in range(2, 13)]
    at = lambda i: n[i - 2]
    whole = lambda *places: F.expr(" AND ".join(f"n{i} IS NOT NULL" for i in places))
    label = F.coalesce("c1", "c0")
    parsed = F.struct(*(c.alias(k) for k, c in numbers.items()), label.alias("label"), _slug(label).alias("base"))
    body = rows.select("*", T.once(parsed).alias("_p")).select("*", "_p.*").withColumns({"newer": whole(2, 3, 4, 5, 6, 7), "older": whole(2, 3, 4, 10, 11, 12)})
    body = body.filter(F.col("label").isNotNull() & ~F.col("base").isin(*GEOMETRY_HEADS) & (F.col("newer") | F.col("older")))
    for k, axis in enumerate("xyz"):
        after = F.when(F.col("newer"), at(5 + k)).otherwise(at(10 + k))
        body = body.withColumns({f"pre_{axis}": at(2 + k), f"post_{axis}": after, f"diff_{axis}": F.abs(F.coalesce(F.when(F.col("newer"), at(8 + k)), at(2 + k) - after))})
    body = body.withColumn("resultant", F.coalesce(F.when(F.col("newer"), F.abs(at(11))), F.sqrt(sum(F.col(f"diff_{a}") * F.col(f"diff_{a}") for a in "xyz"))))
    name = lambda suffix: F.concat("base", F.lit(f"_{suffix}"))
    values = [_measured(name(f"{kind}_{a}_mm"), F.col(f"{kind}_{a}"), "mm") for a in "xyz" for kind in ("pre", "post", "diff")]
    values += [_measured(name("resultant_mm"), F.col("resultant"), "mm"), _measured(name("longitudinal_x_cm"), F.when(F.col("newer"), at(12)), "cm")]
    return _long(body, "excel_intrusion", F.array(*values, _metric(name("label"), F.col("label"), number=F.lit(None))))


def seat(rows: DataFrame) -> DataFrame:
    """Adjustment of the seat: a label and the value to its right."""
    return _long(rows, "excel_umtri", F.array(*(F.when(_c(1) == k, _metric(_slug("c1"), _c(2), unit)) for k, unit in SEAT_LABELS.items())))


def workbook_metrics(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(workbook, sheet, row, family, metric, value_text, value_number, unit) of all sheets that have a role; sums have no row."""
    rows = kept(wide_rows(cells.join(roles(sheets), SHEET, "left_semi")).join(roles(sheets), SHEET), "sheet-rows")
    of = lambda role: rows.filter(F.col("role") == role)
    return summary(of("summary")).unionByName(ratings(of("ratings"))).unionByName(das(of("das"), of("sensors"))).unionByName(geometry(of("geometry"))).unionByName(seat(of("seat")))


def environment(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Climate of each workbook's first sheet, whose first row names the columns: rows, temperature, humidity, first and last time, place."""
    firsts = sheets.groupBy("workbook").agg(F.min_by("sheet", F.struct("position", "sheet")).alias("sheet"))
    own = cells.join(firsts, SHEET)
    heads = own.filter("row = 0").groupBy(*SHEET, F.col("col")).agg(F.max("text").alias("head"))
    value = lambda head: F.max(F.when(F.col("head") == head, F.trim("text")))
    body = own.filter("row > 0").join(heads, [*SHEET, "col"], "left").groupBy(*SHEET, "row").agg(value("Temperature(F)").try_cast("double").alias("t"), _share(value("Humidity")).alias("h"), F.try_to_timestamp(F.concat_ws(" ", value("Date"), value("Time"))).alias("at"), F.nullif(value("Location"), F.lit("")).alias("place"))
    sums = body.groupBy(*SHEET).agg(F.count("*").alias("n"), F.avg("t").alias("mean"), F.min("t").alias("least"), F.max("t").alias("most"), F.avg("h").alias("humidity"), F.min("at").alias("start"), F.max("at").alias("end"), F.min_by("place", F.when(F.col("place").isNotNull(), F.col("row"))).alias("place"))
    text = lambda name, c: _metric(name, c.cast("string"), number=F.lit(None))
    return _long(sums, "excel_environment", F.array(
        _measured(F.lit("row_count"), F.col("n"), "rows"), _measured(F.lit("temperature_avg_f"), F.col("mean"), "degF"), _measured(F.lit("temperature_min_f"), F.col("least"), "degF"), _measured(F.lit("temperature_max_f"), F.col("most"), "degF"),
        _measured(F.lit("humidity_avg_ratio"), F.col("humidity"), "ratio"), text("timestamp_start", F.col("start")), text("timestamp_end", F.col("end")), text("location", T.collapse("place"))), None)
