"""Documents as lines: sections, tables, metrics and classes out of page text.

A page is exploded into lines and every rule is a column expression over them; what carries over from line to line is a
window over the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions import text as T


def lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line): lines collapsed to single blanks are kept as they stand too, in ``raw``."""
    return pages.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "raw")).withColumn("line", T.collapse("raw"))


def sections(rows: DataFrame, keys: list[str], header: str | Column) -> DataFrame:
    """Number the sections that header lines start, and carry each header down; lines before the first have section 0 and none."""
    is_header = F.col("line").rlike(header) if isinstance(header, str) else header
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_header", is_header.cast("int")).withColumns({"section": F.sum("is_header").over(w), "heading": F.last(F.when(F.col("is_header") == 1, F.col("line")), True).over(w)})


def joined_lines(rows: DataFrame, keys: list[str], continues: Column) -> DataFrame:
    """Lines that continue the one above are appended to it."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = rows.withColumn("_g", F.sum((~continues).cast("int")).over(w))
    return grouped.groupBy(*keys, "_g").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line")).drop("_g")


#: The result tables and what their rows look like: a label, then numbers. Fixed values.
TABLE_GRAMMARS = {
    "single": (r"^(.+?)\s+(-?[\d.,]+)$", ("result",)),
    "dual_side": (r"^(.+?)\s+(-?[\d.,]+|--)\s+(-?[\d.,]+|--)$", ("left", "right")),
    "intrusion": (r"^(.+?)\s+(-?[\d.,]+)\s+(-?[\d.,]+)\s+(-?[\d.,]+)\s+(-?[\d.,]+)$", ("longitudinal", "lateral", "vertical", "resultant")),
    "clearance": (r"^(.+?)\s+\(?([A-Z]{2})\)?\s+(-?[\d.,]+)$", ("code", "measure")),
    "kinematics": (r"^(.+?)\s{1,}(-?[\d.,]+)\s*(?:ms|msec)?$", ("time",)),
}


def table_rows(rows: DataFrame, grammar: str, keys: list[str]) -> DataFrame:
    """Lines that a grammar fits, as label, the texts of its cells and their numbers."""
    pattern, cells = TABLE_GRAMMARS[grammar]
    out = rows.filter(F.col("line").rlike(pattern)).select(*keys, "line_no", F.lit(grammar).alias("table_type"), F.regexp_extract("line", pattern, 1).alias("label"), *(F.regexp_extract("line", pattern, i + 2).alias(f"{c}_text") for i, c in enumerate(cells)))
    return out.withColumns({f"{c}_number": T.loose_number(F.replace(F.col(f"{c}_text"), F.lit(","), F.lit(""))) for c in cells if c != "code"})


def metrics(pages: DataFrame, keys: list[str], patterns: dict[str, tuple[str, str | None]], text: str = "text") -> DataFrame:
    """(keys, metric, value_text, value_number, unit): the first match of each pattern in a page; pages are read once for all patterns."""
    found = F.array(*(F.struct(F.lit(name).alias("metric"), F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("value_text"), F.lit(unit).cast("string").alias("unit")) for name, (p, unit) in patterns.items()))
    tall = pages.select(*keys, F.explode(found).alias("m")).select(*keys, "m.*").filter("value_text IS NOT NULL")
    return tall.withColumn("value_number", T.plain_number("value_text"))


def larger_table(first: Column, second: Column) -> Column:
    """Of two candidate tables (rows of cells) the one with more cells that hold text; the first of equals. Fewer than 2 x 2 cells or more than 12 columns is none."""
    def filled(t: Column) -> Column:
        return F.size(F.filter(F.flatten(t), lambda c: F.length(F.trim(c)) > 0))

    def usable(t: Column) -> Column:
        width = F.array_max(F.transform(t, lambda r: F.size(r)))
        return F.when((F.size(t) >= 2) & (width >= 2) & (width <= 12), t)

    a, b = usable(first), usable(second)
    return F.when(b.isNull() | (filled(a) >= filled(b)), a).otherwise(b)


def fingerprint(pages: DataFrame, key: str, text: str = "text", page: str = "page_number") -> DataFrame:
    """Page count, sizes and a layout signature of each document: the first line and the number of lines of each page, in order."""
    per = pages.select(key, page, F.size(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), F.size(T.numbers_in(F.coalesce(text, F.lit("")))).alias("numbers"), T.collapse(F.element_at(F.split(F.coalesce(text, F.lit("")), "\n"), 1)).alias("head"))
    return per.groupBy(key).agg(F.count("*").alias("pages"), F.sum("n").alias("lines"), F.sum("chars").alias("chars"), F.sum("numbers").alias("numbers"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "n", "head"))), lambda x: F.concat_ws("|", x[page].cast("string"), x["n"].cast("string"), x["head"])), "\n"), 256).alias("signature"))


def sheet_metrics(cells: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(workbook, sheet, metric, value_text, value_number): from a cell table (workbook, sheet, row, col, text), the first cell that
    is not empty to the right of a cell with one of the labels."""
    w = Window.partitionBy("workbook", "sheet", "row").orderBy("col").rowsBetween(1, Window.unboundedFollowing)
    filled = F.when(F.length(F.trim("text")) > 0, F.col("text"))
    rule = F.coalesce(*(F.when(T.key("text") == k, F.lit(v)) for k, v in labels.items()))
    found = cells.withColumns({"metric": rule, "value_text": F.first(filled, True).over(w)}).filter("metric IS NOT NULL AND value_text IS NOT NULL")
    return found.select("workbook", "sheet", "row", "metric", "value_text", T.plain_number("value_text").alias("value_number"))


def sheet_table(cells: DataFrame, header_row: int, names: list[str]) -> DataFrame:
    """Rows under a header row, as one column for each header name."""
    heads = cells.filter(F.col("row") == header_row).select("workbook", "sheet", "col", F.lower(F.trim("text")).alias("name"))
    body = cells.filter(F.col("row") > header_row).join(heads, ["workbook", "sheet", "col"])
    return body.groupBy("workbook", "sheet", "row").pivot("name", names).agg(F.first("text"))


def inventory(documents: DataFrame, pages: DataFrame, assignments: DataFrame, metrics_tall: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Documents with their page counts, first page's text, latest family and first metric values, each joined once."""
    from waveloom.operators.relational import first_per_key, first_values

    per_page = pages.groupBy(key).agg(F.count("*").alias("pages"), F.max(F.when(F.col("page_number") == 1, F.col("text"))).alias("first_page"))
    latest = first_per_key(assignments, [key], [F.desc("assignment_id")]).select(key, "family")
    values = first_values(metrics_tall, key, "metric", "value_text", "metric_id", names)
    return documents.join(per_page, key, "left").join(latest, key, "left").join(values, key, "left").withColumn("family", F.coalesce("family", F.lit("[unclassified]")))
