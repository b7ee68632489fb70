"""Injury tables out of page text: records that run over several lines, with values for one or two seats and sides.

A line has values, or is a section header, a column header, a note, or a piece of a label. A piece that starts in lower case or with
a bracket belongs to the record above and stands before its values; any other waits for the next line with values of its section.
Which record a line belongs to is a running count over the table's lines, so the walk is a few windows over a page and no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions import labels
from waveloom.functions import text as T

#: What counts as a value, the sections, how column headers begin, and where a table ends.
TOKEN = r"(?i)(?:[±+\-–−]?\d+(?:\.\d+)?(?:-[±+\-–−]?\d+(?:\.\d+)?)?(?:°)?\*{0,2}|--|n/?a)"
SECTIONS = ("upper tibia", "lower tibia", "foot")
HEADERS = ("published", "tolerance", "threshold", "measure", "result", "time", "driver", "passenger", "left", "right")
FOOTERS = (*(f.lower() for f in labels.FOOTERS), "all rights reserved")
NOTE = "all distance measurements"
VALUES = ("result", "time", "left", "left_time", "right", "right_time")


def mended(c: str | Column) -> Column:
    """A line with one kind of dash and degree sign, its words mended."""
    return labels.clean_label(F.translate(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "−–—º", "---°"))


def _signature(c: Column) -> Column:
    return T.collapse(F.regexp_replace(F.lower(c), r"[^a-z0-9\s:/-]", ""))


def _starts(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("^(?:" + "|".join(words) + ")")


def _merged(record: Column, piece: Column) -> Column:
    """``piece`` before the first value of a record, or behind a record without one."""
    head = F.regexp_extract(record, rf"^(.*?){TOKEN}", 1)
    rest = F.substr(record, F.length(head) + 1)
    return mended(F.when(record.rlike(TOKEN), F.concat_ws(" ", F.rtrim(head), piece, F.ltrim(rest))).otherwise(F.concat_ws(" ", record, piece)))


def records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., record, section, text, two_seats, two_sides, threshold): the records of each table, from its lines (keys.., line_no, raw), and what
    its column headers name. Lines from a table's footer on count for nothing; null and empty lines neither."""
    rows = lines.select(*keys, "line_no", T.once(mended("raw")).alias("line")).filter("line != ''")
    table = Window.partitionBy(*keys)
    upto = table.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    low = F.lower("line")
    signature = _signature(F.col("line"))
    ends = F.lit(False)
    for f in FOOTERS:
        ends = ends | F.contains(signature, F.lit(f.replace(".", ""))) if f[0].isalpha() else ends | F.startswith(signature, F.lit(f.replace(".", "")))
    rows = rows.withColumn("_ended", F.max(ends.cast("int")).over(upto)).filter("_ended = 0").filter(~(F.startswith("line", F.lit("*")) | F.startswith(low, F.lit(NOTE))))
    attaches = (F.col("line") == "ij") | (low == "ij") | F.startswith("line", F.lit("(")) | F.substring("line", 1, 1).rlike(r"^\p{Ll}")
    tokens = F.size(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)))
    number_inside = attaches & (tokens <= 2) & ~F.col("line").rlike(r"\s[±+\-–−]?\d")
    is_section, is_header = low.isin(*SECTIONS), _starts(low, HEADERS)
    kind = F.when(is_section, "section").when(is_header, "header").when((tokens > 0) & ~number_inside, "values").when(attaches, "attach").otherwise("piece")
    rows = rows.withColumn("kind", kind)
    named = {"two_seats": ("driver", "passenger"), "two_sides": ("left", "right"), "threshold": ("threshold",)}
    has = lambda w: F.max(F.when(F.col("kind") == "header", F.contains(low, F.lit(w)).cast("int")).otherwise(0)).over(table)
    for name, words in named.items():
        every = has(words[0])
        for w in words[1:]:
            every = F.least(every, has(w))
        rows = rows.withColumn(name, every == 1)
    count = lambda k: F.sum((F.col("kind") == k).cast("int")).over(upto)
    heading = F.last(F.when(F.col("kind") == "section", F.initcap(low)), True).over(upto)
    rows = rows.withColumns({"n": count("values"), "part": count("section"), "section": heading}).filter("kind NOT IN ('section', 'header')")
    # A piece before the first record cannot join a record above.
    waits = (F.col("kind") == "piece") | ((F.col("kind") == "attach") & (F.col("n") == 0))
    rows = rows.withColumn("record", F.when(waits, F.col("n") + 1).otherwise(F.col("n"))).withColumn("waits", waits)
    own = F.max(F.when(F.col("kind") == "values", F.col("part"))).over(Window.partitionBy(*keys, "record"))
    # What waits is given up at the next section header; what no line with values follows is given up too.
    rows = rows.withColumn("_own", own).filter(F.col("_own").isNotNull() & (~F.col("waits") | (F.col("part") == F.col("_own"))))
    in_order = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("line_no", "line")))), lambda x: x["line"])
    values = F.col("kind") == "values"
    grouped = rows.groupBy(*keys, "record", *named).agg(in_order(F.col("waits") | values).alias("_first"), in_order(~F.col("waits") & ~values).alias("_after"), F.max(F.when(values, F.col("section"))).alias("section"))
    text = F.aggregate("_after", mended(F.array_join("_first", " ")), _merged)
    return grouped.select(*keys, "record", "section", text.alias("text"), *named)


def _tail(n: Column) -> tuple[Column, Column]:
    """Of ``_t`` (values) and ``_f`` (what lies between them) the label without the last ``n`` values, and those values; empty if there are fewer."""
    m = F.size("_t")
    cut = F.greatest(m - n, F.lit(0))
    before = F.array_join(F.zip_with(F.slice("_f", 1, cut), F.slice("_t", 1, cut), lambda f, t: F.concat(f, t)), "")
    label = mended(F.concat_ws(" ", F.concat(before, F.element_at("_f", cut + 1)), F.array_join(F.slice("_f", cut + 2, F.greatest(m - cut, F.lit(0))), " ")))
    return F.when(m >= n, label).otherwise(""), F.slice("_t", cut + 1, n)


def rows_of(found: DataFrame, keys: list[str], title: str | None = None, side: str | None = None) -> DataFrame:
    """(keys.., record, seat_position, section, label, unit, threshold_text, threshold_number, and text and number of result, time, left, left_time,
    right, right_time): the rows of records, two where a table has two seats.

    The last values of a record are its cells, the first of them the threshold where the headers name one and there is one value more; the
    rest is the label. Records with too few values or without a label are left out. Where a table has one seat, the column ``title``
    names it, or ``side``."""
    size = F.when(F.col("two_seats") & F.col("two_sides"), 8).when(F.col("two_seats") | F.col("two_sides"), 4).otherwise(2)
    split = found.withColumns({"_t": F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), "_f": F.split("text", TOKEN, -1), "_n": size})
    (long_label, long_cells), (label, cells) = _tail(F.col("_n") + 1), _tail(F.col("_n"))
    # A threshold only where the headers name one; without a label in front of it, the record is read as one without.
    split = split.withColumn("_labels", T.once(F.struct(F.when(F.col("threshold"), long_label).otherwise("").alias("_long"), label.alias("_short")))).select("*", "_labels.*")
    over = F.col("_long") != ""
    split = split.select(*keys, "record", "section", "two_seats", "two_sides", *([title] if title and title not in keys else []), *([side] if side and side not in keys else []), F.when(over, F.col("_long")).otherwise(F.col("_short")).alias("label"), F.when(over, F.slice(long_cells, F.lit(2), F.col("_n"))).otherwise(cells).alias("_c"), F.when(over, F.get(long_cells, F.lit(0))).alias("threshold_text")).filter("label != ''")
    named = F.when(F.contains(F.lower(F.col(title)), F.lit("driver")), "driver").when(F.contains(F.lower(F.col(title)), F.lit("passenger")), "passenger") if title else F.lit(None).cast("string")
    seat = F.coalesce(named, F.col(side) if side else F.lit(None).cast("string"))
    seats = F.when(F.col("two_seats"), F.array(F.struct(F.lit("driver").alias("seat_position"), F.lit(0).alias("at")), F.struct(F.lit("passenger").alias("seat_position"), F.when(F.col("two_sides"), 4).otherwise(2).alias("at")))).otherwise(F.array(F.struct(seat.alias("seat_position"), F.lit(0).alias("at"))))
    each = split.withColumn("_s", F.explode(seats)).select("*", "_s.*")
    cell = lambda i: F.get("_c", F.col("at") + i)
    own = {v: F.when(F.col("two_sides"), cell(i - 2)) if i > 1 else F.when(~F.col("two_sides"), cell(i)) for i, v in enumerate(VALUES)}
    section = F.when(F.col("two_sides"), F.col("section")).when(F.col("two_seats"), F.initcap("seat_position")).otherwise(F.coalesce("section", F.initcap("seat_position")))
    unit = T.collapse(F.nullif(F.regexp_extract("label", r"\(([^)]+)\)\s*$", 1), F.lit("")))
    out = each.select(*keys, "record", "seat_position", section.alias("section"), "label", unit.alias("unit"), "threshold_text", *(c.alias(f"{v}_text") for v, c in own.items()))
    number = lambda c: F.when(~F.lower(c).isin("--", "n/a", "na"), T.loose_number(F.translate(c, "–−—", "---")))
    return out.withColumns({f"{v}_number": number(F.col(f"{v}_text")) for v in ("threshold", *VALUES)})


def injury_rows(lines: DataFrame, keys: list[str], title: str | None = None, side: str | None = None) -> DataFrame:
    """The rows of injury tables, from their lines (keys.., line_no, raw); ``title`` and ``side`` are among the keys."""
    return rows_of(records(lines, keys), keys, title, side)
