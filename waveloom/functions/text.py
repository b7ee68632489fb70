"""Text normalisers, tolerant number parsers and rule classifiers, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import number


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: str | Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def once(c: Column) -> Column:
    """``c``, a column of its own that is worked out once for each row: filters on it, and what names it often, would else work it out again."""
    return F.explode(F.array(c))


def key(c: str | Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def slug(c: str | Column, keep_case: bool = False, percent: bool = False) -> Column:
    """Runs of other characters to one underscore; ``percent`` spells out the sign."""
    out = _col(c) if keep_case else F.lower(_col(c))
    if percent:
        out = F.replace(out, F.lit("%"), F.lit(" percent "))
    return F.trim(F.regexp_replace(out, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def unique_names(df, name: str, order: list[str], out: str = "unique_name", within: list[str] | None = None):
    """The second of equal names gets the suffix _2, and so on, in ``order``, ``within`` each group."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*(within or []), name).orderBy(*order))
    return df.withColumn(out, F.when(place == 1, F.col(name)).otherwise(F.concat_ws("_", name, place.cast("string"))))


#: What goes from the name of a test, in this order: the year, what follows `` into ``, remarks, test kind, research mark;
#: then one blank stands for each hyphen and run of white space.
FAMILY_STEPS = (
    (r"^\d{4}\s+", ""),
    (r"(?s) into .*$", ""),
    (r"\([^)]*\)", ""),
    (r"(?i)\bSmall Overlap\b", ""),
    (r"(?i)\bR&D\b", ""),
    (r"\s*-\s*", " "),
    (r"\s+", " "),
)


def family(c: str | Column) -> Column:
    """The model family in the name of a test."""
    return F.btrim(reduce(lambda x, step: F.regexp_replace(x, *step), FAMILY_STEPS, F.trim(_col(c))), F.lit(" ,"))


def rewritten(c: str | Column, aliases: list[tuple[str, str]]) -> Column:
    """Canonical label: collapsed, lower-case, then each alias pattern in turn."""
    return collapse(reduce(lambda x, a: F.regexp_replace(x, f"(?i){a[0]}", a[1]), aliases, F.lower(collapse(c))))


def cohort(era: str, side: str, ready: str) -> Column:
    """Era, side and whether signals are ready; a part that is missing is named so."""
    named = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    state = F.when(F.coalesce(F.col(ready).cast("int"), F.lit(0)) != 0, "signal-ready").otherwise("signal-missing")
    return F.concat_ws("|", named(era, "unknown-era"), named(side, "unknown"), state)


def side_factor(c: str | Column) -> Column:
    """-1 for the passenger side, else 1."""
    return F.when(F.lower(_col(c)) == "passenger", -1.0).otherwise(1.0)


def locator_sheet(c: str | Column) -> Column:
    """The sheet in a locator such as ``sheet:A|row:7``; empty for any other."""
    return F.when(_col(c).ilike("sheet:%"), F.substring_index(F.substr(_col(c), F.lit(7)), "|", 1)).otherwise("")


def plain_number(c: str | Column, exponent: bool = True) -> Column:
    """The number that is left when all but digits, signs, points and, with ``exponent``, e is taken out."""
    kept = F.regexp_replace(_col(c), "[^0-9.+eE-]" if exponent else "[^0-9.+-]", "")
    return number(kept)


def loose_number(c: str | Column) -> Column:
    """As printed in reports: plus-minus, degree and star signs go, a range is its midpoint, commas are not accepted."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), r"[°*\s]", ""), "^±", "")
    low, high = (number(F.regexp_extract(bare, r"^(-?\d+(?:\.\d+)?)-(-?\d+(?:\.\d+)?)$", k)) for k in (1, 2))
    return F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(number(F.nullif(bare, F.lit(""))))


#: Fixed values of Roman numerals.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]


def version_number(c: str | Column) -> Column:
    """A number, or a Roman numeral up to ten."""
    place = F.array_position(F.array(*map(F.lit, ROMAN)), F.upper(F.trim(_col(c))))
    return F.coalesce(number(F.trim(_col(c))), F.nullif(place, F.lit(0)).cast("double"))


def share(c: str | Column) -> Column:
    """``45%`` is 0.45, other numbers are themselves."""
    return F.when(F.trim(_col(c)).endswith("%"), plain_number(c) / 100).otherwise(plain_number(c))


def banded(c: str | Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval, open to the left and closed to the right, that a value lies in; NULL beyond the ends."""
    out, value = F.lit(None).cast("string"), _col(c)
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((value > low) & (value <= high), label).otherwise(out)
    return out


def metres_per_second(actual: str, target: str) -> Column:
    """A speed in km/h, the actual one or else the one aimed at, as m/s."""
    return F.coalesce(actual, target) / 3.6


def mode_set(text: str, allowed: list[str]) -> list[str]:
    """The modes that a comma-separated text names, each once and in order; an unknown one raises."""
    asked = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    unknown = [x for x in asked if x not in allowed]
    if unknown:
        raise ValueError(f"unknown modes: {', '.join(sorted(unknown))}")
    return asked


def numbers_in(c: str | Column) -> Column:
    """All numbers in a text, in order."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def columns_of(c: str | Column) -> Column:
    """A line cut at two blanks or more."""
    return F.split(F.trim(_col(c)), r"\s{2,}")


def unit_of(c: str | Column, fallback: str | None = None) -> Column:
    """What stands in parentheses at the end of a label."""
    found = F.regexp_extract(_col(c), r"\(([^()]+)\)\s*$", 1)
    return F.when(found != "", found).otherwise(F.lit(fallback))


def first_match(c: str | Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches, else NULL."""
    return F.coalesce(*(F.nullif(F.regexp_extract(_col(c), p, 1), F.lit("")) for p in patterns))


def classified(c: str | Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The class of the first rule (pattern, class) that matches."""
    out = F.lit(other)
    for pattern, label in reversed(rules):
        out = F.when(_col(c).rlike(pattern), label).otherwise(out)
    return out


def signature(*parts: str | Column) -> Column:
    """SHA-256 over parts joined by bars; NULL parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts)), 256)


def channel_unit(c: str | Column) -> Column:
    """The unit that a channel name ends in, changed by its transform."""
    base = F.when(_col(c).contains("_accel_g"), "g").when(_col(c).contains("_mm"), "mm").otherwise("")
    return F.when(_col(c).endswith("__jerk"), F.concat(base, F.lit("/s"))).when(_col(c).endswith("__rate"), F.concat(base, F.lit("/s"))).when(_col(c).endswith("__delta_v"), F.concat(base, F.lit("*s"))).otherwise(base)
