"""Labels of result rows: what scanning broke is mended, then labels are brought to one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, collapse

#: Words that run together in reports, and how they should read.
JOINED = (
    ("Sternumdeflection", "Sternum deflection"), ("Knee-thigh-hipinjury", "Knee-thigh-hip injury"), ("Deployment ofdriver", "Deployment of driver"), ("seat beltcrash", "seat belt crash"),
    ("loadingfrontal", "loading frontal"), ("Rim toabdomen", "Rim to abdomen"), ("toH-point", "to H-point"), ("Head toroof", "Head to roof"), ("Head tohead", "Head to head"), ("Vector resultantmoment", "Vector resultant moment"),
)
#: Words that scanning cut in two, as patterns of whole words without regard to case.
CUT = (
    (r"hea\s+de\s*r", "header"), (r"head\s+er", "header"), (r"abdom\s+en", "abdomen"), (r"do\s+or", "door"), (r"d\s+oor", "door"), (r"k\s+nee", "knee"), (r"a\s+nkle", "ankle"), (r"an\s+gle", "angle"),
    (r"s\s+ide", "side"), (r"wind\s+ow", "window"), (r"win\s+dow", "window"), (r"verti?\s+cal", "vertical"), (r"hori\s+zontal", "horizontal"), (r"das\s+h", "dash"), (r"p\s+oint", "point"),
    (r"whee\s+l", "wheel"), (r"whe\s+el", "wheel"), (r"wh\s+ee\s+l", "wheel"), (r"r\s+oof", "roof"),
)
#: Other spellings.
SPELLED = ((r"seat[- ]beltcrash", "seat belt crash"), (r"headcontacts", "Head contacts"), (r"A\s*-\s*pillar", "A-pillar"))
#: Where a page's footer starts.
FOOTERS = ("Insurance Institute for Highway Safety", "988 Dairy Road", "1005 N. Glebe Road")
#: Names of axes and criteria as one word.
AXES = (("N ij", "Nij"), ("n ij", "nij"), ("A-P", "AP"), ("a-p", "ap"), ("L-M", "LM"), ("l-m", "lm"), ("I-S", "IS"), ("i-s", "is"))
RESIDUE = r"(?i)\b(?:" + "|".join(p for p, _ in CUT) + r")\b"
NUMERIC_PREFIX = r"^\d{1,3}\s+"
TABLE_PREFIX = r"(?i)^(?:table|attachment)\s+\d+\b"


def clean_label(c: str | Column) -> Column:
    """A label as it should read: joined and cut words mended, no footer, no blanks inside brackets; a year alone is no label."""
    text = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), JOINED, collapse(F.coalesce(_col(c), F.lit(""))))
    text = reduce(lambda x, r: F.regexp_replace(x, rf"(?i)\b{r[0]}\b", r[1]), (*SPELLED, *CUT), text)
    text = reduce(lambda x, mark: F.substring_index(x, mark, 1), FOOTERS, text)
    text = collapse(F.regexp_replace(F.regexp_replace(text, r"\s+([,;:)\]])", "$1"), r"(\()\s+", "$1"))
    text = F.regexp_replace(text, r"(?i)^N\s+(.+?)\s+ij$", "Nij $1")
    return F.regexp_replace(text, r"^\d{4}$", "")  # the text stands here once, so it is worked out once


def canonical_label(c: str | Column) -> Column:
    """The form by which labels are compared: letters and digits, lower-case, single blanks."""
    text = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), AXES, clean_label(c))
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def compact_number(c: str | Column) -> Column:
    """A number as printed, without blanks, degree and star signs and a leading plus-minus; dashes of any kind are hyphens."""
    bare = F.regexp_replace(F.translate(F.coalesce(_col(c), F.lit("")), "–—−", "---"), r"[\s°*]", "")
    return F.lower(F.regexp_replace(bare, "^±", ""))


def unparsed(text: str, number: str, time: bool = False) -> Column:
    """Whether a cell holds something that is neither a number (``number`` is missing too) nor one of the marks for none."""
    raw, token = F.lower(collapse(F.coalesce(F.col(text), F.lit("")))), compact_number(text)
    shape = r"^\d+(\.\d+)?(-\d+(\.\d+)?)?$" if time else r"^-?\d+(\.\d+)?(-\d+(\.\d+)?)?$"
    none = token.isin("--") if time else token.isin("--", "n/a", "na")
    return (raw != "") & ~raw.isin("--", "n/a", "na") & F.col(number).isNull() & ~(none | token.rlike(shape))
