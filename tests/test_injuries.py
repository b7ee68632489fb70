"""Injury tables against a walk over the lines in plain Python."""

import random
import re

import pytest

from waveloom.operators import injuries

TOKEN = re.compile(r"[±+\-–−]?\d+(?:\.\d+)?(?:-[±+\-–−]?\d+(?:\.\d+)?)?°?\*{0,2}|--|n/?a", re.I)


def tidy(text):
    return re.sub(r"\s+", " ", re.sub(r"(\()\s+", r"\1", re.sub(r"\s+([,;:)\]])", r"\1", re.sub(r"\s+", " ", text)))).strip()


def plain(lines, title=""):
    found, heads, section, waiting = [], "", None, ""
    for raw in lines:
        line = tidy(raw or "")
        low = line.lower()
        if not line or line[0] == "*":
            continue
        if "all rights reserved" in low:
            break
        if low in ("upper tibia", "lower tibia", "foot"):
            section, waiting = low.title(), ""
        elif re.match("published|tolerance|threshold|measure|result|time|driver|passenger|left|right", low):
            heads += " " + low
        else:
            n, joins = len(TOKEN.findall(line)), low == "ij" or line[0] == "(" or line[0].islower()
            if n and not (joins and n <= 2 and not re.search(r"\s[±+\-–−]?\d", line)):
                found.append([section, tidy(f"{waiting} {line}")])
                waiting = ""
            elif found and joins:
                m = TOKEN.search(found[-1][1])
                at = m.start() if m else len(found[-1][1])
                found[-1][1] = tidy(f"{found[-1][1][:at]} {line} {found[-1][1][at:]}")
            else:
                waiting = tidy(f"{waiting} {line}")
    seats, sides, limit = "driver" in heads and "passenger" in heads, "left" in heads and "right" in heads, "threshold" in heads
    seat = "driver" if "driver" in title.lower() else "passenger" if "passenger" in title.lower() else None
    n, out = 8 if seats and sides else 4 if seats or sides else 2, []
    for section, text in found:
        m = list(TOKEN.finditer(text))
        for size in ([n + 1, n] if limit else [n]):
            if len(m) >= size:
                cells, at, rest = m[-size:], 0, []
                for c in cells:
                    rest.append(text[at : c.start()])
                    at = c.end()
                label = tidy(" ".join([*rest, text[at:]]))
                if label:
                    values = [c[0] for c in cells]
                    top = values.pop(0) if size > n else None
                    for i, s in enumerate(["driver", "passenger"] if seats else [seat]):
                        own = values[i * n // 2 : (i + 1) * n // 2] if seats else values
                        out.append((s, section if sides else s.title() if seats else section or (s and s.title()), label, top, *([None, None, *own] if sides else [*own, None, None, None, None])))
                    break
    return out


def number(text):
    if text is None or text.lower() in ("--", "n/a", "na"):
        return None
    bare = re.sub(r"[°*\s]", "", text).removeprefix("±")
    m = re.fullmatch(r"(-?\d+(?:\.\d+)?)-(-?\d+(?:\.\d+)?)", bare)
    return (float(m[1]) + float(m[2])) / 2 if m else float(bare)


def check(spark, tables):
    rows = [(k, title, i, line) for k, (title, lines) in enumerate(tables) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "page long, title string, line_no long, raw string").repartition(4)
    got = {}
    for r in injuries.injury_rows(df, ["page", "title"], "title").collect():
        got.setdefault(r.page, []).append(r)
    for k, (title, lines) in enumerate(tables):
        mine = sorted(got.get(k, []), key=lambda r: (r.record, r.seat_position or ""))
        cells = ["threshold", "result", "time", "left", "left_time", "right", "right_time"]
        assert [(r.seat_position, r.section, r.label, *(r[f"{c}_text"] for c in cells)) for r in mine] == plain(lines, title), (title, lines)
        for r in mine:
            assert [r[f"{c}_number"] for c in cells] == pytest.approx([number(r[f"{c}_text"]) for c in cells])
            assert r.unit == (m[1].strip() if (m := re.search(r"\(([^)]+)\)\s*$", r.label)) else None)


def test_forms(spark):
    check(spark, [
        ("Driver head", ["Measure Threshold Result Time (ms)", "HIC-15 700 220 88", "Peak gs at hard contact", "(g) 80 45.5 90", "resultant", "* a note 5 6", "Rotation (deg) n/a --", "All rights reserved", "Late 1 2 3"]),
        ("Legs", ["Measure Left Time Right Time", "Upper tibia", "Vector resultant moment (Nm) 120 -3.5 130 ±4", "ij", "Lost piece", "Lower tibia", "Axial force (kN) 1.5 2 3-5 4**", "Foot", "Acceleration", "of the foot (g) 10° 1 20 2"]),
        ("Both", ["Measure Threshold Driver Passenger", "Left Right", "Axial 4.0 1 2 3 4 5 6 7 8", "Shear 1 2 3 4 5 6 7 8", "few 1 2"]),
        ("Two seats", ["Driver Passenger Result Time", "Chest compression (mm) 20 30 25 35", "(sternum)", "Next", "one 1 2 3 4 5"]),
        ("Passenger", ["lower case first", "Then values 1 2", "and (15 ms) more", "still 7"]), ("", []), ("", [None, "", "  ", "1 2 3"]),
    ])


def test_random_tables(spark):
    r = random.Random(12)
    words = ["Force", "moment", "(kN)", "ij", "(15 ms)", "Upper tibia", "Foot", "Measure Left Right", "Threshold", "Driver Passenger", "Tension 1", "Peak 4.5 6", "Low 1 2 3 4", "Row 9 1 2 3 4 5 6 7 8", "of -2 n/a", "3 4", "", "* x 1", "rate (m/s) 5", "Max 2-4 ±3 --"]
    check(spark, [(r.choice(["", "Driver", "passenger side"]), [r.choice(words) for _ in range(r.randint(0, 14))]) for _ in range(150)])


def test_a_text_is_mended_once_where_it_is_needed(spark):
    """A line, a record's text, a piece that joins it, and the labels with and without a threshold: five places in the plan, none of them twice."""
    lines = spark.createDataFrame([(1, "Driver", 1, "HIC 12 34")], "page int, title string, line_no int, raw string")
    plan = injuries.injury_rows(lines, ["page", "title"], "title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("abdom\\s+en") <= 12, plan.count("abdom\\s+en")
