import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import same
from waveloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, step long, edit string, digest string, `a.b` string"


def plain_best(rows, entry=repair.START):
    """The least (cost, audit) to every state, by dynamic programming."""
    def with_inserts(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                to = repair.NEXT_ROLE[s][0]
                best[to] = min(best.get(to, (c + 5, a + "I")), (c + 5, a + "I"))
        return best

    best = with_inserts({entry: (0, "")})
    for kind in rows:
        new = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 2, a + "D")]
            if kind != "x":
                c += 5 if kind.isupper() else 0
                kept = s if kind in "eE" else kind.lower() if s + kind.lower() in ("^s", "^u", "su", "ua", "au") else None
                ways += [(kept, c, a + "K")] if kept else []
                ways.append((repair.NEXT_ROLE[s][0], c + 1, a + "R"))
            for to, cost, audit in ways:
                new[to] = min(new.get(to, (cost, audit)), (cost, audit))
        best = with_inserts(new)
    return best


def test_search_proves_the_least():
    r = random.Random(5)
    for _ in range(300):
        rows = "".join(r.choice("suauauauaxxUAoeSE") for _ in range(r.randint(0, 14)))
        for entry in "^sua":
            best = plain_best(rows, entry)
            for end in "^sua":
                assert repair.search(rows, entry, end) == best.get(end), (rows, entry, end)
    rows = "".join(r.choice("uauauauaxxUAos") for _ in range(400))
    part = repair._Part(1, whole_start=True)
    for kind in rows:
        part._push(kind, 1)
    part._settle(True)
    best = plain_best(rows)
    assert min(part.chain.whole()["^"][e] for e in "^a" if e in part.chain.whole()["^"]) == min(best[e] for e in "^a")


def test_bounds_are_bounds():
    r = random.Random(6)
    for _ in range(200):
        rows = "".join(r.choice("suauaxUAoe") for _ in range(9))
        bounds = repair.suffix_bounds(rows)
        for i in range(10):
            assert all(bounds[i] <= min(c for c, _ in plain_best(rows[i:], e).values()) for e in "^sua")


def test_search_leaves_out_most_prefixes():
    count = [0]
    repair.search("suauxauAauuauauxauauaoua", repair.START, repair.FINAL, count)
    assert count[0] < 24 * 4 * 25


def plain(rows, ids):
    """(report, digest) of each conversation, in plain Python."""
    out = {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in ids}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if ro is None else ro, " " if x is None else x) for c, t, ro, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, kinds, seen = {"b": 0, "d": 0, "t": 0}, "", set()
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\f\r")
            sound = role[:1] if role[:1] in ("s", "u", "a") else "o" if role else "e"
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kinds += "x" if fault in ("b", "d") else sound.upper() if fault else sound
        cost, audit = min(v for s, v in plain_best(kinds).items() if s in "^a")
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        parts, left, state = [], iter(mine), "^"
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(left)[1:]
            if letter == "D":
                continue
            if letter in "IR":
                role = repair.NEXT_ROLE[state]
            state = role[:1] or state
            parts.append(f"{role}:{text}")
        out[conv] = (gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest())
    return out


def plain_damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        yield from [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["Yes.", "No!", "Why?", "so", " \t ", "", None, "Yes.", "é.\x1c", "long " * 9000 + "."]
    out = []
    for conv in [*range(40), None]:
        for turn in range(r.randint(1, 9)):
            out.append((conv, turn, r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(words)))
    out += [(90, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(500)]  # one conversation over many stretches and tasks
    out += [(91, None, "user", "Yes."), (91, None, "assistant", "No!"), (91, 3, "user", "Yes."), (91, 3, "user", "Yes."), (91, 9, "assistant", "so")] * 2
    out += [(92, 0, "user", "Same.")] * 300 + [(93, t, "assistant", "Same.") for t in range(0, 300, 2)] + [(94, t, "user", " ") for t in range(60)]
    out += [(95, t, "sua"[t % 3], f"{t}") for t in range(100)]
    return out


def test_query(spark, rows, tmp_path):
    full = [(*r, 1, "K", "d", None) for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain(list(plain_damage(rows)), {r[0] for r in rows})
    for partitions in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == "4")
        got = repair.op11_repair(spark, str(tmp_path)).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_outputs(spark, rows):
    df = spark.createDataFrame([(*r, 1, "K", "d", None) for r in rows], SCHEMA)
    edits = repair.repair(df)
    turns = {}
    for r in repair.repaired(edits).orderBy("conv_id", "step").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    want = plain([tuple(r[:4]) for r in rows], set())
    for conv, found in want.items():
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns.get(conv, [])).encode()).hexdigest() == found[-1]
    assert {r.conv_id: r.audit for r in repair.reports(edits).collect()} == {c: f[-2] for c, f in want.items()}
    assert repair.digests(repair.repair(df.limit(0))).count() == 0
    gone = repair.digests(repair.repair(df.limit(0), df.filter("conv_id = 90"))).collect()
    assert [tuple(r) for r in gone] == [(90, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sql(spark, sf_dir, duck):
    same(repair.op11_repair(spark, sf_dir).toPandas(), duck.sql(repair.ORACLE_SQL).df())
    assert repair.op11_repair(spark, sf_dir).agg(F.sum("cost")).first()[0] > 0
