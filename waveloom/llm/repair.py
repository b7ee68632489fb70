"""Conversation structure repair: the cheapest edits that leave an optional system turn and then whole exchanges.

A conversation is sound if its roles' initials form ``(s?(ua)+)?``. ``repair`` finds the edits of least cost, and of those
the ASCII-least audit, by depth-first branch-and-bound: an explicit stack of prefixes, a lower bound on what the rows still
to come must cost, the incumbent (cost, audit), and for each node (rows consumed, what may follow) the best prefix that has
reached it, so that worse ones go. The search ends when the stack is empty: then the incumbent is optimal.

Rows without their texts are dealt by ranges of (conversation, turn, role, text digest), so a conversation of any length is
shared by many tasks. Each task cuts what it holds of a conversation into stretches of ``STRETCH`` rows and searches each from
every role that may come before it to every role that may end it; stretches are joined by cost and audit. Texts are shuffled
once, by conversation, and stream past the audit in order; nothing but the audit is held, however long a conversation is.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What a letter of the audit costs; a row that is cut off and stays costs CUT_OFF more.
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
CUT_OFF = 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = "^sua"
FINAL = START + ASSISTANT
#: The one role that an inserted or reroled turn can have in a state.
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {"su", "ua", "au"}
STRETCH = 24

#: Kinds of rows. Lower case: sound; upper case: cut off. s u a: by initial; o: another role; e: no role. x: must go.
MUST_GO = "x"

_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def initials_allow(state: str, initial: str) -> str | None:
    """The state after a turn with that initial, or None; a turn without a role leaves the state as it is."""
    if initial == "":
        return state
    if state == START and initial in "su":
        return initial
    return initial if state + initial in LEGAL else None


def suffix_bounds(rows: str) -> list[int]:
    """For each place, what the rows from there on cost at least, whatever came before.

    Each row costs its cheapest edit on its own. Besides, two sound rows next to each other (but for rows that may go) whose
    initials may not follow one another cost 1 more; pairs that share no row add up."""
    n = len(rows)
    alone, pairs, following = [0] * (n + 1), [0] * (n + 1), n
    for i in range(n - 1, -1, -1):
        kind = rows[i]
        alone[i] = alone[i + 1] + (COSTS["D"] if kind == MUST_GO or kind.isupper() else COSTS["R"] if kind == "o" else 0)
        pairs[i] = pairs[i + 1]
        if kind in "sua":
            if following < n and rows[following] != "o" and kind + rows[following] not in LEGAL:
                pairs[i] = max(pairs[i], 1 + pairs[following + 1])
            following = i
        elif kind == "o":
            following = i
    return [a + p for a, p in zip(alone, pairs, strict=True)]


def search(rows: str, entry: str, exits: str, count: list[int] | None = None) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``entry`` over ``rows`` to one of ``exits``, or None. ``count`` takes the number of prefixes expanded."""
    exits = "".join(e for e in exits if e in "ua" or e == entry or (e == SYSTEM and entry == START and ("s" in rows or "S" in rows)))
    if not exits:
        return None
    n, bounds, best = len(rows), suffix_bounds(rows), None
    reached: list[dict[str, tuple[int, str]]] = [{} for _ in range(n + 1)]
    reached[0][entry] = (0, "")
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if reached[at][state] < (cost, audit):
            continue
        if at == n and state in exits and (best is None or (cost, audit) < best):
            best = (cost, audit)
        steps = [(at, NEXT_ROLE[state][0], cost + COSTS["I"], audit + "I")]
        if at < n:
            kind = rows[at]
            steps.append((at + 1, state, cost + COSTS["D"], audit + "D"))
            if kind != MUST_GO:
                extra = CUT_OFF if kind.isupper() else 0
                kept = initials_allow(state, "" if kind in "eE" else kind.lower())
                if kept is not None:
                    steps.append((at + 1, kept, cost + extra + COSTS["K"], audit + "K"))
                steps.append((at + 1, NEXT_ROLE[state][0], cost + extra + COSTS["R"], audit + "R"))
        # The most promising prefix is pushed last and so taken first.
        for to, then, spent, letters in sorted(steps, key=lambda s: (s[2] + bounds[s[0]], s[3]), reverse=True):
            if best is not None and ((least := spent + bounds[to]) > best[0] or (least == best[0] and letters > best[1][: len(letters)])):
                continue
            before = reached[to].get(then)
            if before is not None and before <= (spent, letters):
                continue
            reached[to][then] = (spent, letters)
            stack.append((to, then, spent, letters))
        if count is not None:
            count[0] += 1
    return best


_cached = functools.lru_cache(1 << 15)(search)

Table = dict[str, dict[str, tuple[int, str]]]


def joined(left: Table, right: Table) -> Table:
    """The best way from each entry of ``left`` to each exit of ``right``."""
    out: Table = {}
    for entry, middles in left.items():
        for middle, (cost, audit) in middles.items():
            for end, (more, letters) in right.get(middle, {}).items():
                found = (cost + more, audit + letters)
                ends = out.setdefault(entry, {})
                if end not in ends or found < ends[end]:
                    ends[end] = found
    return out


def stretch_table(rows: str, entries: str, last: bool) -> Table:
    """The best way over ``rows`` from each of ``entries`` to each state, or, if they end a conversation, to its end."""
    ends = [FINAL] if last else list(START + SYSTEM + USER + ASSISTANT)
    out: Table = {}
    for entry in entries:
        found = {e[-1]: _cached(rows, entry, e) for e in ends}
        out[entry] = {e: f for e, f in found.items() if f is not None}
    return out


class _Chain:
    """Tables put together in order, neighbours of like length first, so that long audits are not copied for every stretch."""

    def __init__(self):
        self.tables: list[tuple[int, Table]] = []

    def add(self, table: Table) -> None:
        length = 1
        while self.tables and self.tables[-1][0] <= length:
            before, left = self.tables.pop()
            length, table = length + before, joined(left, table)
        self.tables.append((length, table))

    def whole(self) -> Table:
        return functools.reduce(lambda right, left: joined(left[1], right), reversed(self.tables[:-1]), self.tables[-1][1])


class _Part:
    """What one task holds of one conversation, in order."""

    def __init__(self, conv_id, whole_start: bool):
        self.conv_id = conv_id
        self.chain = _Chain()
        self.entries = START if whole_start else START + SYSTEM + USER + ASSISTANT
        self.rows: list[str] = []
        self.waiting = 0
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.low = None

    def add(self, turn, initial: str, kind: str, copies: int, seen: bool) -> None:
        """``copies`` equal rows; all but the first are duplicates, and the first too if ``seen`` says so."""
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
        self.last_turn = turn if turn is not None else self.last_turn
        if self.first_initial is None:
            self.first_initial = initial
        else:
            self.illegal += (self.last_initial + initial) not in LEGAL
        self.illegal += (copies - 1) * ((initial + initial) not in LEGAL)
        self.last_initial = initial
        if kind == MUST_GO:
            self.blank += copies
            self._push(MUST_GO, copies)
            return
        if seen:
            self.duplicate += copies
            self._push(MUST_GO, copies)
            return
        self.duplicate += copies - 1
        self.truncated += kind.isupper()
        self._push(kind, 1)
        self._push(MUST_GO, copies - 1)

    def _push(self, kind: str, copies: int) -> None:
        while copies:
            now = min(copies, STRETCH - self.waiting)
            self.rows.append(kind * now)
            self.waiting += now
            copies -= now
            if self.waiting == STRETCH:
                self._settle(False)

    def _settle(self, last: bool) -> None:
        entries = START + SYSTEM + USER + ASSISTANT if self.chain.tables else self.entries
        self.chain.add(stretch_table("".join(self.rows), entries, last))
        self.rows, self.waiting = [], 0

    def told(self, whole_end: bool) -> str:
        if self.waiting:
            self._settle(whole_end)
        return json.dumps([self.chain.whole(), self.turns, self.low, self.last_turn, self.blank, self.duplicate, self.truncated, self.illegal, self.first_initial, self.last_initial])


class _Whole:
    """The parts of a conversation put together, in order."""

    def __init__(self):
        self.chain = _Chain()
        self.chain.add({START: {START: (0, "")}})
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.initial = None

    def add(self, told: str) -> None:
        table, turns, low, high, blank, duplicate, truncated, illegal, first, last = json.loads(told)
        self.chain.add({a: {b: (c[0], c[1]) for b, c in t.items()} for a, t in table.items()})
        self.turns += turns - (self.high is not None and low == self.high)
        self.low = low if self.low is None else self.low
        self.high = high if high is not None else self.high
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.initial is not None and (self.initial + first) not in LEGAL)
        self.initial = last

    def facts(self) -> tuple:
        cost, audit = min(found for end, found in self.chain.whole()[START].items() if end in FINAL)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _slim(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, kind) of each row, without its text."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    sound = F.when(initial == "", "e").when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(last == "", MUST_GO).when(last.isin(".", "!", "?"), sound).otherwise(F.upper(sound))
    return rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), kind.alias("kind"))


def _parts(rows: DataFrame) -> DataFrame:
    """(conv_id, part, told): what each range of rows says about each conversation in it."""
    key = ["conv_id", "turn", "role", "digest"]
    equal = _slim(rows).groupBy(*key, "kind").agg(F.count("*").alias("copies"))
    first = equal.groupBy(*(F.col(c).alias(f"{c}_") for c in ("conv_id", "role", "digest"))).agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn_"))).alias("first"))
    said = equal.join(first, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")))
    said = said.select(*key, F.substring("role", 1, 1).alias("initial"), "kind", "copies", (~F.col("turn").eqNullSafe(F.col("first.turn_"))).alias("seen"))
    ranged = said.repartitionByRange(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, first_part, found = TaskContext.get().partitionId(), None, True, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], conv_type), pa.array([number] * len(found), pa.int32()), pa.array([f[1] for f in found], pa.string())], ["conv_id", "part", "told"])

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "kind", "copies", "seen")]
            for conv_id, turn, initial, kind, copies, seen in zip(*columns, strict=True):
                if part is None or part.conv_id != conv_id:
                    if part is not None:
                        found.append((part.conv_id, part.told(whole_end=True)))
                        first_part = False
                    # Only the first conversation of a range may have begun in an earlier one, and only the last may go on.
                    part = _Part(conv_id, whole_start=not first_part)
                part.add(turn, initial, kind, copies, seen)
            if len(found) > 2000:
                yield packed()
                found = []
        if part is not None:
            found.append((part.conv_id, part.told(whole_end=False)))
            yield packed()

    return ranged.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, told string")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The edits of each conversation of ``rows`` (conv_id, turn, role, text), in order: (conv_id, step, edit, role, text) and,
    on a closing row whose ``edit`` is null, (gaps, blank, duplicate, truncated, illegal, cost, audit).

    ``edit`` is K, R, D or I; ``role`` and ``text`` are those of the repaired turn, or of the row that went. Conversations of
    ``conversations`` (conv_id) without rows have a closing row only. Rows of a conversation lie together and in order in
    one partition, so that what follows can read them as a stream.

    Rows go by turn, nulls first, then by role and the digest of their text: rows of one turn that differ have a fixed order,
    equal rows are interchangeable. A null role or text counts as one space. A null conv_id is a conversation of its own. A
    role without characters has no initial and may stay anywhere. Empty tables give no rows; other columns are ignored."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ids = rows.select("conv_id") if conversations is None else conversations.select("conv_id")
    no = {c: F.lit(None).cast(t) for c, t in (("part", "int"), ("told", "string"), ("turn", rows.schema["turn"].dataType), ("role", "string"), ("digest", "string"), ("text", "string"))}
    order = ["conv_id", "turn", "role", "digest"]

    def as_stream(df: DataFrame, kind: int) -> DataFrame:
        return df.select("conv_id", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else no[c].alias(c) for c in no))

    texts = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    stream = as_stream(_parts(rows), 0).unionByName(as_stream(ids.distinct(), 0)).unionByName(as_stream(texts, 1))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", *order[1:])
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, step long, edit string, role string, text string, {_FACTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, whole, audit, at, state, facts = None, None, "", 0, START, ()
        open_ = False

        def put(edit, role, text):
            nonlocal at
            out.append((now, at, edit, role, text, *[None] * 7))
            at += 1

        def inserted():
            nonlocal state
            while audit[at : at + 1] == "I":
                state, role = NEXT_ROLE[state][0], NEXT_ROLE[state]
                put("I", role, "")

        def close():
            if facts == ():
                settle()
            inserted()
            out.append((now, at, None, None, None, *facts))

        def settle():
            nonlocal facts, audit
            facts = whole.facts()
            audit = facts[-1]

        types = None
        for whole_batch in batches:
            for batch in common.text_slices([whole_batch]):
                types = batch.schema.field("conv_id").type
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "told", "role", "text")]
                for conv_id, kind, told, role, text in zip(*columns, strict=True):
                    if not open_ or conv_id != now:
                        if open_:
                            close()
                        now, whole, audit, at, state, facts, open_ = conv_id, _Whole(), "", 0, START, (), True
                    if kind == 0:
                        if told is not None:
                            whole.add(told)
                        continue
                    if facts == ():
                        settle()
                    inserted()
                    letter = audit[at]
                    if letter == "R":
                        state, role = NEXT_ROLE[state][0], NEXT_ROLE[state]
                    elif letter == "K":
                        state = initials_allow(state, role[:1])
                    put(letter, role, text)
                if out:
                    yield _arrow(out, types)
                    out = []
        if open_:
            close()
            yield _arrow(out, types)

    return stream.mapInArrow(run, schema)


def _arrow(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "step", "edit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repaired(edits: DataFrame) -> DataFrame:
    """(conv_id, step, role, text): the turns that ``repair`` leaves."""
    return edits.filter(F.col("edit").isin("K", "R", "I")).select("conv_id", "step", "role", "text")


def reports(edits: DataFrame) -> DataFrame:
    """One row a conversation: its faults, what its repair costs, and the audit."""
    return edits.filter(F.col("edit").isNull()).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(edits: DataFrame) -> DataFrame:
    """``reports`` with the SHA-256 of each repaired conversation, ``role:text`` a turn, joined by line ends; read off the stream of ``repair``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, first = hashlib.sha256(), True
        for batch in batches:
            closing, found = [], []
            for i, (edit, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("edit", "role", "text")), strict=True)):
                if edit is None:
                    closing.append(i)
                    found.append(hashed.hexdigest())
                    hashed, first = hashlib.sha256(), True
                elif edit != "D":
                    hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if closing:
                kept = batch.take(pa.array(closing))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in names] + [pa.array(found)], [*names, "repaired_sha256"])

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return edits.mapInArrow(run, f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {_FACTS}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with every twentieth each dropped, emptied, bared of its full stops, repeated, or made a user's, by the CRC-32 of ``conv_id:turn``.

    A null in any of the columns counts as one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    found = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
    return found.drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digests(repair(damaged(rows), rows))


ORACLE_SQL = r"""
WITH RECURSIVE
bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
         UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes FROM conversations),
crc AS (SELECT conv_id, turn, role, text,
               xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS kind FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS before,
                rtrim(text, E' \t\n\x0b\f\r') AS bare FROM dam),
rows_ AS (SELECT conv_id, turn, i, role, text, role[1] AS c, before,
                 CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM rows_ GROUP BY conv_id),
-- One state a letter: the least (cost, audit, repaired) after i rows; inserted turns are put in before the next row.
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 'r': ''} AS z, {'c': 1000000000, 'a': '', 'r': ''} AS s, {'c': 1000000000, 'a': '', 'r': ''} AS u, {'c': 1000000000, 'a': '', 'r': ''} AS a FROM stats
  UNION ALL
  SELECT q.conv_id, x.i,
    {'c': z.c + 2, 'a': z.a || 'D', 'r': z.r},
    list_min([{'c': s.c + 2, 'a': s.a || 'D', 'r': s.r}, CASE WHEN x.c = 's' AND ok THEN {'c': z.c + more, 'a': z.a || 'K', 'r': z.r || E'\n' || x.role || ':' || x.text} END]),
    list_min([{'c': u1.c + 2, 'a': u1.a || 'D', 'r': u1.r}, CASE WHEN ok THEN list_min([
       {'c': f.c + more + CASE WHEN x.c = 'u' THEN 0 ELSE 1 END, 'a': f.a || CASE WHEN x.c = 'u' THEN 'K' ELSE 'R' END, 'r': f.r || E'\n' || CASE WHEN x.c = 'u' THEN x.role ELSE 'user' END || ':' || x.text}]) END]),
    list_min([{'c': a1.c + 2, 'a': a1.a || 'D', 'r': a1.r}, CASE WHEN ok THEN
       {'c': u1.c + more + CASE WHEN x.c = 'a' THEN 0 ELSE 1 END, 'a': u1.a || CASE WHEN x.c = 'a' THEN 'K' ELSE 'R' END, 'r': u1.r || E'\n' || CASE WHEN x.c = 'a' THEN x.role ELSE 'assistant' END || ':' || x.text} END])
  FROM (SELECT p.*, list_min([z, s, a1]) AS f FROM (
          SELECT o.*, list_min([a, {'c': u1.c + 5, 'a': u1.a || 'I', 'r': u1.r || E'\nassistant:'}]) AS a1 FROM (
            SELECT w.*, list_min([u] || list_transform([z, s, a], lambda v: {'c': v.c + 5, 'a': v.a || 'I', 'r': v.r || E'\nuser:'})) AS u1 FROM walk w) o) p) q
  JOIN (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS more FROM rows_) x ON x.conv_id IS NOT DISTINCT FROM q.conv_id AND x.i = q.i + 1),
ends AS (SELECT w.conv_id, list_min([z, a, {'c': u.c + 5, 'a': u.a || 'I', 'r': u.r || E'\nassistant:'}] || list_transform([s], lambda v: {'c': v.c + 10, 'a': v.a || 'II', 'r': v.r || E'\nuser:\nassistant:'})) AS e
         FROM walk w JOIN stats t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(e.c AS BIGINT), 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN stats t ON t.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM g.conv_id
"""
