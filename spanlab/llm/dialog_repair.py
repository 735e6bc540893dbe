"""Conversation structure repair by Knuth's lightest-derivation agenda (operator 11).

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Repair edits its
rows in turn order: Keep (0), Rerole to user or assistant (1), Delete (2, required for blank
and duplicate rows), Insert an empty user or assistant turn anywhere (5); a truncated row
that stays costs 5 more. Of the cheapest edits those count whose initials, in order, are
ASCII-least.

*Deductions.* An item (i, q) says that the rows from i on can be repaired when q precedes
them; q is one of four states (nothing yet, after system, after user, after assistant). A
deduction prepends one edit to an item's audit and adds its cost. Items are popped from an
agenda by (cost, rows covered, audit). Prepending is monotone in that order, and superior:
Keep costs nothing but covers a row more, Insert covers none but costs. So the first
derivation of an item to be popped is its lightest, and work ends when the goal is popped.
Audits are never compared as strings: derivations of equal cost and cover that begin with
the same edit have tails of equal cost and cover, and those were popped in audit order.

*Long conversations.* Rows are dealt by range of (conv_id, turn, ...), so one conversation
may lie in many tasks, and a task cuts it into segments of at most ``SEGMENT`` rows or
``SEGMENT_CHARS`` characters. A conversation that lies within one segment is finished there.
For the segments of the others, items (segment, q, q') are derived for all pairs of states,
repeats are found across segments by the rows' keys, and a fold over one small row per
segment joins the items end to end. Inserts stand before a row of their segment or at the
end of the conversation, so no audit of a segment is the beginning of another one and
comparing audits segment by segment is exact. What goes through one task for a conversation
however long: that fold, and the hash of the repaired text, which SHA-256 makes sequential;
both stream. An audit is one value of one row.

Defined results: nulls in conv_id, turn, role and text stand for one space where text is
made of them; a null conv_id is one conversation, null turns come first. Rows of one turn are
taken by role, then text (16 and 64 code points of them, then their SHA-256). A role without
an initial, or with one other than s, u and a, cannot be kept. A conversation none of whose
rows is present has zeros, an empty audit and the hash of the empty string. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlab.llm.common import table, written
from spanlab.session import ship_package

SEGMENT = 1024  # rows
SEGMENT_CHARS = 1 << 22

# Costs, role names, states and the legal pairs of neighbours.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLE = {"u": "user", "a": "assistant"}
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the user or assistant turn that may follow
BEFORE = {NOTHING: (), SYSTEM: (), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ARRIVAL = {USER: "u", ASSISTANT: "a"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL_PAIRS = {"su", "ua", "au"}
ENDING = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}  # turns to insert behind the last row

WORD = re.compile(r"[^\x20\x09-\x0D]")
BLANKS = " \t\n\r\x0b\x0c"

REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURN = "struct<edit:string,role:string,text:string>"
PIECE = "conv_id long, segment long, start long, turns array<" + TURN + ">"


# ---------------------------------------------------------------- deductions


def lightest(rows: list[tuple[str, bool, int]], exits: tuple[int, ...], ending: bool, goal: int | None = None) -> dict:
    """Lightest derivations of items over ``rows`` of (initial, must go, cost of staying).

    ``{(i, q): (cost, edit, next item)}``; axioms are the ends in a state of ``exits``,
    ``ending`` allows inserts there. Stops when the item (0, ``goal``) is final.
    """
    n = len(rows)
    final: dict = {}
    agenda = [(0, 0, "", q, n, q, None) for q in exits]
    while agenda:
        cost, covered, edit, _, at, state, tail = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        rank = len(final)
        final[at, state] = (cost, edit, tail)
        if at == 0 and state == goal:
            break
        here = (at, state)
        before = BEFORE[state]
        if at:
            initial, must_go, stay = rows[at - 1]
            heapq.heappush(agenda, (cost + DELETE, covered + 1, "D", rank, at - 1, state, here))
            if not must_go:
                if AFTER.get(initial) == state:
                    kept = (NOTHING,) if state == SYSTEM else before
                    for q in kept:
                        heapq.heappush(agenda, (cost + stay, covered + 1, "K", rank, at - 1, q, here))
                else:
                    for q in before:
                        heapq.heappush(agenda, (cost + stay + REROLE, covered + 1, "R", rank, at - 1, q, here))
        if at < n or ending:
            for q in before:
                heapq.heappush(agenda, (cost + INSERT, covered, "I", rank, at, q, here))
    return final


def edits(final: dict, entry: int) -> list[tuple[str, int, int]]:
    """(edit, row, state after it) along the derivation of the item (0, ``entry``)."""
    out, item = [], (0, entry)
    while final[item][2] is not None:
        _, edit, tail = final[item]
        out.append((edit, item[0], tail[1]))
        item = tail
    return out


def turns_of(path: list[tuple[str, int, int]], roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of each edit; a deletion's turn is the row that goes."""
    out = []
    for edit, row, state in path:
        if edit in "KD":
            out.append((edit, roles[row], texts[row]))
        else:
            out.append((edit, ROLE[ARRIVAL[state]], "" if edit == "I" else texts[row]))
    return out


def transcript(turns) -> str:
    """The repaired text: ``role:text`` lines of the turns that stay."""
    return "\n".join(f"{role}:{text}" for edit, role, text in turns if edit != "D")


class Rows:
    """Consecutive rows of one conversation, at most a segment."""

    def __init__(self, most: int = SEGMENT):
        self.roles, self.texts, self.keys, self.chars, self.most = [], [], [], 0, most
        self.n_turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turn: int | None, role: str, text: str, key: bytes) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.keys.append(key)
        self.chars += len(role) + len(text)
        if turn is not None:
            self.n_turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    @property
    def full(self) -> bool:
        return len(self.roles) >= self.most or self.chars >= SEGMENT_CHARS

    def judged(self, seen: set[bytes] = frozenset()) -> tuple[list[tuple[str, bool, int]], dict[str, int]]:
        """Rows for ``lightest`` and the number of each fault; ``seen`` holds keys of earlier rows."""
        return judged(self.roles, self.texts, self.keys, seen)


def judged(roles, texts, keys, seen=frozenset()):
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    rows, met, last = [], set(), None
    for role, text, key in zip(roles, texts, keys):
        initial = role[:1]
        fault = None
        if not WORD.search(text):
            fault = "blank"
        elif key in met or key in seen:
            fault = "duplicate"
        elif text.rstrip(BLANKS)[-1] not in ".!?":
            fault = "truncated"
        met.add(key)
        if fault:
            counts[fault] += 1
        counts["illegal"] += last is not None and last + initial not in LEGAL_PAIRS
        last = initial
        rows.append((initial, fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))
    return rows, counts


def finished(c: Rows) -> tuple[dict, list[tuple[str, str, str]]]:
    """Report and turns of a conversation that is one segment."""
    rows, counts = c.judged()
    final = lightest(rows, (NOTHING, ASSISTANT), True, NOTHING)
    turns = turns_of(edits(final, NOTHING), c.roles, c.texts)
    gaps = c.last_turn - c.first_turn + 1 - c.n_turns if c.n_turns else 0
    digest = hashlib.sha256(transcript(turns).encode()).hexdigest()
    return dict(gaps=gaps, **counts, cost=final[0, NOTHING][0], audit="".join(t[0] for t in turns), repaired_sha256=digest), turns


# ---------------------------------------------------------------- rows to segments

SEGMENTS = (
    "conv_id long, segment long, report struct<" + REPORT.replace(" ", ":").replace(",:", ",") + ">, turns array<" + TURN + ">, "
    "rows array<struct<role:string,text:string,key:binary>>, n_turns long, first_turn long, last_turn long"
)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in conversation order, dealt by range; equal rows may lie in several tasks."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    src = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        text("role").alias("role"), text("text").alias("text"), present.alias("present"),
    )
    key = F.unhex(F.sha2(F.concat(F.char_length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    keyed = src.select(
        "*", F.substring("role", 1, 16).alias("_role"), F.substring("text", 1, 64).alias("_text"),
        key.alias("key"), F.monotonically_increasing_id().alias("_row"),
    )
    by = ["conv_id", "turn", "_role", "_text", "key", "_row"]
    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", "key", "present")


def arrow_type(spark_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(spark_type))


def batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_struct_array(pa.array(rows, kind))


def segments(rows: DataFrame, with_turns: bool, most: int = SEGMENT) -> DataFrame:
    """``SEGMENTS``: a finished row for a conversation that lies inside one task and one
    segment, else its segments in order."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = ordered(rows)
    # the types are worked out on the driver, where a session is at hand
    kind = to_arrow_type(source.sparkSession.createDataFrame([], SEGMENTS).schema)

    def one(batches):
        base, number, out = TaskContext.get().partitionId() << 32, 0, []
        conv, current, first, cut = None, None, True, False

        def close(open_ended: bool) -> None:
            nonlocal number
            if open_ended or first or cut:
                packed = [dict(role=r, text=t, key=k) for r, t, k in zip(current.roles, current.texts, current.keys)]
                out.append(dict(conv_id=conv, segment=base + number, rows=packed, n_turns=current.n_turns, first_turn=current.first_turn, last_turn=current.last_turn))
            else:
                report, turns = finished(current)
                kept = [dict(edit=e, role=r, text=t) for e, r, t in turns] if with_turns else None
                out.append(dict(conv_id=conv, segment=base + number, report=report, turns=kept))
            number += 1

        for b in batches:
            for c, turn, role, text, key, present in zip(*(b.column(i).to_pylist() for i in range(6))):
                if current is None:
                    conv, current = c, Rows(most)
                elif c != conv:
                    close(False)
                    conv, current, first, cut = c, Rows(most), False, False
                elif present and current.full:
                    cut = True
                    close(True)
                    current = Rows(most)
                if present:
                    current.add(turn, role, text, key)
            if out:
                yield batch(out, kind)
                out = []
        if current is not None:
            close(True)  # the next task may go on with it
            yield batch(out, kind)

    return source.mapInArrow(one, SEGMENTS)


# ---------------------------------------------------------------- conversations of several segments

ITEMS = (
    "conv_id long, segment long, costs array<long>, ranks array<int>, outs array<int>, blank long, duplicate long, truncated long, "
    "illegal long, initials string, n_turns long, first_turn long, last_turn long"
)
ROUTE = "conv_id long, segment long, entry int, leave int, start long, ending string, report struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long>"


def with_repeats(parts: DataFrame) -> DataFrame:
    """Segments with ``again``: keys of their rows that an earlier segment of the conversation holds."""
    keys = parts.select("conv_id", "segment", F.explode(F.array_distinct("rows.key")).alias("key"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("segment"))
    again = keys.withColumn("nth", earlier).filter("nth > 1").groupBy("segment").agg(F.collect_list("key").alias("again"))
    return parts.join(again, "segment", "left")


def items(parts: DataFrame) -> DataFrame:
    """``ITEMS``: the lightest (segment, q, q') of every segment, as 16 costs, ranks of audits
    and numbers of turns that stay; a cost of -1 where there is none."""

    def one(batches):
        for b in batches:
            for r in b.to_pylist():
                cols = [[x[c] for x in r["rows"]] for c in ("role", "text", "key")]
                rows, counts = judged(*cols, set(r["again"] or ()))
                costs, audits = [-1] * STATES**2, [None] * STATES**2
                for leave in range(STATES):
                    final = lightest(rows, (leave,), False)
                    for entry in range(STATES):
                        if (0, entry) in final:
                            costs[entry * STATES + leave] = final[0, entry][0]
                            audits[entry * STATES + leave] = "".join(e for e, _, _ in edits(final, entry))
                order = {a: i for i, a in enumerate(sorted({a for a in audits if a is not None}))}
                ranks = [order.get(a, -1) for a in audits]
                outs = [len(a) - a.count("D") if a is not None else 0 for a in audits]
                ends = (cols[0][0][:1] or "-") + (cols[0][-1][:1] or "-") if rows else ""
                cells = [r["conv_id"], r["segment"], costs, ranks, outs, *counts.values(), ends, r["n_turns"], r["first_turn"], r["last_turn"]]
                names = [c.split()[0] for c in ITEMS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], names=names)

    long, small = pa.int64(), pa.int32()
    kinds = [long, long, pa.list_(long), pa.list_(small), pa.list_(small), long, long, long, long, pa.string(), long, long, long]
    return parts.select("conv_id", "segment", "rows", "again", "n_turns", "first_turn", "last_turn").mapInArrow(one, ITEMS)


def folded(conv: int | None, parts: list[dict]) -> list[dict]:
    """``ROUTE`` rows of one conversation: where each of its segments enters and leaves."""
    weight = {q: INSERT * len(ENDING[q]) for q in range(STATES)}
    choices = []
    for p in reversed(parts):
        best = {}
        for entry in range(STATES):
            found = [
                (p["costs"][entry * STATES + q] + weight[q], p["ranks"][entry * STATES + q], q)
                for q in weight
                if p["costs"][entry * STATES + q] >= 0
            ]
            if found:
                best[entry] = min(found)
        weight = {q: cost for q, (cost, _, _) in best.items()}
        choices.append({q: leave for q, (_, _, leave) in best.items()})
    report = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    turns, low, high, last = 0, None, None, ""
    for p in parts:
        if p["n_turns"]:
            turns += p["n_turns"] - (p["first_turn"] == high)
            low, high = p["first_turn"] if low is None else low, p["last_turn"]
        if p["initials"]:
            report["illegal"] += bool(last) and last + p["initials"][0] not in LEGAL_PAIRS
            last = p["initials"][1]
    report.update(gaps=high - low + 1 - turns if turns else 0, cost=weight[NOTHING])
    out, state, start = [], NOTHING, 0
    for p, choice in zip(parts, reversed(choices)):
        leave = choice[state]
        out.append(dict(conv_id=conv, segment=p["segment"], entry=state, leave=leave, start=start, ending=""))
        start += p["outs"][state * STATES + leave]
        state = leave
    out[0]["report"] = report
    out[-1]["ending"] = ENDING[state]
    return out


def groups(batches):
    """(conv_id, rows) of consecutive rows of one conv_id."""
    conv, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r["conv_id"] != conv:
                yield conv, rows
                rows = []
            conv = r["conv_id"]
            rows.append(r)
    if rows:
        yield conv, rows


def routes(parts: DataFrame) -> DataFrame:
    """``ROUTE`` of every segment: a fold over the conversation's items, from its end."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(parts.sparkSession.createDataFrame([], ROUTE).schema)

    def one(batches):
        for conv, rows in groups(batches):
            yield batch(folded(conv, rows), kind)

    dealt = items(parts).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(one, ROUTE)


def pieces(parts: DataFrame, route: DataFrame) -> DataFrame:
    """Repaired turns of every segment along its route, with ``report`` in a conversation's first."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = parts.sparkSession
    schema = PIECE + ", " + ROUTE.rsplit(", ", 1)[1]
    kind = to_arrow_type(spark.createDataFrame([], schema).schema)

    def one(batches):
        for b in batches:
            for r in b.to_pylist():
                cols = [[x[c] for x in r["rows"]] for c in ("role", "text", "key")]
                rows, _ = judged(*cols, set(r["again"] or ()))
                turns = turns_of(edits(lightest(rows, (r["leave"],), False, r["entry"]), r["entry"]), *cols[:2])
                turns += [("I", ROLE[c], "") for c in r["ending"]]
                packed = [dict(edit=e, role=o, text=t) for e, o, t in turns]
                yield batch([dict(conv_id=r["conv_id"], segment=r["segment"], start=r["start"], turns=packed, report=r["report"])], kind)

    joined = parts.join(route.drop("conv_id"), "segment")
    return joined.select("conv_id", "segment", "rows", "again", "entry", "leave", "start", "ending", "report").mapInArrow(one, schema)


def long_reports(long_pieces: DataFrame) -> DataFrame:
    """One row per conversation of several segments: the hash runs over its turns as they stream by."""
    columns = "conv_id long, " + REPORT
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def one(batches):
        def closed():
            cells = [conv, *(report[c] for c in names[1:7]), "".join(audit), digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], names=names)

        report = None
        for b in batches:
            for r in b.to_pylist():
                if r["report"] is not None:  # a conversation's first piece
                    if report is not None:
                        yield closed()
                    conv, report, audit, digest, begun = r["conv_id"], r["report"], [], hashlib.sha256(), False
                turns = [(t["edit"], t["role"], t["text"]) for t in r["turns"]]
                audit.append("".join(t[0] for t in turns))
                if any(t[0] != "D" for t in turns):
                    digest.update(("\n" if begun else "").encode() + transcript(turns).encode())
                    begun = True
        if report is not None:
            yield closed()

    dealt = long_pieces.select("conv_id", "segment", "turns", "report").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInArrow(one, columns)


# ---------------------------------------------------------------- the operator


def repaired(rows: DataFrame, with_turns: bool = True, most: int = SEGMENT) -> tuple[DataFrame, DataFrame | None]:
    """Repair every conversation of ``rows`` (conv_id, turn, role, text and optionally
    ``present``; a row that is not present only names its conversation).

    Returns ``(reports, turns)``: ``conv_id`` and ``REPORT`` per conversation, and the
    repaired conversations as rows (conv_id, position, edit, role, text), where edit is K, R
    or I (None without ``with_turns``). ``most`` is the number of rows of a segment.
    """
    spark = rows.sparkSession
    ship_package(spark)
    cut = written(segments(rows, with_turns, most), "dialog-segments")
    done = cut.filter("report is not null")
    parts = with_repeats(cut.filter("report is null").drop("report", "turns"))
    long_pieces = pieces(parts, written(routes(parts), "dialog-routes"))
    reports = done.select("conv_id", "report.*").unionByName(long_reports(long_pieces))
    if not with_turns:
        return reports, None
    every = done.select("conv_id", F.lit(0).cast("bigint").alias("start"), "turns").unionByName(long_pieces.select("conv_id", "start", "turns"))
    stay = F.filter("turns", lambda t: t["edit"] != "D")
    turns = every.select("conv_id", "start", F.posexplode(stay).alias("at", "t")).select("conv_id", (F.col("start") + F.col("at")).alias("position"), "t.*")
    return reports, turns


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(``conv_id:turn``) % 20; a dropped row is not present."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    words = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        conversations.select("conv_id", "turn", "role", "text", kind.alias("kind"))
        .withColumn("copy", F.explode(times))
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(text("role")).alias("role"),
            words.alias("text"), (F.col("kind") != 0).alias("present"),
        )
    )


def op11_dialog_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    reports, _ = repaired(damaged(table(spark, sf_dir, "conversations")), with_turns=False)
    return reports


# From each conversation's end one row a step: the lightest (cost, audit, text) of the four states,
# first with the row's own edits, then with up to two inserts before it.
_STEP = {q: ("u", USER) if q != USER else ("a", ASSISTANT) for q in range(STATES)}


def _own_edits(q: int) -> str:
    letter, to = _STEP[q]
    line = "chr(10) || {role} || ':' || r.text"
    found = [f"{{'c': w.v[{q + 1}].c + 2, 'a': 'D' || w.v[{q + 1}].a, 't': w.v[{q + 1}].t}}"]
    keeps = [("s", SYSTEM), (letter, to)] if q == NOTHING else [(letter, to)]
    stay = "NOT r.gone"
    for initial, k in keeps:
        item = f"{{'c': w.v[{k + 1}].c + r.stay, 'a': 'K' || w.v[{k + 1}].a, 't': {line.format(role='r.role')} || w.v[{k + 1}].t}}"
        found.append(f"CASE WHEN {stay} AND left(r.role, 1) = '{initial}' THEN {item} END")
    item = f"{{'c': w.v[{to + 1}].c + r.stay + 1, 'a': 'R' || w.v[{to + 1}].a, 't': {line.format(role=repr(ROLE[letter]))} || w.v[{to + 1}].t}}"
    found.append(f"CASE WHEN {stay} THEN {item} END")
    return f"list_min([{', '.join(found)}])"


def _inserts(name: str) -> str:
    cells = []
    for q in range(STATES):
        letter, to = _STEP[q]
        item = f"{{'c': {name}[{to + 1}].c + 5, 'a': 'I' || {name}[{to + 1}].a, 't': chr(10) || '{ROLE[letter]}:' || {name}[{to + 1}].t}}"
        cells.append(f"list_min([{name}[{q + 1}], {item}])")
    return f"[{', '.join(cells)}]"


ORACLE = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                        lambda c: CAST(ascii(c) AS BIGINT)) AS codes
  FROM conversations
), kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda c, b:
         list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z:
           CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), facts AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered
), rows_in AS (
  SELECT conv_id, turn, role, text, i, blank, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated,
         blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 5 ELSE 0 END AS stay,
         pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') AS illegal
  FROM facts
), report AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows_in GROUP BY conv_id
), walk AS (
  SELECT conv_id, n AS pos, [{{'c': 0, 'a': '', 't': ''}}, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}},
                       {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}}] AS v
  FROM report
  UNION ALL
  SELECT conv_id, pos - 1, {_inserts('once')} AS v FROM (
    SELECT conv_id, pos, {_inserts('own')} AS once FROM (
      SELECT w.conv_id, w.pos, [{', '.join(_own_edits(q) for q in range(STATES))}] AS own
      FROM walk w JOIN rows_in r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.pos = r.i))
)
SELECT c.conv_id, coalesce(p.gaps, 0) AS gaps, coalesce(p.blank, 0) AS blank, coalesce(p.duplicate, 0) AS duplicate,
       coalesce(p.truncated, 0) AS truncated, coalesce(p.illegal, 0) AS illegal, CAST(coalesce(w.v[1].c, 0) AS BIGINT) AS cost,
       coalesce(w.v[1].a, '') AS audit, sha256(substr(coalesce(w.v[1].t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN report p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
LEFT JOIN walk w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = 0
"""
