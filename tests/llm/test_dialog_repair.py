import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from spanlab.llm import dialog_repair as D

WORD = re.compile(r"[^\x20\x09-\x0D]")
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """Report of one conversation's rows by a table over suffixes that keeps audits as strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    counts = dict(blank=0, duplicate=0, truncated=0, illegal=0)
    facts, seen = [], set()
    for i, (_, role, text) in enumerate(rows):
        if not WORD.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = None if text.rstrip(" \t\n\r\x0b\x0c")[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        if i and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
            counts["illegal"] += 1
        facts.append((role, text, fault in ("blank", "duplicate"), 5 if fault == "truncated" else 0))

    def step(state, initial):
        return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(facts) and state in "0a" else []
        if inserts:
            for initial in "ua":
                if step(state, initial) and (tail := best(i, step(state, initial), inserts - 1)):
                    found.append((tail[0] + 5, "I" + tail[1], (NAME[initial] + ":",) + tail[2]))
        if i < len(facts):
            role, text, must_go, stay = facts[i]
            if tail := best(i + 1, state, 2):
                found.append((tail[0] + 2, "D" + tail[1], tail[2]))
            for edit, r in [("K", role), ("R", "user"), ("R", "assistant")]:
                if not must_go and step(state, r[:1]) and (tail := best(i + 1, step(state, r[:1]), 2)):
                    found.append((tail[0] + stay + (edit == "R"), edit + tail[1], (f"{r}:{text}",) + tail[2]))
        return min(found) if found else None

    for i in range(len(facts), 0, -1):  # from the end, so no call goes deep
        for state in "0sua":
            best(i, state, 2)
    cost, audit, lines = best(0, "0", 2)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return dict(gaps=gaps, **counts, cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_reports(rows, damaged=True):
    convs = {r[0]: [] for r in rows}
    for conv, *rest in damage(rows) if damaged else rows:
        convs[conv].append(tuple(rest))
    return {c: plain(r) for c, r in convs.items()}


def got(reports):
    rows = [r.asDict() for r in reports.collect()]
    out = {r.pop("conv_id"): r for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def noisy(seed, conversations, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?  ", "cut off", "", " \t\n", "a.b", "é🎉.", "x" * 70 + "1.", "x" * 70 + "2."]
    roles = ["user", "assistant", "system", "tool", "", "usher", "System"]
    out = []
    for c in range(conversations):
        turn = 0
        for _ in range(r.randint(0, longest)):
            turn += r.choice([0, 1, 1, 1, 1, 3])
            role = r.choice(roles) if r.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = r.choice(texts) if r.random() < 0.4 else f"Line {r.randint(0, 10**6)}."
            out.append((c, None if r.random() < 0.05 else turn, None if r.random() < 0.03 else role, None if r.random() < 0.03 else text))
    return out


def every_edit(facts):
    """Least (cost, audit) over all sequences of edits with at most two inserts in a row (tiny inputs)."""
    options = []
    for initial, must_go, stay in facts:
        rows = [("D", "", 2)]
        if not must_go:
            rows += [("K", initial, stay), ("R", "u", stay + 1), ("R", "a", stay + 1)]
        options.append(rows)
    inserts = [()] + [(("I", a, 5),) for a in "ua"] + [(("I", a, 5), ("I", b, 5)) for a in "ua" for b in "ua"]
    found = []
    for rows in itertools.product(*options):
        for extra in itertools.product(inserts, repeat=len(facts) + 1):
            path = [*extra[0], *itertools.chain.from_iterable((r, *e) for r, e in zip(rows, extra[1:]))]
            if all(initial for e, initial, _ in path if e != "D") and re.fullmatch("(s?(ua)+)?", "".join(p[1] for p in path)):
                found.append((sum(p[2] for p in path), "".join(p[0] for p in path)))
    return min(found)


def test_agenda_equals_every_edit_sequence():
    kinds = [("u", False, 0), ("a", False, 0), ("s", False, 0), ("t", False, 0), ("", False, 0), ("u", True, 0), ("a", False, 5), ("s", False, 5)]
    short = [f for n in range(3) for f in itertools.product(kinds, repeat=n)]
    longer = random.Random(1).sample(list(itertools.product(kinds, repeat=3)), 8)
    for facts in short + longer:
        final = D.lightest(list(facts), (D.NOTHING, D.ASSISTANT), True, D.NOTHING)
        audit = "".join(e for e, _, _ in D.edits(final, D.NOTHING))
        assert (final[0, D.NOTHING][0], audit) == every_edit(facts), facts


def test_items_pop_in_order():
    r = random.Random(5)
    rows = [(r.choice("uasx"), r.random() < 0.2, r.choice([0, 5])) for _ in range(60)]
    final = D.lightest(rows, (D.NOTHING, D.ASSISTANT), True)
    costs = [c for c, _, _ in final.values()]
    assert costs == sorted(costs) and len(final) == 4 * (len(rows) + 1)


@pytest.mark.parametrize("most", [1, 2, 7, 1024])
def test_reports_equal_plain_version(spark, most):
    rows = noisy(most, 40, 25)
    rows += [(None, None, None, None), (None, 1, "user", "Null id."), (10**12, None, "user", "Only null turns."), (10**12, None, "user", "Only null turns.")]
    reports, _ = D.repaired(D.damaged(frame(spark, rows)), with_turns=False, most=most)
    assert got(reports) == plain_reports(rows)


@pytest.mark.parametrize("most", [3, 1024])
def test_one_conversation_over_many_tasks(spark, most):
    rows = [(c if c is None else 7, t, role, text) for c, t, role, text in noisy(11, 30, 30)]
    rows += [(7, 500, "user", "Same.")] * 60
    reports, turns = D.repaired(frame(spark, rows, 8), most=most)
    expected = plain_reports([(c, t, ro if ro is not None else " ", x if x is not None else " ") for c, t, ro, x in rows], damaged=False)
    assert got(reports) == expected
    lines = [r for r in turns.orderBy("position").collect()]
    assert [r["position"] for r in lines] == list(range(len(lines)))
    text = "\n".join(f"{r['role']}:{r['text']}" for r in lines)
    assert hashlib.sha256(text.encode()).hexdigest() == expected[7]["repaired_sha256"]
    assert "".join(r["edit"] for r in lines) == expected[7]["audit"].replace("D", "")


def test_edge_tables(spark):
    empty, turns = D.repaired(frame(spark, [], 1))
    assert got(empty) == {} and turns.collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    clash = frame(spark, [(gone, 0, "user", "Hi.")]).selectExpr("*", "1 AS report", "2 AS key", "3 AS segment", "4 AS kind", "5 AS present")
    reports, _ = D.repaired(D.damaged(clash), with_turns=False)
    zero = dict(gaps=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit="", repaired_sha256=hashlib.sha256(b"").hexdigest())
    assert got(reports) == {gone: zero}


def test_very_long_text(spark):
    long = "word " * 2_000_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long), (2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    reports, _ = D.repaired(frame(spark, rows, 1), with_turns=False)
    assert got(reports) == plain_reports(rows, damaged=False)
