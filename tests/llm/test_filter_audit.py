import itertools
import re
from collections import Counter

import numpy as np

from spanlab.llm import filter_audit as A


def plain(docs, labels):
    """Every document through every order, one step at a time."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, source, t in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if d is not None and least[t] < d:
            fails.add("E")
        rows.append((source or "", frozenset(fails), d in good, d in toxic))
    counts, out = Counter(rows), {}
    for part in {r[0] for r in rows}:
        mine = {k: n for k, n in counts.items() if k[0] == part}
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = dict(mine)
            for step, f in enumerate(order, 1):
                here = {k: n for k, n in left.items() if f in k[1]}
                left = {k: n for k, n in left.items() if f not in k[1]}
                removed = sum(here.values())
                shapley[f] += removed
                out[part, "".join(order), step] = [
                    sum(left.values()), removed, sum(n for k, n in mine.items() if f in k[1]) - removed,
                    sum(n for k, n in mine.items() if k[1] == {f}),
                    sum(n for k, n in here.items() if k[2]), sum(n for k, n in here.items() if k[3]),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def frames(spark, docs, labels, parts=3):
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, source string, text string, part int, mask int, good int")
    return d.repartition(parts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check(spark, docs, labels):
    rows = A.filter_audit(*frames(spark, docs, labels)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}
    assert len(got) == len(rows)
    assert got == plain(docs, labels)
    return got


def test_edge_rows(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, "a", None), (2, "a", ""), (3, "b", ""), (None, "b", ""), (None, None, ""),
        (4, None, prose), (4, "", prose), (5, "", prose), (5, "a", prose), (None, "a", prose), (3, "a", prose + "x"), (3, "b", prose + "x"),
        (6, "a", "same " * 80), (7, "c", "same " * 80), (8, "c", "LOUD " * 60), (9, "c", "é" * 10 + "$"), (10, "d", "a\x0bb\x1fc d " * 20),
        (11, "d", "|" * 200_000 + " x" * 200_000), (12, "only null twins", "twin"), (None, "n", "alone"), (None, "n", "alone"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (7, None, 1), (8, 0, 0), (99, 1, 1), (None, 1, 1), (9, 1, 1), (9, 1, 1)]
    got = check(spark, docs, labels)
    assert len(got) == 600 * len({s or "" for _, s, _ in docs})


def test_one_text_and_one_part_hold_most_rows(spark):
    docs = [(i if i % 3 else None, "hot" if i % 10 else "cold", "the same passage") for i in range(2000)]
    docs += [(i, "hot", f"text {i % 40}") for i in range(2000, 2400)]
    check(spark, docs, [(i, i % 2, int(i % 3 == 0)) for i in range(0, 2400, 7)])


def test_empty_tables(spark):
    assert A.filter_audit(*frames(spark, [], [(1, 1, 1)], 1)).collect() == []
    check(spark, [(1, "a", "x"), (2, "a", "x")], [])


def test_ranks_are_least_positions():
    orders, place = A.positions()
    assert len(orders) == 120 and orders[0] == "ABCDE"
    ranks = A.removal_ranks(np.arange(32), place)
    for m, o in itertools.product(range(32), range(120)):
        failing = [i for i, f in enumerate(orders[o]) if m >> A.LETTERS.index(f) & 1]
        assert ranks[m, o] == min(failing, default=5)
