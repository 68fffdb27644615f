"""Nearest names of a block against brute force, and that no block's pairs are all made."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from support import SF

from tidemark.operators import nearest
from tidemark.operators.matching import best_per_entity, ladder
from tidemark.plans import catalog


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        own = [i]
        for j, y in enumerate(b, 1):
            own.append(min(last[j] + 1, own[-1] + 1, last[j - 1] + (x != y)))
        last = own
    return last[-1]


def similar(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0


def edited(r, bases, letters):
    s = list(r.choice(bases))
    for _ in range(r.randrange(5)):
        i = r.randrange(len(s) + 1)
        s[i : i + r.randrange(2)] = r.choices(letters, k=r.randrange(2))
    return "".join(s)


@pytest.mark.parametrize("least", [0.95, 0.9, 0.8, 0.6])
@pytest.mark.parametrize("size", [2, 3, 12, 20, 30, 60])
def test_close_pairs(least, size):
    """The nearest ones of each name are told, whatever the lengths, letters and common ends."""
    r = random.Random(size)
    for letters in ("ab", "0123456789", "aé漢😀"):
        for head, tail in (("", ""), ("FIRM ", " LTD")):
            bases = ["".join(r.choices(letters, k=r.randrange(max(0, size - 3), size + 1))) for _ in range(4)]
            a, b = (sorted({head + edited(r, bases, letters) + tail for _ in range(n)}) for n in (20, 25))
            told = {(int(i), int(j)) for p, q in nearest.close_pairs(a, b, least) for i, j in zip(p, q, strict=True)}
            for i, x in enumerate(a):
                scores = [similar(x, y) for y in b]
                if max(scores) >= least:
                    assert {(i, j) for j, s in enumerate(scores) if s == max(scores)} <= told


def test_few_pairs_of_a_large_block():
    r = random.Random(4)
    others = [f"Supplier#{i:09d}" for i in r.sample(range(900_000), 9000)]
    names = [f"Supplier#{i:09d}" for i in r.sample(range(60_000), 2000)]
    told = {(int(i), int(j)) for p, q in nearest.close_pairs(names, others, 0.9) for i, j in zip(p, q, strict=True)}
    assert {names[i] for i, _ in told} >= set(names) & set(others)
    assert 0 < len(told) < 2 * len(names) and all(distance(names[i], others[j]) <= 1 for i, j in told)


@pytest.mark.parametrize("name", ["er5_ladder", "er7_best_per_entity", "er11_coverage", "j22_block_join"])
def test_no_join_compares_names(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan and not re.search("Join .*levenshtein", plan)


def test_ladder_over_cells(spark, monkeypatch):
    """A block dealt over many cells; entities that share a name; the smallest of equally near ones wins."""
    monkeypatch.setattr(nearest, "CELL", 7)
    r = random.Random(5)
    ref = [(i, f"ACME {r.randrange(30_000)} {r.choice(('STEELWORKS', 'BAKERY'))}", r.choice(("AB1", "CD2", None))) for i in range(300)]
    ref += [(1000 + i, ref[i][1], ref[i][2]) for i in range(40)] + [(5000, None, "AB1")]
    rows = [(i, None, like[1][: -1 - i % 2] + r.choice(("", "X", "Z")), like[2] if i % 9 else "ZZ9") for i, like in enumerate(r.choices(ref[:300], k=120))]
    got = ladder(spark.createDataFrame(rows, "id int, number long, nm string, pc string"), spark.createDataFrame(ref, "cn long, nm string, pc string"))
    got = {x["id"]: (x["cn"], x["confidence"]) for x in got.collect() if x["method"] in ("fuzzy", "none")}
    names = {n for _, n, _ in ref}
    want = {}
    for i, _, name, pc in rows:
        if name not in names:
            near = min(((-similar(name, n), c) for c, n, p in ref if n and p and p == pc), default=(0, None))
            want[i] = (near[1], round(-near[0] * 0.9, 6)) if -near[0] >= 0.9 else (None, None)
    assert got == want and len({c for c, _ in want.values()}) > 20


def test_distances():
    r = random.Random(6)
    for n in range(7):
        for m in range(7):
            for most in range(4):
                x, y = (np.array([r.choices(range(2), k=k) for _ in range(12)], np.uint32).reshape(12, k) for k in (n, m))
                assert list(nearest.distances(x, y, most)) == [min(most + 1, distance(list(a), list(b))) for a, b in zip(x, y, strict=True)]


def test_a_cell_tells_the_best_only():
    r = random.Random(7)
    others = sorted({f"FIRM {r.randrange(1000)} FURNITURE WORKS" for _ in range(150)})
    names = [f"FIRM {i} FURNITURE WORKSX" for i in range(100, 140)] + ["ELSE"]
    rows = [["AB", 0, 0, False, n, None] for n in names] + [["AB", 0, 0, True, n, -i] for i, n in enumerate(others)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("b", "i", "j", "side", "name", "r_cn"), x, strict=True)) for x in rows], pa.schema([("b", "string"), ("i", "int64"), ("j", "int64"), ("side", "bool"), ("name", "string"), ("r_cn", "int64")]))
    for every in (False, True):
        got = {x["nm"]: (x["r_cn"], x["edits"]) for part in nearest._cells([batch], ["b"], 0.9, every) for x in part.to_pylist()}
        told = sum(len(part) for part in nearest._cells([batch], ["b"], 0.9, every))
        want = {}
        for n in names:
            score, cn, d = min((-similar(n, o), -i, distance(n, o)) for i, o in enumerate(others))
            want[n] = (cn, d) if -score >= 0.9 else (None, None)
        assert len(want) == 41 and 3 < sum(c is not None for c, _ in want.values()) < 41
        assert told == len(got) and got == {n: w for n, w in want.items() if every or w[0] is not None}


def test_rows_of_the_ladder_are_looked_up_twice(spark):
    """By number, then by name and postcode; names nobody has are told from them without those look-ups."""
    plan = catalog.queries()["er11_coverage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, ") <= 4 and not re.search("Join .*(split_part|stringsplit)", plan)


def test_best_of_each_entity_after_one_row_for_alike_ones(spark):
    r = random.Random(8)
    rows = [(i, r.choice((None, 1, 2, 3)), r.choice((1.0, 0.95, 0.6))) for i in r.sample(range(1000), 200)] + [(1, 9, None)]
    got = best_per_entity(spark.createDataFrame(rows, "id int, cn long, confidence double"))
    best = {c: min((-(s or 0), i) for i, k, s in rows if k == c)[1] for c in (1, 2, 3, 9)}
    assert {x["cn"]: x["id"] for x in got.collect()} == best and got.columns == ["id", "cn", "confidence"]
    assert "Aggregate [" in got._jdf.queryExecution().optimizedPlan().toString()
