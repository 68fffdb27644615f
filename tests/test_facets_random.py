"""Random filter combinations against SQL written from the same request."""

import random

from pyspark.sql import functions as F
from support import SF

from tidemark.operators.facets import NOT_STATED, facet_counts, where
from tidemark.plans.expressions import filters
from tidemark.plans.registry import Tables
from tidemark.plans.standins import WIDE, wide

SECTORS = ["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE"]
BANDS = {"debt": "score < 0", "mid": "(score >= 0 AND score < 5000)", "high": "score >= 5000", NOT_STATED: "score IS NULL"}
STATES = {"yes": "flag IS TRUE", "no": "flag IS FALSE", NOT_STATED: "flag IS NULL"}


def draw(r):
    request, sql = {}, {}
    if r.random() < 0.5:
        v = r.sample(SECTORS, r.randint(1, 4))
        request["sector"], sql["sector"] = v, "sector IN (" + ", ".join(f"'{x}'" for x in v) + ")"
    if r.random() < 0.5:
        v = r.sample(sorted(STATES), r.randint(1, 2))
        request["flag"], sql["flag"] = v, " OR ".join(STATES[x] for x in v)
    if r.random() < 0.4:
        v = r.sample(["0", "1", "2", NOT_STATED], r.randint(1, 3))
        stated = [x for x in v if x != NOT_STATED]
        parts = [f"moves IN ({', '.join(stated)})"] * bool(stated) + ["moves IS NULL"] * (NOT_STATED in v)
        request["moves"], sql["moves"] = v, " OR ".join(parts)
    if r.random() < 0.4:
        v = r.sample(sorted(BANDS), r.randint(1, 3))
        request["band"], sql["band"] = v, " OR ".join(BANDS[x] for x in v)
    if r.random() < 0.4:
        lo, hi = r.choice([(0, None), (None, 7000), (1000, 900), (-500.5, 8000)])
        request["score"], sql["score"] = (lo, hi), " AND ".join([f"score >= {lo}"] * (lo is not None) + [f"score <= {hi}"] * (hi is not None))
    return request, sql


def test_random_filters(spark, tables):
    """All requests in one pass: each is a counted condition."""
    r, d = random.Random(11), wide(Tables(spark, SF)).cache()
    drawn = [draw(r) for _ in range(120)]
    got = d.agg(*[F.count_if(where(filters(), q)).alias(f"c{i}") for i, (q, _) in enumerate(drawn)]).first()
    conditions = [" AND ".join(f"({c})" for c in s.values()) or "TRUE" for _, s in drawn]
    want = tables.sql(f"WITH {WIDE} SELECT {', '.join(f'count(*) FILTER ({c})' for c in conditions)} FROM wide").fetchall()[0]
    assert list(got) == list(want)


def test_random_facets(spark, tables):
    r, d = random.Random(12), wide(Tables(spark, SF)).cache()
    for _ in range(8):
        request, sql = draw(r)
        got = {(x["facet"], x["option"]): x["n"] for x in facet_counts(d, filters(), request, {k: F.col(k) for k in ("sector", "flag", "moves")}).collect()}
        want = {}
        for k in ("sector", "flag", "moves"):
            others = " AND ".join(f"({c})" for f, c in sql.items() if f != k) or "TRUE"
            want |= {(k, o): n for o, n in tables.sql(f"WITH {WIDE} SELECT {k}::VARCHAR, count(*) FROM wide WHERE {others} GROUP BY 1").fetchall()}
        assert got == want
