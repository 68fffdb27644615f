"""Temporal composites (TF) and the as-of joins (J7, J8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import award_features, handover, handover_checks, lender_features, near_event, primary, relationship_feeds, visible_rows
from ..operators.models import downsample
from ..operators.panel import Months, forward_labels, run_starts
from .registry import query
from .standins import AWARDS, CHARGES, HALVES, PANEL, QUARTERS, awards, charges, dates_sql, panel

END = 2001 * 12 + 8
W = "PARTITION BY cn ORDER BY m"
VISIBLE = "greatest(created, coalesce(delivered, created)) + 4"
OUT = "(satisfied IS NULL OR satisfied + 1 > d)"


@query("j7_as_of", f"WITH {CHARGES}, days(d) AS (VALUES {dates_sql(QUARTERS)}) SELECT cn, d AS as_of, count(DISTINCT charge) AS seen FROM days JOIN charges ON {VISIBLE} <= d GROUP BY 1, 2")
def j7(t):
    c = charges(t).withColumn("visible", F.date_add(F.greatest("created", F.coalesce("delivered", "created")), 4))
    one = c.groupBy("cn", "charge").agg(F.min("visible").alias("visible"))  # a charge is seen from its first row on
    return visible_rows(one, QUARTERS, F.col("visible")).groupBy("cn", "as_of").agg(F.count("*").alias("seen"))


@query("tf1_panel_by_universe", f"WITH {PANEL}, u AS (SELECT DISTINCT c_custkey AS cn FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) SELECT panel.cn, m, charges, status FROM panel JOIN u ON u.cn = panel.cn")
def tf1(t):
    u = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("cn"))
    return panel(t).join(u, "cn", "left_semi").select("cn", "m", "charges", "status")


AWARD_SQL = f"""{AWARDS}, award_days(e) AS (VALUES {{days}}),
award_sums AS (SELECT cn, e AS as_of, count(DISTINCT CASE WHEN published > y1 THEN contract END) AS won_12m, sum(CASE WHEN published > y1 THEN value::DECIMAL(18,2) END)::DOUBLE AS v, count(CASE WHEN published > y1 AND value IS NOT NULL THEN 1 END) AS valued_12m,
    count(DISTINCT CASE WHEN published > y2 AND published <= y1 THEN contract END) AS prev, max(published) AS last, min(published) AS first, any_value(y1) AS y1
  FROM (SELECT *, (e - INTERVAL 12 MONTH)::DATE AS y1, (e - INTERVAL 24 MONTH)::DATE AS y2 FROM award_days) JOIN awards ON published <= e GROUP BY 1, 2),
award_rows AS (SELECT cn, as_of, won_12m, coalesce(v, 0.0) AS value_12m, valued_12m::BIGINT AS valued_12m, datediff('month', last, as_of)::INTEGER AS months_since_award, won_12m - prev AS d_won_12m, TRUE AS ever_won, first > y1 AS first_in_12m FROM award_sums)"""


@query("tf3_award_features", f"WITH {AWARD_SQL.format(days=dates_sql(HALVES))} SELECT * FROM award_rows")
def tf3(t):
    """J8 and AG5: half-open windows at month ends."""
    return award_features(awards(t), HALVES)


LENDER_SQL = f"""{CHARGES}, lender_days(d) AS (VALUES {{days}}),
lender_j AS (SELECT *, {OUT} AS o, lender <> 'unclassified' AND NOT ours AS rival, {VISIBLE} AS v, satisfied + 1 AS g, (d - INTERVAL 12 MONTH)::DATE AS y, (d - INTERVAL 6 MONTH)::DATE AS h FROM lender_days JOIN charges ON {VISIBLE} <= d),
lender_a AS (SELECT cn, d, count(DISTINCT CASE WHEN o THEN charge END) AS n_open, count(DISTINCT CASE WHEN o AND ours THEN charge END) AS n_ours,
    count(DISTINCT CASE WHEN o AND lender <> 'unclassified' THEN lender END) AS n_lenders, count(DISTINCT CASE WHEN o AND rival THEN lender END) AS n_rivals, bool_or(ours) AS ever_ours,
    max(CASE WHEN ours THEN created END) AS oc, max(CASE WHEN ours AND g <= d THEN satisfied END) AS os,
    count(DISTINCT CASE WHEN v <= y AND (g IS NULL OR g > y) THEN charge END) AS t12, count(DISTINCT CASE WHEN v <= y AND (g IS NULL OR g > y) AND NOT ours THEN charge END) AS t12o,
    count(DISTINCT CASE WHEN rival AND v > y THEN charge END) AS r12, count(DISTINCT CASE WHEN rival AND v > h THEN charge END) AS r6, count(DISTINCT CASE WHEN ours AND g <= d AND g > h THEN charge END) AS s6
  FROM lender_j GROUP BY 1, 2),
lender_p AS (SELECT cn, d, lender FROM (SELECT cn, d, lender, row_number() OVER (PARTITION BY cn, d ORDER BY count(DISTINCT charge) DESC, max(created) DESC, lender) AS rn FROM lender_j WHERE o AND lender <> 'unclassified' GROUP BY 1, 2, 3) WHERE rn = 1),
lenders AS (SELECT a.cn, a.d AS as_of, n_open, n_ours, n_ours > 0 AS is_ours, CASE WHEN n_open > 0 THEN n_ours::DOUBLE / n_open END AS share_ours, n_lenders, n_rivals, datediff('month', oc, a.d)::INTEGER AS months_since_ours, datediff('month', os, a.d)::INTEGER AS months_since_ours_gone,
  t12 > 0 AND t12o = 0 AND r12 > 0 AS rival_entered_12m, s6 > 0 AS ours_gone_6m, r6 > 0 AS rival_created_6m, ever_ours, p.lender AS main_lender
FROM lender_a a LEFT JOIN lender_p p ON p.cn = a.cn AND p.d = a.d)"""


@query("tf4_lender_features", f"WITH {LENDER_SQL.format(days=dates_sql(QUARTERS))} SELECT * FROM lenders")
def tf4(t):
    """AG4 and AG7: distinct charges without a distinct explosion, the main lender by a total order."""
    return lender_features(charges(t), QUARTERS)


def ahead(agg: str, n: int) -> str:
    return f"{agg} OVER ({W} RANGE BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


LABELS = f"""SELECT cn, m, CASE WHEN m + 3 <= {END} AND {ahead('count(charges)', 3)} > 0 THEN ({ahead('max(charges)', 3)} > charges)::INT END AS y_lending,
  CASE WHEN m + 6 <= {END} AND {ahead('count(*)', 6)} > 0 THEN {ahead("max(CASE WHEN status = 'F' THEN 1 ELSE 0 END)", 6)} END::INT AS y_insolvency,
  CASE WHEN m + 6 <= {END} AND {ahead('count(*)', 6)} > 0 THEN {ahead("max(CASE WHEN status = 'P' THEN 1 ELSE 0 END)", 6)} END::INT AS y_exit,
  CASE WHEN m + 12 <= {END} AND {ahead('count(*)', 12)} > 0 AND tier IS NOT NULL AND {ahead('max(tier)', 12)} IS NOT NULL THEN ({ahead('max(tier)', 12)} > tier)::INT END AS y_growth,
  CASE WHEN m + 6 <= {END} AND {ahead('count(*)', 6)} > 0 AND tier IS NOT NULL AND {ahead('max(tier)', 6)} IS NOT NULL THEN ({ahead('max(tier)', 6)} > tier)::INT END AS y_growth_6m FROM panel"""


@query("tf5_forward_labels", f"WITH {PANEL} {LABELS}")
def tf5(t):
    return forward_labels(panel(t), END)


@query("tf6_switching", """WITH e AS (SELECT o_custkey AS cn, o_orderkey AS k, o_orderdate::DATE AS d, o_orderstatus AS s FROM orders)
SELECT a.cn, a.k, EXISTS (SELECT 1 FROM e b WHERE b.cn = a.cn AND b.s = 'O' AND b.d BETWEEN a.d - INTERVAL 3 MONTH AND a.d + INTERVAL 3 MONTH) AS switched FROM e a WHERE a.s = 'F'""")
def tf6(t):
    """An exit with a replacement within three months either way."""
    o = t.orders.select(F.col("o_custkey").alias("cn"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("s"))
    return o.withColumn("switched", near_event(o, "cn", "d", F.col("s") == "O", 3)).filter("s = 'F'").select("cn", "k", "switched")


@query("tf7_downsampling", f"""WITH {PANEL}, l AS ({LABELS}), r AS (SELECT m, CASE WHEN count(*) FILTER (y_lending = 0) > 0 THEN least(1.0, 3.0 * count(*) FILTER (y_lending = 1) / count(*) FILTER (y_lending = 0)) ELSE 1.0 END::DOUBLE AS keep_rate FROM l WHERE y_lending IS NOT NULL GROUP BY 1)
SELECT cn, l.m, y_lending AS y, keep_rate FROM l JOIN r ON r.m = l.m WHERE y_lending = 1 OR (y_lending = 0 AND ('0x' || md5(cn::VARCHAR || '|' || l.m::VARCHAR || '|y_lending')[1:8])::BIGINT / 4294967296.0 < keep_rate)""")
def tf7(t):
    """A sampling operator: negatives by origin, with the rate at which they were kept."""
    labels = forward_labels(panel(t), END).select("cn", "m", "y_lending")
    return downsample(labels, "y_lending", "m", ["cn", "m"], 3.0).select("cn", "m", F.col("y_lending").alias("y"), "keep_rate")


@query("tf8_split_with_embargo", f"WITH {PANEL}, o AS (SELECT DISTINCT m FROM panel WHERE m <= {END} - 6 AND m % 2 = 0), t AS (SELECT m FROM o ORDER BY m DESC LIMIT 2) SELECT m, CASE WHEN m IN (SELECT m FROM t) THEN 'test' WHEN m + 6 < (SELECT min(m) FROM t) THEN 'train' ELSE 'embargo' END AS part FROM o")
def tf8(t):
    from ..operators.models import origin_split

    origins = sorted(r[0] for r in panel(t).filter((F.col("m") <= END - 6) & (F.col("m") % 2 == 0)).select("m").distinct().collect())  # months only
    train, test = origin_split(origins, 6)
    part = F.when(F.col("m").isin(*test), "test").when(F.col("m").isin(*train), "train").otherwise("embargo")
    return t.spark.createDataFrame([(m,) for m in origins], "m int").select("m", part.alias("part"))


@query("tf9_expanding_folds", f"""WITH {PANEL}, o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, (count(*) OVER ()) // 4 AS size FROM (SELECT DISTINCT m FROM panel)), k AS (SELECT unnest([1, 2, 3])::INTEGER AS fold),
v AS (SELECT fold, m FROM o, k WHERE i >= fold * size AND i < (fold + 1) * size) SELECT fold, m, 'validate' AS part FROM v UNION ALL SELECT k.fold, o.m, 'train' FROM o, k WHERE o.m + 6 < (SELECT min(m) FROM v WHERE v.fold = k.fold)""")
def tf9(t):
    from ..operators.models import expanding_folds

    origins = sorted(r[0] for r in panel(t).select("m").distinct().collect())  # months only
    rows = [(k, m, part) for k, fold in enumerate(expanding_folds(origins, 6), 1) for part, months in zip(("train", "validate"), fold, strict=True) for m in months]
    return t.spark.createDataFrame(rows, "fold int, m int, part string")


@query("tf10_event_and_state", f"WITH {PANEL} SELECT a.m, count(b.cn) AS observed, count(*) FILTER (b.status = 'F') AS in_state FROM panel a LEFT JOIN panel b ON b.cn = a.cn AND b.m = a.m + 6 GROUP BY 1")
def tf10(t):
    w = Months()
    later = F.max("status").over(w.w.rangeBetween(6, 6))
    return panel(t).select("m", later.alias("s")).groupBy("m").agg(F.count("s").alias("observed"), F.count_if(F.col("s") == "F").alias("in_state"))


@query("tf11_margin_sweep", f"WITH {CHARGES}, g AS (SELECT least(greatest(datediff('day', created, delivered), -5), 10)::INTEGER AS lag, count(*) AS n FROM charges WHERE delivered IS NOT NULL GROUP BY 1) SELECT lag, n, (sum(n) OVER (ORDER BY lag DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS n_at_least FROM g")
def tf11(t):
    """A histogram once, then every margin from its running sum from above."""
    g = charges(t).filter(F.col("delivered").isNotNull()).select(F.least(F.greatest(F.datediff("delivered", "created"), F.lit(-5)), F.lit(10)).alias("lag")).groupBy("lag").agg(F.count("*").alias("n"))
    return g.withColumn("n_at_least", F.sum("n").over(Window.orderBy(F.desc("lag")).rowsBetween(Window.unboundedPreceding, 0)))  # 16 rows at most


SNAPS = f"""snaps AS (SELECT d, row_number() OVER (ORDER BY d) AS i, lag(d) OVER (ORDER BY d) AS before FROM (VALUES {dates_sql(QUARTERS)}) AS x(d)),
one AS (SELECT cn, charge, min(greatest(created, coalesce(delivered, created))) AS seen, max(satisfied) AS done FROM charges GROUP BY 1, 2),
bulk AS (SELECT cn, d, i, before, count(*) FILTER (seen + (charge % 25)::INTEGER <= d) AS n_created, count(*) FILTER (done + (charge % 9)::INTEGER <= d) AS n_satisfied FROM one, snaps GROUP BY 1, 2, 3, 4)"""


def appearance_sql(kind: str) -> str:
    day = "seen" if kind == "created" else "done"
    return f"""SELECT '{kind}' AS kind, datediff('day', k.day, b.d) AS hi, datediff('day', k.day, b.before) AS lo FROM
  (SELECT cn, {day} AS day, row_number() OVER (PARTITION BY cn ORDER BY {day}, charge) AS r FROM one WHERE {day} IS NOT NULL) k JOIN bulk b ON b.cn = k.cn AND b.n_{kind} >= k.r
  WHERE k.day > DATE '{QUARTERS[0]}' AND k.day < DATE '{QUARTERS[-1]}' - INTERVAL 1 MONTH AND NOT EXISTS (SELECT 1 FROM bulk e WHERE e.cn = k.cn AND e.n_{kind} >= k.r AND e.i < b.i) AND b.before IS NOT NULL"""


@query("tf12_first_appearance", f"""WITH {CHARGES}, {SNAPS}, f AS ({appearance_sql('created')} UNION ALL {appearance_sql('satisfied')})
SELECT kind, l::INTEGER AS lag, count(*) AS n, round(100.0 * count(*) FILTER (lo >= l) / count(*), 6) AS early, round(100.0 * count(*) FILTER (hi < l) / count(*), 6) AS stale FROM f, (SELECT unnest(range(31)) AS l) GROUP BY 1, 2""")
def tf12(t):
    """J20 and a grid of lags: the snapshot in which a charge's rank is first reached brackets its true delay; each lag of
    0 to 30 days is judged by the share it admits too early and holds back too long. Brackets are counted first, so the
    grid meets their counts, not the charges."""
    from ..operators.events import first_appearances, lag_grid

    c = charges(t).groupBy("cn", "charge").agg(F.min(F.greatest("created", F.coalesce("delivered", "created"))).alias("created"), F.max("satisfied").alias("satisfied"))
    out = None
    for kind, slow in (("created", 25), ("satisfied", 9)):
        shown = c.select("cn", F.date_add(kind, (F.col("charge") % slow).cast("int")).alias("shown"))
        part = lag_grid(first_appearances(c, shown, kind, "charge", QUARTERS)).select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.unionByName(part)
    return out


AT = QUARTERS[-3]


@query("tf13_reconciliation", f"""WITH {CHARGES}, a AS (SELECT cn, count(DISTINCT charge) FILTER ({VISIBLE} <= DATE '{AT}' AND (satisfied IS NULL OR satisfied + 1 > DATE '{AT}')) AS n FROM charges GROUP BY 1 HAVING min({VISIBLE}) <= DATE '{AT}'),
b AS (SELECT o_custkey AS cn, count(*) FILTER (o_orderstatus <> 'P') AS n FROM orders WHERE o_orderdate::DATE <= DATE '{AT}' GROUP BY 1)
SELECT count(*) AS companies, avg((a.n = b.n)::INT) AS exact_match, avg((abs(a.n - b.n) <= 1)::INT) AS within_one, avg((a.n > b.n)::INT) AS harvested_higher, avg((a.n < b.n)::INT) AS harvested_lower FROM a JOIN b USING (cn)""")
def tf13(t):
    """Open charges by replay of the harvested events against the count that the register states, company by company."""
    a = lender_features(charges(t), [AT]).select("cn", F.col("n_open").alias("n"))
    b = t.orders.filter(F.col("o_orderdate").cast("date") <= F.lit(AT)).groupBy(F.col("o_custkey").alias("cn")).agg(F.count_if(F.col("o_orderstatus") != "P").alias("stated"))
    share = lambda x: F.avg(x.cast("int"))
    n, m = F.col("n"), F.col("stated")
    return a.join(b, "cn").agg(F.count("*").alias("companies"), share(n == m).alias("exact_match"), share(F.abs(n - m) <= 1).alias("within_one"), share(n > m).alias("harvested_higher"), share(n < m).alias("harvested_lower"))


@query("tf14_blind_replay", "SELECT 0::BIGINT AS changed")
def tf14(t):
    """History cut at a date and rebuilt must give the same rows up to it."""
    from ..operators.compare import differences

    early = [d for d in QUARTERS if d.year <= 1998]
    c = charges(t)
    cut = c.filter(F.col("created") <= F.lit(early[-1]))
    # what is not known yet at the cut must not be used either
    cut = cut.withColumn("satisfied", F.when(F.date_add("satisfied", 1) <= F.lit(early[-1]), F.col("satisfied")))
    whole = lender_features(c, QUARTERS).filter(F.col("as_of") <= F.lit(early[-1]))
    return differences(whole, lender_features(cut, early)).agg(F.count("*").alias("changed"))


LENDERS = LENDER_SQL.format(days=dates_sql([AT]))
LIVE = f"""live AS (SELECT f.*, p.segment FROM lenders f JOIN (SELECT cn, segment FROM (SELECT *, row_number() OVER (PARTITION BY cn ORDER BY m DESC) AS rn FROM panel) WHERE rn = 1 AND status <> 'F') p ON p.cn = f.cn)"""


@query("tf15_four_feeds", f"""WITH {PANEL}, {LENDERS}, {LIVE}
SELECT 'client' AS feed, cn, segment, n_open, n_ours, n_rivals, share_ours, main_lender, months_since_ours_gone FROM live WHERE is_ours
UNION ALL SELECT 'just_switched', cn, segment, n_open, n_ours, n_rivals, share_ours, main_lender, months_since_ours_gone FROM live WHERE NOT is_ours AND ever_ours AND ours_gone_6m AND rival_created_6m
UNION ALL SELECT 'competitor_entered', cn, segment, n_open, n_ours, n_rivals, share_ours, main_lender, months_since_ours_gone FROM live WHERE is_ours AND rival_entered_12m
UNION ALL SELECT 'borrowing_elsewhere', cn, segment, n_open, n_ours, n_rivals, share_ours, main_lender, months_since_ours_gone FROM live WHERE NOT is_ours AND n_rivals > 0""")
def tf15(t):
    """ST1: the companies of four feeds, tagged by feed, from one pass over the live ones."""
    p = primary(panel(t), ["cn"], [F.desc("m")]).filter("status <> 'F'").select("cn", "segment")
    return relationship_feeds(lender_features(charges(t), [AT]).join(p, "cn")).select("feed", "cn", "segment", "n_open", "n_ours", "n_rivals", "share_ours", "main_lender", "months_since_ours_gone")


BASE = 1999 * 12 + 10
AWARDED = AWARD_SQL.format(days=dates_sql([HALVES[7]]))
WIDE_SQL = f"""{PANEL}, {AWARDED}, {LENDERS}, base AS (SELECT p.*, status <> 'F' AS is_active, charges - q.charges_12 AS d_charges_12m FROM panel p LEFT JOIN (SELECT cn, m + 12 AS m, charges AS charges_12 FROM panel) q USING (cn, m) WHERE p.m = {BASE}),
scores AS (SELECT cn, charges / 10.0::DOUBLE AS score_lending FROM base WHERE is_active),
w AS (SELECT b.cn, b.m, b.is_active, b.segment, b.d_charges_12m, coalesce(won_12m, 0) AS won_12m, coalesce(ever_won, FALSE) AS ever_won, months_since_award, coalesce(n_open, 0) AS n_open, coalesce(is_ours, FALSE) AS is_ours, coalesce(ever_ours, FALSE) AS ever_ours, months_since_ours, main_lender, score_lending
  FROM base b LEFT JOIN award_rows a ON a.cn = b.cn LEFT JOIN lenders l ON l.cn = b.cn LEFT JOIN scores s ON s.cn = b.cn)"""


def handover_table(t):
    b = panel(t)
    b = b.withColumns({"is_active": F.col("status") != "F", "d_charges_12m": F.col("charges") - Months().lag(F.col("charges"), 12)}).filter(F.col("m") == BASE)
    scores = b.filter("is_active").select("cn", (F.col("charges") / 10.0).alias("score_lending"))
    return b, handover(b.select("cn", "m", "is_active", "segment", "d_charges_12m"), award_features(awards(t), [HALVES[7]]).drop("as_of"), lender_features(charges(t), [AT]).drop("as_of"), scores)


WIDE_COLUMNS = ["cn", "m", "is_active", "segment", "d_charges_12m", "won_12m", "ever_won", "months_since_award", "n_open", "is_ours", "ever_ours", "months_since_ours", "main_lender", "score_lending"]


@query("tf16_handover", f"WITH {WIDE_SQL} SELECT * FROM w")
def tf16_rows(t):
    """J13: base rows with three sparse blocks; counts and flags of absent companies are 0 and false, months stay null."""
    return handover_table(t)[1].select(*WIDE_COLUMNS)


@query("tf16_wide_checks", f"""WITH {WIDE_SQL} SELECT count(*) AS n_rows, count(DISTINCT cn) AS distinct_keys, count(*) FILTER (cn IS NULL) AS null_keys, (SELECT count(*) FROM base) AS base_rows, count(*) FILTER (is_active) AS active, count(score_lending) AS scored,
  count(*) FILTER (is_active AND score_lending IS NULL) AS active_unscored, count(*) FILTER (NOT is_active AND score_lending IS NOT NULL) AS inactive_scored, count(*) FILTER (ever_won) AS has_award, count(*) FILTER (won_12m IS NULL) AS awards_null, count(*) FILTER (months_since_award IS NULL) AS never_won,
  count(*) FILTER (n_open > 0) AS has_open, count(*) FILTER (n_open IS NULL) AS open_null, count(*) FILTER (is_ours) AS ours, count(*) FILTER (ever_ours AND NOT is_ours) AS lapsed, count(*) FILTER (segment <> '5-LOW') AS in_sector, count(*) FILTER (segment <> '5-LOW' AND is_active) AS in_sector_trading,
  round(avg(CASE WHEN is_active THEN (d_charges_12m IS NOT NULL)::INT END), 6) AS alive_12m, min(m)::INTEGER AS first_month, max(m)::INTEGER AS last_month FROM w""")
def tf16(t):
    """Six checks of the wide table in one pass: keys, scores on exactly the active, filled counts, the universe by one
    predicate, live twelve-month features, one base month."""
    base, wide_rows = handover_table(t)
    return handover_checks(wide_rows, base, F.col("segment") != "5-LOW", "d_charges_12m")


GATED = [1995 * 12 + 6, 1997 * 12 + 1, 1999 * 12 + 11, 2001 * 12 + 6, 2001 * 12 + 7, 2001 * 12 + 8, 2002 * 12 + 1]


@query("tf17_watermark_gate", f"WITH {PANEL}, w AS (SELECT min(d) - 1 AS m FROM (SELECT status, max(m) AS d FROM panel GROUP BY 1)), o AS (SELECT unnest({GATED})::INTEGER AS origin) SELECT origin, w.m::INTEGER AS last_complete, origin > w.m AS refused FROM o, w")
def tf17(t):
    """Building on an origin past the last complete month is refused; the query says for which of some origins it is."""
    from ..operators.compare import GuardError, require_complete
    from ..operators.events import watermark

    p = panel(t)
    last = watermark(p, "status", "m").first()[0] - 1  # one row

    def refused(origin: int) -> bool:
        try:
            require_complete([origin], last)
        except GuardError:
            return True
        return False

    return t.spark.createDataFrame([(o, last, refused(o)) for o in GATED], "origin int, last_complete int, refused boolean")


@query("tf_run_lengths", f"WITH {PANEL}, b AS (SELECT *, lag(segment IGNORE NULLS) OVER ({W}) AS p FROM panel), g AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM segment THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS grp FROM b) SELECT segment, count(*) AS runs FROM (SELECT DISTINCT cn, grp, segment FROM g) GROUP BY 1")
def tf_runs(t):
    return run_starts(panel(t), ["segment"]).select("cn", "segment_since", "segment").distinct().groupBy("segment").agg(F.count("*").alias("runs"))


@query("j8_month_end_as_of", f"WITH {AWARDS}, days(e) AS (VALUES {dates_sql(HALVES)}) SELECT cn, e AS as_of, count(DISTINCT contract) AS contracts FROM days JOIN awards ON published <= e GROUP BY 1, 2")
def j8(t):
    first = awards(t).groupBy("cn", "contract").agg(F.min("published").alias("published"))  # seen from its first line on
    return visible_rows(first, HALVES, F.col("published")).groupBy("cn", "as_of").agg(F.count("*").alias("contracts"))
