"""Window queries (WN) and the delta panel (TF2), the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import primary
from ..operators.events import notice_features
from ..operators.metrics import mean_rank_auc
from ..operators.panel import Months, deltas, run_starts
from .registry import query
from .standins import AT, NOTICES, PANEL, REGISTER, WIDE, notices, panel, register, wide

W = "PARTITION BY cn ORDER BY m"


@query("wn1_calendar_lag", f"WITH {PANEL} SELECT cn, m, " + ", ".join(f"max(charges) OVER ({W} RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)::BIGINT AS lag_{n}" for n in (1, 3, 6, 12)) + " FROM panel")
def wn1(t):
    w = Months()
    return panel(t).select("cn", "m", *[w.lag(F.col("charges"), n).alias(f"lag_{n}") for n in (1, 3, 6, 12)])


@query("wn2_previous_observed", f"WITH {PANEL} SELECT cn, m, lag(overdue IGNORE NULLS) OVER ({W}) AS before FROM panel")
def wn2(t):
    return panel(t).select("cn", "m", Months().previous(F.col("overdue")).alias("before"))


@query("wn3_present_at_lag", f"WITH {PANEL} SELECT cn, m, count(*) OVER ({W} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) > 0 AS had_1, count(*) OVER ({W} RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) > 0 AS had_12 FROM panel")
def wn3(t):
    w = Months()
    return panel(t).select("cn", "m", w.present(1).alias("had_1"), w.present(12).alias("had_12"))


ISLANDS = f"""b AS (SELECT *, lag(status IGNORE NULLS) OVER ({W}) AS p FROM panel), g AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM status THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS grp FROM b)"""


@query("wn4_runs", f"WITH {PANEL}, {ISLANDS} SELECT cn, m, grp::BIGINT AS run FROM g")
def wn4(t):
    w = Months()
    before = w.previous(F.col("status"))
    broke = panel(t).withColumn("broke", (before.isNotNull() & ~before.eqNullSafe(F.col("status"))).cast("int"))
    return broke.select("cn", "m", F.sum("broke").over(w.w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


@query("wn5_months_in_status", f"WITH {PANEL}, {ISLANDS} SELECT cn, m, (m - min(m) OVER (PARTITION BY cn, grp))::INTEGER AS months_in_status FROM g")
def wn5(t):
    return run_starts(panel(t), ["status"]).select("cn", "m", (F.col("m") - F.col("status_since")).alias("months_in_status"))


@query("wn6_overdue_streak", f"""WITH {PANEL}, b AS (SELECT *, lag(overdue IGNORE NULLS) OVER ({W}) AS p FROM panel),
g AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM overdue THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS grp FROM b)
SELECT cn, m, CASE WHEN overdue THEN m - min(m) OVER (PARTITION BY cn, grp) + 1 ELSE 0 END::INTEGER AS streak FROM g""")
def wn6(t):
    return run_starts(panel(t), ["overdue"]).select("cn", "m", F.when(F.col("overdue"), F.col("m") - F.col("overdue_since") + 1).otherwise(0).alias("streak"))


NEW = f"""l AS (SELECT *, max(charges) OVER ({W} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS c1 FROM panel), n AS (SELECT *, charges > c1 AS new FROM l)"""


def with_new(t):
    return panel(t).withColumn("new", F.col("charges") > Months().lag(F.col("charges"), 1))


@query("wn7_trailing_year", f"WITH {PANEL}, {NEW} SELECT cn, m, (sum(CASE WHEN new THEN 1 ELSE 0 END) OVER ({W} RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))::BIGINT AS new_12m FROM n")
def wn7(t):
    return with_new(t).select("cn", "m", Months().trailing(F.when(F.col("new"), 1).otherwise(0), 12).alias("new_12m"))


@query("wn8_last_event_month", f"WITH {PANEL}, {NEW} SELECT cn, m, (max(CASE WHEN new THEN m END) OVER ({W} ROWS UNBOUNDED PRECEDING))::INTEGER AS last_new FROM n")
def wn8(t):
    return with_new(t).select("cn", "m", Months().last_month(F.col("new")).alias("last_new"))


@query("wn9_ever_before", f"WITH {PANEL} SELECT cn, m, coalesce(max(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ever FROM panel")
def wn9(t):
    return panel(t).select("cn", "m", Months().ever_before(F.col("status") == "F").alias("ever"))


@query("wn10_forward_range", f"WITH {PANEL} SELECT cn, m, " + ", ".join(f"(max(charges) OVER ({W} RANGE BETWEEN 1 FOLLOWING AND {n} FOLLOWING))::BIGINT AS max_{n}, (count(*) OVER ({W} RANGE BETWEEN 1 FOLLOWING AND {n} FOLLOWING))::BIGINT AS n_{n}" for n in (3, 6, 12)) + " FROM panel")
def wn10(t):
    w = Months()
    return panel(t).select("cn", "m", *[c for n in (3, 6, 12) for c in (w.ahead(F.max("charges"), n).alias(f"max_{n}"), w.ahead(F.count(F.lit(1)), n).alias(f"n_{n}"))])


@query("wn11_top_per_sector", f"WITH {WIDE} SELECT sector, cn, rn FROM (SELECT sector, cn, row_number() OVER (PARTITION BY sector ORDER BY score DESC, cn) AS rn FROM wide) WHERE rn <= 10")
def wn11(t):
    w = Window.partitionBy("sector").orderBy(F.desc("score"), "cn")
    return wide(t).select("sector", "cn", F.row_number().over(w).cast("long").alias("rn")).filter("rn <= 10")


@query("wn12_rank_over_aggregates", "SELECT o_custkey AS cn, o_orderpriority AS main FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(DISTINCT o_orderkey) DESC, max(o_orderdate) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1")
def wn12(t):
    g = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count_distinct("o_orderkey").alias("n"), F.max("o_orderdate").alias("d"))
    return primary(g, ["o_custkey"], [F.desc("n"), F.desc("d"), F.asc("o_orderpriority")]).select(F.col("o_custkey").alias("cn"), F.col("o_orderpriority").alias("main"))


@query("wn13_one_row_per_key", "SELECT o_custkey AS cn, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def wn13(t):
    return primary(t.orders, ["o_custkey"], [F.asc("o_orderkey")]).select(F.col("o_custkey").alias("cn"), F.col("o_orderkey").alias("first_order"))


@query("wn14_previous_extract", "SELECT m, lag(m) OVER (ORDER BY m) AS before FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders)")
def wn14(t):
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    return months.select("m", F.lag("m").over(Window.orderBy("m")).alias("before"))  # one row a month


@query("wn15_order_of_appearance", "SELECT o_custkey AS cn, o_orderkey AS charge, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders")
def wn15(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("cn"), F.col("o_orderkey").alias("charge"), F.row_number().over(w).cast("long").alias("nth"))


@query("wn16_first_over_partition", f"WITH {PANEL} SELECT cn, m, min(CASE WHEN status = 'F' THEN m END) OVER (PARTITION BY cn)::INTEGER AS first_closed FROM panel")
def wn16(t):
    return panel(t).select("cn", "m", F.min(F.when(F.col("status") == "F", F.col("m"))).over(Window.partitionBy("cn")).alias("first_closed"))


@query("wn17_named_window", f"WITH {PANEL} SELECT cn, m, sum(charges) OVER w::BIGINT AS s, count(*) OVER w AS n FROM panel WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)")
def wn17(t):
    return t.spark.sql(f"SELECT cn, m, sum(charges) OVER w AS s, count(*) OVER w AS n FROM {{rows}} WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)", rows=panel(t))


@query("wn18_average_rank_auc", """WITH s AS (SELECT floor(o_totalprice / 1000) AS p, (o_orderpriority = '1-URGENT')::INT AS y FROM orders),
g AS (SELECT p, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM s GROUP BY 1), r AS (SELECT *, sum(pos + neg) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) - (pos + neg - 1) / 2 AS rk FROM g)
SELECT (sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg)) AS auc FROM r""")
def wn18(t):
    return mean_rank_auc(t.orders.select(F.floor(F.col("o_totalprice") / 1000).alias("p"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y")), "p", "y")


@query("wn19_cumulative", f"WITH {WIDE}, g AS (SELECT nation, count(*)::BIGINT AS n FROM wide GROUP BY 1) SELECT nation, n, (sum(n) OVER (ORDER BY n DESC, nation ROWS UNBOUNDED PRECEDING))::BIGINT AS n_cumulative FROM g")
def wn19(t):
    from ..operators.market import shares

    return shares(wide(t), "nation").select("nation", "n", "n_cumulative")


@query("wn20_burst", f"WITH {NOTICES}, l AS (SELECT cn, lead(notice_date, 2) OVER (PARTITION BY cn ORDER BY notice_date, url) - notice_date AS gap FROM notices) SELECT cn, coalesce(bool_or(gap <= 90), FALSE)::INTEGER AS burst FROM l GROUP BY 1")
def wn20(t):
    return notice_features(notices(t), F.lit(AT)).select("cn", F.col("notice_burst_flag").alias("burst"))


@query("wn21_recurring", f"WITH {NOTICES} SELECT cn, (count(DISTINCT notice_date) >= 2 AND max(notice_date) - min(notice_date) > 180)::INTEGER AS recurring FROM notices GROUP BY 1")
def wn21(t):
    return notice_features(notices(t), F.lit(AT)).select("cn", F.col("recurring_distress_flag").alias("recurring"))


def on_spine(c: str, n: int) -> str:
    return f"lag(r.{c}, {n}) OVER w AS {c}_{n}"


#: The same features over a dense spine, where the row n places back is the month n back and absent months have no cn.
LAGS = [("charges", 1), ("charges", 3), ("charges", 6), ("charges", 12), ("outstanding", 3), ("outstanding", 6), ("outstanding", 12), ("satisfied", 12), ("debt_ratio", 12), ("status", 1), ("tier", 12), ("sic", 12), ("name", 12), ("postcode", 12)]
RUNS = ("status", "segment", "overdue", "stale")
SHOWN = ", ".join(("charges", "outstanding", "satisfied", "debt_ratio", "status", "is_active", "segment", "tier", "overdue", "stale", "sic", "name", "postcode"))
DATES = ("accounts_due", "statement_due", "accounts_made", "statement_made")
DELTAS = f"""WITH {REGISTER}, bounds AS (SELECT min(m) AS a, max(m) AS z FROM register),
spine AS (SELECT cn, month AS m FROM (SELECT DISTINCT cn FROM register), (SELECT unnest(range(a, z + 1))::INTEGER AS month FROM bounds)),
l AS (
  SELECT s.cn, s.m, r.cn IS NOT NULL AS there, r.* EXCLUDE (cn, m), {', '.join(on_spine(c, n) for c, n in LAGS)}, lag(r.cn, 1) OVER w IS NOT NULL AS h1, lag(r.cn, 12) OVER w IS NOT NULL AS h12,
    {', '.join(f"lag(r.{c} IGNORE NULLS) OVER w AS {c}_seen" for c in RUNS)}
  FROM spine s LEFT JOIN register r ON r.cn = s.cn AND r.m = s.m WINDOW w AS (PARTITION BY s.cn ORDER BY s.m)),
b AS (
  SELECT *, CASE WHEN h1 THEN charges > charges_1 END AS fresh, {', '.join(f"try_strptime({c}_text, '%d/%m/%Y')::DATE AS {c}" for c in DATES)},
    {', '.join(f"sum((there AND {c}_seen IS NOT NULL AND {c}_seen IS DISTINCT FROM {c})::INT) OVER ({W} ROWS UNBOUNDED PRECEDING) AS {c}_run" for c in RUNS)}
  FROM l),
f AS (
  SELECT *, sum((fresh IS TRUE)::INT) OVER ({W} RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS n_fresh, max(CASE WHEN fresh THEN m END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS last_fresh,
    max((there AND NOT is_active)::INT) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_out, {', '.join(f"m - min(CASE WHEN there THEN m END) OVER (PARTITION BY cn, {c}_run) AS {c}_months" for c in RUNS)}
  FROM b)
SELECT cn, m, source_date, {SHOWN}, {', '.join(DATES)},
  {', '.join(f"{c} - {c}_{n} AS d_{c}_{n}m" for c, n in LAGS if c in ('charges', 'outstanding', 'satisfied') and n > 1)}, debt_ratio - debt_ratio_12 AS debt_ratio_trend_12m,
  coalesce(n_fresh, 0)::BIGINT AS new_charge_events_12m, (m - last_fresh)::INTEGER AS months_since_last_new_charge, CASE WHEN h1 THEN status IS DISTINCT FROM status_1 END AS status_changed,
  status_months::INTEGER AS months_in_current_status, coalesce(was_out = 1, FALSE) AS ever_distressed_before, CASE WHEN tier IS NOT NULL AND tier_12 IS NOT NULL THEN tier > tier_12 END AS segment_upgraded_12m,
  CASE WHEN tier IS NOT NULL AND tier_12 IS NOT NULL THEN tier < tier_12 END AS segment_downgraded_12m, segment_months::INTEGER AS months_since_segment_change,
  (CASE WHEN overdue THEN overdue_months + 1 ELSE 0 END)::INTEGER AS accounts_overdue_streak_months, (CASE WHEN stale THEN stale_months + 1 ELSE 0 END)::INTEGER AS accounts_stale_streak_months,
  statement_due < source_date AS confstmt_late, datediff('day', source_date, accounts_due)::INTEGER AS days_to_next_accounts_due, datediff('month', accounts_made, source_date)::INTEGER AS months_since_last_accounts_filing,
  datediff('month', statement_made, source_date)::INTEGER AS months_since_last_confstmt, {', '.join(f"CASE WHEN h12 THEN {c} IS DISTINCT FROM {c}_12 END AS {c}_changed_12m" for c in ('sic', 'name', 'postcode'))}
FROM f WHERE there"""


@query("tf2_delta_features", DELTAS)
def tf2(t):
    return deltas(register(t))
