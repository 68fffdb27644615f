"""Aggregation queries (AG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_avg, exact_sum
from ..operators.asof import first_n, primary
from ..operators.compare import coverage
from ..operators.events import event_pack, notice_features, watermark
from ..operators.market import concentration, crosstab_share, group_metric, histogram, quantile_bins, shares
from .registry import query
from .standins import AT, NOTICES, PANEL, WIDE, notices, panel, wide


@query("ag1_facet_count", f"WITH {WIDE} SELECT nation, count(*) AS n FROM wide GROUP BY 1 ORDER BY n DESC, nation LIMIT 10")
def ag1(t):
    return wide(t).groupBy("nation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nation").limit(10)


@query("ag2_many_metrics_one_scan", f"WITH {WIDE} SELECT sector, count(*) AS n, count(*) FILTER (flag) AS yes, count(*) FILTER (NOT flag) AS no, count(*) FILTER (flag IS NULL) AS unknown, count(*) FILTER (score < 0) AS debt FROM wide GROUP BY 1")
def ag2(t):
    return wide(t).groupBy("sector").agg(F.count("*").alias("n"), F.count_if("flag").alias("yes"), F.count_if(~F.col("flag")).alias("no"), F.count_if(F.col("flag").isNull()).alias("unknown"), F.count_if(F.col("score") < 0).alias("debt"))


@query("ag4_conditional_distinct", "SELECT l_suppkey AS k, " + ", ".join(f"count(DISTINCT CASE WHEN l_returnflag = '{f}' THEN l_orderkey END) AS d_{f.lower()}" for f in "RAN") + " FROM lineitem GROUP BY 1")
def ag4(t):
    """Flags by (key, order) first, then plain counts: rows are not expanded for each distinct count."""
    per = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(*[F.max(F.col("l_returnflag") == f).alias(f) for f in "RAN"])
    return per.groupBy(F.col("l_suppkey").alias("k")).agg(*[F.count_if(f).alias(f"d_{f.lower()}") for f in "RAN"])


@query("ag5_two_windows", "SELECT l_suppkey AS k, sum(CASE WHEN l_shipdate > DATE '2000-11-04' THEN l_extendedprice::DECIMAL(18,2) END)::DOUBLE AS v_12m, count(*) FILTER (l_shipdate > DATE '1999-11-04' AND l_shipdate <= DATE '2000-11-04') AS n_before FROM lineitem GROUP BY 1")
def ag5(t):
    d = F.col("l_shipdate").cast("date")
    year, two = F.lit("2000-11-04").cast("date"), F.lit("1999-11-04").cast("date")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(exact_sum(F.when(d > year, F.col("l_extendedprice"))).alias("v_12m"), F.count_if((d > two) & (d <= year)).alias("n_before"))


@query("ag6_extremes", "SELECT o_custkey AS k, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, bool_or(o_orderstatus = 'F') AS ever_closed FROM orders GROUP BY 1")
def ag6(t):
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"), F.bool_or(F.col("o_orderstatus") == "F").alias("ever_closed"))


@query("ag7_group_mode", "SELECT k, main FROM (SELECT l_orderkey AS k, l_returnflag AS main, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def ag7(t):
    g = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return g.groupBy(F.col("l_orderkey").alias("k")).agg(F.min_by("l_returnflag", F.struct(-F.col("n"), "l_returnflag")).alias("main"))


D = f"DATE '{AT}'"


def counted(f: str) -> str:
    return f"count(*) FILTER (family = '{f}')"


LIQUID = "family IN ('voluntary_liquidation', 'winding_up_order')"


@query("ag8_notice_rollup", f"""WITH {NOTICES}, s AS (SELECT * EXCLUDE (postcode), trim(coalesce(postcode, '')) AS postcode, CASE family WHEN 'petition' THEN 1 WHEN 'closing' THEN 5 WHEN 'dividend' THEN 4 WHEN 'creditor_process' THEN 3 WHEN 'administration' THEN 2 WHEN 'winding_up_order' THEN 2 WHEN 'voluntary_liquidation' THEN 2 END AS stage,
  lead(notice_date, 2) OVER (PARTITION BY cn ORDER BY notice_date, url) - notice_date AS gap FROM notices),
g AS (SELECT cn, arg_min(name, {{'d': notice_date, 'u': url}}) FILTER (name IS NOT NULL) AS company_name, count(notice_type) AS notice_count_total, count(DISTINCT notice_type) AS distinct_notice_type_count,
  {counted('petition')} AS winding_up_petition_count, {counted('winding_up_order')} AS winding_up_order_count, {counted('voluntary_liquidation')} AS voluntary_liquidation_count, count(*) FILTER ({LIQUID}) AS liquidation_notice_count,
  {counted('administration')} AS administration_count, {counted('creditor_process')} AS creditors_process_count, {counted('dividend')} AS dividend_notice_count, {counted('closing')} AS closing_notice_count,
  min(notice_date) AS first_notice_date, max(notice_date) AS latest_notice_date, count(*) FILTER (notice_date >= {D} - 365) AS notice_count_12m, count(*) FILTER (notice_date >= {D} - 730) AS notice_count_24m, coalesce(max(stage), 0)::INTEGER AS max_distress_stage, min(stage) AS least,
  {', '.join(f"({counted(f)} > 0)::INTEGER AS has_{n}" for n, f in (('prohibited_name_reuse', 'prohibited_name_reuse'), ('petition_dismissed', 'petition_dismissed'), ('cross_border_insolvency', 'cross_border'), ('other_insolvency', 'other_insolvency')))},
  (count(*) FILTER (notice_type = 'Appointment of Administrative Receivers') > 0)::INTEGER AS receiver_appointed_flag, (count(*) FILTER (notice_type LIKE '%Partnership%') > 0)::INTEGER AS partnership_insolvency_flag, (count(*) FILTER (postcode <> '') > 0)::INTEGER AS postcode_present_flag,
  max({{'d': notice_date, 'u': url, 's': stage, 'f': family, 'p': postcode}}) AS l, min(notice_date) FILTER (family = 'petition') AS pet, min(notice_date) FILTER (family = 'administration') AS adm,
  min(notice_date) FILTER ({LIQUID}) AS liq0, max(notice_date) FILTER ({LIQUID}) AS liq1, coalesce(bool_or(gap <= 90), FALSE)::INTEGER AS notice_burst_flag, (count(DISTINCT notice_date) >= 2 AND max(notice_date) - min(notice_date) > 180)::INTEGER AS recurring_distress_flag FROM s GROUP BY 1)
SELECT * EXCLUDE (least, l, pet, adm, liq0, liq1), 1 AS has_any_notice, {', '.join(f"({c}_count > 0)::INTEGER AS has_{n}" for n, c in (('winding_up_petition', 'winding_up_petition'), ('winding_up_order', 'winding_up_order'), ('liquidation', 'liquidation_notice'), ('administration', 'administration'), ('creditors_process', 'creditors_process'), ('dividend_notice', 'dividend_notice'), ('closing_notice', 'closing_notice')))},
  (winding_up_order_count > 0)::INTEGER AS compulsory_liquidation_flag, (voluntary_liquidation_count > 0 AND winding_up_order_count = 0)::INTEGER AS voluntary_liquidation_flag, (winding_up_petition_count + winding_up_order_count > 0)::INTEGER AS court_involved_flag,
  CASE max_distress_stage WHEN 0 THEN 'none' WHEN 1 THEN 'early_warning' WHEN 2 THEN 'formal_insolvency' ELSE 'terminal' END AS severity_tier, ({D} - latest_notice_date)::INTEGER AS days_since_latest_notice, ({D} - first_notice_date)::INTEGER AS days_since_first_notice,
  (latest_notice_date - first_notice_date)::INTEGER AS notice_span_days, ({D} - latest_notice_date <= 90)::INTEGER AS recent_notice_90d_flag, ({D} - latest_notice_date <= 365)::INTEGER AS recent_notice_365d_flag, (max_distress_stage - coalesce(least, max_distress_stage) >= 2)::INTEGER AS stage_progressed_flag,
  CASE l.s WHEN 1 THEN 'petition' WHEN 2 THEN 'formal_insolvency' WHEN 3 THEN 'creditor_process' WHEN 4 THEN 'dividend' WHEN 5 THEN 'closing' ELSE 'other' END AS current_stage,
  (l.f IN ('petition', 'winding_up_order', 'administration', 'voluntary_liquidation') AND {D} - latest_notice_date <= 365)::INTEGER AS active_case_flag, nullif(l.p, '') AS notice_postcode, nullif(upper(regexp_extract(l.p, '^([A-Za-z]{{1,2}})', 1)), '') AS notice_postcode_area, l.u AS latest_notice_url,
  coalesce(liq1 >= pet, FALSE)::INTEGER AS petition_to_liquidation_flag, coalesce(liq1 >= adm, FALSE)::INTEGER AS administration_to_liquidation_flag, CASE WHEN liq0 >= pet THEN (liq0 - pet)::INTEGER END AS days_petition_to_order FROM g""")
def ag8(t):
    return notice_features(notices(t), F.lit(AT))


@query("ag9_latest_row", f"WITH {NOTICES} SELECT cn, max({{'d': notice_date, 'u': url, 'f': family}}).f AS family FROM notices GROUP BY 1")
def ag9(t):
    return notices(t).groupBy("cn").agg(F.max_by("family", F.struct("notice_date", "url")).alias("family"))


@query("ag10_first_value", "SELECT user_id AS cn, event_type AS first FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def ag10(t):
    return t.events.groupBy(F.col("user_id").alias("cn")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first"))


@query("ag11_event_pack", f"""WITH e AS (SELECT user_id AS cn, ts::DATE AS d, event_type AS y, CASE WHEN event_id % 3 > 0 THEN value END AS v, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS c, CASE WHEN event_id % 5 > 0 THEN 'm' || (event_id % 3) END AS q FROM events)
SELECT cn, 1 AS ev_has_any, count(*) AS ev_count_total, count(*) FILTER (d >= ({D} - INTERVAL 12 MONTH)::DATE) AS ev_count_12m, min(d) AS ev_first_date, max(d) AS ev_latest_date, ({D} - max(d))::INTEGER AS ev_days_since_latest, sum(v::DECIMAL(18,2))::DOUBLE AS ev_value_total, max(v) AS ev_value_max, count(v) AS ev_value_count,
  array_to_string(list_sort(list_distinct(list(y))), '|') AS ev_types, array_to_string(list_sort(list_distinct(list(q) FILTER (q IS NOT NULL))), '|') AS ev_methods, max(c) AS ev_max_confidence, min(c) AS ev_min_confidence FROM e GROUP BY 1""")
def ag11(t):
    """AG11, AG12 and AG15: sums that stay null without a value, names sorted and joined."""
    n = F.col("event_id")
    e = t.events.select(F.col("user_id").alias("cn"), F.col("ts").cast("date").alias("event_date"), "event_type", F.when(n % 3 > 0, F.col("value")).alias("value"), F.when(n % 2 == 0, 1.0).otherwise(0.6).alias("confidence"), F.when(n % 5 > 0, F.concat(F.lit("m"), (n % 3).cast("string"))).alias("method"))
    return event_pack(e, "ev", F.lit(AT))


@query("ag12_top5_joined", "SELECT o_custkey AS k, array_to_string(list_sort(list_distinct(list(o_orderkey)))[1:5], '; ') AS first5 FROM orders GROUP BY 1")
def ag12(t):
    o = first_n(t.orders.select("o_custkey", "o_orderkey").distinct(), ["o_custkey"], [F.asc("o_orderkey")], 5)
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "; ").alias("first5"))


@query("ag13_head5_in_order", "SELECT o_custkey AS k, array_to_string((list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey))[1:5], ' | ') AS newest5 FROM orders GROUP BY 1")
def ag13(t):
    o = first_n(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 5)
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), " | ").alias("newest5"))


@query("ag14_supplier_rollup", "SELECT l_suppkey AS k, count(DISTINCT l_orderkey) AS orders, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(l_extendedprice) AS mean, max(l_extendedprice) AS largest FROM lineitem GROUP BY 1")
def ag14(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count_distinct("l_orderkey").alias("orders"), exact_sum(F.col("l_extendedprice")).alias("total"), exact_avg(F.col("l_extendedprice")).alias("mean"), F.max("l_extendedprice").alias("largest"))


@query("ag16_weighted_mean", "SELECT l_returnflag AS f, sum((l_quantity * l_discount)::DECIMAL(18,4))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS discount, avg((l_linestatus = 'O')::INT) AS open_rate FROM lineitem GROUP BY 1")
def ag16(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("f")).agg((exact_sum(F.col("l_quantity") * F.col("l_discount"), 4) / exact_sum(F.col("l_quantity"))).alias("discount"), F.avg((F.col("l_linestatus") == "O").cast("int")).alias("open_rate"))


@query("ag17_distinct", "SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders")
def ag17(t):
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p")).distinct()


@query("ag18_any_value", "SELECT n_regionkey AS k, any_value(r_name) AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def ag18(t):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("n_regionkey").alias("k")).agg(F.any_value("r_name").alias("region"), F.count("*").alias("nations"))


@query("ag19_having", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6 AND count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') > 1")
def ag19(t):
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("d"))
    return g.filter("n > 6 AND d > 1").select("k", "n")


@query("ag20_quantiles", "SELECT o_orderpriority AS p, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY 1")
def ag20(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("p")).agg(*[F.round(F.percentile("o_totalprice", q), 6).alias(n) for n, q in (("median", 0.5), ("p90", 0.9), ("p99", 0.99))])


@query("ag21_histogram", "SELECT least(floor(o_totalprice / 20000), 15)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def ag21(t):
    return histogram(t.orders, F.col("o_totalprice"), 20000, 15)


@query("ag22_crosstab", f"WITH {WIDE}, c AS (SELECT nation, sector, count(*) AS n FROM wide GROUP BY 1, 2), top AS (SELECT nation FROM wide GROUP BY 1 ORDER BY count(*) DESC, nation LIMIT 8), s AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY sector) AS share FROM c) SELECT nation, sector, n, share FROM s WHERE nation IN (SELECT nation FROM top)")
def ag22(t):
    return crosstab_share(wide(t), "nation", "sector")


SHARES = "g AS (SELECT s_nationkey AS nation, count(*)::BIGINT AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), s AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, nation) AS rank, (sum(n) OVER (ORDER BY n DESC, nation ROWS UNBOUNDED PRECEDING))::BIGINT AS n_cumulative FROM g)"


def by_nation(t):
    return t.lineitem.select("l_suppkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")


@query("ag23_market_shares", f"WITH {SHARES} SELECT nation, n, share, rank, n_cumulative FROM s")
def ag23(t):
    return shares(by_nation(t), "nation")


@query("ag23_concentration", f"WITH {SHARES} SELECT round(sum(share) FILTER (rank <= 4), 6) AS top4, round(sum(share * share), 6) AS hhi, count(*) AS groups FROM s")
def ag23b(t):
    return concentration(shares(by_nation(t), "nation")).withColumns({"top4": F.round("top4", 6), "hhi": F.round("hhi", 6)})


@query("ag24_sector_table", f"WITH {WIDE} SELECT sector, count(*) AS n, avg(flag::INT) AS flagged, avg((score < 0)::INT) AS in_debt FROM wide GROUP BY 1")
def ag24(t):
    return wide(t).groupBy("sector").agg(F.count("*").alias("n"), F.avg(F.col("flag").cast("int")).alias("flagged"), F.avg((F.col("score") < 0).cast("int")).alias("in_debt"))


@query("ag25_group_metric", f"WITH {WIDE} SELECT region, max(score) AS value FROM wide GROUP BY 1")
def ag25(t):
    return group_metric(wide(t), "region", "max", "score", ["score"])


@query("ag26_pivot", "SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p2, count(*) AS total FROM orders GROUP BY 1")
def ag26(t):
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).toDF("p", "f", "o", "p2")
    return p.withColumn("total", F.col("f") + F.col("o") + F.col("p2"))


@query("ag27_unpivot", "SELECT p_partkey AS k, 'p_name' AS slot, p_name AS v FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def ag27(t):
    p = t.part.withColumn("p_brand", F.when(F.col("p_size") > 10, F.col("p_brand")))
    return p.unpivot([F.col("p_partkey").alias("k")], ["p_name", "p_brand", "p_type"], "slot", "v").filter("v IS NOT NULL")


@query("ag28_right_closed_bands", "SELECT CASE WHEN v > 0 AND v <= 10000 THEN 'a' WHEN v > 10000 AND v <= 50000 THEN 'b' WHEN v > 50000 THEN 'c' END AS band, count(*) AS n FROM (SELECT l_extendedprice AS v FROM lineitem) GROUP BY 1")
def ag28(t):
    v = F.col("l_extendedprice")
    return t.lineitem.groupBy(F.when((v > 0) & (v <= 10000), "a").when((v > 10000) & (v <= 50000), "b").when(v > 50000, "c").alias("band")).agg(F.count("*").alias("n"))


@query("ag29_quantile_bins", "WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders) SELECT len(list_filter(list_distinct(q), lambda x: x < o_totalprice))::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def ag29(t):
    return quantile_bins(t.orders, "o_totalprice").groupBy("bin").agg(F.count("*").alias("n"))


@query("ag30_correlations", f"WITH {WIDE} SELECT round(corr(score, flag::INT), 9) AS score_flag, round(corr(score, moves), 9) AS score_moves, round(corr(moves, flag::INT), 9) AS moves_flag FROM wide")
def ag30(t):
    w = wide(t).withColumn("y", F.col("flag").cast("int"))
    return w.agg(*[F.round(F.corr(a, b), 9).alias(n) for n, a, b in (("score_flag", "score", "y"), ("score_moves", "score", "moves"), ("moves_flag", "moves", "y"))])


@query("ag31_label_overlap", f"WITH {WIDE}, l AS (SELECT flag::INT AS a, (moves > 0)::INT AS b FROM wide), x AS (SELECT * FROM l WHERE a IS NOT NULL AND b IS NOT NULL) SELECT sum(a * b)::DOUBLE / sum(b) AS a_given_b, sum(a * b)::DOUBLE / sum(b) / avg(a) AS lift FROM x")
def ag31(t):
    x = wide(t).select(F.col("flag").cast("int").alias("a"), (F.col("moves") > 0).cast("int").alias("b")).dropna()
    both = F.sum(F.col("a") * F.col("b")) / F.sum("b")
    return x.agg(both.alias("a_given_b"), (both / F.avg("a")).alias("lift"))


@query("ag32_aggregate_of_aggregate", f"WITH {PANEL} SELECT months, count(*) AS companies FROM (SELECT cn, count(*) AS months FROM panel GROUP BY 1) GROUP BY 1")
def ag32(t):
    return panel(t).groupBy("cn").agg(F.count("*").alias("months")).groupBy("months").agg(F.count("*").alias("companies"))


@query("ag33_cut_rates", f"WITH {WIDE} SELECT CASE WHEN score < 0 THEN 'debt' WHEN score < 5000 THEN 'mid' ELSE 'high' END AS band, region, count(*) AS n, avg(flag::INT) AS rate FROM wide GROUP BY 1, 2")
def ag33(t):
    s = F.col("score")
    return wide(t).groupBy(F.when(s < 0, "debt").when(s < 5000, "mid").otherwise("high").alias("band"), "region").agg(F.count("*").alias("n"), F.avg(F.col("flag").cast("int")).alias("rate"))


@query("ag34_coverage", f"WITH {WIDE} SELECT 'flag' AS \"column\", 'boolean' AS dtype, count(flag)::DOUBLE / count(*) AS non_null FROM wide UNION ALL SELECT 'moves', 'bigint', count(moves)::DOUBLE / count(*) FROM wide UNION ALL SELECT 'score', 'double', count(score)::DOUBLE / count(*) FROM wide")
def ag34(t):
    return coverage(wide(t), ["flag", "moves", "score"])


@query("ag35_month_buckets", "WITH c AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS m) SELECT c.m, count(o_orderkey) AS n FROM c LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = c.m GROUP BY 1")
def ag35(t):
    from ..sources.readers import calendar

    n = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("n"))
    return calendar(t.spark, "1995-01-01", "2001-12-01").join(n, "m", "left").na.fill({"n": 0})


@query("ag36_watermark", "SELECT min(d) AS watermark FROM (SELECT event_type, max(ts)::DATE AS d FROM events GROUP BY 1)")
def ag36(t):
    return watermark(t.events.withColumn("d", F.col("ts").cast("date")), "event_type", "d")


@query("ag37_describe", "SELECT count(*) AS n, min(o_totalprice) AS lo, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS q2, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS hi, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean FROM orders")
def ag37(t):
    v = "o_totalprice"
    return t.orders.agg(F.count("*").alias("n"), F.min(v).alias("lo"), *[F.percentile(v, q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))], F.max(v).alias("hi"), exact_avg(F.col(v)).alias("mean"))


@query("ag38_standing_of_one", f"WITH {WIDE}, one AS (SELECT * FROM wide WHERE cn = 42) SELECT count(*) AS n, count(*) FILTER (wide.score > one.score) AS better, count(*) FILTER (wide.moves > one.moves) AS more_moves, count(*) FILTER (wide.sector = one.sector AND wide.score > one.score) AS better_in_sector FROM wide, one")
def ag38(t):
    """A row's standing on several columns, in one scan."""
    w = wide(t)
    one = w.filter("cn = 42").select(F.col("score").alias("s"), F.col("moves").alias("v"), F.col("sector").alias("c"))
    x = w.crossJoin(F.broadcast(one))  # one row
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("score") > F.col("s")).alias("better"), F.count_if(F.col("moves") > F.col("v")).alias("more_moves"), F.count_if((F.col("sector") == F.col("c")) & (F.col("score") > F.col("s"))).alias("better_in_sector"))


@query("ag_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY 1, 2")
def ag_pricing(t):
    d = t.lineitem.filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("date"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(exact_sum(F.col("l_quantity")).alias("sum_qty"), exact_sum(F.col("l_extendedprice")).alias("sum_price"), exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("sum_disc"), F.count("*").alias("n"))


@query("sl6_largest", f"WITH {WIDE} SELECT cn, score, row_number() OVER (ORDER BY score DESC, cn) AS rank FROM wide ORDER BY rank LIMIT 100")
def sl6(t):
    from ..operators.facets import top

    return top(wide(t), "score", "cn", 100).select("cn", "score", "rank")


@query("sl3_count_and_page", f"WITH {WIDE} SELECT cn, score, (SELECT count(*) FROM wide WHERE sector = 'BUILDING') AS total FROM wide WHERE sector = 'BUILDING' ORDER BY score DESC, cn LIMIT 20")
def sl3(t):
    w = wide(t).filter("sector = 'BUILDING'").select("cn", "score")
    return w.orderBy(F.desc("score"), "cn").limit(20).crossJoin(F.broadcast(w.agg(F.count("*").alias("total"))))  # one row


@query("sl4_watchlist_order", f"WITH {NOTICES} SELECT cn, family, url FROM notices ORDER BY family DESC, notice_date DESC, url LIMIT 50")
def sl4(t):
    return notices(t).orderBy(F.desc("family"), F.desc("notice_date"), "url").limit(50).select("cn", "family", "url")


@query("sl7_top3_per_row", "SELECT user_id AS cn, event_id AS e, r AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50) DESC, event_id) AS r FROM events) WHERE r <= 3")
def sl7(t):
    w = Window.partitionBy("user_id").orderBy(F.desc(F.abs(F.col("value") - 50)), "event_id")
    return t.events.select(F.col("user_id").alias("cn"), F.col("event_id").alias("e"), F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 3")


@query("sl8_merged_timeline", "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate::DATE AS d FROM orders WHERE o_custkey = 7 ORDER BY d DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts::DATE AS d FROM events WHERE user_id = 7 ORDER BY d DESC, id LIMIT 5)")
def sl8(t):
    a = t.orders.filter("o_custkey = 7").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    b = t.events.filter("user_id = 7").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("date").alias("d"))
    newest = lambda x: x.orderBy(F.desc("d"), "id").limit(5)
    return newest(a).unionByName(newest(b)).orderBy("d", "kind", "id")


@query("sl9_priority_dedupe_head", f"WITH {WIDE}, r AS (SELECT *, row_number() OVER (PARTITION BY nation, sector ORDER BY score DESC, cn) AS rn FROM wide) SELECT cn, nation, sector FROM r WHERE rn = 1 ORDER BY score DESC, cn LIMIT 40")
def sl9(t):
    return primary(wide(t), ["nation", "sector"], [F.desc("score"), F.asc("cn")]).orderBy(F.desc("score"), "cn").limit(40).select("cn", "nation", "sector")


@query("sl10_stratified_sample", f"WITH {WIDE}, r AS (SELECT *, row_number() OVER (PARTITION BY sector, region ORDER BY md5(cn::VARCHAR), cn) AS rn FROM wide) SELECT sector, region, cn FROM r WHERE rn <= 5")
def sl10(t):
    """A sampling operator: five of each cell."""
    w = Window.partitionBy("sector", "region").orderBy(F.md5(F.col("cn").cast("string")), "cn")
    return wide(t).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("sector", "region", "cn")


@query("ag15_null_sum", "SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2) END)::DOUBLE AS returned FROM lineitem GROUP BY 1")
def ag15(t):
    """A sum without a value is null, not 0."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(exact_sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("returned"))
