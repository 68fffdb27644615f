"""Reporting and shaping queries (RP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum
from ..operators.compare import coverage
from ..operators.market import shares
from .registry import query
from .standins import CHARGES, NOTICES, PANEL, WIDE, charges, notices, panel, wide


@query("rp2_single_row", f"WITH {WIDE} SELECT * FROM wide WHERE cn = 42")
def rp2(t):
    return wide(t).filter("cn = 42")


@query("rp4_signal_shape", f"WITH {NOTICES} SELECT cn, 'register' AS source, family AS signal_type, notice_date AS signal_date, notice_type AS title, NULL::DOUBLE AS value, url, 1.0::DOUBLE AS confidence, 'number' AS method FROM notices")
def rp4(t):
    return notices(t).select("cn", F.lit("register").alias("source"), F.col("family").alias("signal_type"), F.col("notice_date").alias("signal_date"), F.col("notice_type").alias("title"), F.lit(None).cast("double").alias("value"), "url", F.lit(1.0).alias("confidence"), F.lit("number").alias("method"))


RAW = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS cn, CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%d/%m/%Y') END AS d"


@query("rp5_audited_pack", f"WITH r AS (SELECT {RAW} FROM events) SELECT count(*) AS n_rows, count(*) FILTER (cn IS NULL) AS no_key, count(*) FILTER (cn IS NOT NULL AND d = 'soon') AS no_date, count(*) FILTER (cn IS NOT NULL AND d <> 'soon' AND cn NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS outside, count(*) FILTER (cn IS NOT NULL AND d <> 'soon' AND cn IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS kept FROM r")
def rp5(t):
    """Every row is kept or counted under the first reason against it, in one pass."""
    e = F.col("event_id")
    r = t.events.select(F.when(e % 13 != 0, F.col("user_id")).alias("cn"), F.when(e % 11 == 0, "soon").otherwise(F.date_format("ts", "dd/MM/yyyy")).alias("raw"))
    u = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cn"), F.lit(True).alias("inside"))
    day = F.try_to_date("raw", "dd/MM/yyyy")
    why = F.when(F.col("cn").isNull(), "no_key").when(day.isNull(), "no_date").when(F.col("inside").isNull(), "outside").otherwise("kept")
    return r.join(u, "cn", "left").withColumn("why", why).agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("why") == k).alias(k) for k in ("no_key", "no_date", "outside", "kept")])


@query("rp6_only_undated", "WITH r AS (SELECT user_id AS cn, CASE WHEN event_type = 'purchase' AND event_id % 20 = 0 THEN ts::DATE END AS d FROM events) SELECT DISTINCT cn FROM r WHERE d IS NULL AND cn NOT IN (SELECT cn FROM r WHERE d IS NOT NULL)")
def rp6(t):
    r = t.events.select(F.col("user_id").alias("cn"), F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 20 == 0), F.col("ts").cast("date")).alias("d"))
    return r.groupBy("cn").agg(F.count("d").alias("n")).filter("n = 0").select("cn")


@query("rp7_rollup_in_universe", f"WITH {NOTICES} SELECT cn, count(*) AS n, max(notice_date) AS latest FROM notices WHERE cn IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def rp7(t):
    u = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cn"))
    return notices(t).join(u, "cn", "left_semi").groupBy("cn").agg(F.count("*").alias("n"), F.max("notice_date").alias("latest"))


@query("rp8_coverage_by_tier", f"WITH {WIDE}, h AS (SELECT user_id AS cn, count(*)::BIGINT AS n FROM events GROUP BY 1) SELECT sector, count(*) AS companies, count(h.cn) AS hit, coalesce(sum(n), 0)::BIGINT AS hits, 100.0::DOUBLE * count(h.cn) / count(*) AS pct FROM wide LEFT JOIN h ON h.cn = wide.cn GROUP BY 1")
def rp8(t):
    h = t.events.groupBy(F.col("user_id").alias("cn")).agg(F.count("*").alias("n"))
    return wide(t).join(h, "cn", "left").groupBy("sector").agg(F.count("*").alias("companies"), F.count("n").alias("hit"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), (F.lit(100.0) * F.count("n") / F.count("*")).alias("pct"))


@query("rp9_three_states", "WITH s AS (SELECT user_id AS cn, bool_or(event_type = 'error') AS found FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT c_custkey AS cn, CASE WHEN found THEN 'found' WHEN found IS FALSE THEN 'searched, none' ELSE 'not searched' END AS status FROM customer LEFT JOIN s ON cn = c_custkey")
def rp9(t):
    s = t.events.filter("user_id % 2 = 0").groupBy(F.col("user_id").alias("cn")).agg(F.bool_or(F.col("event_type") == "error").alias("found"))
    f = F.col("found")
    return t.customer.select(F.col("c_custkey").alias("cn")).join(s, "cn", "left").select("cn", F.when(f, "found").when(~f, "searched, none").otherwise("not searched").alias("status"))


@query("rp10_status_mix", f"WITH {PANEL} SELECT m, count(*) FILTER (status = 'F') AS f, count(*) FILTER (status = 'O') AS o, count(*) FILTER (tier IS NULL) AS outside FROM panel GROUP BY 1")
def rp10(t):
    return panel(t).groupBy("m").agg(F.count_if(F.col("status") == "F").alias("f"), F.count_if(F.col("status") == "O").alias("o"), F.count_if(F.col("tier").isNull()).alias("outside"))


@query("rp11_signal_means", f"WITH {PANEL} SELECT status, avg(charges) AS charges, avg(overdue::INT) AS overdue, avg(tier) AS tier FROM panel GROUP BY 1")
def rp11(t):
    return panel(t).groupBy("status").agg(F.avg("charges").alias("charges"), F.avg(F.col("overdue").cast("int")).alias("overdue"), F.avg("tier").alias("tier"))


@query("rp12_non_zero_rates", f"WITH {PANEL} SELECT avg((charges <> 0)::INT) AS charges, avg((outstanding <> 0)::INT) AS outstanding, avg(CASE WHEN overdue THEN 1 ELSE 0 END) AS overdue FROM panel")
def rp12(t):
    return panel(t).agg(F.avg((F.col("charges") != 0).cast("int")).alias("charges"), F.avg((F.col("outstanding") != 0).cast("int")).alias("outstanding"), F.avg(F.when(F.col("overdue"), 1).otherwise(0)).alias("overdue"))


@query("rp13_group_comparison", "WITH w AS (SELECT DISTINCT o_custkey AS cn FROM orders WHERE o_totalprice > 450000) SELECT CASE WHEN w.cn IS NULL THEN 'none' ELSE 'large' END AS grp, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*) AS mean FROM customer LEFT JOIN w ON w.cn = c_custkey GROUP BY 1")
def rp13(t):
    w = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("grp", F.lit("large"))
    return t.customer.join(w, "c_custkey", "left").na.fill({"grp": "none"}).groupBy("grp").agg(F.count("*").alias("n"), (exact_sum(F.col("c_acctbal")) / F.count("*")).alias("mean"))


@query("rp14_concentration", "SELECT sum(CASE WHEN o_totalprice >= 400000 THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE / sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS share FROM orders")
def rp14(t):
    v = F.col("o_totalprice")
    return t.orders.agg((exact_sum(F.when(v >= 400000, v)) / exact_sum(v)).alias("share"))


@query("rp15_unmatched_prefixes", "SELECT regexp_extract(s_name, '^(Supplier#0000000[0-9])', 1) AS prefix, count(*) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def rp15(t):
    u = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("s_suppkey"))
    return t.supplier.join(u, "s_suppkey", "left_anti").groupBy(F.regexp_extract("s_name", "^(Supplier#0000000[0-9])", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query("rp16_still_to_do", "SELECT c_custkey AS cn FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT user_id FROM events)")
def rp16(t):
    from ..sources.sinks import pending

    return pending(t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("cn")), t.events.select(F.col("user_id").alias("cn")), "cn")


@query("rp17_catalogue", "SELECT * FROM (VALUES ('cn', 'bigint', 1.0), ('name', 'string', 1.0), ('sector', 'string', 1.0), ('nation', 'string', 1.0), ('region', 'string', 1.0), ('score', 'double', 1.0)) t(\"column\", dtype, non_null)".replace("1.0)", "1.0::DOUBLE)"))
def rp17(t):
    return coverage(wide(t), ["cn", "name", "sector", "nation", "region", "score"])


@query("rp18_top_buyers", f"WITH {WIDE} SELECT moves, count(DISTINCT nation) AS nations, count(*) AS n FROM wide GROUP BY 1")
def rp18(t):
    """The null group is a group."""
    return wide(t).groupBy("moves").agg(F.count_distinct("nation").alias("nations"), F.count("*").alias("n"))


@query("rp19_dictionary_coverage", f"WITH {CHARGES}, g AS (SELECT lender, count(*)::BIGINT AS n FROM charges GROUP BY 1) SELECT lender, n, 100.0::DOUBLE * n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, lender) AS rank, (sum(n) OVER (ORDER BY n DESC, lender ROWS UNBOUNDED PRECEDING))::BIGINT AS n_cumulative FROM g")
def rp19(t):
    return shares(charges(t), "lender")


@query("rp20_label_totals", "SELECT 'urgent' AS label, count(*) AS n_rows, count(*) FILTER (o_orderpriority = '1-URGENT') AS positives, count(DISTINCT o_custkey) AS companies FROM orders UNION ALL SELECT 'closed', count(*), count(*) FILTER (o_orderstatus = 'F'), count(DISTINCT o_custkey) FROM orders")
def rp20(t):
    one = t.orders.agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.count_distinct("o_custkey").alias("companies"))
    return one.unpivot(["n_rows", "companies"], ["urgent", "closed"], "label", "positives")


@query("rp21_single_walk", f"WITH {PANEL} SELECT cn, m, charges, status FROM panel WHERE cn = 42 AND m BETWEEN 23960 AND 24000")
def rp21(t):
    return panel(t).filter("cn = 42 AND m BETWEEN 23960 AND 24000").select("cn", "m", "charges", "status").orderBy("m")


@query("rp22_lag_profile", "SELECT quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90, avg((d > 60)::INT) AS delayed FROM (SELECT datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def rp22(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.datediff("l_shipdate", "o_orderdate").alias("d"))
    return d.agg(F.percentile("d", 0.5).alias("median"), F.percentile("d", 0.9).alias("p90"), F.avg((F.col("d") > 60).cast("int")).alias("delayed"))


@query("rp23_row_normalised", "SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS f, count(*) FILTER (o_orderstatus = 'O')::DOUBLE / count(*) AS o FROM orders GROUP BY 1")
def rp23(t):
    p = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    whole = F.col("F") + F.col("O") + F.col("P")
    return p.select(F.col("o_orderpriority").alias("p"), (F.col("F") / whole).alias("f"), (F.col("O") / whole).alias("o"))


@query("rp24_uniform_sample", "SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE ('0x' || md5(l_orderkey::VARCHAR || '|' || l_partkey::VARCHAR || '|' || l_linenumber::VARCHAR)[1:8])::BIGINT / 4294967296.0 < 0.01")
def rp24(t):
    """A sampling operator: one row in a hundred by hash, without a sort."""
    from ..functions.numbers import bucket_share

    u = bucket_share(*[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber")])
    return t.lineitem.filter(u < 0.01).select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))


@query("rp25_priority_map", "SELECT p_partkey AS k, coalesce(CASE WHEN p_size > 45 THEN 'fast' END, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'section_a' WHEN p_type = 'LARGE' THEN 'section_b' END, 'none') AS sector FROM part")
def rp25(t):
    sections = t.spark.createDataFrame([("ECONOMY", "section_a"), ("SMALL", "section_a"), ("LARGE", "section_b")], "p_type string, section string")
    j = t.part.join(F.broadcast(sections), "p_type", "left")
    return j.select(F.col("p_partkey").alias("k"), F.coalesce(F.when(F.col("p_size") > 45, "fast"), "section", F.lit("none")).alias("sector"))


@query("rp_latest_month", f"WITH {PANEL} SELECT cn, m, charges FROM (SELECT *, row_number() OVER (PARTITION BY cn ORDER BY m DESC) AS rn FROM panel) WHERE rn = 1")
def rp_latest(t):
    w = Window.partitionBy("cn").orderBy(F.desc("m"))
    return panel(t).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("cn", "m", "charges")
