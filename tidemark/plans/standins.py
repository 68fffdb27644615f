"""Domain tables made from the driver's tables: the same relation as a DataFrame and as a SQL CTE.

company: customer. company-month panel: orders by customer and month. charge: an order's line, lender: its supplier.
award: a line of a contract (the order). notice: an event, its family by type. score: an account balance.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_number
from .registry import Tables

OURS = 7  # the nation whose suppliers are "ours"
AT = date(2024, 1, 31)  # the reference date of the notices
QUARTERS = [date(y, m, 28) for y in range(1996, 2002) for m in (3, 9)]  # a calendar of extract dates
HALVES = [date(y, m, d) for y in range(1996, 2002) for m, d in ((6, 30), (12, 31))]  # month ends


def dates_sql(days: list[date]) -> str:
    return ", ".join(f"(DATE '{d}')" for d in days)


def priority_tier(c: Column) -> Column:
    return F.when(c == "1-URGENT", 1).when(c == "2-HIGH", 2).when(c == "3-MEDIUM", 3).when(c == "4-NOT SPECIFIED", 4)


PANEL = """panel AS (
  SELECT o_custkey AS cn, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS m, count(*)::BIGINT AS charges,
         (count(*) FILTER (WHERE o_orderstatus = 'O'))::BIGINT AS outstanding, min(o_orderstatus) AS status, max(o_orderpriority) AS segment,
         CASE max(o_orderpriority) WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END::INTEGER AS tier,
         CASE WHEN max(o_orderstatus) <> 'F' THEN bool_or(o_orderpriority = '1-URGENT') END AS overdue
  FROM orders GROUP BY 1, 2)"""


def panel(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("cn"), month_number(F.col("o_orderdate")).alias("m"), "o_orderstatus", "o_orderpriority")
    # dealt by key first: (key, month) hardly repeats, so a partial aggregate would not shrink, and all windows by key that
    # follow find their rows in place
    return o.repartition("cn").groupBy("cn", "m").agg(
        F.count("*").alias("charges"), F.count_if(F.col("o_orderstatus") == "O").alias("outstanding"), F.min("o_orderstatus").alias("status"), F.max("o_orderpriority").alias("segment"),
        priority_tier(F.max("o_orderpriority")).alias("tier"), F.when(F.max("o_orderstatus") != "F", F.bool_or(F.col("o_orderpriority") == "1-URGENT")).alias("overdue"),
    )


REGISTER = """register AS (
  SELECT o_custkey AS cn, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS m, max(o_orderdate)::DATE AS source_date, count(*)::BIGINT AS charges,
         (count(*) FILTER (WHERE o_orderstatus = 'O'))::BIGINT AS outstanding, (count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS satisfied,
         round((count(*) FILTER (WHERE o_orderstatus = 'O')) / count(*), 2)::DOUBLE AS debt_ratio, min(o_orderstatus) AS status, max(o_orderstatus) <> 'F' AS is_active, max(o_orderpriority) AS segment,
         CASE max(o_orderpriority) WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END::INTEGER AS tier,
         CASE WHEN max(o_orderstatus) <> 'F' THEN bool_or(o_orderpriority = '1-URGENT') END AS overdue, CASE WHEN max(o_orderkey) % 11 > 0 THEN bool_or(o_totalprice > 200000) END AS stale,
         CASE WHEN max(o_orderkey) % 7 > 0 THEN 'S' || (max(o_orderkey) % 3) END AS sic, 'N' || (o_custkey % 10 + max(o_orderkey) % 2) AS name, CASE WHEN max(o_orderkey) % 5 > 0 THEN 'AB' || (max(o_orderkey) % 4) END AS postcode,
         CASE WHEN max(o_orderkey) % 6 = 0 THEN 'not given' ELSE strftime(max(o_orderdate)::DATE + (max(o_orderkey) % 300 - 100)::INTEGER, '%d/%m/%Y') END AS accounts_due_text,
         CASE WHEN max(o_orderkey) % 8 = 0 THEN '' ELSE strftime(max(o_orderdate)::DATE + (max(o_orderkey) % 90 - 45)::INTEGER, '%d/%m/%Y') END AS statement_due_text,
         CASE WHEN max(o_orderkey) % 9 > 0 THEN strftime(max(o_orderdate)::DATE - (max(o_orderkey) % 900)::INTEGER, '%d/%m/%Y') END AS accounts_made_text,
         CASE WHEN max(o_orderkey) % 10 > 0 THEN strftime(max(o_orderdate)::DATE - (max(o_orderkey) % 500)::INTEGER, '%d/%m/%Y') END AS statement_made_text
  FROM orders GROUP BY 1, 2)"""


def register(t: Tables) -> DataFrame:
    """What a register shows of a company each month: its dates are text, day first, some of them no dates."""
    o = t.orders.select(F.col("o_custkey").alias("cn"), month_number(F.col("o_orderdate")).alias("m"), "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    held = lambda s: F.count_if(F.col("o_orderstatus") == s)
    g = o.repartition("cn").groupBy("cn", "m").agg(
        F.max("o_orderdate").cast("date").alias("source_date"), F.count("*").alias("charges"), held("O").alias("outstanding"), held("F").alias("satisfied"), F.min("o_orderstatus").alias("status"), F.max("o_orderstatus").alias("_top"),
        F.max("o_orderpriority").alias("segment"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("_urgent"), F.bool_or(F.col("o_totalprice") > 200000).alias("_large"), F.max("o_orderkey").alias("_k"),
    )
    k, text = F.col("_k"), lambda c: c.cast("string")
    day = lambda n: F.date_format(F.date_add("source_date", n.cast("int")), "dd/MM/yyyy")
    told = {"accounts_due": F.when(k % 6 == 0, "not given").otherwise(day(k % 300 - 100)), "statement_due": F.when(k % 8 == 0, "").otherwise(day(k % 90 - 45)), "accounts_made": F.when(k % 9 > 0, day(-(k % 900))), "statement_made": F.when(k % 10 > 0, day(-(k % 500)))}
    return g.select(
        "cn", "m", "source_date", "charges", "outstanding", "satisfied", F.round(F.col("outstanding") / F.col("charges"), 2).alias("debt_ratio"), "status", (F.col("_top") != "F").alias("is_active"), "segment",
        priority_tier(F.col("segment")).alias("tier"), F.when(F.col("_top") != "F", F.col("_urgent")).alias("overdue"), F.when(k % 11 > 0, F.col("_large")).alias("stale"),
        F.when(k % 7 > 0, F.concat(F.lit("S"), text(k % 3))).alias("sic"), F.concat(F.lit("N"), text(F.col("cn") % 10 + k % 2)).alias("name"), F.when(k % 5 > 0, F.concat(F.lit("AB"), text(k % 4))).alias("postcode"),
        *[F.try_to_date(c, "dd/MM/yyyy").alias(x) for x, c in told.items()],
    )


CHARGES = f"""charges AS (
  SELECT o_custkey AS cn, l_orderkey AS charge, o_orderdate::DATE AS created, CASE WHEN l_linenumber % 3 > 0 THEN o_orderdate::DATE + l_linenumber END AS delivered,
         CASE WHEN l_returnflag = 'R' THEN o_orderdate::DATE + 200 END AS satisfied,
         CASE WHEN s_nationkey % 10 = 9 THEN 'unclassified' ELSE 'G' || (s_nationkey % 10) END AS lender, s_nationkey % 10 = {OURS} AS ours
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def charges(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    j = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag").join(o, "l_orderkey").join(s, "l_suppkey")
    group = F.col("s_nationkey") % 10
    return j.select(
        F.col("o_custkey").alias("cn"), F.col("l_orderkey").alias("charge"), F.col("day").alias("created"), F.when(F.col("l_linenumber") % 3 > 0, F.date_add("day", F.col("l_linenumber"))).alias("delivered"),
        F.when(F.col("l_returnflag") == "R", F.date_add("day", 200)).alias("satisfied"), F.when(group == 9, "unclassified").otherwise(F.concat(F.lit("G"), group.cast("string"))).alias("lender"), (group == OURS).alias("ours"),
    )


AWARDS = """awards AS (
  SELECT l_suppkey AS cn, l_orderkey AS contract, l_shipdate::DATE AS published, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS value FROM lineitem)"""


def awards(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("cn"), F.col("l_orderkey").alias("contract"), F.col("l_shipdate").cast("date").alias("published"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("value"))


FAMILIES = ("petition", "winding_up_order", "voluntary_liquidation", "administration", "creditor_process", "dividend", "closing", "petition_dismissed", "prohibited_name_reuse", "cross_border", "other_insolvency", "noise")
KINDS = {0: "Appointment of Administrative Receivers", 1: "Partnership: Petitions to Wind Up"}

NOTICES = f"""notices AS (
  SELECT user_id AS cn, CASE WHEN event_id % 3 > 0 THEN 'N' || (event_id % 5) END AS name, ({list(FAMILIES)})[(event_id * 7 + user_id) % 12 + 1] AS family, CASE event_id % 29 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in KINDS.items())} ELSE event_type END AS notice_type,
         ts::DATE AS notice_date, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL WHEN 2 THEN '1AB' ELSE 'ab' || (event_id % 90 + 10) || 'CD ' END AS postcode, lpad(event_id::VARCHAR, 12, '0') AS url FROM events)"""


def notices(t: Tables) -> DataFrame:
    e, n = t.events, F.col("event_id")
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), ((n * 7 + F.col("user_id")) % 12 + 1).cast("int"))
    kind = F.when(n % 29 == 0, KINDS[0]).when(n % 29 == 1, KINDS[1]).otherwise(F.col("event_type"))
    place = F.when(n % 5 == 0, " ").when(n % 5 == 1, F.lit(None)).when(n % 5 == 2, "1AB").otherwise(F.concat(F.lit("ab"), (n % 90 + 10).cast("string"), F.lit("CD ")))
    name = F.when(n % 3 > 0, F.concat(F.lit("N"), (n % 5).cast("string")))
    return e.select(F.col("user_id").alias("cn"), name.alias("name"), family.alias("family"), kind.alias("notice_type"), F.col("ts").cast("date").alias("notice_date"), place.alias("postcode"), F.lpad(n.cast("string"), 12, "0").alias("url"))


WIDE = """wide AS (
  SELECT c_custkey AS cn, c_name AS name, c_mktsegment AS sector, n_name AS nation, r_name AS region, c_acctbal AS score,
         CASE WHEN c_custkey % 5 > 0 THEN c_acctbal > 5000 END AS flag, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 3 END AS moves
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def wide(t: Tables) -> DataFrame:
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # 25 rows
    c, k = t.customer, F.col("c_custkey")
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(k.alias("cn"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("score"), F.when(k % 5 > 0, F.col("c_acctbal") > 5000).alias("flag"), F.when(k % 7 > 0, k % 3).alias("moves"))
