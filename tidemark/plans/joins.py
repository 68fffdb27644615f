"""Join queries (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum
from ..operators.asof import near_event
from ..operators.nearest import nearest
from .registry import query
from .standins import PANEL, panel


@query("j1_coalesced_lookups", "SELECT p_partkey AS k, coalesce(a.n_name, b.n_name, 'none') AS nation FROM part LEFT JOIN nation a ON p_size = a.n_nationkey LEFT JOIN nation b ON p_size % 10 = b.n_nationkey")
def j1(t):
    """Several lookups in one dimension of 25 rows, the first hit counts."""
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    a, b = n.toDF("a_key", "a_name"), n.toDF("b_key", "b_name")
    j = t.part.join(F.broadcast(a), F.col("p_size") == F.col("a_key"), "left").join(F.broadcast(b), F.col("p_size") % 10 == F.col("b_key"), "left")
    return j.select(F.col("p_partkey").alias("k"), F.coalesce("a_name", "b_name", F.lit("none")).alias("nation"))


@query("j2_semi", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j2(t):
    """J2 and J3: membership in a universe."""
    return t.customer.join(t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_custkey").alias("k"))


@query("j4_anti", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j4(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("k"))


@query("j5_j6_spine", f"WITH {PANEL}, months AS (SELECT DISTINCT m FROM panel WHERE m % 12 IN (0, 6)), u AS (SELECT DISTINCT cn FROM panel) SELECT u.cn, months.m, panel.charges, panel.cn IS NOT NULL AS present FROM u CROSS JOIN months LEFT JOIN panel ON panel.cn = u.cn AND panel.m = months.m")
def j5(t):
    """A dense spine by exploding the list of months beside each key, then the panel on (key, month). The lag queries need
    no spine; this is for output that must show absent months."""
    p = panel(t)
    months = F.array_sort(F.collect_set(F.when(F.col("m") % 12 % 6 == 0, F.col("m"))))
    spine = p.select("cn").distinct().crossJoin(F.broadcast(p.agg(months.alias("ms")))).select("cn", F.explode("ms").alias("m"))  # one row
    return spine.join(p.select("cn", "m", "charges"), ["cn", "m"], "left").select("cn", "m", "charges", F.col("charges").isNotNull().alias("present"))


@query("j9_within_months", "SELECT a.o_orderkey AS k FROM orders a WHERE a.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O' AND b.o_orderdate BETWEEN a.o_orderdate - INTERVAL 3 MONTH AND a.o_orderdate + INTERVAL 3 MONTH)")
def j9(t):
    """An interval join of existence: the nearest event on each side decides."""
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cn"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("s"))
    return o.withColumn("near", near_event(o, "cn", "d", F.col("s") == "O", 3)).filter("s = 'F' AND near").select("k")


@query("j10_range", "SELECT a.o_orderkey AS k, count(*) AS n FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 90 DAY GROUP BY 1")
def j10(t):
    """Events in the 90 days after each one, as a RANGE frame on days: no row is paired with another."""
    w = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.col("o_orderdate").cast("date"))).rangeBetween(1, 90)
    return t.orders.select(F.col("o_orderkey").alias("k"), F.count("*").over(w).alias("n")).filter("n > 0")


@query("j11_calendar_offset", f"WITH {PANEL} SELECT a.cn, a.m, b.charges AS then FROM panel a JOIN panel b ON a.cn = b.cn AND b.m = a.m + 6".replace("AS then", 'AS "then"'))
def j11(t):
    """The panel six months on, as a RANGE frame instead of a self-join."""
    w = Window.partitionBy("cn").orderBy("m").rangeBetween(6, 6)
    return panel(t).select("cn", "m", F.max("charges").over(w).alias("then")).filter(F.col("then").isNotNull())


@query("j12_exists_column", "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01' AND o_totalprice < 50000) AS small_2000s FROM customer")
def j12(t):
    hit = t.orders.filter((F.col("o_orderdate") >= "2000-01-01") & (F.col("o_totalprice") < 50000)).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return t.customer.join(hit, "c_custkey", "left").select(F.col("c_custkey").alias("k"), F.coalesce("hit", F.lit(False)).alias("small_2000s"))


@query("j13_sparse_chain", "SELECT c_custkey AS k, coalesce(a.n, 0)::BIGINT AS orders, coalesce(b.n, 0)::BIGINT AS urgent, c.last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON b.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) c ON c.o_custkey = c_custkey")
def j13(t):
    """Three sparse tables of one source, in one aggregate and one join."""
    g = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).cast("date").alias("last"))
    return t.customer.select("c_custkey").join(g, "c_custkey", "left").na.fill({"orders": 0, "urgent": 0}).select(F.col("c_custkey").alias("k"), "orders", "urgent", "last")


@query("j14_many_to_one", "WITH r AS (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1) SELECT o_orderkey AS k, rate FROM orders JOIN r USING (o_orderpriority)")
def j14(t):
    rates = t.orders.groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"))
    return t.orders.select("o_orderkey", "o_orderpriority").join(F.broadcast(rates), "o_orderpriority").select(F.col("o_orderkey").alias("k"), "rate")  # five rows


OLD = "(SELECT o_custkey AS cn, count(*)::BIGINT AS n FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1)"
NEWER = "(SELECT o_custkey AS cn, count(*)::BIGINT AS n FROM orders WHERE o_orderdate >= DATE '1998-06-01' GROUP BY 1)"


def old_and_new(t):
    o, d = t.orders.withColumnRenamed("o_custkey", "cn"), F.col("o_orderdate")
    return tuple(o.filter(c).groupBy("cn").agg(F.count("*").alias("n")) for c in (d < "1998-01-01", d >= "1998-06-01"))


@query("j15_full_outer_diff", f"SELECT coalesce(a.cn, b.cn) AS cn, CASE WHEN b.cn IS NULL THEN 'only_a' WHEN a.cn IS NULL THEN 'only_b' ELSE 'differs' END AS change FROM {OLD} a FULL JOIN {NEWER} b ON a.cn = b.cn WHERE a.n IS DISTINCT FROM b.n")
def j15(t):
    from ..operators.compare import changed_rows

    return changed_rows(*old_and_new(t), ["cn"])


@query("j16_outer_merge", f"SELECT coalesce(a.cn, b.cn) AS cn, a.n AS before, b.n AS after FROM {OLD} a FULL JOIN {NEWER} b ON a.cn = b.cn")
def j16(t):
    a, b = old_and_new(t)
    return a.withColumnRenamed("n", "before").join(b.withColumnRenamed("n", "after"), "cn", "full")


@query("j17_one_to_one_indicator", f"SELECT c_custkey AS cn, n, CASE WHEN n IS NULL THEN 'left_only' ELSE 'both' END AS source FROM customer LEFT JOIN {OLD} a ON a.cn = c_custkey")
def j17(t):
    from ..operators.compare import require_unique

    a = require_unique(old_and_new(t)[0], ["cn"])
    return t.customer.select(F.col("c_custkey").alias("cn")).join(a, "cn", "left").withColumn("source", F.when(F.col("n").isNull(), "left_only").otherwise("both"))


@query("j18_second_lookup", f"SELECT c_custkey AS cn, coalesce(b.n, a.n) AS n FROM customer LEFT JOIN {OLD} a ON a.cn = c_custkey LEFT JOIN {NEWER} b ON b.cn = c_custkey")
def j18(t):
    a, b = old_and_new(t)
    c = t.customer.select(F.col("c_custkey").alias("cn"))
    return c.join(a.withColumnRenamed("n", "x"), "cn", "left").join(b, "cn", "left").select("cn", F.coalesce("n", "x").alias("n"))


@query("j19_two_key_lookup", "SELECT l_orderkey AS k, count(*) AS n, count(s_suppkey) AS found FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = l_linenumber GROUP BY 1")
def j19(t):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("l_linenumber"), "s_name")
    j = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber").join(s, ["l_suppkey", "l_linenumber"], "left")
    return j.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count("s_name").alias("found"))


@query("j20_first_reached", f"WITH {PANEL}, c AS (SELECT cn, m, sum(charges) OVER (PARTITION BY cn ORDER BY m ROWS UNBOUNDED PRECEDING) AS total FROM panel), e AS (SELECT o_custkey AS cn, o_orderkey AS charge, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) SELECT e.cn, charge, min(m)::INTEGER AS first_m FROM e JOIN c ON c.cn = e.cn AND c.total >= e.r GROUP BY 1, 2")
def j20(t):
    """The first month whose running total reaches each charge's number: as totals only grow, each month holds the numbers
    above the last total, so the join is on equal numbers."""
    w = Window.partitionBy("cn").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    c = panel(t).withColumn("total", F.sum("charges").over(w)).withColumn("r", F.explode(F.sequence(F.col("total") - F.col("charges") + 1, F.col("total"))))
    e = t.orders.select(F.col("o_custkey").alias("cn"), F.col("o_orderkey").alias("charge"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("r"))
    return e.join(c.select("cn", "r", F.col("m").alias("first_m")), ["cn", "r"]).select("cn", "charge", "first_m")


@query("j21_eav_lookup", "WITH i AS (SELECT o_custkey AS cn, o_orderpriority AS id_type, max(o_orderkey) AS id_value FROM orders GROUP BY 1, 2) SELECT c_custkey AS cn, a.id_value AS urgent, b.id_value AS low FROM customer LEFT JOIN i a ON a.cn = c_custkey AND a.id_type = '1-URGENT' LEFT JOIN i b ON b.cn = c_custkey AND b.id_type = '5-LOW'")
def j21(t):
    """Two attributes of an entity-attribute-value table by one pivot."""
    p = t.orders.groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.max("o_orderkey")).toDF("cn", "urgent", "low")
    return t.customer.select(F.col("c_custkey").alias("cn")).join(p, "cn", "left")


@query("j23_scalar_subquery", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal::DECIMAL(18,2))::DOUBLE FROM customer)")
def j23(t):
    mean = t.customer.select((F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("m"))
    return t.customer.filter(F.col("c_acctbal") > mean.scalar()).select(F.col("c_custkey").alias("k"))


@query("j24_rank_in_population", "SELECT c_custkey AS k, (SELECT count(*) FROM customer b WHERE b.c_mktsegment = a.c_mktsegment AND b.c_acctbal > a.c_acctbal) + 1 AS standing FROM customer a")
def j24(t):
    """A correlated count of better rows is a rank."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"))
    return t.customer.select(F.col("c_custkey").alias("k"), F.rank().over(w).cast("long").alias("standing"))


@query("j_revenue_by_region", "SELECT r_name AS region, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j_revenue(t):
    """The whole star: lines are summed by order before they meet customers."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"), F.count("*").alias("n"))
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    j = lines.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").join(c, "o_custkey")
    return j.groupBy(F.col("r_name").alias("region")).agg(F.sum("v").cast("double").alias("revenue"), F.sum("n").alias("lines"))


@query("j_value_of_first_orders", "SELECT c_mktsegment AS sector, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j_value(t):
    return t.orders.select("o_custkey", "o_totalprice").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").groupBy(F.col("c_mktsegment").alias("sector")).agg(exact_sum(F.col("o_totalprice")).alias("v"))


@query("j3_in_subquery", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def j3(t):
    rich = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(rich, "l_suppkey", "left_semi").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))


@query("j6_key_and_month", f"WITH {PANEL} SELECT c_custkey AS cn, m, charges FROM customer LEFT JOIN panel ON panel.cn = c_custkey AND m = 23970")
def j6(t):
    return t.customer.select(F.col("c_custkey").alias("cn")).join(panel(t).filter("m = 23970").select("cn", "m", "charges"), "cn", "left")


@query("j22_block_join", "WITH a AS (SELECT s_suppkey AS id, s_name AS nm, s_nationkey AS block FROM supplier), b AS (SELECT c_custkey AS cn, replace(c_name, 'Customer', 'Supplier') AS nm, c_nationkey AS block FROM customer) SELECT id, cn, s FROM (SELECT id, cn, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, cn) AS rn FROM (SELECT id, cn, 1 - levenshtein(a.nm, b.nm)::DOUBLE / greatest(length(a.nm), length(b.nm)) AS s FROM a JOIN b USING (block)) WHERE s >= 0.9) WHERE rn = 1")
def j22(t):
    """The nearest name of the same block, never a product of the tables or of a block's names."""
    names = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nm"), F.col("s_nationkey").alias("block"))
    ref = t.customer.select(F.col("c_custkey").alias("r_cn"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("r_nm"), F.col("c_nationkey").alias("block"))
    found = nearest(names.select("block", "nm").distinct(), ref, ["block"], 0.9)
    return names.join(found, ["block", "nm"]).groupBy("id").agg(F.min_by("f", F.struct(-F.col("f.score"), "f.r_cn")).alias("f")).select("id", F.col("f.r_cn").alias("cn"), F.col("f.score").alias("s"))
