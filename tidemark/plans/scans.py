"""Source and sink queries (SC, SK): each writes with a sink, reads with a reader, and must give the table back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..sources.shared import fresh
from .registry import query

NATION = "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_mktsegment"]
CUSTOMER = "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer"


def as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("sc1_csv_strict", NATION)
def sc1(t):
    path = fresh(t.spark, "sc1")
    t.nation.write.option("header", True).csv(path)
    return readers.csv(t.spark, path)


@query("sc2_csv_lenient", CUSTOMER)
def sc2(t):
    """SC2 and SC3: an ordinary lazy scan; a malformed line is dropped, not fatal."""
    path = fresh(t.spark, "sc2")
    t.customer.select(*CUSTOMER_COLUMNS).write.option("header", True).csv(path)
    return readers.csv(t.spark, path, strict=False)


@query("sc4_stripped_projection", "SELECT c_mktsegment, c_custkey::VARCHAR AS c_custkey, NULL::VARCHAR AS absent FROM customer")
def sc4(t):
    path = fresh(t.spark, "sc4")
    t.customer.select(F.col("c_custkey").alias(" c_custkey"), F.col("c_name"), F.col("c_mktsegment").alias("c_mktsegment ")).write.option("header", True).csv(path)
    return readers.csv(t.spark, path, ["c_mktsegment", "c_custkey", "absent"])


@query("sc5_utf16_pipes", CUSTOMER)
def sc5(t):
    """Pipes in UTF-16 inside zip files, a file a task."""
    path = fresh(t.spark, "sc5")
    sinks.zipped_csv(as_text(t.customer.select(*CUSTOMER_COLUMNS)).repartition(3), path, "|", "utf-16")
    return readers.zipped_csv(t.spark, path, CUSTOMER_COLUMNS, sep="|", encoding="utf-16")


@query("sc6_zipped_csv", "SELECT p_name, p_partkey::VARCHAR AS p_partkey, NULL::VARCHAR AS absent FROM part")
def sc6(t):
    path = fresh(t.spark, "sc6")
    sinks.zipped_csv(as_text(t.part.select("p_partkey", "p_name", "p_brand")).repartition(2), path)
    return readers.zipped_csv(t.spark, path, ["p_name", "p_partkey", "absent"])


@query("sc7_parquet_glob", "SELECT * FROM orders")
def sc7(t):
    path = fresh(t.spark, "sc7")
    t.orders.write.parquet(f"{path}/a")
    return readers.parquet(t.spark, f"{path}/*")


@query("sc8_union_by_name", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, (o_orderkey % 2)::INTEGER AS part FROM orders")
def sc8(t):
    path = fresh(t.spark, "sc8")
    o = t.orders
    o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderstatus").write.parquet(f"{path}/part=0")
    o.filter("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey").write.parquet(f"{path}/part=1")
    return readers.parquet(t.spark, path, merge=True).select("o_orderkey", "o_custkey", "o_orderstatus", "part")


@query("sc9_one_partition", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def sc9(t):
    """SK1 too: a write by partition folder; the filter reads one folder only."""
    path = fresh(t.spark, "sc9")
    sinks.partitioned(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return readers.parquet(t.spark, path).filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("sc10_ndjson", "SELECT event_id, user_id, value FROM events")
def sc10(t):
    path = fresh(t.spark, "sc10")
    t.events.select("event_id", "user_id", "value").write.json(path)
    return readers.ndjson(t.spark, path, "event_id bigint, user_id bigint, value double")


@query("sc11_gzipped_lines", "SELECT event_id, event_type FROM events")
def sc11(t):
    path = fresh(t.spark, "sc11")
    t.events.select("event_id", "event_type").write.option("compression", "gzip").json(path)
    return readers.ndjson(t.spark, f"{path}/*.gz", "event_id bigint, event_type string")


@query("sc12_object_or_list", "SELECT event_id AS k, (props::JSON ->> 'k')::BIGINT AS v FROM events UNION ALL SELECT event_id, (props::JSON ->> 'k')::BIGINT FROM events WHERE event_id % 2 = 0")
def sc12(t):
    """An object stands for a list of one."""
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).otherwise(F.col("props"))
    return t.events.select(F.col("event_id").alias("k"), F.explode(readers.listed(raw, "struct<k:bigint>")).alias("x")).select("k", F.col("x.k").alias("v"))


@query("sc13_xml", "SELECT p_partkey, p_name, p_size FROM part")
def sc13(t):
    path = fresh(t.spark, "sc13")
    t.part.select("p_partkey", "p_name", "p_size").write.format("xml").option("rowTag", "part").option("rootTag", "parts").save(path)
    return readers.xml(t.spark, path, "part", "p_partkey bigint, p_name string, p_size int")


@query("sc14_html_rows", "SELECT p_partkey AS k, p_name AS name, p_brand AS brand FROM part")
def sc14(t):
    html = F.concat(F.lit("<table><tr><th>only</th></tr><tr class='x'><td>"), "p_name", F.lit("</td>\n<TD><b>"), "p_brand", F.lit("</b></TD></tr></table>"))
    return t.part.select(F.col("p_partkey").alias("k"), F.explode(readers.html_rows(html, 2)).alias("r")).select("k", F.get("r", F.lit(0)).alias("name"), F.get("r", F.lit(1)).alias("brand"))


@query("sc15_carried_header", "SELECT o_custkey AS doc, o_orderkey AS line, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS section FROM orders QUALIFY o_orderpriority <> '1-URGENT'")
def sc15(t):
    lines = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("line"), (F.col("o_orderpriority") == "1-URGENT").alias("h"))
    return readers.carry_header(lines, "line", F.col("h"), F.col("line"), "doc").drop("h")


@query("sc16_registered_view", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc16(t):
    """SC16 and SK7: tables under names that SQL can use."""
    return t.spark.sql("SELECT n_name AS name, r_name AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey", nation=t.nation, region=t.region)


@query("sc17_values", "SELECT * FROM (VALUES (DATE '2026-01-01', DATE '2026-02-01'), (DATE '2026-02-01', DATE '2026-03-02')) t(snapshot_date, source_date)")
def sc17(t):
    return t.spark.sql("SELECT * FROM VALUES (DATE '2026-01-01', DATE '2026-02-01'), (DATE '2026-02-01', DATE '2026-03-02') AS t(snapshot_date, source_date)")


@query("sc18_series", "SELECT unnest(generate_series(DATE '2023-11-01', DATE '2026-07-01', INTERVAL 1 MONTH))::DATE AS m")
def sc18(t):
    return readers.calendar(t.spark, "2023-11-01", "2026-07-01")


@query("sk2_one_file", "SELECT c_mktsegment AS sector, count(*) AS n FROM customer GROUP BY 1")
def sk2(t):
    path = fresh(t.spark, "sk2")
    sinks.one_file(t.customer.groupBy(F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("n")), path)
    return t.spark.read.parquet(path)


@query("sk3_ordered_csv", NATION)
def sk3(t):
    path = fresh(t.spark, "sk3")
    sinks.ordered_csv(as_text(t.nation), path, "n_name", "n_nationkey")
    return readers.csv(t.spark, path)


@query("sk4_resumed_append", "SELECT user_id, event_id FROM events")
def sk4(t):
    """A harvest that stopped half way goes on with the keys that are not written yet."""
    path = fresh(t.spark, "sk4")
    e = t.events.select("user_id", "event_id")
    sinks.append_ndjson(e.filter("user_id % 2 = 0"), path)
    done = readers.ndjson(t.spark, path, "user_id bigint, event_id bigint")
    rest = e.join(sinks.pending(e.select("user_id").distinct(), done, "user_id"), "user_id", "left_semi")
    sinks.append_ndjson(rest.select("user_id", "event_id"), path)
    return readers.ndjson(t.spark, path, "user_id bigint, event_id bigint")


@query("sk5_once", "SELECT r_regionkey, r_name FROM region")
def sk5(t):
    """The second call finds the first one's result and computes nothing."""
    path = fresh(t.spark, "sk5")
    sinks.once(lambda: t.region.select("r_regionkey", "r_name"), t.spark, path)
    return sinks.once(lambda: t.region.filter("1 = 0").select("r_regionkey", "r_name"), t.spark, path)


@query("sk9_run_record", "SELECT 'run' AS tag, count(*) AS n FROM orders")
def sk9(t):
    path = fresh(t.spark, "sk9")
    sinks.record(t.orders.agg(F.lit("run").alias("tag"), F.count("*").alias("n")), path)
    return t.spark.read.schema("tag string, n bigint").json(path)


@query("sc3_filtered_scan", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def sc3(t):
    """What a chunked reader filters chunk by chunk is a lazy scan with a filter pushed to it."""
    path = fresh(t.spark, "sc3")
    t.customer.select(*CUSTOMER_COLUMNS).write.option("header", True).csv(path)
    return readers.csv(t.spark, path, CUSTOMER_COLUMNS).filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@query("sk1_dynamic_overwrite", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS version FROM orders")
def sk1(t):
    """A second write of one partition leaves the others as they are."""
    path = fresh(t.spark, "sk1")
    o = t.orders.select("o_orderkey", "o_orderstatus")
    sinks.partitioned(o.withColumn("version", F.lit(1)), path, ["o_orderstatus"])
    sinks.partitioned(o.filter("o_orderstatus = 'F'").withColumn("version", F.lit(0)), path, ["o_orderstatus"])
    return t.spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "version")


@query("sk7_temporary_table", "SELECT o_custkey AS cn, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def sk7(t):
    """A table kept for several uses: written once, then read under a name."""
    path = fresh(t.spark, "sk7")
    t.orders.groupBy(F.col("o_custkey").alias("cn")).agg(F.count("*").alias("n")).write.parquet(path)
    return t.spark.sql("SELECT cn, n FROM {counts} WHERE n > 12", counts=t.spark.read.parquet(path))
