"""Set and comparison (ST), nested (NS) and entity resolution (ER) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import company_name, postcode
from ..operators.asof import first_n
from ..operators.compare import changed_rows, differences
from ..operators.events import append_new, cross_source_dedup, upsert_by
from ..operators.matching import best_per_entity, ladder, precision, resolve, two_tier, unique_candidates, verify_articles
from ..operators.nearest import similarity
from .registry import query

# ---- sets


@query("st2_concat", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def st2(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


def two_versions(t):
    p = t.part.select("p_partkey", "p_brand", "p_size")
    return p.filter("p_partkey % 11 > 0"), p.filter("p_partkey % 13 > 0").withColumn("p_size", F.when(F.col("p_partkey") % 17 == 0, None).otherwise(F.col("p_size")))


A, B = "(SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 11 > 0)", "(SELECT p_partkey, p_brand, CASE WHEN p_partkey % 17 > 0 THEN p_size END AS p_size FROM part WHERE p_partkey % 13 > 0)"


@query("st3_differences", f"SELECT *, 'a' AS side FROM (FROM {A} EXCEPT ALL FROM {B}) UNION ALL SELECT *, 'b' FROM (FROM {B} EXCEPT ALL FROM {A})")
def st3(t):
    return differences(*two_versions(t))


@query("st4_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def st4(t):
    by = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return by("F").intersect(by("P"))


@query("st5_new_dropped_common", f"SELECT CASE WHEN b.p_partkey IS NULL THEN 'dropped' WHEN a.p_partkey IS NULL THEN 'new' ELSE 'common' END AS what, count(*) AS n FROM {A} a FULL JOIN {B} b ON a.p_partkey = b.p_partkey GROUP BY 1")
def st5(t):
    a, b = (x.select("p_partkey").withColumn(c, F.lit(True)) for x, c in zip(two_versions(t), "ab", strict=True))
    return a.join(b, "p_partkey", "full").groupBy(F.when(F.col("b").isNull(), "dropped").when(F.col("a").isNull(), "new").otherwise("common").alias("what")).agg(F.count("*").alias("n"))


@query("st6_changed_rows", f"SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'only_b' WHEN b.p_partkey IS NULL THEN 'only_a' ELSE 'differs' END AS change FROM {A} a FULL JOIN {B} b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_brand IS DISTINCT FROM b.p_brand OR a.p_size IS DISTINCT FROM b.p_size")
def st6(t):
    return changed_rows(*two_versions(t), ["p_partkey"])


@query("st7_transitions", "WITH x AS (SELECT o_custkey, o_orderstatus AS s, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT s AS was, count(*) FILTER (n = 'F') AS f, count(*) FILTER (n = 'O') AS o, count(*) FILTER (n = 'P') AS p FROM x WHERE n IS NOT NULL GROUP BY 1")
def st7(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t.orders.withColumn("n", F.lead("o_orderstatus").over(w)).filter("n IS NOT NULL")
    return x.groupBy("o_orderstatus").pivot("n", ["F", "O", "P"]).count().na.fill(0).toDF("was", "f", "o", "p")


@query("st8_dedupe", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def st8(t):
    from ..operators.asof import primary

    return primary(t.lineitem, ["l_orderkey", "l_linenumber"], [F.asc(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("st9_cross_source_dedup", "WITH r AS (SELECT user_id AS cn, event_type AS source, round(value / 10) AS v, ts::DATE AS d, event_id FROM events), w AS (SELECT *, min({'d': d, 's': source}) OVER (PARTITION BY cn, v) AS first FROM r) SELECT cn, source, v, event_id FROM w WHERE source = first.s")
def st9(t):
    r = t.events.select(F.col("user_id").alias("cn"), F.col("event_type").alias("source"), F.round(F.col("value") / 10).alias("v"), F.col("ts").cast("date").alias("d"), "event_id")
    return cross_source_dedup(r, ["cn", "v"], "source", "d").drop("d")


@query("sk6_replace_by_source", "SELECT event_type AS source, event_id, value FROM events WHERE event_type <> 'click' UNION ALL SELECT 'click', event_id, -value FROM events WHERE event_type = 'click' AND event_id % 2 = 0")
def sk6(t):
    e = t.events.select(F.col("event_type").alias("source"), "event_id", "value")
    return upsert_by(e, e.filter("source = 'click' AND event_id % 2 = 0").withColumn("value", -F.col("value")))


@query("sk8_append_new", "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY 1")
def sk8(t):
    e = t.events.select("user_id", "event_id", "event_type")
    have = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return append_new(have, e.filter("event_type = 'error'").select("user_id", "event_id"), ["user_id"])


# ---- nested


def order_documents(t):
    """One document an order, its lines as an array of structs (null for orders without lines)."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("nr"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("value")))).alias("lines"))
    return t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("ns1_explode", "SELECT l_orderkey AS k, l_suppkey AS supplier, l_extendedprice AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def ns1(t):
    """NS1 and NS3."""
    return order_documents(t).select(F.col("o_orderkey").alias("k"), F.explode("lines").alias("l")).select("k", "l.supplier", "l.value")


@query("ns2_keep_parents", "SELECT o_orderkey AS k, l_suppkey AS supplier FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 9 > 0 OR l_orderkey IS NULL")
def ns2(t):
    """A null list keeps its parent, an empty one does not."""
    d = order_documents(t).withColumn("s", F.when(F.col("o_orderkey") % 9 > 0, F.transform("lines", lambda x: x["supplier"])).when(F.col("lines").isNotNull(), F.array().cast("array<bigint>")))
    return d.filter(F.col("s").isNull() | (F.size("s") > 0)).select(F.col("o_orderkey").alias("k"), F.explode_outer("s").alias("supplier"))


@query("ns4_party_index", "SELECT o_orderkey AS k, l_suppkey AS party, s_name AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 10 GROUP BY ALL")
def ns4(t):
    parties = order_documents(t).select("o_orderkey", F.explode(F.array_distinct(F.transform("lines", lambda x: x["supplier"]))).alias("party"))
    named = t.supplier.filter("s_nationkey < 10").select(F.col("s_suppkey").alias("party"), F.col("s_name").alias("name"))
    return parties.join(named, "party").select(F.col("o_orderkey").alias("k"), "party", "name")


@query("ns5_value_share", "WITH n AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1) SELECT l_orderkey AS k, l_suppkey AS supplier, v / n AS share FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN n USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey")
def ns5(t):
    d = order_documents(t).filter("lines IS NOT NULL")
    suppliers = F.array_distinct(F.transform("lines", lambda x: x["supplier"]))
    value = F.aggregate("lines", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["value"].cast("decimal(18,2)")).cast("decimal(28,2)")).cast("double")
    return d.select(F.col("o_orderkey").alias("k"), (value / F.size(suppliers)).alias("share"), F.explode(suppliers).alias("supplier"))


def order_contracts(t):
    """Documents as harvested: an order with contracts (some without a value) and awards, an award with its suppliers."""
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    by_award = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("award"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("value"))).alias("contracts"),
        F.struct(F.col("l_linenumber").alias("id"), F.max("l_quantity").alias("value"), F.array_sort(F.collect_set("l_suppkey")).alias("suppliers")).alias("award"),
    )
    return by_award.groupBy(F.col("l_orderkey").alias("k")).agg(F.flatten(F.collect_list("contracts")).alias("contracts"), F.collect_list("award").alias("awards"))


@query("ns6_within_document", """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS award, l_suppkey AS supplier, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS own, l_quantity AS stated FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT k, award, max(stated) AS award_value, list_sort(list_distinct(list(supplier))) AS suppliers FROM c GROUP BY 1, 2)
SELECT c.k, c.award, coalesce(c.own, a.award_value * 1000) AS value, unnest(a.suppliers) AS supplier FROM c JOIN a ON a.k = c.k AND a.award = c.award""")
def ns6(t):
    """Contracts find their award by its id inside the same document, and with it their suppliers; a contract without a value
    takes the award's. The document's awards are a map by id, so nothing is shuffled."""
    d = order_contracts(t)
    named = F.map_from_entries(F.transform("awards", lambda a: F.struct(a["id"], a)))
    each = d.select("k", named.alias("awards"), F.explode("contracts").alias("c"))
    award = F.try_element_at("awards", F.col("c.award"))
    return each.select("k", F.col("c.award").alias("award"), F.coalesce("c.value", award["value"] * 1000).alias("value"), F.explode(award["suppliers"]).alias("supplier"))


@query("ns7_roles", "SELECT o_orderkey AS k, 'buyer' AS role, o_custkey AS party FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'supplier', l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def ns7(t):
    d = order_documents(t)
    buyers = d.select(F.col("o_orderkey").alias("k"), F.lit("buyer").alias("role"), F.col("o_custkey").alias("party"))
    return buyers.unionByName(d.select(F.col("o_orderkey").alias("k"), F.lit("supplier").alias("role"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["supplier"]))).alias("party")))


@query("ns8_array_summary", "SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_linenumber > 3) AS late, max(l_extendedprice) AS largest, bool_or(l_suppkey = 7) AS has_7 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def ns8(t):
    d = order_documents(t).filter("lines IS NOT NULL")
    return d.select(F.col("o_orderkey").alias("k"), F.size("lines").cast("bigint").alias("n"), F.size(F.filter("lines", lambda x: x["nr"] > 3)).cast("bigint").alias("late"), F.array_max(F.transform("lines", lambda x: x["value"])).alias("largest"), F.exists("lines", lambda x: x["supplier"] == 7).alias("has_7"))


@query("ns9_json_flatten", "SELECT event_id AS k, 'k' AS name, (props::JSON ->> 'k')::BIGINT AS value FROM events")
def ns9(t):
    return t.events.select(F.col("event_id").alias("k"), F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "value"))


@query("ns10_long_to_wide", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id AS cn, max(event_id) FILTER (r = 1) AS first, max(event_id) FILTER (r = 2) AS second, max(event_id) FILTER (r = 3) AS third FROM r GROUP BY 1")
def ns10(t):
    e = first_n(t.events, ["user_id"], [F.desc("value"), F.asc("event_id")], 3)
    return e.groupBy(F.col("user_id").alias("cn")).agg(*[F.max(F.when(F.col("nth") == n, F.col("event_id"))).alias(a) for n, a in enumerate(("first", "second", "third"), 1)])


# ---- entity resolution: a register of names with a few that several entities share, and rows to be matched


REGISTER = "reg AS (SELECT c_custkey AS cn, 'FIRM ' || (CASE WHEN c_custkey % 10 = 0 THEN c_custkey // 20 ELSE c_custkey END) || ' ' || c_mktsegment AS nm, CASE WHEN c_custkey % 6 > 0 THEN 'AB' || (c_custkey % 50) || 'CD' END AS pc FROM customer)"
ROWS = "r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS number, 'FIRM ' || (CASE WHEN o_custkey % 10 = 0 THEN o_custkey // 20 ELSE o_custkey END) || ' ' || c_mktsegment || (CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE '' END) AS nm, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ZZ99' ELSE 'AB' || (o_custkey % 50) || 'CD' END AS pc, o_custkey AS true_cn FROM orders JOIN customer ON c_custkey = o_custkey)"


def firm(key, sector):
    return F.concat(F.lit("FIRM "), F.when(key % 10 == 0, F.floor(key / 20)).otherwise(key).cast("string"), F.lit(" "), sector)


def code(key):
    return F.concat(F.lit("AB"), (key % 50).cast("string"), F.lit("CD"))


def register(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("cn"), firm(k, F.col("c_mktsegment")).alias("nm"), F.when(k % 6 > 0, code(k)).alias("pc"))


def rows(t):
    k = F.col("c_custkey")  # a customer's name is made once, not for each order
    j = t.orders.join(t.customer.select(k.alias("o_custkey"), firm(k, F.col("c_mktsegment")).alias("c_nm")), "o_custkey")
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    return j.select(i.alias("id"), F.when(i % 7 == 0, c).alias("number"), F.concat("c_nm", F.when(i % 9 == 0, "X").otherwise("")).alias("nm"), F.when(i % 4 == 0, None).when(i % 4 == 1, "ZZ99").otherwise(code(c)).alias("pc"), c.alias("true_cn"))


@query("er1_reference", "SELECT DISTINCT c_custkey AS cn, upper(c_name) AS nm, CASE WHEN c_custkey % 2 = 0 THEN 'AB1CD' END AS pc FROM customer")
def er1(t):
    k = F.col("c_custkey")
    raw = F.regexp_replace("c_name", "#", "")
    return t.customer.select(k.alias("cn"), F.concat(F.substring(company_name(raw), 1, 8), F.lit("#"), F.substring(company_name(raw), 9, 20)).alias("nm"), postcode(F.when(k % 2 == 0, "ab1 cd").otherwise("nan")).alias("pc")).distinct()


@query("er2_unique_candidates", f"WITH {REGISTER} SELECT nm, pc, min(cn) AS cn FROM reg WHERE nm IS NOT NULL AND pc IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT cn) = 1")
def er2(t):
    return unique_candidates(register(t), ["nm", "pc"])


@query("er3_resolve_in_universe", f"WITH {REGISTER}, {ROWS}, u AS (SELECT nm, pc, min(cn) AS cn FROM reg WHERE pc IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT cn) = 1) SELECT id, CASE WHEN u.cn % 3 > 0 THEN u.cn END AS cn FROM r LEFT JOIN u ON u.nm = r.nm AND u.pc = r.pc")
def er3(t):
    universe = register(t).filter("cn % 3 > 0").select("cn")
    return resolve(rows(t), register(t), ["nm", "pc"], universe).select("id", "cn")


@query("er4_precision", f"WITH {REGISTER}, {ROWS}, a AS (SELECT nm, min(cn) AS cn FROM reg GROUP BY 1 HAVING count(DISTINCT cn) = 1), b AS (SELECT nm, pc, min(cn) AS cn FROM reg WHERE pc IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT cn) = 1) SELECT 'name' AS strategy, count(*) AS n, count(a.cn) AS matched, count(*) FILTER (a.cn = true_cn) AS \"right\" FROM r LEFT JOIN a USING (nm) UNION ALL SELECT 'name_postcode', count(*), count(b.cn), count(*) FILTER (b.cn = true_cn) FROM r LEFT JOIN b ON b.nm = r.nm AND b.pc = r.pc")
def er4(t):
    return precision(rows(t), register(t), {"name": ["nm"], "name_postcode": ["nm", "pc"]})


LADDER = f"""WITH {REGISTER}, {ROWS}, m AS (SELECT nm, min(cn) AS lo, max(cn) AS hi FROM reg GROUP BY 1), b AS (SELECT nm, pc, min(cn) AS lo, max(cn) AS hi FROM reg WHERE pc IS NOT NULL GROUP BY 1, 2),
f AS (SELECT id, cn, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, cn) AS rn FROM (SELECT r.id, g.cn, 1 - levenshtein(r.nm, g.nm)::DOUBLE / greatest(length(r.nm), length(g.nm)) AS s FROM r JOIN reg g ON g.pc = r.pc AND split_part(g.nm, ' ', 1) = split_part(r.nm, ' ', 1) WHERE r.nm NOT IN (SELECT nm FROM m) AND (r.number IS NULL OR r.number NOT IN (SELECT cn FROM reg))) WHERE s >= 0.9),
x AS (SELECT r.*, n.cn AS n_cn, m.lo AS m_lo, m.hi AS m_hi, b.lo AS b_lo, b.hi AS b_hi, f.cn AS f_cn, f.s FROM r LEFT JOIN (SELECT DISTINCT cn FROM reg) n ON n.cn = r.number LEFT JOIN m ON m.nm = r.nm LEFT JOIN b ON b.nm = r.nm AND b.pc = r.pc LEFT JOIN f ON f.id = r.id AND f.rn = 1),
l AS (SELECT id, CASE WHEN n_cn IS NOT NULL THEN 'number' WHEN b_lo = b_hi THEN 'exact' WHEN m_lo IS NOT NULL AND pc IS NOT NULL THEN 'rejected' WHEN m_lo = m_hi THEN 'unconfirmed' WHEN m_lo IS NOT NULL THEN 'ambiguous' WHEN f_cn IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method, n_cn, b_lo, m_lo, f_cn, s FROM x),
ladder AS (SELECT id, CASE method WHEN 'number' THEN n_cn WHEN 'exact' THEN b_lo WHEN 'unconfirmed' THEN m_lo WHEN 'fuzzy' THEN f_cn END AS cn, CASE method WHEN 'number' THEN 1.0 WHEN 'exact' THEN 0.95 WHEN 'unconfirmed' THEN 0.6 WHEN 'fuzzy' THEN round(s * 0.9, 6) END::DOUBLE AS confidence, method FROM l)"""


@query("er5_ladder", f"{LADDER} SELECT id, cn, confidence, method FROM ladder")
def er5(t):
    """ER5 and J22: number, name with postcode, name alone, near names of one block; a contradiction ends the ladder."""
    return ladder(rows(t), register(t))


@query("er7_best_per_entity", f"{LADDER} SELECT cn, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY cn ORDER BY confidence DESC, id) AS rn FROM ladder WHERE cn IS NOT NULL) WHERE rn = 1")
def er7(t):
    return best_per_entity(ladder(rows(t), register(t)).select("cn", "id", "confidence"))


@query("er8_two_tier_keys", f"WITH {REGISTER}, {ROWS}, g AS (SELECT *, substr(pc, 1, 3) AS area FROM reg), q AS (SELECT *, substr(pc, 1, 3) AS area FROM r), a AS (SELECT nm, pc, min(cn) AS cn FROM g WHERE pc IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT cn) = 1), b AS (SELECT nm, area, min(cn) AS cn FROM g WHERE area IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT cn) = 1) SELECT id, coalesce(a.cn, b.cn) AS cn, CASE WHEN a.cn IS NOT NULL THEN 0.9 WHEN b.cn IS NOT NULL THEN 0.8 END::DOUBLE AS confidence FROM q LEFT JOIN a ON a.nm = q.nm AND a.pc = q.pc LEFT JOIN b ON b.nm = q.nm AND b.area = q.area")
def er8(t):
    """ER6, ER8 and ER9: the full postcode first, then its area."""
    area = F.substring("pc", 1, 3)
    return two_tier(rows(t).withColumn("area", area), register(t).withColumn("area", area), "nm", [("pc", 0.9), ("area", 0.8)]).select("id", "cn", "confidence")


@query("er10_crosswalk_append", f"WITH {REGISTER} SELECT DISTINCT s_suppkey AS cn, 'name' AS id_type, s_name AS id_value FROM supplier WHERE s_suppkey IN (SELECT cn FROM reg WHERE cn % 2 = 0) UNION SELECT cn, 'postcode', pc FROM reg WHERE pc IS NOT NULL")
def er10(t):
    names = t.supplier.select(F.col("s_suppkey").alias("cn"), F.lit("name").alias("id_type"), F.col("s_name").alias("id_value")).join(register(t).filter("cn % 2 = 0").select("cn"), "cn", "left_semi")
    return names.unionByName(register(t).filter("pc IS NOT NULL").select("cn", F.lit("postcode").alias("id_type"), F.col("pc").alias("id_value"))).distinct()


@query("er11_coverage", f"{LADDER} SELECT method, count(*) AS n, count(DISTINCT cn) AS entities FROM ladder GROUP BY 1")
def er11(t):
    return ladder(rows(t), register(t)).groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("cn").alias("entities"))


ARTICLES = """a AS (SELECT doc_id AS k, source, lower(substr(text, 1, 400)) AS summary, lower(text) AS body, CASE doc_id % 5 WHEN 0 THEN 'license' WHEN 1 THEN 'the' WHEN 2 THEN 'mit license' ELSE lower(split_part(text, ' ', 3)) || ' ' || lower(split_part(text, ' ', 4)) END AS name,
  CASE WHEN doc_id % 3 > 0 THEN lower(split_part(text, ' ', 40)) END AS town, lang AS sector FROM documents WHERE text IS NOT NULL)"""


def whole(text: str, phrase: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_-])' || regexp_escape({phrase}) || '([^\\p{{L}}\\p{{N}}_-]|$)')"


KEYWORDS = {"en": ["tion", "and"], "de": ["und", "der"]}
CONTEXT = ["license", "copyright"]
VERIFIED = f"""{ARTICLES}, f AS (SELECT k, source, {whole('summary', 'name')} AS phrase, coalesce(length(town) > 1 AND {whole('body', 'town')}, FALSE) AS town, CASE sector {' '.join(f"WHEN '{s}' THEN {' OR '.join(whole('body', repr(w)) for w in ws)}" for s, ws in KEYWORDS.items())} ELSE FALSE END AS sector,
  {' OR '.join(f"contains(body, '{w}')" for w in CONTEXT)} AS context, len(regexp_extract_all(name, '[a-z0-9]+')) <= 1 AS single_word, name IN ('the', 'and') AS unsearchable FROM a),
v AS (SELECT *, NOT unsearchable AND phrase AND (town OR sector OR context) AS verified FROM f)"""


def articles(t):
    k, low = F.col("doc_id"), F.lower("text")
    word = lambda n: F.lower(F.split_part("text", F.lit(" "), F.lit(n)))
    name = F.when(k % 5 == 0, "license").when(k % 5 == 1, "the").when(k % 5 == 2, "mit license").otherwise(F.concat_ws(" ", word(3), word(4)))
    d = t.documents.filter(F.col("text").isNotNull()).select(k.alias("k"), "source", F.substring(low, 1, 400).alias("summary"), low.alias("body"), name.alias("name"), F.when(k % 3 > 0, word(40)).alias("town"), F.col("lang").alias("sector"))
    return verify_articles(d, KEYWORDS, CONTEXT, ["the", "and"])


@query("er12_verify_text", f"WITH {VERIFIED} SELECT * EXCLUDE (source) FROM v")
def er12(t):
    """A name that stands alone in the summary, with its town, a word of its sector or of business anywhere."""
    return articles(t).drop("source")


@query("er13_kept_and_rejected", f"WITH {VERIFIED} SELECT source, count(*) FILTER (verified) AS kept, count(*) FILTER (NOT verified) AS rejected, array_to_string((list(k ORDER BY k) FILTER (verified))[1:3], ', ') AS first3 FROM v GROUP BY 1")
def er13(t):
    v = articles(t)
    counts = v.groupBy("source").agg(F.count_if("verified").alias("kept"), F.count_if(~F.col("verified")).alias("rejected"))
    some = first_n(v.filter("verified"), ["source"], [F.asc("k")], 3).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), ", ").alias("first3"))
    return counts.join(some, "source", "left")


@query("er_similarity", "SELECT p_partkey AS k, 1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)) AS s FROM part")
def er_similarity(t):
    return t.part.select(F.col("p_partkey").alias("k"), similarity(F.col("p_name"), F.col("p_type")).alias("s"))


@query("st1_tagged_union", "SELECT 'customer' AS kind, count(*) AS n, max(c_acctbal) AS most FROM customer UNION ALL SELECT 'supplier', count(*), max(s_acctbal) FROM supplier")
def st1(t):
    each = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.max(c).alias("most")) for k, df, c in (("customer", t.customer, "c_acctbal"), ("supplier", t.supplier, "s_acctbal"))]
    return each[0].unionByName(each[1])


@query("er6_area_ladder", f"WITH {REGISTER}, {ROWS}, m AS (SELECT nm, substr(pc, 1, 3) AS area, min(cn) AS lo, max(cn) AS hi FROM reg WHERE pc IS NOT NULL GROUP BY 1, 2), a AS (SELECT nm, min(cn) AS lo, max(cn) AS hi FROM reg GROUP BY 1) SELECT id, CASE WHEN m.lo = m.hi THEN m.lo WHEN r.pc IS NULL AND a.lo = a.hi THEN a.lo END AS cn, CASE WHEN m.lo = m.hi THEN 0.8 WHEN r.pc IS NULL AND a.lo = a.hi THEN 0.45 END::DOUBLE AS confidence FROM r LEFT JOIN m ON m.nm = r.nm AND m.area = substr(r.pc, 1, 3) LEFT JOIN a ON a.nm = r.nm")
def er6(t):
    """By area of the postcode 0.8, by name alone where no postcode is stated 0.45."""
    area = F.substring("pc", 1, 3)
    g = register(t).withColumn("area", area)
    by_area = unique_candidates(g, ["nm", "area"]).withColumnRenamed("cn", "a_cn")
    by_name = unique_candidates(g, ["nm"]).withColumnRenamed("cn", "n_cn")
    x = rows(t).withColumn("area", area).join(by_area, ["nm", "area"], "left").join(by_name, "nm", "left")
    alone = F.col("pc").isNull() & F.col("n_cn").isNotNull()
    return x.select("id", F.coalesce("a_cn", F.when(alone, F.col("n_cn"))).alias("cn"), F.when(F.col("a_cn").isNotNull(), 0.8).when(alone, 0.45).alias("confidence"))


@query("er9_name_and_area", f"WITH {REGISTER}, {ROWS}, m AS (SELECT nm, substr(pc, 1, 3) AS area, min(cn) AS cn FROM reg WHERE pc IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT cn) = 1) SELECT id, m.cn, CASE WHEN m.cn IS NOT NULL THEN 0.85 END::DOUBLE AS confidence FROM r LEFT JOIN m ON m.nm = r.nm AND m.area = substr(r.pc, 1, 3)")
def er9(t):
    area = F.substring("pc", 1, 3)
    return two_tier(rows(t).withColumn("area", area), register(t).withColumn("area", area), "nm", [("area", 0.85)]).select("id", "cn", "confidence")
