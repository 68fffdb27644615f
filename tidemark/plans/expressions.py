"""Function, projection and predicate queries (FN, PJ, PR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators.facets import NOT_STATED, Filter, page, search, where
from ..operators.metrics import by_score
from .registry import query
from .standins import WIDE, wide

# ---- functions


@query("fn1_text_basics", "SELECT c_custkey AS k, upper(trim(c_name)) AS u, lower(replace(c_name, '#', '-')) AS l, length(c_name)::INTEGER AS n, substr(c_name, 1, 5) || '/' || c_mktsegment AS s FROM customer")
def fn1(t):
    c = t.customer
    return c.select(F.col("c_custkey").alias("k"), F.upper(F.trim("c_name")).alias("u"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("l"), F.length("c_name").alias("n"), F.concat(F.substring("c_name", 1, 5), F.lit("/"), "c_mktsegment").alias("s"))


@query("fn2_guarded_pad", "SELECT c_custkey AS k, lpad((c_custkey * 100003)::VARCHAR, greatest(8, length((c_custkey * 100003)::VARCHAR))::INTEGER, '0') AS padded FROM customer")
def fn2(t):
    return t.customer.select(F.col("c_custkey").alias("k"), text.company_number((F.col("c_custkey") * 100003).cast("string"), "plain").alias("padded"))


@query("fn3_regex_extract", "SELECT c_custkey AS k, regexp_extract(c_name, '#0*([1-9][0-9]*)$', 1) AS digits, regexp_matches(c_name, '7$') AS ends_7 FROM customer")
def fn3(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.regexp_extract("c_name", "#0*([1-9][0-9]*)$", 1).alias("digits"), F.col("c_name").rlike("7$").alias("ends_7"))


@query("fn4_regex_replace_chain", "SELECT p_partkey AS k, trim(regexp_replace(regexp_replace(upper(p_name), '[AEIOU]', '', 'g'), '\\s+', '_', 'g')) AS s FROM part")
def fn4(t):
    return t.part.select(F.col("p_partkey").alias("k"), F.trim(F.regexp_replace(F.regexp_replace(F.upper("p_name"), "[AEIOU]", ""), r"\s+", "_")).alias("s"))


@query("fn5_look_behind", "SELECT c_custkey AS k, regexp_matches(c_name, '(^|[^0-9])0*7$') AS only_7 FROM customer")
def fn5(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").rlike("(?<![1-9])7$").alias("x"), F.regexp_extract("c_name", "(?<![0-9])0*7$", 0).alias("m")).select("k", (F.col("m") != "").alias("only_7"))


@query("fn6_safe_parse", "SELECT o_orderkey AS k, try_strptime(CASE WHEN o_orderkey % 5 = 0 THEN '31/02/1999' ELSE strftime(o_orderdate, '%d/%m/%Y') END, '%d/%m/%Y')::DATE AS d, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END AS BIGINT) AS n FROM orders")
def fn6(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "31/02/1999").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return t.orders.select(k.alias("k"), F.try_to_date(raw, "dd/MM/yyyy").alias("d"), F.when(k % 3 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).try_cast("bigint").alias("n"))


@query("fn7_iso_passthrough", "SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders")
def fn7(t):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    return t.orders.select(F.col("o_orderkey").alias("k"), dates.iso_date(raw).alias("d"))


@query("fn8_month_difference", "SELECT l_orderkey AS k, l_partkey AS p, datediff('month', o_orderdate, l_shipdate)::INTEGER AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fn8(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), dates.months_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("months"))


@query("fn9_day_difference", "SELECT l_orderkey AS k, l_partkey AS p, datediff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fn9(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.datediff("l_shipdate", "o_orderdate").alias("days"))


@query("fn10_calendar", "SELECT o_orderkey AS k, last_day(o_orderdate)::DATE AS e, date_trunc('month', o_orderdate)::DATE AS s, (o_orderdate::DATE - INTERVAL 12 MONTH)::DATE AS y FROM orders")
def fn10(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), F.last_day("o_orderdate").alias("e"), F.trunc("o_orderdate", "month").alias("s"), dates.months_back(F.col("o_orderdate").cast("date"), 12).alias("y"))


@query("fn11_least_greatest", "SELECT c_custkey AS k, greatest(c_acctbal, 0) AS g, least(floor(c_acctbal / 500), 10)::BIGINT AS b, nullif(c_nationkey, 7) AS n FROM customer")
def fn11(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.greatest("c_acctbal", F.lit(0.0)).alias("g"), F.least(F.floor(F.col("c_acctbal") / 500), F.lit(10)).cast("bigint").alias("b"), F.nullif("c_nationkey", F.lit(7)).alias("n"))


RAW_NUMBER = "CASE c_custkey % 8 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN 'sc' || c_custkey::VARCHAR WHEN 2 THEN ' nan' WHEN 3 THEN '1234567' || c_custkey::VARCHAR WHEN 4 THEN ' s c ' || c_custkey::VARCHAR WHEN 5 THEN 'N/A' WHEN 6 THEN 'abcdefg' || c_custkey::VARCHAR ELSE 'NI-' || c_custkey::VARCHAR END"
PADDED = "lpad({0}, greatest(8, length({0}))::INTEGER, '0')"


@query("fn12_company_number", f"""WITH r AS (SELECT c_custkey AS k, upper(trim({RAW_NUMBER})) AS s FROM customer), b AS (SELECT *, regexp_replace(s, '[^A-Z0-9]', '', 'g') AS x, replace(s, ' ', '') AS n FROM r)
SELECT k, CASE WHEN s NOT IN ('', 'NAN', 'NONE', 'NULL', 'N/A') AND length(x) BETWEEN 1 AND 8 THEN CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 8, '0') WHEN regexp_matches(x, '^[A-Z][A-Z][0-9]+$') THEN substr(x, 1, 2) || lpad(substr(x, 3), 6, '0') END END AS prefix,
  CASE WHEN n IN ('', 'NAN', 'NONE') THEN NULL WHEN regexp_matches(n, '^[0-9]+$') THEN {PADDED.format('n')} WHEN length(n) <= 8 THEN lpad(n, 8, '0') END AS plain,
  CASE WHEN n NOT IN ('', 'NAN', 'NONE') THEN CASE WHEN length(n) <= 8 THEN lpad(n, 8, '0') ELSE n END END AS lookup,
  CASE WHEN s NOT IN ('', 'NAN') THEN CASE WHEN regexp_matches(s, '^[0-9]+$') THEN {PADDED.format('s')} ELSE s END END AS digits, {PADDED.format('s')} AS zeros FROM b""")
def fn12(t):
    k = F.col("c_custkey")
    s, n = k.cast("string"), k % 8
    after = lambda x: F.concat(F.lit(x), s)
    raw = F.when(n == 0, s).when(n == 1, after("sc")).when(n == 2, " nan").when(n == 3, after("1234567")).when(n == 4, after(" s c ")).when(n == 5, "N/A").when(n == 6, after("abcdefg")).otherwise(after("NI-"))
    return t.customer.select(k.alias("k"), *[text.company_number(raw, m).alias(m) for m in ("prefix", "plain", "lookup", "digits", "zeros")])


RAW_NAME = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' Holdings, Ltd.' WHEN 1 THEN ' & Co Limited' WHEN 2 THEN '  The PLC' WHEN 3 THEN ' group, l.t.d.' WHEN 4 THEN ' Corp Company ., ' ELSE '' END"
WORDS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
READABLE = "trim(regexp_replace(trim(regexp_replace(trim(upper(s)), '(\\s(LIMITED|LTD|PLC|LLP|LP|CIC|INC|CORP|CORPORATION|GROUP|HOLDINGS|COMPANY|CO)[\\s,.]*)+$', '')), '[\\s,.]+$', ''))"


@query("fn13_company_name", f"""WITH r AS (SELECT p_partkey AS k, {RAW_NAME} AS s FROM part)
SELECT k, trim(regexp_replace(regexp_replace(upper(regexp_replace(s, '[^A-Za-z0-9 ]', '', 'g')), '\\s+', ' ', 'g'), '( LIMITED| LTD| PLC| LLP| CIC| CIO)+$', '')) AS trailing,
  trim(regexp_replace(regexp_replace(regexp_replace(upper(s), '[^A-Z0-9 ]', ' ', 'g'), '\\b({'|'.join(text.LOOSE_WORDS)})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS anywhere,
  trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS lower, {WORDS.format(f'lower({READABLE})')} AS readable,
  trim(regexp_replace(s, '(?i)\\s+(LIMITED|LTD|PLC|LLP|L\\.T\\.D\\.)\\.?\\s*$', '')) AS last,
  trim(regexp_replace(regexp_replace(regexp_replace(upper(s), '[^A-Z0-9 &]', ' ', 'g'), '\\b(LIMITED|LTD|PLC|LLP|CIC|CIO|COMPANY|CO|HOLDINGS|GROUP)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS search FROM r""")
def fn13(t):
    k, n = F.col("p_partkey"), F.col("p_partkey") % 6
    raw = F.concat("p_name", F.when(n == 0, " Holdings, Ltd.").when(n == 1, " & Co Limited").when(n == 2, "  The PLC").when(n == 3, " group, l.t.d.").when(n == 4, " Corp Company ., ").otherwise(""))
    return t.part.select(k.alias("k"), *[text.company_name(raw, m).alias(m) for m in ("trailing", "anywhere", "lower", "readable", "last", "search")])


RAW_CODE = "CASE c_custkey % 4 WHEN 0 THEN 'sl' || (c_custkey % 9) || ' 9eh' WHEN 1 THEN 'nan' WHEN 2 THEN ' EC' || (c_custkey % 9) || 'A-1BB ' ELSE 'x1' END"


@query("fn14_postcode", f"""WITH r AS (SELECT c_custkey AS k, upper(trim({RAW_CODE})) AS s FROM customer), b AS (SELECT k, CASE WHEN s <> 'NAN' THEN regexp_replace(s, '[^A-Z0-9]', '', 'g') END AS pc FROM r)
SELECT k, pc, CASE WHEN length(pc) >= 4 THEN substr(pc, 1, length(pc) - 3) END AS outward, nullif(regexp_extract(pc, '^([A-Z][A-Z]?)', 1), '') AS area FROM b""")
def fn14(t):
    k = F.col("c_custkey")
    nine = (k % 9).cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("sl"), nine, F.lit(" 9eh"))).when(k % 4 == 1, "nan").when(k % 4 == 2, F.concat(F.lit(" EC"), nine, F.lit("A-1BB "))).otherwise("x1")
    return t.customer.select(k.alias("k"), text.postcode(raw).alias("pc"), text.postcode_outward(raw).alias("outward"), text.postcode_area(raw).alias("area"))


@query("fn15_postcode_in_text", """WITH r AS (SELECT doc_id AS k, regexp_extract_all(upper(text || CASE WHEN doc_id % 3 = 0 THEN ' at AB1 2CD and ' || 'EC' || (doc_id % 9) || 'A 1BB.' ELSE '' END), '([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})', 1) AS f FROM documents)
SELECT k, regexp_replace(f[1], '[^A-Z0-9]', '', 'g') AS first, regexp_replace(f[len(f)], '[^A-Z0-9]', '', 'g') AS last FROM r""")
def fn15(t):
    k = F.col("doc_id")
    s = F.concat("text", F.when(k % 3 == 0, F.concat(F.lit(" at AB1 2CD and EC"), (k % 9).cast("string"), F.lit("A 1BB."))).otherwise(""))
    return t.documents.select(k.alias("k"), text.postcode_in(s).alias("first"), text.postcode_in(s, "last").alias("last"))


TAGGED = " <b>&pound;5</b> &#163;6 &#x41;&#66; &eacute;&amp;lt; &nope; &hellip;&nbsp;&nbsp;end"


def replaced(s: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        s = f"replace({s}, '{a}', '{b}')"
    return s


LETTERS = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&pound;", "£"), ("&#163;", "£"), ("&#x41;", "A"), ("&#66;", "B"), ("&eacute;", "é"), ("&hellip;", "…"), ("&copy;", "©"), ("&middot;", "·"), ("&euro;", "€"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")]
NO_TAGS = f"regexp_replace(regexp_replace(html || '{TAGGED}', '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query("fn16_html_text", f"SELECT page_id AS k, trim(regexp_replace({replaced(NO_TAGS, LETTERS)}, '\\s+', ' ', 'g')) AS plain FROM pages")
def fn16(t):
    return t.pages.select(F.col("page_id").alias("k"), text.plain_text(F.concat("html", F.lit(TAGGED))).alias("plain"))


@query("fn17_labelled_number", "WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Company Number: ' WHEN 1 THEN 'registered no ' ELSE 'none ' END || lpad(o_custkey::VARCHAR, 8, '0') AS s FROM orders) SELECT k, coalesce(nullif(regexp_extract(s, '(?i)company number\\s*:?\\s*([A-Z0-9]{6,8})', 1), ''), nullif(regexp_extract(s, '(?i)registered no\\s*:?\\s*([A-Z0-9]{6,8})', 1), '')) AS number FROM r")
def fn17(t):
    k = F.col("o_orderkey")
    s = F.concat(F.when(k % 3 == 0, "Company Number: ").when(k % 3 == 1, "registered no ").otherwise("none "), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return t.orders.select(k.alias("k"), text.labelled_number(s, "company number", "registered no").alias("number"))


@query("fn18_price", "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 1 THEN NULL ELSE p_retailprice END AS price FROM part")
def fn18(t):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, " ").when(k % 4 == 1, "£0").otherwise(F.concat(F.lit("£ "), F.col("p_retailprice").cast("string")))
    return t.part.select(k.alias("k"), text.price(raw).alias("price"))


@query("fn19_detail_line", "SELECT p_partkey AS k, substr(concat_ws(' | ', p_name, CASE WHEN p_size > 10 THEN p_type END, p_brand), 1, 22) AS line FROM part")
def fn19(t):
    return t.part.select(F.col("p_partkey").alias("k"), text.detail_line(F.col("p_name"), F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_brand"), most=22).alias("line"))


KEYWORDS = [("distress", ["red", "bolt"]), ("change", ["ring", "blue"])]


@query("fn20_keyword_class", "SELECT p_partkey AS k, CASE WHEN regexp_matches(p_name, '(?:red)|(?:bolt)') THEN 'distress' WHEN regexp_matches(p_name, '(?:ring)|(?:blue)') THEN 'change' ELSE 'other' END AS class FROM part")
def fn20(t):
    return t.part.select(F.col("p_partkey").alias("k"), text.first_match(F.col("p_name"), KEYWORDS, "other").alias("class"))


@query("fn21_first_match_dictionary", "SELECT p_partkey AS k, CASE WHEN regexp_matches(p_brand, '#1') THEN 'ones' WHEN regexp_matches(p_brand, '#2|#12') THEN 'twos' ELSE 'unclassified' END AS class FROM part")
def fn21(t):
    """Classify distinct values once, then join them back."""
    rules = [("ones", ["#1"]), ("twos", ["#2", "#12"])]
    named = t.part.select("p_brand").distinct().withColumn("class", text.first_match(F.col("p_brand"), rules, "unclassified"))
    return t.part.join(named, "p_brand").select(F.col("p_partkey").alias("k"), "class")


@query("fn22_query_phrase", "SELECT c_custkey AS k, '\"' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || '\" AND ' || lower(c_mktsegment) AS phrase FROM customer")
def fn22(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.concat(F.lit('"'), text.company_name(F.regexp_replace("c_name", "[^A-Za-z0-9]+", " "), "lower"), F.lit('" AND '), F.lower("c_mktsegment")).alias("phrase"))


@query("fn23_hash_sample", "SELECT o_orderkey AS k FROM orders WHERE ('0x' || md5(o_orderkey::VARCHAR || '|lending')[1:8])::BIGINT / 4294967296.0 < 0.2")
def fn23(t):
    """A sampling operator: a fifth of the keys, fixed by their md5."""
    return t.orders.filter(numbers.bucket_share(F.col("o_orderkey").cast("string"), F.lit("lending")) < 0.2).select(F.col("o_orderkey").alias("k"))


@query("fn24_hashes", "SELECT c_custkey AS k, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def fn24(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


P = "(o_orderkey % 97 + 1) / 100.0"


@query("fn25_odds", f"SELECT o_orderkey AS k, ({P})::DOUBLE / (1 - ({P})::DOUBLE) AS odds, round(ln(({P})::DOUBLE / (1 - ({P})::DOUBLE)), 9) AS log_odds FROM orders")
def fn25(t):
    p = (F.col("o_orderkey") % 97 + 1) / F.lit(100.0)
    return t.orders.select(F.col("o_orderkey").alias("k"), numbers.odds(p).alias("odds"), F.round(F.log(numbers.odds(p)), 9).alias("log_odds"))


@query("fn26_recalibrate", f"SELECT o_orderkey AS k, ({P})::DOUBLE * 0.1 / (1 - ({P})::DOUBLE + ({P})::DOUBLE * 0.1) AS p FROM orders")
def fn26(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), numbers.recalibrated((F.col("o_orderkey") % 97 + 1) / F.lit(100.0), F.lit(0.1)).alias("p"))


# ---- projections


@query("pj1_fixed_schema", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, NULL::VARCHAR AS absent FROM part")
def pj1(t):
    from ..sources.readers import fitted

    return fitted(t.part.withColumn("p_partkey", F.col("p_partkey").cast("string")), ["p_partkey", "p_name", "absent"])


@query("pj2_star_minus", "SELECT * EXCLUDE (p_type, p_size) FROM part")
def pj2(t):
    return t.part.drop("p_type", "p_size")


@query("pj3_first_non_null", "SELECT p_partkey AS k, coalesce(CASE WHEN p_size < 10 THEN p_name END, CASE WHEN p_size < 30 THEN p_brand END, p_type) AS v FROM part")
def pj3(t):
    return t.part.select(F.col("p_partkey").alias("k"), F.coalesce(F.when(F.col("p_size") < 10, F.col("p_name")), F.when(F.col("p_size") < 30, F.col("p_brand")), "p_type").alias("v"))


SEGMENTS = {"BUILDING": "Large", "MACHINERY": "Medium", "HOUSEHOLD": "Small"}


@query("pj4_dictionary", "SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 'Large' WHEN 'MACHINERY' THEN 'Medium' WHEN 'HOUSEHOLD' THEN 'Small' END AS segment FROM customer")
def pj4(t):
    lookup = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])
    return t.customer.select(F.col("c_custkey").alias("k"), lookup[F.col("c_mktsegment")].alias("segment"))


@query("pj5_lifecycle", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'Trading' WHEN 'P' THEN 'Fading' ELSE 'Unknown' END AS life FROM orders")
def pj5(t):
    s = F.col("o_orderstatus")
    return t.orders.select(F.col("o_orderkey").alias("k"), F.when(s == "O", "Trading").when(s == "P", "Fading").otherwise("Unknown").alias("life"))


@query("pj6_ordinal", "SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS tier FROM orders")
def pj6(t):
    from .standins import priority_tier

    return t.orders.select(F.col("o_orderkey").alias("k"), priority_tier(F.col("o_orderpriority")).alias("tier"))


@query("pj7_age_years", "SELECT o_orderkey AS k, round(datediff('day', o_orderdate::DATE, DATE '2002-01-01') / 365.25, 1) AS age FROM orders")
def pj7(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), numbers.age_years(F.lit("2002-01-01").cast("date"), F.col("o_orderdate")).alias("age"))


@query("pj8_guarded_ratio", "SELECT l_orderkey AS k, l_partkey AS p, CASE WHEN l_linenumber - 1 > 0 THEN round(l_quantity / (l_linenumber - 1), 2) ELSE 0 END AS r FROM lineitem")
def pj8(t):
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), numbers.ratio(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("r"))


@query("pj8b_clipped_ratio", "SELECT l_orderkey AS k, l_partkey AS p, coalesce(l_quantity / greatest(l_linenumber - 3, 1), 0) AS r FROM lineitem")
def pj8b(t):
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), numbers.clipped_ratio(F.col("l_quantity"), F.col("l_linenumber") - 3).alias("r"))


DUE = "CASE WHEN l_linenumber <> 3 THEN l_shipdate::DATE END"


@query("pj9_11_null_rules", f"SELECT l_orderkey AS k, l_partkey AS p, coalesce({DUE} < DATE '1998-01-01', FALSE) AS overdue, ({DUE} IS NULL OR {DUE} < DATE '1996-01-01') AS stale, {DUE} < DATE '1998-01-01' AS late FROM lineitem")
def pj9(t):
    """A missing date is not overdue, is stale, and is late or not, unknown."""
    due = F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("date"))
    at = F.lit("1998-01-01").cast("date")
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.coalesce(due < at, F.lit(False)).alias("overdue"), (due.isNull() | (due < F.add_months(at, -24))).alias("stale"), (due < at).alias("late"))


@query("pj12_count_non_null", "SELECT p_partkey AS k, ((CASE WHEN p_size < 10 THEN p_name END) IS NOT NULL)::INT + ((CASE WHEN p_size < 30 THEN p_brand END) IS NOT NULL)::INT + 1 AS n FROM part")
def pj12(t):
    cols = [F.when(F.col("p_size") < 10, F.col("p_name")), F.when(F.col("p_size") < 30, F.col("p_brand")), F.col("p_type")]
    return t.part.select(F.col("p_partkey").alias("k"), sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int")).alias("n"))


@query("pj13_whitelist", "SELECT c_custkey AS k, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS tier FROM customer")
def pj13(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("tier"))


SPARSE = "(SELECT o_custkey AS c, count(*)::BIGINT AS n, max(o_orderdate)::DATE AS last, bool_or(o_orderstatus = 'F') AS closed FROM orders WHERE o_orderdate < DATE '1995-06-01' GROUP BY 1)"


@query("pj14_sparse_fill", f"SELECT c_custkey AS k, coalesce(n, 0)::BIGINT AS n, coalesce(closed, FALSE) AS closed, CASE WHEN n IS NULL THEN 'none' ELSE 'some' END AS tier, last FROM customer LEFT JOIN {SPARSE} ON c_custkey = c")
def pj14(t):
    """Counts 0, flags false, names 'none', dates null where the sparse table has no row (PJ14, PJ15)."""
    s = t.orders.filter(F.col("o_orderdate") < "1995-06-01").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("last"), F.bool_or(F.col("o_orderstatus") == "F").alias("closed"))
    j = t.customer.select("c_custkey").join(s.withColumn("tier", F.lit("some")), "c_custkey", "left")
    return j.na.fill({"n": 0, "closed": False, "tier": "none"}).select(F.col("c_custkey").alias("k"), "n", "closed", "tier", "last")


@query("pj16_null_markers", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS v FROM orders")
def pj16(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), text.no_missing_words(F.when(F.col("o_orderkey") % 3 == 0, F.lit("NaT ")).otherwise(F.col("o_orderpriority"))).alias("v"))


@query("pj17_sentinels", "SELECT o_orderkey AS k, CASE WHEN abs(o_orderkey * 7) <= 1200 THEN o_orderkey * 7 END AS months_since, CASE WHEN abs(o_orderkey * 7) <= 36525 THEN o_orderkey * 7 END AS days_since, o_orderkey * 7 AS other FROM orders")
def pj17(t):
    v = F.col("o_orderkey") * 7
    return t.orders.select(F.col("o_orderkey").alias("k"), *[numbers.no_sentinel(v, n).alias(n) for n in ("months_since", "days_since", "other")])


@query("pj18_partition_of_cases", "SELECT c_custkey AS k, CASE WHEN c_acctbal >= 8000 THEN 'top' WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 2000 THEN 'mid' WHEN c_acctbal >= 0 THEN 'low' ELSE 'debt' END AS band FROM customer")
def pj18(t):
    b = F.col("c_acctbal")
    return t.customer.select(F.col("c_custkey").alias("k"), F.when(b >= 8000, "top").when(b >= 5000, "high").when(b >= 2000, "mid").when(b >= 0, "low").otherwise("debt").alias("band"))


@query("pj19_contribution_share", "SELECT user_id AS cn, event_id AS e, abs(value - 50) / sum(abs(value - 50)::DECIMAL(18,2)) OVER (PARTITION BY user_id)::DOUBLE AS share, sign(value - 50)::INTEGER AS direction FROM events")
def pj19(t):
    from pyspark.sql import Window

    v = F.col("value") - 50
    whole = F.sum(F.abs(v).cast("decimal(18,2)")).over(Window.partitionBy("user_id")).cast("double")
    return t.events.select(F.col("user_id").alias("cn"), F.col("event_id").alias("e"), (F.abs(v) / whole).alias("share"), F.signum(v).cast("int").alias("direction"))


@query("pj21_concern", f"SELECT l_orderkey AS k, l_partkey AS p, l_linenumber > 5 OR coalesce({DUE} < DATE '1996-01-01', FALSE) OR coalesce({DUE} < DATE '1995-06-01', TRUE) AS concern FROM lineitem")
def pj21(t):
    due = F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("date"))
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), ((F.col("l_linenumber") > 5) | F.coalesce(due < F.lit("1996-01-01").cast("date"), F.lit(False)) | F.coalesce(due < F.lit("1995-06-01").cast("date"), F.lit(True))).alias("concern"))


@query("pj22_priority_score", f"WITH {WIDE}, b AS (SELECT *, min(score) OVER (PARTITION BY sector) AS lo, max(score) OVER (PARTITION BY sector) AS hi FROM wide) SELECT cn, (CASE WHEN coalesce(flag, FALSE) THEN 4 ELSE 0 END + CASE WHEN coalesce(moves, 0) > 0 THEN 3 ELSE 0 END) + CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS priority FROM b")
def pj22(t):
    from pyspark.sql import Window

    w = Window.partitionBy("sector")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    d = wide(t).withColumn("scaled", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))
    return d.select("cn", (F.when(F.coalesce("flag", F.lit(False)), 4).otherwise(0) + F.when(F.coalesce("moves", F.lit(0)) > 0, 3).otherwise(0) + F.col("scaled")).alias("priority"))


# ---- predicates


def filters() -> list[Filter]:
    s = F.col("score")
    bands = {"debt": s < 0, "mid": (s >= 0) & (s < 5000), "high": s >= 5000}
    return [Filter("sector", "in", F.col("sector")), Filter("region", "in", F.lower("region")), Filter("rich", "bool", F.col("flag")), Filter("flag", "tri", F.col("flag")), Filter("band", "choice", s, bands), Filter("score", "range", s), Filter("moves", "in", F.col("moves").cast("string"))]


REQUESTS = {
    "pr1_in_or_not_stated": ({"moves": ["1", NOT_STATED]}, "moves IN (1) OR moves IS NULL"),
    "pr2_in_expression": ({"region": ["region_1", "region_2", "asia", "europe"]}, "lower(region) IN ('region_1', 'region_2', 'asia', 'europe')"),
    "pr3_bool": ({"rich": "no"}, "NOT flag"),
    "pr4_tri": ({"flag": ["no", NOT_STATED]}, "flag IS FALSE OR flag IS NULL"),
    "pr5_choice": ({"band": ["debt", "high"]}, "score < 0 OR score >= 5000"),
    "pr6_range": ({"score": (1000, 3000.5)}, "score >= 1000 AND score <= 3000.5"),
    "pr8_compose": ({"sector": ["BUILDING", "MACHINERY"], "flag": "yes", "score": (None, 9000)}, "sector IN ('BUILDING', 'MACHINERY') AND flag IS TRUE AND score <= 9000"),
}
for _name, (_request, _sql) in REQUESTS.items():
    query(_name, f"WITH {WIDE} SELECT cn, sector, flag, moves, score FROM wide WHERE {_sql}")(lambda t, r=_request: wide(t).filter(where(filters(), r)).select("cn", "sector", "flag", "moves", "score"))


@query("pr10_view", f"WITH {WIDE} SELECT cn, score FROM wide WHERE flag IS NOT NULL AND sector IN ('BUILDING')")
def pr10(t):
    return wide(t).filter(where(filters(), {"sector": "BUILDING"}, base=F.col("flag").isNotNull())).select("cn", "score")


@query("pr11_coalesced_flag", f"WITH {WIDE} SELECT cn FROM wide WHERE coalesce(flag, FALSE) = FALSE")
def pr11(t):
    return wide(t).filter(~F.coalesce("flag", F.lit(False))).select("cn")


@query("pr13_contains", f"WITH {WIDE} SELECT cn, name FROM wide WHERE upper(name) LIKE '%00012%'")
def pr13(t):
    return wide(t).filter(F.contains(F.upper("name"), F.lit("00012"))).select("cn", "name")


@query("pr14_number_or_name", f"WITH {WIDE} SELECT cn, name FROM wide WHERE cn = 77")
def pr14(t):
    return search(wide(t), "77", "cn", "name").select("cn", "name")


@query("pr14_name_search", f"WITH {WIDE} SELECT cn, name FROM wide WHERE upper(name) LIKE '%ER#0000000%' ORDER BY length(name), name, cn LIMIT 20")
def pr14b(t):
    return search(wide(t), "er#0000000", "cn", "name").select("cn", "name")


@query("pr15_quantile_threshold", f"WITH {WIDE} SELECT cn, score FROM wide WHERE score >= (SELECT quantile_cont(score, 0.9) FROM wide WHERE flag)")
def pr15(t):
    w = wide(t)
    return w.filter(F.col("score") >= w.filter("flag").select(F.percentile("score", 0.9)).scalar()).select("cn", "score")


@query("pr16_between_dates", "SELECT o_orderkey AS k, (o_orderdate::DATE BETWEEN DATE '1997-07-01' AND DATE '1997-07-31')::INT AS in_july FROM orders")
def pr16(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").between("1997-07-01", "1997-07-31").cast("int").alias("in_july"))


@query("sl1_ordered_page", f"WITH {WIDE} SELECT cn, moves FROM wide ORDER BY moves DESC NULLS LAST, cn LIMIT 50 OFFSET 100")
def sl1(t):
    """SL1 and SL2: a page of a total order."""
    return page(wide(t), "moves", True, "cn", ["moves", "score"], 50, 100).select("cn", "moves")


@query("ml7_counts_by_score", f"WITH {WIDE} SELECT floor(score / 100)::BIGINT AS s, sum(flag::INT)::DOUBLE AS pos, (count(*) - sum(flag::INT))::DOUBLE AS neg FROM wide WHERE flag IS NOT NULL GROUP BY 1")
def ml7_counts(t):
    return by_score(wide(t).select(F.floor(F.col("score") / 100).alias("s"), F.col("flag").cast("int").alias("y")), "s", "y")


@query("pj15_family_fill", f"SELECT c_custkey AS k, coalesce(n, 0)::BIGINT AS n_total, coalesce(n > 1, FALSE) AS is_many, CASE WHEN n IS NULL THEN 'no_notice' ELSE 'open' END AS stage, last AS last_date, (DATE '1995-06-01' - last)::INTEGER AS days_since FROM customer LEFT JOIN {SPARSE} ON c_custkey = c")
def pj15(t):
    """By family of names: counts 0, flags false, stages 'no_notice'; dates and days since stay null."""
    s = t.orders.filter(F.col("o_orderdate") < "1995-06-01").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_total"), F.max("o_orderdate").cast("date").alias("last_date"))
    s = s.withColumns({"is_many": F.col("n_total") > 1, "stage": F.lit("open"), "days_since": F.datediff(F.lit("1995-06-01").cast("date"), "last_date")})
    fills = {c: 0 if c.startswith("n_") else False if c.startswith("is_") else "no_notice" for c in s.columns if c.startswith(("n_", "is_")) or c == "stage"}
    return t.customer.select("c_custkey").join(s, "c_custkey", "left").na.fill(fills).select(F.col("c_custkey").alias("k"), "n_total", "is_many", "stage", "last_date", "days_since")


@query("sl2_clamped_page", f"WITH {WIDE} SELECT cn FROM wide ORDER BY score ASC NULLS LAST, cn LIMIT 500")
def sl2(t):
    """A limit beyond the most allowed, and an offset below 0."""
    return page(wide(t), "score", False, "cn", ["score"], 10_000, -5).select("cn")


@query("sl5_shortest_first", f"WITH {WIDE} SELECT cn, name FROM wide WHERE sector = 'BUILDING' ORDER BY length(name), name, cn LIMIT 30")
def sl5(t):
    return wide(t).filter("sector = 'BUILDING'").orderBy(F.length("name"), "name", "cn").limit(30).select("cn", "name")
