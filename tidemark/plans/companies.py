"""The company filters, presets and panel (PR7, PR9, AG3), the meta block (RP1), the profile (RP3) and request checks (PR12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.companies import COUNTED, lifecycle, panel_counts, preset_table, registry, search_options, service_flags, thresholds, view
from ..operators.facets import FilterError, conditions, where
from .registry import Tables, query

#: Made from customers; these expressions read the same in both engines.
BASE = {"cn": "c_custkey", "name": "c_name", "h": "(c_custkey * 7919 + 101) % 10007", "bal": "c_acctbal", "seg": "c_mktsegment"}
COLUMNS = {
    "segment": "CASE h % 8 WHEN 0 THEN 'Micro' WHEN 1 THEN 'Small' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Large' WHEN 4 THEN 'Micro' WHEN 5 THEN 'Dormant' WHEN 6 THEN 'Unknown' ELSE 'No Filings' END",
    "status": "CASE WHEN h % 10 < 6 THEN 'Active' WHEN h % 10 = 6 THEN 'Active - Proposal to Strike off' WHEN h % 10 = 7 THEN ' Voluntary Arrangement' WHEN h % 10 = 8 THEN 'Liquidation ' ELSE 'Converted' END",
    "postcode": "CASE h % 7 WHEN 0 THEN NULL WHEN 1 THEN '1AB' WHEN 2 THEN 'EC1' WHEN 3 THEN 'M4' WHEN 4 THEN 'EC2' WHEN 5 THEN 'SW1' ELSE 'L1' END",
    "sic": "CASE h % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Retail' WHEN 2 THEN 'Software publishing' WHEN 3 THEN 'Steel' WHEN 4 THEN 'Manufacture of steel' ELSE 'Accounting and audit' END",
    "sector": "CASE h % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Fast growth & emerging' WHEN 2 THEN 'Technology, legal & professional' WHEN 3 THEN 'Manufacturing' ELSE seg END",
    "age": "CAST(h % 300 AS DOUBLE) / 10",
    "charges": "CASE WHEN h % 3 = 0 THEN 0 ELSE h % 5 END",
    "new_charges_12m": "CASE WHEN h % 4 = 1 THEN h % 3 ELSE 0 END",
    "ever_ours": "h % 5 = 1",
    "is_ours": "h % 10 = 1",
    "n_rivals": "CASE WHEN h % 3 = 2 THEN 1 + h % 2 ELSE 0 END",
    "n_ours_open": "CASE WHEN h % 10 = 1 THEN h % 3 ELSE 0 END",
    "main_lender": "CASE WHEN h % 11 < 4 THEN CASE h % 4 WHEN 0 THEN 'G1' WHEN 1 THEN 'G2' WHEN 2 THEN 'G3' ELSE 'unclassified' END END",
    "n_lenders": "h % 4",
    "rival_created_6m": "h % 6 = 5",
    "rival_entered_12m": "h % 12 = 7",
    "overdue": "h % 13 < 5",
    "overdue_months": "CASE WHEN h % 13 < 5 THEN h % 11 ELSE 0 END",
    "stale_months": "CASE WHEN h % 17 < 6 THEN h % 40 ELSE 0 END",
    "statement_late": "h % 19 < 8",
    "upgraded": "CASE WHEN h % 4 > 0 THEN h % 7 = 3 END",
    "downgraded": "CASE WHEN h % 4 > 0 THEN h % 7 = 4 END",
    "moved": "CASE WHEN h % 4 > 0 THEN h % 9 = 2 END",
    "sic_changed": "CASE WHEN h % 4 > 0 THEN h % 10 = 3 END",
    "score_lending": "CASE WHEN h % 10 < 6 THEN CAST(h * 13 % 9973 AS DOUBLE) / 9973 END",
    "score_growth": "CASE WHEN h % 10 < 6 THEN CAST(h * 29 % 9967 AS DOUBLE) / 9967 END",
    "score_insolvency": "CASE WHEN h % 10 < 6 THEN CAST(h * 37 % 9949 AS DOUBLE) / 9949 END",
    "matched": "CASE WHEN h % 14 < 3 THEN 1 ELSE 0 END",
    "contracts_won_12m": "CASE WHEN h % 8 = 2 THEN 1 ELSE 0 END",
}
LATER = {
    "outstanding": "CASE WHEN charges < h % 4 THEN charges ELSE h % 4 END",
    "severity": "CASE WHEN matched = 1 THEN CASE h % 3 WHEN 0 THEN 'early_warning' WHEN 1 THEN 'formal_insolvency' ELSE 'terminal' END END",
    "recent_365d": "CASE WHEN matched = 1 THEN CASE WHEN h % 2 = 0 THEN 1 ELSE 0 END END",
    "recent_90d": "CASE WHEN matched = 1 THEN CASE WHEN h % 6 = 0 THEN 1 ELSE 0 END END",
    "active_case": "CASE WHEN matched = 1 THEN CASE WHEN h % 10 = 2 THEN 1 ELSE 0 END END",
    "court": "CASE WHEN matched = 1 THEN CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END END",
    "petition": "CASE WHEN matched = 1 THEN CASE WHEN h % 5 < 2 THEN 1 ELSE 0 END END",
    "n_open": "CASE WHEN charges < h % 4 THEN charges ELSE h % 4 END",
}
RATIO = "CASE WHEN charges > 0 THEN round(CAST(outstanding AS DOUBLE) / charges, 2) ELSE CAST(0 AS DOUBLE) END"


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


PHASE = "CASE trim(status) WHEN 'Active' THEN 'Trading' WHEN 'Active - Proposal to Strike off' THEN 'Fading' WHEN 'Voluntary Arrangement' THEN 'Distressed' WHEN 'Liquidation' THEN 'Insolvent' ELSE 'Unknown' END"
COMPANY = f"company AS (SELECT *, {RATIO} AS debt_ratio, {PHASE} AS phase FROM (SELECT *, {listed(LATER)} FROM (SELECT *, {listed(COLUMNS)} FROM (SELECT {listed(BASE)} FROM customer))))"
TOP = ", ".join(f"quantile_cont({c}, 0.99) AS {k}99, quantile_cont({c}, 0.9) AS {k}90" for k, c in (("lending", "score_lending"), ("growth", "score_growth"), ("risk", "score_insolvency")))
SCORED = f"{COMPANY}, tops AS (SELECT {TOP} FROM company), c AS (SELECT * FROM company, tops)"


def companies(t: Tables) -> DataFrame:
    d = t.customer
    for columns in (BASE, COLUMNS, LATER, {"debt_ratio": RATIO}):
        d = d.selectExpr(*([] if columns is BASE else ["*"]), *[f"{v} AS {k}" for k, v in columns.items()])
    return d


TRADING = "phase = 'Trading' AND segment IN ('Micro', 'Small', 'Medium', 'Large')"
#: The same options in SQL.
CHOICES = {
    "repayment": {"fully_repaid": "charges > 0 AND debt_ratio = 0", "partial": "debt_ratio > 0 AND debt_ratio < 1", "all_outstanding": "debt_ratio = 1"},
    "relation": {
        "current": "is_ours", "former": "ever_ours AND NOT is_ours", "elsewhere": "NOT ever_ours AND n_rivals > 0", "unclassified": "NOT ever_ours AND n_rivals = 0 AND n_open > 0",
        "no_charge": "NOT ever_ours AND n_rivals = 0 AND n_open = 0",
    },
    "size_move": {"up": "upgraded", "down": "downgraded", "none": "NOT upgraded AND NOT downgraded", None: "upgraded IS NULL"},
    **{k: {"top1": f"{c} >= {k}99", "top10": f"{c} >= {k}90", None: f"{c} IS NULL"} for k, c in (("lending", "score_lending"), ("growth", "score_growth"), ("risk", "score_insolvency"))},
    "notices": {
        "none": "matched = 0", "any": "matched = 1", "formal_insolvency": "severity = 'formal_insolvency'", "recent_365": "recent_365d = 1", "active_case": "active_case = 1", "court": "court = 1",
        "petition": "petition = 1", "recent_90": "recent_90d = 1", "terminal": "severity = 'terminal'", "early_warning": "severity = 'early_warning'",
    },
    **{k: {"yes": c, "no": f"NOT ({c})"} for k, c in (
        ("ever_borrowed", "charges > 0"), ("new_charge_12m", "new_charges_12m > 0"), ("competitor", "n_rivals > 0"), ("competitor_6m", "rival_created_6m"), ("competitor_entered", "rival_entered_12m"),
        ("overdue", "overdue"), ("overdue_6m", "overdue_months >= 6"), ("confstmt_late", "statement_late"), ("no_filing_24m", "stale_months >= 24"))},
    **{k: {"yes": f"{c} IS TRUE", "no": f"{c} IS FALSE", None: f"{c} IS NULL"} for k, c in (("relocated", "moved"), ("sic_changed", "sic_changed"))},
}
VALUES = {"segment": "segment", "lifecycle": "phase", "sector": "sector", "main_lender": "main_lender"}
REQUEST = {"lifecycle": ["Trading", "Fading"], "ever_borrowed": "yes", "size_move": ["none", "up", "__notstated__"], "age": (1, 28.5), "main_lender": ["G1", "G2", "__notstated__"], "overdue": "no"}
REQUEST_SQL = {
    "lifecycle": "phase IN ('Trading', 'Fading')", "ever_borrowed": "charges > 0", "size_move": "((NOT upgraded AND NOT downgraded) OR upgraded OR upgraded IS NULL)", "age": "age >= 1 AND age <= 28.5",
    "main_lender": "(main_lender IN ('G1', 'G2') OR main_lender IS NULL)", "overdue": "NOT overdue",
}


def others(key: str) -> str:
    return " AND ".join(f"({s})" for k, s in REQUEST_SQL.items() if k != key)


def one_option(key: str, option: str | None, sql: str) -> str:
    return f"SELECT '{key}' AS facet, {'NULL' if option is None else repr(option)}::VARCHAR AS option, count(*) AS n FROM c WHERE {others(key)} AND ({sql})"


PANEL_SQL = [one_option(k, o, s) for k, own in CHOICES.items() for o, s in own.items()] + [f"SELECT * FROM (SELECT '{k}' AS facet, {v} AS option, count(*) AS n FROM c WHERE {others(k)} GROUP BY 2 ORDER BY n DESC LIMIT 40)" for k, v in VALUES.items()]


@query("ag3_facet_panel", f"WITH {SCORED} " + " UNION ALL ".join(PANEL_SQL))
def ag3(t):
    """All 22 facets with their options, each without its own filter, in one scan."""
    c = companies(t)
    return panel_counts(c, registry(thresholds(c)), REQUEST, COUNTED)


#: One request to each of the 27 filters, and its SQL.
EACH = {
    "segment": (["Micro", "Large"], "segment IN ('Micro', 'Large')"), "lifecycle": ("Insolvent", "phase = 'Insolvent'"), "region": (["EC", "M"], "regexp_extract(postcode, '^[A-Z]+') IN ('EC', 'M')"),
    "industry": (["Steel", "__notstated__"], "sic = 'Steel' OR sic IS NULL"), "sector": ("BUILDING", "sector = 'BUILDING'"), "age": ((2.5, 10), "age >= 2.5 AND age <= 10"), "ever_borrowed": ("1", "charges > 0"),
    "outstanding": ((1, None), "outstanding >= 1"), "repayment": (["partial", "all_outstanding"], "debt_ratio > 0"), "new_charge_12m": ("no", "new_charges_12m <= 0"), "relation": (["former", "no_charge"], "(ever_ours AND NOT is_ours) OR (NOT ever_ours AND n_rivals = 0 AND n_open = 0)"),
    "main_lender": (["G3", "unclassified"], "main_lender IN ('G3', 'unclassified')"), "lenders": ((None, 1), "n_lenders <= 1"), "competitor": ("true", "n_rivals > 0"), "competitor_6m": ("yes", "rival_created_6m"),
    "competitor_entered": ("yes", "rival_entered_12m"), "overdue": ("false", "NOT overdue"), "overdue_6m": ("yes", "overdue_months >= 6"), "confstmt_late": ("0", "NOT statement_late"), "no_filing_24m": ("yes", "stale_months >= 24"),
    "size_move": (["down", "__notstated__"], "downgraded OR upgraded IS NULL"), "relocated": ("notstated", "moved IS NULL"), "sic_changed": ("no", "sic_changed IS FALSE"), "lending": ("top1", "score_lending >= lending99"),
    "growth": (["top10", "__notstated__"], "score_growth >= growth90 OR score_growth IS NULL"), "risk": ("top10", "score_insolvency >= risk90"), "notices": (["court", "terminal"], "court = 1 OR severity = 'terminal'"),
}


@query("pr7_registry", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n FROM c WHERE {s}" for k, (_, s) in EACH.items()))
def pr7(t):
    """Every filter of the registry on its own, counted in one scan."""
    c = companies(t)
    filters = registry(thresholds(c))
    return c.agg(*[F.count_if(where(filters, {k: v})).alias(k) for k, (v, _) in EACH.items()]).unpivot([], list(EACH), "key", "n")


PRESET_SQL = {
    "proven_borrower": f"{TRADING} AND charges > 0 AND outstanding = 0", "unlevered_growth": f"{TRADING} AND age >= 5 AND charges = 0 AND score_growth >= growth90",
    "prospects_not_banked": f"{TRADING} AND score_lending >= lending99 AND NOT ever_ours", "exposure_deteriorating": "outstanding > 0 AND overdue_months >= 6",
    "growing_borrowing": f"{TRADING} AND new_charges_12m > 0 AND score_growth >= growth90", "silent_distress": "phase = 'Trading' AND matched = 0 AND overdue_months >= 6 AND statement_late",
    "contract_no_borrowing": f"{TRADING} AND contracts_won_12m > 0 AND charges = 0", "rival_moved_in": "ever_ours AND NOT is_ours AND rival_created_6m",
    "risk_on_our_security": "phase = 'Trading' AND score_insolvency >= risk99 AND n_ours_open > 0",
}


def against(key: str) -> str:
    """The companies of risk_on_our_security that its filters do not give are those without an open charge, and so on: the
    mapping of every preset is compared company by company."""
    asked = {"proven_borrower": f"{TRADING} AND charges > 0 AND outstanding <= 0", "risk_on_our_security": "phase = 'Trading' AND score_insolvency >= risk99 AND is_ours"}.get(key, PRESET_SQL[key])
    return f"count(*) FILTER (({PRESET_SQL[key]}) AND NOT ({asked})), count(*) FILTER (({asked}) AND NOT ({PRESET_SQL[key]}))"


@query("pr9_presets", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{k}' AS preset, n, a AS only_preset, b AS only_filters FROM (SELECT count(*) FILTER ({s}), {'NULL::BIGINT, NULL::BIGINT' if k == 'contract_no_borrowing' else against(k)} FROM c) AS x(n, a, b)" for k, s in PRESET_SQL.items()))
def pr9(t):
    """Nine populations, each beside the request that stands for it, compared row by row in the same scan."""
    c = companies(t)
    return preset_table(c, thresholds(c))


@query("pr7_option_search", f"WITH {SCORED} SELECT regexp_extract(postcode, '^[A-Z]+') AS option, count(*) AS n FROM c WHERE postcode IS NOT NULL AND upper(regexp_extract(postcode, '^[A-Z]+')) LIKE '%E%' AND overdue GROUP BY 1 ORDER BY n DESC, option LIMIT 30")
def pr7_search(t):
    c = companies(t)
    return search_options(c, registry(thresholds(c)), "region", " e ", {"overdue": "yes", "region": "M"})


BAD = (("segment", []), ("ever_borrowed", "maybe"), ("relocated", "unknown"), ("repayment", "__notstated__"), ("lending", "top5"), ("age", (float("nan"), None)), ("age", ("1", None)), ("lenders", (None, float("inf"))), ("nothing", "yes"))


@query("pr12_fail_closed", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', TRUE)" for i, (k, _) in enumerate(BAD)) + ", (99, 'view', TRUE)) AS x(i, key, refused)")
def pr12(t):
    """Requests that name no filter or no value it has are refused before a plan is built; none falls back to all rows."""
    filters = registry({})

    def refused(check) -> bool:
        try:
            check()
        except FilterError:
            return True
        return False

    rows = [(i, k, refused(lambda k=k, v=v: conditions(filters, {k: v}))) for i, (k, v) in enumerate(BAD)] + [(99, "view", refused(lambda: view("al")))]
    return t.spark.createDataFrame(rows, "i int, key string, refused boolean")


META = {"sector": "sector", "segment": "segment", "status": "status", "size": "CASE WHEN segment IN ('Micro', 'Small', 'Medium', 'Large') THEN segment END", "lifecycle": "phase"}


@query("rp1_meta", f"WITH {SCORED} SELECT 'count' AS block, x.key AS value, x.n FROM (SELECT unnest(['universe', 'with_notice', 'former', 'scored', 'unscored']) AS key, unnest([count(*), count(*) FILTER (matched = 1), count(*) FILTER (ever_ours AND NOT is_ours), count(*) FILTER (phase = 'Trading'), count(*) FILTER (phase <> 'Trading')]) AS n FROM c) x UNION ALL "
       + " UNION ALL ".join(f"SELECT '{k}', {v}, count(*) FROM c GROUP BY 2" for k, v in META.items()) + " UNION ALL SELECT 'noticed_lifecycle', phase, count(*) FROM c WHERE matched = 1 GROUP BY 2")
def rp1(t):
    """The size of the universe and of its parts, the five facet tables and the noticed companies by phase, in one scan: the
    values of a row are counted in one grouping."""
    c = companies(t).withColumn("phase", lifecycle(F.col("status")))
    size = F.when(F.col("segment").isin("Micro", "Small", "Medium", "Large"), F.col("segment"))
    entry = lambda block, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(block).alias("block"), value.alias("value")))
    counts = {"universe": None, "with_notice": F.col("matched") == 1, "former": view("former"), "scored": F.col("phase") == "Trading", "unscored": F.col("phase") != "Trading"}
    facets = {"sector": F.col("sector"), "segment": F.col("segment"), "status": F.col("status"), "size": size, "lifecycle": F.col("phase")}
    rows = [entry("count", F.lit(k), v) for k, v in counts.items()] + [entry(k, v) for k, v in facets.items()] + [entry("noticed_lifecycle", F.col("phase"), F.col("matched") == 1)]
    return c.select(F.explode(F.filter(F.array(*rows), lambda e: e.isNotNull())).alias("e")).groupBy("e.block", "e.value").agg(F.count("*").alias("n"))


@query("pj20_multi_label", f"""WITH {COMPANY}, f AS (SELECT cn, list_filter([CASE WHEN is_ours THEN 'our_lender' END, CASE WHEN n_rivals > 0 AND NOT is_ours THEN 'other_lender' END, CASE WHEN outstanding > 0 THEN 'outstanding_charge' END, CASE WHEN debt_ratio >= 0.5 THEN 'high_debt_ratio' END,
  CASE WHEN lower(coalesce(sector, '')) LIKE '%manufacturing%' OR lower(coalesce(sic, '')) LIKE '%manufactur%' THEN 'manufacturing' END,
  CASE WHEN regexp_matches(lower(coalesce(sector, '')), 'technology|legal|professional') OR regexp_matches(lower(coalesce(sic, '')), 'information|software|consult|legal|account') THEN 'professional' END,
  CASE WHEN lower(sector) LIKE '%fast growth%' OR lower(sector) LIKE '%emerging%' THEN 'fast_growth' END, CASE WHEN age <= 3 THEN 'young' END, CASE WHEN age >= 10 THEN 'established' END], lambda x: x IS NOT NULL) AS flags FROM company)
SELECT cn, unnest(CASE WHEN len(flags) = 0 THEN ['no_signal'] ELSE flags END) AS flag FROM f""")
def pj20(t):
    c = companies(t).withColumns({"has_outstanding": F.col("outstanding") > 0, "has_our_lender": F.col("is_ours"), "has_other_lender": F.col("n_rivals") > 0})
    return service_flags(c, "cn")


PROFILE = 7
PROFILE_SQL = f"""WITH {COMPANY}, o AS (SELECT * FROM orders WHERE o_custkey = {PROFILE}), l AS (SELECT * FROM lineitem JOIN o ON l_orderkey = o_orderkey), e AS (SELECT * FROM events WHERE user_id = {PROFILE})
SELECT cn, name, phase, (SELECT count(*) FROM o WHERE o_orderstatus = 'O') AS live, (SELECT count(*) FROM o WHERE o_orderstatus = 'F') AS lapsed, (SELECT count(*) FROM o WHERE o_orderstatus NOT IN ('O', 'F')) AS other, (SELECT min(o_orderdate)::DATE FROM o) AS first_order, (SELECT max(o_orderdate)::DATE FROM o) AS latest_order,
  (SELECT count(*) FROM l) AS titles, (SELECT count(*) FROM l WHERE l_returnflag LIKE 'R%') AS freehold, (SELECT count(*) FROM l WHERE l_returnflag LIKE 'A%') AS leasehold, (SELECT max(l_extendedprice) FROM l) AS value_max, (SELECT count(*) FROM e) AS notices,
  (SELECT string_agg(event_type, '|' ORDER BY ts, event_id) FROM (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 8)) AS timeline FROM company WHERE cn = {PROFILE}"""


@query("rp3_profile", PROFILE_SQL)
def rp3(t):
    """One company from several sources: each is cut to its key before it meets the others; counts that a source does not
    have are 0; the last eight notices in order."""
    one = companies(t).filter(F.col("cn") == PROFILE).select("cn", "name", lifecycle(F.col("status")).alias("phase"))
    s, f = F.col("o_orderstatus"), F.col("l_returnflag")
    o = t.orders.filter(F.col("o_custkey") == PROFILE)
    orders = o.agg(F.count_if(s == "O").alias("live"), F.count_if(s == "F").alias("lapsed"), F.count_if(~s.isin("O", "F")).alias("other"), F.min("o_orderdate").cast("date").alias("first_order"), F.max("o_orderdate").cast("date").alias("latest_order"))
    lines = t.lineitem.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").agg(F.count("*").alias("titles"), F.count_if(f.startswith("R")).alias("freehold"), F.count_if(f.startswith("A")).alias("leasehold"), F.max("l_extendedprice").alias("value_max"))
    own = t.events.filter(F.col("user_id") == PROFILE)
    last = own.orderBy(F.desc("ts"), F.desc("event_id")).limit(8).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l")).select(F.nullif(F.array_join(F.transform("l", lambda x: x["event_type"]), "|"), F.lit("")).alias("timeline"))
    out = one
    for part in (orders, lines, own.agg(F.count("*").alias("notices")), last):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
