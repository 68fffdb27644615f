"""The registry of company filters, the presets made of them, and the panel of their counts.

A company row has: segment, status, postcode, sic, sector, age, charges, outstanding, debt_ratio, new_charges_12m, is_ours,
ever_ours, n_rivals, n_open, n_ours_open, main_lender, n_lenders, rival_created_6m, rival_entered_12m, overdue,
overdue_months, stale_months, statement_late, upgraded, downgraded, moved, sic_changed, score_lending, score_growth,
score_insolvency, matched, severity, recent_365d, recent_90d, active_case, court, petition, contracts_won_12m.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facets import NOT_STATED, Filter, FilterError, conditions, where
from .metrics import quantiles

# Register statuses by phase of life, and the segments that trade.
PHASES = {
    "Trading": ("Active",),
    "Fading": ("Active - Proposal to Strike off",),
    "Distressed": ("Live but Receiver Manager on at least one charge", "Voluntary Arrangement"),
    "Insolvent": (
        "In Administration", "In Administration/Administrative Receiver", "In Administration/Receiver Manager", "ADMINISTRATION ORDER", "ADMINISTRATIVE RECEIVER",
        "RECEIVERSHIP", "RECEIVER MANAGER / ADMINISTRATIVE RECEIVER", "Liquidation",
    ),
}
TRADING_SEGMENTS = ("Micro", "Small", "Medium", "Large")
SCORES = {"lending": "score_lending", "growth": "score_growth", "risk": "score_insolvency"}


def lifecycle(status: Column) -> Column:
    s = F.trim(status)
    return F.coalesce(*[F.when(s.isin(*own), phase) for phase, own in PHASES.items()], F.lit("Unknown"))


def is_active() -> Column:
    return lifecycle(F.col("status")) == "Trading"


def thresholds(companies: DataFrame, in_one_pass: int = 5_000_000) -> dict[str, tuple[float, float]]:
    """The 99th and 90th percentile of each score over all companies that have one; six numbers reach the driver. Up to
    in_one_pass rows one aggregate holds the scores; beyond, each score's values are ranked in bands."""
    if companies.count() <= in_one_pass:
        row = companies.agg(*[F.percentile(c, F.array(F.lit(0.99), F.lit(0.9))).alias(k) for k, c in SCORES.items()]).first()
        return {k: tuple(row[k]) for k in SCORES if row[k]}
    found = {k: tuple(quantiles(companies, c, [0.99, 0.9]).first()) for k, c in SCORES.items()}
    return {k: v for k, v in found.items() if v[0] is not None}


def registry(top: dict[str, tuple[float, float]]) -> list[Filter]:
    """The 27 filters. top: the scores from which on a company is in the top 1 and the top 10 per cent."""
    c = F.col
    never = ~c("ever_ours")
    counterparty = {
        "current": c("is_ours"), "former": c("ever_ours") & ~c("is_ours"), "elsewhere": never & (c("n_rivals") > 0),
        "unclassified": never & (c("n_rivals") == 0) & (c("n_open") > 0), "no_charge": never & (c("n_rivals") == 0) & (c("n_open") == 0),
    }
    repayment = {"fully_repaid": (c("charges") > 0) & (c("debt_ratio") == 0), "partial": (c("debt_ratio") > 0) & (c("debt_ratio") < 1), "all_outstanding": c("debt_ratio") == 1}
    size = {"up": c("upgraded"), "down": c("downgraded"), "none": ~c("upgraded") & ~c("downgraded")}
    notices = {
        "none": c("matched") == 0, "any": c("matched") == 1, "formal_insolvency": c("severity") == "formal_insolvency", "recent_365": c("recent_365d") == 1, "active_case": c("active_case") == 1,
        "court": c("court") == 1, "petition": c("petition") == 1, "recent_90": c("recent_90d") == 1, "terminal": c("severity") == "terminal", "early_warning": c("severity") == "early_warning",
    }
    score = lambda k: Filter(k, "choice", c(SCORES[k]), {n: c(SCORES[k]) >= v for n, v in zip(("top1", "top10"), top.get(k, (float("inf"),) * 2), strict=True)})
    return [
        Filter("segment", "in", c("segment")), Filter("lifecycle", "in", lifecycle(c("status"))), Filter("region", "in", F.regexp_extract("postcode", "^[A-Z]+", 0)), Filter("industry", "in", c("sic")),
        Filter("sector", "in", c("sector")), Filter("age", "range", c("age")),
        Filter("ever_borrowed", "bool", c("charges") > 0), Filter("outstanding", "range", c("outstanding")), Filter("repayment", "choice", c("debt_ratio"), repayment, False), Filter("new_charge_12m", "bool", c("new_charges_12m") > 0),
        Filter("relation", "choice", c("ever_ours"), counterparty, False), Filter("main_lender", "in", c("main_lender")), Filter("lenders", "range", c("n_lenders")), Filter("competitor", "bool", c("n_rivals") > 0),
        Filter("competitor_6m", "bool", c("rival_created_6m")), Filter("competitor_entered", "bool", c("rival_entered_12m")),
        Filter("overdue", "bool", c("overdue")), Filter("overdue_6m", "bool", c("overdue_months") >= 6), Filter("confstmt_late", "bool", c("statement_late")), Filter("no_filing_24m", "bool", c("stale_months") >= 24),
        Filter("size_move", "choice", c("upgraded"), size), Filter("relocated", "tri", c("moved")), Filter("sic_changed", "tri", c("sic_changed")),
        score("lending"), score("growth"), score("risk"), Filter("notices", "choice", c("matched"), notices, False),
    ]


#: Filters whose options the panel counts; ranges have none, and regions and industries are searched.
COUNTED = (
    "segment", "lifecycle", "sector", "repayment", "relation", "main_lender", "size_move", "lending", "growth", "risk", "notices", "ever_borrowed", "new_charge_12m", "competitor", "competitor_6m",
    "competitor_entered", "overdue", "overdue_6m", "confstmt_late", "no_filing_24m", "relocated", "sic_changed",
)
VIEWS = {"all": lambda: F.lit(True), "notices": lambda: F.col("matched") == 1, "former": lambda: F.col("ever_ours") & ~F.col("is_ours")}


def view(name: str) -> Column:
    if name not in VIEWS:
        raise FilterError(f"view: one of {', '.join(VIEWS)}")
    return VIEWS[name]()


def presets(top: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """The nine named populations."""
    c = F.col
    trading = is_active() & c("segment").isin(*TRADING_SEGMENTS)
    first = lambda k, n: c(SCORES[k]) >= top.get(k, (float("inf"),) * 2)[n]
    return {
        "proven_borrower": trading & (c("charges") > 0) & (c("outstanding") == 0),
        "unlevered_growth": trading & (c("age") >= 5) & (c("charges") == 0) & first("growth", 1),
        "prospects_not_banked": trading & first("lending", 0) & ~c("ever_ours"),
        "exposure_deteriorating": (c("outstanding") > 0) & (c("overdue_months") >= 6),
        "growing_borrowing": trading & (c("new_charges_12m") > 0) & first("growth", 1),
        "silent_distress": is_active() & (c("matched") == 0) & (c("overdue_months") >= 6) & c("statement_late"),
        "contract_no_borrowing": trading & (c("contracts_won_12m") > 0) & (c("charges") == 0),
        "rival_moved_in": c("ever_ours") & ~c("is_ours") & c("rival_created_6m"),
        "risk_on_our_security": is_active() & first("risk", 0) & (c("n_ours_open") > 0),
    }


_TRADING = {"lifecycle": ["Trading"], "segment": list(TRADING_SEGMENTS)}
#: The presets as requests to the registry; the winners of contracts have no filter for that.
PRESET_REQUESTS = {
    "proven_borrower": _TRADING | {"ever_borrowed": "yes", "outstanding": (None, 0)},
    "unlevered_growth": _TRADING | {"age": (5, None), "ever_borrowed": "no", "growth": "top10"},
    "prospects_not_banked": _TRADING | {"lending": "top1", "relation": ["elsewhere", "unclassified", "no_charge"]},
    "exposure_deteriorating": {"outstanding": (1, None), "overdue_6m": "yes"},
    "growing_borrowing": _TRADING | {"new_charge_12m": "yes", "growth": "top10"},
    "silent_distress": {"lifecycle": ["Trading"], "notices": ["none"], "overdue_6m": "yes", "confstmt_late": "yes"},
    "rival_moved_in": {"relation": "former", "competitor_6m": "yes"},
    "risk_on_our_security": {"lifecycle": ["Trading"], "risk": "top1", "relation": "current"},
}


def preset_table(companies: DataFrame, top: dict[str, tuple[float, float]]) -> DataFrame:
    """preset, n, only_preset, only_filters: the size of each population and how many companies it and its request to the
    registry do not share (null where there is no request), in one scan."""
    filters, sets = registry(top), presets(top)
    held = lambda x: F.coalesce(x, F.lit(False))
    counts = []
    for k, own in sets.items():
        asked = held(where(filters, PRESET_REQUESTS[k])) if k in PRESET_REQUESTS else None
        only = [F.count_if(held(own) & ~asked), F.count_if(asked & ~held(own))] if asked is not None else [F.lit(None).cast("long")] * 2
        counts.append(F.struct(F.lit(k).alias("preset"), F.count_if(own).alias("n"), only[0].alias("only_preset"), only[1].alias("only_filters")))
    return companies.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def panel_counts(companies: DataFrame, filters: list[Filter], request: dict, keys: tuple[str, ...] = COUNTED, base: Column | None = None, most: int = 40) -> DataFrame:
    """facet, option (null: not stated), n: every option of every facet under the other filters, in one scan.

    A row knows how many filters it fails, so it counts for a facet if it fails none but that facet's own. Values of `in`
    filters are those that occur, the `most` largest of each; named options are there with 0 too."""
    by, found = {f.key: f for f in filters}, conditions(filters, request)
    d = companies.filter(base) if base is not None else companies
    fails = {k: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1) for k, c in found.items()}
    options = {k: _options(by[k]) for k in keys if by[k].kind != "in"}
    flat = [v.alias(f"f_{k}") for k, v in fails.items()] + [by[k].column.cast("string").alias(f"v_{k}") for k in keys if by[k].kind == "in"]
    flat += [F.coalesce(c, F.lit(False)).alias(f"o_{k}_{n}") for k, own in options.items() for n, (_, c) in enumerate(own)]
    d = d.select(*flat)
    total = reduce(lambda a, b: a + b, [F.col(f"f_{k}") for k in fails]) if fails else F.lit(0)
    entries = []
    for k in keys:
        counts = total - (F.col(f"f_{k}") if k in fails else F.lit(0)) == 0
        named = [(F.lit(x), F.col(f"o_{k}_{n}")) for n, (x, _) in enumerate(options[k])] if k in options else [(F.col(f"v_{k}"), F.lit(True))]
        entries += [F.when(counts & c, F.struct(F.lit(k).alias("facet"), x.cast("string").alias("option"), F.lit(k in options).alias("named"))) for x, c in named]
    got = d.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).groupBy("e.facet", "e.option", "e.named").agg(F.count("*").alias("n"))
    empty = [(k, x, True, 0) for k, own in options.items() for x, _ in own]
    if empty:
        zeros = companies.sparkSession.createDataFrame(empty, "facet string, option string, named boolean, n long")
        got = got.unionByName(zeros).groupBy("facet", "option", "named").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.col("option").asc_nulls_first()))
    return got.withColumn("place", rank).filter(F.col("named") | (F.col("place") <= most)).select("facet", F.when(F.col("option") != NOT_STATED, F.col("option")).alias("option"), "n")


def _options(f: Filter) -> list[tuple[str, Column]]:
    if f.kind == "choice":
        return [*f.options.items(), *[(NOT_STATED, f.column.isNull())] * f.nullable]
    if f.kind == "bool":
        return [("yes", f.column), ("no", ~f.column)]
    if f.kind == "tri":
        return [("yes", f.column.eqNullSafe(True)), ("no", f.column.eqNullSafe(False)), (NOT_STATED, f.column.isNull())]
    raise FilterError(f"{f.key}: a range has no options")


def search_options(companies: DataFrame, filters: list[Filter], key: str, typed: str, request: dict, most: int = 30) -> DataFrame:
    """option, n: the largest values of an `in` filter that hold the typed text, under the other filters."""
    f = {x.key: x for x in filters}.get(key)
    if f is None or f.kind != "in":
        raise FilterError(f"{key}: no list of options")
    value = f.column.cast("string")
    d = companies.filter(where(filters, request, skip=key)).filter(value.isNotNull() & F.contains(F.upper(value), F.lit(typed.strip().upper())))
    return d.groupBy(value.alias("option")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "option").limit(most)


def service_flags(companies: DataFrame, key: str) -> DataFrame:
    """key, flag: one row for each of nine rules that a company meets, or one `no_signal`. Reads sector, sic, age,
    debt_ratio, has_outstanding, has_our_lender, has_other_lender; what is null meets no rule."""
    c, held = F.col, lambda x: F.coalesce(x, F.lit(False))
    sector, sic = F.lower("sector"), F.lower("sic")
    rules = {
        "our_lender": held(c("has_our_lender")),
        "other_lender": held(c("has_other_lender")) & ~held(c("has_our_lender")),
        "outstanding_charge": c("has_outstanding"),
        "high_debt_ratio": c("debt_ratio") >= 0.5,
        "manufacturing": held(sector.contains("manufacturing")) | held(sic.contains("manufactur")),
        "professional": held(sector.rlike("technology|legal|professional")) | held(sic.rlike("information|software|consult|legal|account")),
        "fast_growth": sector.rlike("fast growth|emerging"),
        "young": c("age") <= 3,
        "established": c("age") >= 10,
    }
    met = F.filter(F.array(*[F.when(rule, flag) for flag, rule in rules.items()]), lambda x: x.isNotNull())
    return companies.select(key, met.alias("flags")).select(key, F.explode(F.when(F.size("flags") > 0, c("flags")).otherwise(F.array(F.lit("no_signal")))).alias("flag"))
