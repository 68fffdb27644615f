"""Event and notice logs rolled up to one row an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_pack(events: DataFrame, prefix: str, at: Column) -> DataFrame:
    """events: cn, event_date date, event_type, value, confidence, method. Counts are 0 or more, value totals null where
    no event carries a value, names sorted and joined by |."""
    p, day = prefix, F.col("event_date")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return events.groupBy("cn").agg(
        F.lit(1).alias(f"{p}_has_any"), F.count("*").alias(f"{p}_count_total"), F.count_if(day >= F.add_months(at, -12)).alias(f"{p}_count_12m"),
        F.min(day).alias(f"{p}_first_date"), F.max(day).alias(f"{p}_latest_date"), F.datediff(at, F.max(day)).alias(f"{p}_days_since_latest"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias(f"{p}_value_total"), F.max("value").alias(f"{p}_value_max"), F.count("value").alias(f"{p}_value_count"),
        names("event_type").alias(f"{p}_types"), names("method").alias(f"{p}_methods"), F.max("confidence").alias(f"{p}_max_confidence"), F.min("confidence").alias(f"{p}_min_confidence"),
    )


# The stage of each family of notices that has one, the families of an open case, and the names of stages.
STAGES = {"petition": 1, "winding_up_order": 2, "administration": 2, "voluntary_liquidation": 2, "creditor_process": 3, "dividend": 4, "closing": 5}
OPEN_FAMILIES = ("petition", "winding_up_order", "administration", "voluntary_liquidation")
STAGE_NAMES = {1: "petition", 2: "formal_insolvency", 3: "creditor_process", 4: "dividend", 5: "closing"}
TIERS = {0: "none", 1: "early_warning", 2: "formal_insolvency"}
RECEIVERS = "Appointment of Administrative Receivers"
#: Counted families by the name of their count, and what tells that a company has any.
COUNTED = {
    "winding_up_petition": "petition", "winding_up_order": "winding_up_order", "voluntary_liquidation": "voluntary_liquidation", "administration": "administration",
    "creditors_process": "creditor_process", "dividend_notice": "dividend", "closing_notice": "closing",
}
FLAGGED = {"prohibited_name_reuse": "prohibited_name_reuse", "petition_dismissed": "petition_dismissed", "cross_border_insolvency": "cross_border", "other_insolvency": "other_insolvency"}


def _named(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def notice_features(notices: DataFrame, at: Column) -> DataFrame:
    """notices: cn, name, family, notice_type, notice_date, postcode, url. One row a company with its 50 features as of `at`.

    One aggregate over rows that were ordered once: bursts look two notices ahead; the latest notice is that of the last
    date, then the largest url; the name is that of the earliest notice that has one. Flags are 0 or 1."""
    w = Window.partitionBy("cn").orderBy("notice_date", "url")
    c, day = F.col, F.col("notice_date")
    d = notices.withColumns({"stage": _named(STAGES, c("family")), "gap": F.datediff(F.lead("notice_date", 2).over(w), "notice_date"), "postcode": F.trim(F.coalesce("postcode", F.lit("")))})
    is_ = lambda *f: c("family").isin(*f)
    liquid = is_("voluntary_liquidation", "winding_up_order")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    when = lambda f, x: f(F.when(x, day))
    order = F.struct("notice_date", "url")
    g = d.groupBy("cn").agg(
        F.min_by("name", F.when(c("name").isNotNull(), order)).alias("company_name"), F.count("notice_type").alias("notice_count_total"),
        F.size(F.collect_set("notice_type")).cast("long").alias("distinct_notice_type_count"),  # of the kinds of notices there are
        *[F.count_if(is_(f)).alias(f"{n}_count") for n, f in COUNTED.items()], F.count_if(liquid).alias("liquidation_notice_count"),
        F.min(day).alias("first_notice_date"), F.max(day).alias("latest_notice_date"), F.count_if(day >= F.date_sub(at, 365)).alias("notice_count_12m"), F.count_if(day >= F.date_sub(at, 730)).alias("notice_count_24m"),
        F.coalesce(F.max("stage"), F.lit(0)).alias("max_distress_stage"), F.min("stage").alias("least"), *[flag(F.max(is_(f))).alias(f"has_{n}") for n, f in FLAGGED.items()],
        flag(F.max(c("notice_type") == RECEIVERS)).alias("receiver_appointed_flag"), flag(F.max(F.contains("notice_type", F.lit("Partnership")))).alias("partnership_insolvency_flag"), flag(F.max(c("postcode") != "")).alias("postcode_present_flag"),
        F.max_by(F.struct("stage", "family", "postcode", "url"), order).alias("last"), when(F.min, is_("petition")).alias("petition"), when(F.min, is_("administration")).alias("administration"),
        when(F.min, liquid).alias("liquid_first"), when(F.max, liquid).alias("liquid_last"), flag(F.max(c("gap") <= 90)).alias("notice_burst_flag"),
    )
    since, span = F.datediff(at, "latest_notice_date"), F.datediff("latest_notice_date", "first_notice_date")
    to_order = F.datediff("liquid_first", "petition")
    has = {"has_liquidation" if n == "voluntary_liquidation" else f"has_{n}": c("liquidation_notice_count" if n == "voluntary_liquidation" else f"{n}_count") > 0 for n in COUNTED}
    place = F.nullif(c("last.postcode"), F.lit(""))
    g = g.withColumns({k: flag(v) for k, v in has.items()} | {
        "has_any_notice": F.lit(1),
        "compulsory_liquidation_flag": flag(c("winding_up_order_count") > 0),
        "voluntary_liquidation_flag": flag((c("voluntary_liquidation_count") > 0) & (c("winding_up_order_count") == 0)),
        "court_involved_flag": flag((c("winding_up_petition_count") > 0) | (c("winding_up_order_count") > 0)),
        "severity_tier": F.coalesce(_named(TIERS, c("max_distress_stage")), F.lit("terminal")),
        "days_since_latest_notice": since, "days_since_first_notice": F.datediff(at, "first_notice_date"), "notice_span_days": span,
        "recent_notice_90d_flag": flag(since <= 90), "recent_notice_365d_flag": flag(since <= 365),
        "stage_progressed_flag": flag(c("max_distress_stage") - F.coalesce("least", "max_distress_stage") >= 2),
        "current_stage": F.coalesce(_named(STAGE_NAMES, c("last.stage")), F.lit("other")),
        "active_case_flag": flag(c("last.family").isin(*OPEN_FAMILIES) & (since <= 365)),
        "notice_postcode": place, "notice_postcode_area": F.nullif(F.upper(F.regexp_extract(place, "^([A-Za-z]{1,2})", 1)), F.lit("")), "latest_notice_url": c("last.url"),
        "petition_to_liquidation_flag": flag(c("liquid_last") >= c("petition")), "administration_to_liquidation_flag": flag(c("liquid_last") >= c("administration")),
        "days_petition_to_order": F.when(to_order >= 0, to_order),
        "recurring_distress_flag": flag(span > 180),  # so there are two dates at least
    })
    return g.drop("least", "last", "petition", "administration", "liquid_first", "liquid_last")


def cross_source_dedup(rows: DataFrame, keys: list[str], source: str, date: str) -> DataFrame:
    """Where several sources have the same key, keep all rows of the source that has it first; one source's own repeats
    are kept. Ties by source name."""
    w = Window.partitionBy(*keys)
    winner = F.min(F.struct(date, source)).over(w)
    return rows.withColumn("_w", winner).filter(F.col(source) == F.col(f"_w.{source}")).drop("_w")


def upsert_by(existing: DataFrame, incoming: DataFrame, by: str = "source") -> DataFrame:
    """existing with all rows of the incoming sources replaced."""
    return existing.join(incoming.select(by).distinct(), by, "left_anti").unionByName(incoming)


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing, and the incoming rows whose key it has not; of equal incoming keys one stays, the smallest row."""
    from .asof import primary

    rest = [F.col(c).asc_nulls_last() for c in incoming.columns if c not in key]
    one = primary(incoming, key, rest or [F.col(key[0])])
    return existing.unionByName(one.join(existing.select(*key), key, "left_anti"))


def watermark(events: DataFrame, source: str, date: str) -> DataFrame:
    """One row: the date up to which every source is complete."""
    return events.groupBy(source).agg(F.max(date).alias("_d")).agg(F.min("_d").alias("watermark"))


def first_appearances(events: DataFrame, shown: DataFrame, date: str, tie: str, calendar: list) -> DataFrame:
    """lo, hi: the days from an event to the last snapshot that lacks it and to the first that holds it.

    A snapshot states only how many events a company has: the event of rank r (by date, then tie) is there once the count
    reaches r. events: cn, date, tie; shown: cn, shown (the day from which the source counts an event). Each snapshot is
    laid out over the ranks that it is the first to reach, so ranks meet by equality. Events that the calendar's ends cut
    off are left out."""
    days = F.array(*[F.lit(d).cast("date") for d in calendar])
    first = F.size(F.filter(days, lambda d: d < F.col("shown")))
    counts = shown.filter(F.col("shown").isNotNull()).select("cn", first.alias("i")).filter(F.col("i") < len(calendar)).groupBy("cn", "i").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("cn").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("upto", upto).select("cn", "i", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("r"))
    ranks = events.filter(F.col(date).isNotNull()).select("cn", F.col(date).alias("day"), F.row_number().over(Window.partitionBy("cn").orderBy(date, tie)).cast("long").alias("r"))
    inside = ranks.filter((F.col("day") > F.lit(calendar[0])) & (F.col("day") < F.add_months(F.lit(calendar[-1]), -1)))
    met = inside.join(reached, ["cn", "r"]).filter(F.col("i") > 0)
    at = lambda k: F.get(days, F.col("i") - k)
    return met.select(F.datediff(at(1), "day").alias("lo"), F.datediff(at(0), "day").alias("hi"))


def lag_grid(brackets: DataFrame, most: int = 30) -> DataFrame:
    """lag, n, early, stale: for each lag in days, the per cent of events it admits before their source shows them and holds
    back after."""
    counts = brackets.groupBy("lo", "hi").agg(F.count("*").alias("n"))
    grid = counts.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most))))
    share = lambda when: F.round(100.0 * F.sum(F.when(when, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return grid.groupBy("lag").agg(F.sum("n").alias("n"), share(F.col("lo") >= F.col("lag")).alias("early"), share(F.col("hi") < F.col("lag")).alias("stale"))
