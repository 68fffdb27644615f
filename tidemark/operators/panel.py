"""A company-month panel and what looks back or ahead in it.

All windows partition by the key and order by a whole month number, so one shuffle and one sort serve them all. A RANGE
frame on the month number is calendar-aware: an absent month is an empty frame, and nothing is ever shifted by a hole.
(key, month) must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import months_between


class Months:
    """Window expressions over one key and month column."""

    def __init__(self, key: str = "cn", month: str = "m"):
        self.key, self.month = key, month
        self.w = Window.partitionBy(key).orderBy(month)

    def lag(self, c: Column, n: int) -> Column:
        """The value n calendar months before; null where that month is absent."""
        return F.max(c).over(self.w.rangeBetween(-n, -n))

    def present(self, n: int) -> Column:
        return F.count(F.lit(1)).over(self.w.rangeBetween(-n, -n)) > 0

    def previous(self, c: Column) -> Column:
        """The last non-null value before this row."""
        return F.last(c, ignorenulls=True).over(self.w.rowsBetween(Window.unboundedPreceding, -1))

    def trailing(self, c: Column, n: int) -> Column:
        """Sum over n calendar months up to this one, 0 if none."""
        return F.coalesce(F.sum(c).over(self.w.rangeBetween(-(n - 1), 0)), F.lit(0))

    def ahead(self, agg: Column, n: int) -> Column:
        """An aggregate over the n calendar months after this one."""
        return agg.over(self.w.rangeBetween(1, n))

    def last_month(self, flag: Column) -> Column:
        """The latest month so far in which flag held."""
        return F.max(F.when(flag, F.col(self.month))).over(self.w.rowsBetween(Window.unboundedPreceding, 0))

    def ever_before(self, flag: Column) -> Column:
        held = F.max(F.when(flag, 1).otherwise(0)).over(self.w.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(held, F.lit(0)) == 1


def run_starts(panel: DataFrame, columns: list[str], key: str = "cn", month: str = "m") -> DataFrame:
    """<c>_since for each column: the first month of the run of equal values that this row is in.

    A run breaks where the value differs from the last non-null one before it; holes and nulls before do not break it.
    Since months only grow, a run's start is the latest break so far, in the same order as all other windows."""
    w = Months(key, month)
    out = panel
    for c in columns:
        before = w.previous(F.col(c))
        out = out.withColumn(f"_{c}_break", before.isNotNull() & ~before.eqNullSafe(F.col(c)))
    first = F.min(month).over(w.w.rowsBetween(Window.unboundedPreceding, 0))
    for c in columns:
        out = out.withColumn(f"{c}_since", F.coalesce(w.last_month(F.col(f"_{c}_break")), first))
    return out.drop(*[f"_{c}_break" for c in columns])


def changed(now: Column, then: Column, was_present: Column) -> Column:
    """Null-safe difference, null where the earlier month is absent."""
    return F.when(was_present, ~now.eqNullSafe(then))


#: What deltas() reads beside the key and month, and what it adds.
DELTA_INPUTS = (
    "source_date", "charges", "outstanding", "satisfied", "debt_ratio", "status", "is_active", "segment", "tier", "overdue", "stale",
    "sic", "name", "postcode", "accounts_due", "statement_due", "accounts_made", "statement_made",
)
DELTA_FEATURES = (
    "d_charges_3m", "d_charges_6m", "d_charges_12m", "d_outstanding_3m", "d_outstanding_6m", "d_outstanding_12m", "d_satisfied_12m", "debt_ratio_trend_12m",
    "new_charge_events_12m", "months_since_last_new_charge", "status_changed", "months_in_current_status", "ever_distressed_before",
    "segment_upgraded_12m", "segment_downgraded_12m", "months_since_segment_change", "accounts_overdue_streak_months", "accounts_stale_streak_months",
    "confstmt_late", "days_to_next_accounts_due", "months_since_last_accounts_filing", "months_since_last_confstmt",
    "sic_changed_12m", "name_changed_12m", "postcode_changed_12m",
)


def deltas(panel: DataFrame, key: str = "cn", month: str = "m") -> DataFrame:
    """The 25 backward features (DELTA_FEATURES) of a panel with DELTA_INPUTS, which stay beside them. Nothing after the
    row's own month is read; dates are compared with the row's own source_date, never with today.

    Differences are null where the earlier month is absent. Runs and streaks are counted over the months that are there,
    from the first one seen on. All windows share one partition and one order."""
    w, c = Months(key, month), F.col
    whole = {f"{x}_{n}": w.lag(c(x), n) for x, spans in (("charges", (1, 3, 6, 12)), ("outstanding", (3, 6, 12)), ("satisfied", (12,)), ("debt_ratio", (12,)), ("status", (1,)), ("tier", (12,)), ("sic", (12,)), ("name", (12,)), ("postcode", (12,))) for n in spans}
    p = panel.select(key, month, *DELTA_INPUTS).withColumns(whole | {"had_1": w.present(1), "had_12": w.present(12)})
    p = p.withColumn("new_charge", F.when(c("had_1"), c("charges") > c("charges_1")))
    p = run_starts(p, ["status", "segment", "overdue", "stale"], key, month)
    new, tiers = c("new_charge") == F.lit(True), c("tier").isNotNull() & c("tier_12").isNotNull()
    streak = lambda x: F.when(c(x), c(month) - c(f"{x}_since") + 1).otherwise(0)
    features = {f"d_{x}_{n}m": c(x) - c(f"{x}_{n}") for x in ("charges", "outstanding") for n in (3, 6, 12)} | {
        "d_satisfied_12m": c("satisfied") - c("satisfied_12"),
        "debt_ratio_trend_12m": c("debt_ratio") - c("debt_ratio_12"),
        "new_charge_events_12m": w.trailing(F.when(new, 1).otherwise(0), 12),
        "months_since_last_new_charge": c(month) - w.last_month(new),
        "status_changed": changed(c("status"), c("status_1"), c("had_1")),
        "months_in_current_status": c(month) - c("status_since"),
        "ever_distressed_before": w.ever_before(~c("is_active")),
        "segment_upgraded_12m": F.when(tiers, c("tier") > c("tier_12")),
        "segment_downgraded_12m": F.when(tiers, c("tier") < c("tier_12")),
        "months_since_segment_change": c(month) - c("segment_since"),
        "accounts_overdue_streak_months": streak("overdue"),
        "accounts_stale_streak_months": streak("stale"),
        "confstmt_late": c("statement_due") < c("source_date"),
        "days_to_next_accounts_due": F.datediff("accounts_due", "source_date"),
        "months_since_last_accounts_filing": months_between(c("accounts_made"), c("source_date")),
        "months_since_last_confstmt": months_between(c("statement_made"), c("source_date")),
    } | {f"{x}_changed_12m": changed(c(x), c(f"{x}_12"), c("had_12")) for x in ("sic", "name", "postcode")}
    return p.withColumns(features).select(key, month, *DELTA_INPUTS, *DELTA_FEATURES)


def forward_labels(panel: DataFrame, end_month: int, key: str = "cn", month: str = "m") -> DataFrame:
    """Labels over the months after an origin. Null where the window runs past the panel's end or holds no observation;
    the lending window counts observed charges, the others rows."""
    w, c = Months(key, month), F.col

    def label(value: Column, seen: Column, horizon: int) -> Column:
        return F.when((c(month) + horizon <= end_month) & (seen > 0), value)

    worst = lambda s, n: w.ahead(F.max(F.when(c("status") == s, 1).otherwise(0)), n)
    rows = lambda n: w.ahead(F.count(F.lit(1)), n)
    best = lambda n: w.ahead(F.max("tier"), n)
    growth = lambda n: label(F.when(c("tier").isNotNull() & best(n).isNotNull(), (best(n) > c("tier")).cast("int")), rows(n), n)
    return panel.select(
        key, month,
        label((w.ahead(F.max("charges"), 3) > c("charges")).cast("int"), w.ahead(F.count("charges"), 3), 3).alias("y_lending"),
        label(worst("F", 6), rows(6), 6).alias("y_insolvency"),
        label(worst("P", 6), rows(6), 6).alias("y_exit"),
        growth(12).alias("y_growth"), growth(6).alias("y_growth_6m"),
    )
