"""Event logs replayed as of each date of a calendar.

An event's life is a run of the calendar's dates, so it is kept as a 64-bit mask: one bit a date. The masks of a contract's
lines or a charge's rows are or-ed, which counts each once, before anything is laid out by date; what is laid out is summed
by key and date in the same stage. So no shuffle grows with the length of the calendar, and no key meets a date by an
inequality.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dates whose bits one mask holds; longer calendars are replayed part by part, each date being on its own.
MASK_DATES = 62


def visible_rows(events: DataFrame, calendar: list, visible_on: Column, until: Column | None = None) -> DataFrame:
    """events with `as_of`: one row for each calendar date from visible_on on, and before `until` where it is given and
    not null. calendar is a sorted list of dates, of the size of a calendar."""
    dates = F.array(*[F.lit(d).cast("date") for d in calendar])
    shown = F.filter(dates, lambda d: (d >= visible_on) & ((F.lit(True) if until is None else F.coalesce(d < until, F.lit(True)))))
    return events.withColumn("as_of", F.explode(shown))


def months_before(d: date, n: int) -> date:
    year, month = divmod(d.year * 12 + d.month - 1 - n, 12)
    return date(year, month + 1, min(d.day, monthrange(year, month + 1)[1]))


def first_at(dates: list[date], day: Column) -> Column:
    """The index of the first of the sorted dates that is not before day; their number if there is none or no day."""
    known = F.array(*[F.lit(d).cast("date") for d in dates])
    return F.when(day.isNull(), len(dates)).otherwise(F.size(F.filter(known, lambda d: d < day))).cast("int")


def bits(start: Column, end: Column) -> Column:
    """The mask of the dates from index start up to end; 0 if there are none."""
    below = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    return F.when(end > start, below(end) - below(start)).otherwise(F.lit(0).cast("long"))


def dates_of(mask: Column, calendar: list[date]) -> Column:
    """array<struct<i, as_of>> of the dates in a mask."""
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).cast("date").alias("as_of")) for i, d in enumerate(calendar)])
    return F.filter(known, lambda x: F.getbit(mask, x["i"]) == 1)


def has(mask: str) -> Column:
    return F.getbit(F.col(mask), F.col("i"))


def _in_parts(build, rows: DataFrame, calendar: list[date], *more) -> DataFrame:
    out = None
    for k in range(0, len(calendar), MASK_DATES):
        part = build(rows, calendar[k : k + MASK_DATES], *more)
        out = part if out is None else out.unionByName(part)
    return out


def award_features(awards: DataFrame, calendar: list[date]) -> DataFrame:
    """Contracts as of month ends (calendar). awards: cn, contract, published date, value. Windows are half open: after
    (end - 12 months) and up to the end. Keys without a visible award have no row; a sum without a value is 0."""
    return _in_parts(_award_features, awards, calendar)


def _award_features(awards: DataFrame, calendar: list[date]) -> DataFrame:
    n, day = len(calendar), F.col("published")
    place = {"a": first_at(calendar, day), "b": first_at([months_before(d, 12) for d in calendar], day), "c": first_at([months_before(d, 24) for d in calendar], day)}
    lines = awards.withColumns(place).filter(F.col("a") < n)
    contracts = lines.groupBy("cn", "contract").agg(F.bit_or(bits(F.col("a"), F.col("b"))).alias("recent"), F.bit_or(bits(F.col("b"), F.col("c"))).alias("before"))
    counts = contracts.withColumn("x", F.explode(dates_of(F.col("recent").bitwiseOR(F.col("before")), calendar))).select("cn", "x.i", "x.as_of", "recent", "before")
    counts = counts.groupBy("cn", "as_of").agg(F.sum(has("recent")).alias("won_12m"), F.sum(has("before")).alias("won_before"))
    value = F.col("value").cast("decimal(18,2)")
    spans = lines.groupBy("cn", "a", "b").agg(F.sum(value).alias("value"), F.count("value").alias("valued"), F.max("published").alias("last"), F.min("published").alias("first"))
    shown = spans.withColumn("x", F.explode(dates_of(bits(F.col("a"), F.lit(n)), calendar))).select("*", "x.i", "x.as_of")
    recent = F.col("i") < F.col("b")
    sums = shown.groupBy("cn", "as_of").agg(
        F.sum(F.when(recent, F.col("value"))).alias("value"), F.sum(F.when(recent, F.col("valued"))).alias("valued"), F.max("last").alias("last"), F.min("first").alias("first"),
    )
    months = lambda a, b: (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sums.join(counts, ["cn", "as_of"], "left").select(
        "cn", "as_of", none("won_12m").alias("won_12m"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value_12m"), none("valued").alias("valued_12m"),
        months(F.col("last"), F.col("as_of")).alias("months_since_award"), (none("won_12m") - none("won_before")).alias("d_won_12m"), F.lit(True).alias("ever_won"), (F.col("first") > F.add_months("as_of", -12)).alias("first_in_12m"),
    )


def lender_features(charges: DataFrame, calendar: list[date], registration_lag: int = 4, satisfaction_lag: int = 1) -> DataFrame:
    """Charges as the register shows them at each date. charges: cn, charge, created, delivered, satisfied, lender, ours.

    A charge is visible `registration_lag` days after the later of creation and delivery, its satisfaction
    `satisfaction_lag` days after. A charge with several lenders has several rows and counts once."""
    return _in_parts(_lender_features, charges, calendar, registration_lag, satisfaction_lag)


def _lender_features(charges: DataFrame, calendar: list[date], registration_lag: int, satisfaction_lag: int) -> DataFrame:
    c, n = F.col, len(calendar)
    year, half = [months_before(d, 12) for d in calendar], [months_before(d, 6) for d in calendar]
    seen, gone = F.date_add(F.greatest("created", F.coalesce("delivered", "created")), registration_lag), F.date_add("satisfied", satisfaction_lag)
    rival = ~c("ours") & (c("lender") != "unclassified")
    r = charges.filter(c("created").isNotNull()).select("cn", "charge", "lender", "ours", "created", "satisfied", rival.alias("rival"), seen.alias("seen"), gone.alias("gone"))
    # places of being seen and gone among the dates, and among the dates a year and half a year before them
    r = r.withColumns({f"{x}_{k}": first_at(dates, c(x)) for x in ("seen", "gone") for k, dates in (("now", calendar), ("year", year), ("half", half))}).filter(c("seen_now") < n)
    only = lambda when, mask: F.when(when, mask).otherwise(F.lit(0).cast("long"))
    open_now, open_then = bits(c("seen_now"), c("gone_now")), bits(c("seen_year"), c("gone_year"))
    left = bits(F.greatest("seen_now", "gone_now"), c("gone_half"))
    masks = {
        "shown": bits(c("seen_now"), F.lit(n)), "open": open_now, "open_ours": only(c("ours"), open_now), "then": open_then, "then_other": only(~c("ours"), open_then),
        "rival_12m": only(c("rival"), bits(c("seen_now"), c("seen_year"))), "rival_6m": only(c("rival"), bits(c("seen_now"), c("seen_half"))), "ours_gone_6m": only(c("ours"), left),
        "ours_gone": only(c("ours"), bits(F.greatest("seen_now", "gone_now"), F.lit(n))), "ours_shown": only(c("ours"), bits(c("seen_now"), F.lit(n))),
    }
    # one row a charge and lender, then one a charge: both find their rows where this shuffle puts them
    r = r.select("cn", "charge", "lender", "rival", "created", "satisfied", *[v.alias(k) for k, v in masks.items()]).repartition("cn", "charge")
    dated = {"ours_created": ("ours_shown", "created"), "ours_satisfied": ("ours_gone", "satisfied")}
    per = r.groupBy("cn", "charge").agg(*[F.bit_or(k).alias(k) for k in masks], *[F.collect_set(F.when(c(m) != 0, F.struct(F.col(d).alias("day"), c(m).alias("mask")))).alias(k) for k, (m, d) in dated.items()])
    at = per.withColumn("x", F.explode(dates_of(c("shown"), calendar))).select("*", "x.i", "x.as_of")
    latest = lambda k: F.max(F.array_max(F.transform(c(k), lambda x: F.when(F.getbit(x["mask"], c("i")) == 1, x["day"]))))
    counted = ("open", "open_ours", "then", "then_other", "rival_12m", "rival_6m", "ours_gone_6m")
    g = at.groupBy("cn", "as_of").agg(*[F.sum(has(k)).alias(f"n_{k}") for k in counted], (F.max(has("ours_shown")) == 1).alias("ever_ours"), *[latest(k).alias(k) for k in dated])
    named = r.filter((c("lender") != "unclassified") & (c("open") != 0)).groupBy("cn", "charge", "lender").agg(F.bit_or("open").alias("open"), F.max("created").alias("created"), F.max("rival").alias("rival"))
    by = named.withColumn("x", F.explode(dates_of(c("open"), calendar))).groupBy("cn", "x.as_of", "lender").agg(F.count("*").alias("n"), F.max("created").alias("newest"), F.max("rival").alias("rival"))
    main = by.groupBy("cn", "as_of").agg(F.count("*").alias("n_lenders"), F.count_if("rival").alias("n_rivals"), F.min_by("lender", F.struct(-F.col("n"), -F.unix_date("newest"), F.col("lender"))).alias("main_lender"))
    months = lambda a: (F.year("as_of") - F.year(a)) * 12 + F.month("as_of") - F.month(a)
    return g.join(main, ["cn", "as_of"], "left").select(
        "cn", "as_of", "n_open", c("n_open_ours").alias("n_ours"), (c("n_open_ours") > 0).alias("is_ours"), F.when(c("n_open") > 0, c("n_open_ours") / c("n_open")).alias("share_ours"),
        F.coalesce("n_lenders", F.lit(0)).cast("long").alias("n_lenders"), F.coalesce("n_rivals", F.lit(0)).cast("long").alias("n_rivals"),
        months(c("ours_created")).alias("months_since_ours"), months(c("ours_satisfied")).alias("months_since_ours_gone"),
        ((c("n_then") > 0) & (c("n_then_other") == 0) & (c("n_rival_12m") > 0)).alias("rival_entered_12m"),
        (c("n_ours_gone_6m") > 0).alias("ours_gone_6m"), (c("n_rival_6m") > 0).alias("rival_created_6m"), "ever_ours", "main_lender",
    )


def relationship_feeds(live: DataFrame) -> DataFrame:
    """live rows with `feed`, a row once for each feed it is in."""
    c = F.col
    feeds = {
        "client": c("is_ours"), "just_switched": ~c("is_ours") & c("ever_ours") & c("ours_gone_6m") & c("rival_created_6m"),
        "competitor_entered": c("is_ours") & c("rival_entered_12m"), "borrowing_elsewhere": ~c("is_ours") & (c("n_rivals") > 0),
    }
    met = F.filter(F.array(*[F.when(when, F.lit(k)) for k, when in feeds.items()]), lambda x: x.isNotNull())
    return live.withColumn("feed", F.explode(met))


def handover(base: DataFrame, awards: DataFrame, lenders: DataFrame, scores: DataFrame, key: str = "cn") -> DataFrame:
    """base with the sparse blocks beside it, a row for each of its rows. Of companies that a block does not know, counts
    and sums are 0 and flags false; months since an event, shares and names stay null, and so do scores."""
    out = base
    for block in (awards, lenders):
        known = [x for x, kind in block.dtypes if x != key and not x.startswith("months_") and kind in ("bigint", "double", "boolean") and not x.startswith("share_")]
        kinds = dict(block.dtypes)
        out = out.join(block, key, "left").withColumns({x: F.coalesce(F.col(x), F.lit(False) if kinds[x] == "boolean" else F.lit(0).cast(kinds[x])) for x in known})
    return out.join(scores, key, "left")


def handover_checks(wide: DataFrame, base: DataFrame, in_universe: Column, feature: str, key: str = "cn", month: str = "m") -> DataFrame:
    """One row: keys and fan-out, scores on exactly the active rows, filled blocks, the universe, the share of active rows
    in which a twelve-month feature is alive, the months."""
    c, n = F.col, F.count_if
    scored = c("score_lending").isNotNull()
    checks = wide.agg(
        F.count("*").alias("n_rows"), F.count_distinct(key).alias("distinct_keys"), n(c(key).isNull()).alias("null_keys"), n("is_active").alias("active"), n(scored).alias("scored"),
        n(c("is_active") & ~scored).alias("active_unscored"), n(~c("is_active") & scored).alias("inactive_scored"), n("ever_won").alias("has_award"), n(c("won_12m").isNull()).alias("awards_null"),
        n(c("months_since_award").isNull()).alias("never_won"), n(c("n_open") > 0).alias("has_open"), n(c("n_open").isNull()).alias("open_null"), n("is_ours").alias("ours"), n(c("ever_ours") & ~c("is_ours")).alias("lapsed"),
        n(in_universe).alias("in_sector"), n(in_universe & c("is_active")).alias("in_sector_trading"), F.round(F.avg(F.when(c("is_active"), c(feature).isNotNull().cast("int"))), 6).alias("alive_12m"),
        F.min(month).alias("first_month"), F.max(month).alias("last_month"),
    )
    return checks.crossJoin(F.broadcast(base.agg(F.count("*").alias("base_rows"))))  # one row each


def primary(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key with `nth`. The limit is pushed below the shuffle, so a key with a third of all rows
    sends n rows a partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def near_event(rows: DataFrame, key: str, day: str, event: Column, months: int) -> Column:
    """Whether an event of the same key lies within so many calendar months of the row, either way. The nearest one on
    each side decides, so no row is paired with another. Use it in select() on `rows`."""
    w = Window.partitionBy(key).orderBy(F.unix_date(day))
    before = F.max(F.when(event, F.col(day))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(event, F.col(day))).over(w.rangeBetween(0, Window.unboundedFollowing))
    return F.coalesce(before >= F.add_months(day, -months), F.lit(False)) | F.coalesce(after <= F.add_months(day, months), F.lit(False))
