"""Ranking metrics that treat ties exactly, from counts by score.

Rows shrink to (score, positives, negatives) first. Running counts over scores are taken in two steps: within bands of
neighbouring scores, and over the bands' totals. So no task orders all distinct scores, whatever their number, and no job
runs ahead to find the bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands an octave of scores: a band is a 250th part of a score wide.
BANDS = 256


def by_score(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*(groups or []), score).agg(F.sum(label).cast("double").alias("pos"), (F.count("*") - F.sum(label)).cast("double").alias("neg"))


def band(score: Column) -> Column:
    """A whole number that never falls as the score grows. At most 2 * 2098 * BANDS bands hold all finite scores."""
    x = score.cast("double")
    half = F.lit(1100 * BANDS)  # beyond the smallest and largest octave
    return F.when(x > 0, F.floor(F.log2(x) * BANDS) + 2 * half).when(x < 0, -F.floor(F.log2(-x) * BANDS) - 2 * half).otherwise(F.lit(0)).cast("long")


def running(counts: DataFrame, score: str, groups: list[str], values: list[str], descending: bool = True) -> DataFrame:
    """counts with upto_<value>, the sum over all scores from the best (or the lowest) to the row's own, and all_<value>.
    One row a group and score."""
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    d = counts.withColumn("_band", band(F.col(score)))
    inner = Window.partitionBy(*groups, "_band").orderBy(order(score)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_in_{v}": F.sum(v).over(inner) for v in values})
    totals = counts.groupBy(*groups, band(F.col(score)).alias("_band")).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    outer = Window.partitionBy(*groups).orderBy(order("_band"))
    before = {f"_b_{v}": F.coalesce(F.sum(f"_t_{v}").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) for v in values}
    whole = {f"all_{v}": F.sum(f"_t_{v}").over(Window.partitionBy(*groups)) for v in values}
    bands = totals.withColumns(before | whole).drop(*[f"_t_{v}" for v in values])
    out = d.join(bands, [*groups, "_band"])
    return out.withColumns({f"upto_{v}": F.col(f"_in_{v}") + F.col(f"_b_{v}") for v in values}).drop("_band", *[f"_{k}_{v}" for k in ("in", "b") for v in values])


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with the exact quantile (interpolated between neighbours) for each share: q0, q1, ... No aggregate holds all
    values; equal ones shrink to a count and the counts are ranked in bands."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    r = running(counts, "v", [], ["n"], descending=False)
    out = []
    for k, share in enumerate(shares):
        at = share * (F.col("all_n") - 1)
        low, high = (F.min(F.when(F.col("upto_n") > f(at), F.col("v"))) for f in (F.floor, F.ceil))
        up = F.max(at - F.floor(at))
        out.append((low * (1 - up) + high * up).alias(f"q{k}"))
    return r.agg(*out)


def ranking(df: DataFrame, score: str, label: str, groups: list[str] | None = None, cuts: tuple[int, ...] = (100,)) -> DataFrame:
    """n, base_rate, roc_auc, pr_auc (average precision), and precision and lift at each cut, by group.

    Tied scores count half in roc_auc and enter pr_auc together. At a cut within a tie, the tie's rows are taken in
    proportion. precision at n is null with fewer than n rows."""
    groups, c = groups or [], F.col
    s = running(by_score(df, score, label, groups), score, groups, ["pos", "neg"])
    tp, fp, p, n = c("upto_pos"), c("upto_neg"), c("all_pos"), c("all_neg")
    won = c("pos") * (n - fp) + c("pos") * c("neg") / 2
    taken = lambda k: F.greatest(F.lit(0.0), F.least(c("pos") + c("neg"), k - (tp + fp - c("pos") - c("neg"))))
    rows = (F.max(p) + F.max(n)).cast("long")
    rate = F.try_divide(F.max(p), F.max(p) + F.max(n))
    hits = lambda k: F.when(rows >= k, F.sum(c("pos") / (c("pos") + c("neg")) * taken(F.lit(float(k)))) / k)
    out = [rows.alias("n"), rate.alias("base_rate"), F.try_divide(F.sum(won), F.max(p) * F.max(n)).alias("roc_auc"), F.try_divide(F.sum(c("pos") * tp / (tp + fp)), F.max(p)).alias("pr_auc")]
    for k in cuts:
        out += [hits(k).alias(f"precision_{k}"), F.try_divide(hits(k), rate).alias(f"lift_{k}")]
    return s.groupBy(*groups).agg(*out)


def poisson(key: list[Column], resamples: int) -> Column:
    """A Poisson(1) weight up to 7 for each resample, fixed by the key's hash: an array."""
    steps = F.lit(poisson_steps())
    share = lambda b: F.conv(F.substring(F.md5(F.concat_ws("|", *key, b)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.transform(F.transform(F.sequence(F.lit(1), F.lit(resamples)), share), lambda u: F.size(F.filter(steps, lambda s: u >= s)))


def poisson_steps() -> list[float]:
    """The chances of a weight of at most 0, 1, ... 6."""
    total, term, out = 0.0, 0.36787944117144233, []
    for k in range(1, 8):
        total += term
        out.append(total)
        term /= k
    return out


def resampled(df: DataFrame, score: str, label: str, key: list[Column], resamples: int) -> DataFrame:
    """b, score, pos, neg: weighted counts by score for each resample, a bootstrap without an index into the whole table.

    A resample is a pair of sums beside the others in one aggregate by score, so rows are not multiplied; the sums are laid
    out by resample afterwards. Keys that are equal (as a company's rows) get equal weights: a cluster bootstrap."""
    y = F.col(label)
    d = df.filter(y.isNotNull() & F.col(score).isNotNull()).select(F.col(score).cast("double").alias("score"), y.alias("y"), *[k.alias(f"key_{i}") for i, k in enumerate(key)])
    own = [F.col(f"key_{i}") for i in range(len(key))]
    d = d.withColumn("w", poisson(own, resamples))
    sums = [F.struct(F.lit(b).alias("b"), F.sum(F.get("w", F.lit(b - 1)) * F.col("y")).cast("double").alias("pos"), F.sum(F.get("w", F.lit(b - 1)) * (1 - F.col("y"))).cast("double").alias("neg")) for b in range(1, resamples + 1)]
    return d.groupBy("score").agg(F.array(*sums).alias("all")).select("score", F.inline("all")).filter("pos + neg > 0")


def _auc(s: DataFrame, groups: list[str]) -> DataFrame:
    c = F.col
    r = running(s, "score", groups, ["pos", "neg"])
    return r.groupBy(*groups).agg(F.try_divide(F.sum(c("pos") * (c("all_neg") - c("upto_neg")) + c("pos") * c("neg") / 2), F.max("all_pos") * F.max("all_neg")).alias("auc"))


def _interval(df: DataFrame, value: str) -> DataFrame:
    return df.agg(*[F.percentile(value, q).alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])


def bootstrap_interval(df: DataFrame, score: str, label: str, key: list[Column], resamples: int = 200) -> DataFrame:
    """roc_auc's 2.5, 50 and 97.5 percentiles over resamples."""
    return _interval(_auc(resampled(df, score, label, key, resamples), ["b"]), "auc")


def paired_delta(df: DataFrame, score_a: str, score_b: str, label: str, key: list[Column], resamples: int = 200) -> DataFrame:
    """low, mid, high of roc_auc(b) - roc_auc(a), both under the same weights."""
    a, b = (_auc(resampled(df, s, label, key, resamples), ["b"]).select("b", F.col("auc").alias(n)) for s, n in ((score_a, "auc_a"), (score_b, "auc_b")))
    return _interval(a.join(b, "b").select((F.col("auc_b") - F.col("auc_a")).alias("d")), "d")


def mean_rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc from average ranks of positives (Mann-Whitney)."""
    s = running(by_score(df, score, label), score, [], ["pos", "neg"], descending=False)
    rank = F.col("upto_pos") + F.col("upto_neg") - (F.col("pos") + F.col("neg") - 1) / 2
    p, n = F.sum("pos"), F.sum("neg")
    return s.agg(F.try_divide(F.sum(F.col("pos") * rank) - p * (p + 1) / 2, p * n).alias("auc"))
