"""Modelling and evaluation queries (ML)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.explain import contributions as contributions_of
from ..operators.explain import kernel_values, tree_values
from ..operators.metrics import bootstrap_interval, paired_delta, poisson_steps, ranking
from ..operators.models import auc, fit, flagged, fold_of, frequent, grouped_auc, held_back, importance, linear_contributions, score, top_reasons, tune
from .registry import query
from .standins import WIDE, wide

SCORED = "s AS (SELECT o_orderkey AS k, o_custkey AS cn, year(o_orderdate)::INTEGER AS origin, floor(o_totalprice / 5000)::DOUBLE AS p, floor(o_totalprice / 50000)::DOUBLE AS q, CASE WHEN o_orderkey % 17 > 0 THEN (o_orderpriority = '1-URGENT')::INT END AS y FROM orders)"


def scored(t):
    v = F.col("o_totalprice")
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cn"), F.year("o_orderdate").alias("origin"), F.floor(v / 5000).cast("double").alias("p"), F.floor(v / 50000).cast("double").alias("q"), F.when(F.col("o_orderkey") % 17 > 0, (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("y"))


def metrics_sql(group: str | None) -> str:
    by, part = (f"{group}, ", f"PARTITION BY {group} ") if group else ("", "")
    n = 2 if group else 1
    return f"""WITH {SCORED}, g AS (SELECT {by}p AS s, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM s WHERE y IS NOT NULL GROUP BY {', '.join(map(str, range(1, n + 1)))}),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM g WINDOW w AS ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING), a AS ({part.strip()})),
k AS (SELECT {by}(max(p) + max(n))::BIGINT AS n, max(p) / (max(p) + max(n)) AS base_rate, sum(pos * (n - fp) + pos * neg / 2) / (max(p) * max(n)) AS roc_auc, sum(pos * tp / (tp + fp)) / max(p) AS pr_auc,
  CASE WHEN max(p) + max(n) >= 100 THEN sum(pos / (pos + neg) * greatest(0, least(pos + neg, 100 - (tp + fp - pos - neg)))) / 100 END AS precision_100 FROM c {f'GROUP BY {group}' if group else ''})
SELECT {by}n, base_rate, roc_auc, pr_auc, precision_100, precision_100 / base_rate AS lift_100 FROM k"""


@query("ml7_ranking_metrics", metrics_sql(None))
def ml7(t):
    return ranking(scored(t), "p", "y")


@query("ml8_metrics_by_origin", metrics_sql("origin"))
def ml8(t):
    return ranking(scored(t), "p", "y", ["origin"])


RESAMPLES = 50
STEPS = poisson_steps()


def resampled_sql(name: str, score: str, key: str) -> str:
    """AUC of each resample, from the same weights: how many steps the key's hash is beyond."""
    u = f"('0x' || md5({key}::VARCHAR || '|' || b::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE"
    weight = " + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in STEPS)
    return f"""{name}_w AS (SELECT b, {score} AS v, y, {weight} AS w FROM (SELECT *, {u} AS u FROM s, (SELECT unnest(range(1, {RESAMPLES + 1})) AS b) WHERE y IS NOT NULL)),
{name}_g AS (SELECT b, v, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM {name}_w GROUP BY 1, 2),
{name}_r AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER (PARTITION BY b) AS p, sum(neg) OVER (PARTITION BY b) AS n FROM {name}_g),
{name} AS (SELECT b, sum(pos * (n - fp) + pos * neg / 2) / (max(p) * max(n)) AS auc FROM {name}_r GROUP BY 1)"""


def interval_sql(value: str) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), 9) AS {n}" for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975)))


def rounded(df):
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("ml9_bootstrap_interval", f"WITH {SCORED}, {resampled_sql('a', 'p', 'k')} SELECT {interval_sql('auc')} FROM a")
def ml9(t):
    return rounded(bootstrap_interval(scored(t), "p", "y", [F.col("k").cast("string")], RESAMPLES))


@query("ml10_paired_delta", f"WITH {SCORED}, {resampled_sql('a', 'p', 'k')}, {resampled_sql('c', 'q', 'k')} SELECT {interval_sql('c.auc - a.auc')} FROM a JOIN c USING (b)")
def ml10(t):
    return rounded(paired_delta(scored(t), "p", "q", "y", [F.col("k").cast("string")], RESAMPLES))


@query("ml11_cluster_bootstrap", f"WITH {SCORED}, {resampled_sql('a', 'p', 'cn')} SELECT {interval_sql('auc')} FROM a")
def ml11(t):
    return rounded(bootstrap_interval(scored(t), "p", "y", [F.col("cn").cast("string")], RESAMPLES))


@query("ml6_recalibrated", f"WITH {SCORED} SELECT k, ((q + 1) / 12) * 0.1 / (1 - ((q + 1) / 12) + ((q + 1) / 12) * 0.1) AS p FROM s")
def ml6(t):
    from ..functions.numbers import recalibrated

    return scored(t).select("k", recalibrated((F.col("q") + 1) / 12, F.lit(0.1)).alias("p"))


COEFFICIENTS = {"score": 0.0005, "moves": -0.3}
REASONS = f"""WITH {WIDE}, x AS (SELECT cn, score, coalesce(moves, 0) AS moves FROM wide), m AS (SELECT sum(score::DECIMAL(18,2))::DOUBLE / count(*) AS a, avg(moves) AS b FROM x),
c AS (SELECT cn, 'score' AS feature, round(0.0005 * (score - a), 6) AS v FROM x, m UNION ALL SELECT cn, 'moves', round(-0.3 * (moves - b), 6) FROM x, m)"""


def contributions(t):
    x = wide(t).select("cn", "score", F.coalesce("moves", F.lit(0)).alias("moves"))
    return linear_contributions(x, COEFFICIENTS, "cn").withColumn("contribution", F.round("contribution", 6))


@query("ml12_linear_contributions", f"{REASONS} SELECT cn, feature, v AS contribution FROM c")
def ml12(t):
    return contributions(t)


@query("ml13_importance", f"{REASONS} SELECT feature, round(avg(abs(v)), 6) AS mean_abs, round(avg(v), 6) AS mean FROM c GROUP BY 1")
def ml13(t):
    return importance(contributions(t)).withColumns({"mean_abs": F.round("mean_abs", 6), "mean": F.round("mean", 6)})


@query("ml14_stratified_sample", f"WITH {SCORED}, r AS (SELECT k, y, row_number() OVER (PARTITION BY y ORDER BY md5(k::VARCHAR), k) AS rn FROM s WHERE y IS NOT NULL) SELECT k, y FROM r WHERE rn <= 50")
def ml14(t):
    """A sampling operator: fifty of each class."""
    from pyspark.sql import Window

    w = Window.partitionBy("y").orderBy(F.md5(F.col("k").cast("string")), "k")
    return scored(t).filter("y IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn <= 50").select("k", "y")


@query("ml15_direction_agreement", f"{REASONS}, r AS (SELECT feature, corr(v, x.score) AS a, corr(v, x.moves) AS b FROM c JOIN x USING (cn) GROUP BY 1) SELECT feature, CASE feature WHEN 'score' THEN a > 0 ELSE b < 0 END AS agrees FROM r")
def ml15(t):
    x = wide(t).select("cn", "score", F.coalesce("moves", F.lit(0)).alias("moves"))
    j = contributions(t).join(x, "cn")
    value = F.when(F.col("feature") == "score", F.col("score")).otherwise(F.col("moves"))
    sign = F.when(F.col("feature") == "score", 1).otherwise(-1)
    return j.groupBy("feature").agg((F.corr("contribution", value) * F.first(sign) > 0).alias("agrees"))


NUMERIC, CATEGORICAL = ["q", "age", "lines"], ["segment"]


def labelled(t):
    """Orders as company-months: something to learn from, a category, missing numbers."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    d = t.orders.select(
        k.alias("k"), F.col("o_custkey").alias("cn"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), F.floor(v / 50000).cast("double").alias("q"),
        F.when(k % 5 > 0, (k % 40).cast("double")).alias("age"), (k % 7).cast("double").alias("lines"), F.col("o_orderpriority").alias("segment"), v.alias("v"),
    )
    return d.withColumn("y", ((F.col("v") / 500000 + F.col("lines") / 7 + F.when(F.col("segment") == "1-URGENT", 0.4).otherwise(0.0)) > 0.85).cast("double")).drop("v")


@query("ml16_fit_and_score")
def ml16(t):
    """ML1 to ML3: boosted trees fitted on the even companies, a tenth of which stops the boosting, score all. A fit has no
    SQL form; tests hold it to its ranking and to grouped parts."""
    d = labelled(t)
    fitted = fit(d.filter("cn % 2 = 0"), NUMERIC, CATEGORICAL, "gbt", "cn")
    return score(d, fitted).select("k", "cn", "y", F.round("p", 6).alias("p"))


@query("ml1_registry_scores")
def ml1(t):
    """Every model of the registry on the same split and preparation, by its AUC on companies it has not seen."""
    d = labelled(t)
    rows = [(m, auc(score(d.filter("cn % 2 = 1"), fit(d.filter("cn % 2 = 0"), NUMERIC, CATEGORICAL, m)))) for m in ("logistic", "gbt", "mlp")]
    return t.spark.createDataFrame([(m, a, a > 0.8) for m, a in rows], "model string, roc_auc double, good boolean").select("model", F.round("roc_auc", 3).alias("roc_auc"), "good")


@query("ml2_frequent_categories", "WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n >= 0.18 * (SELECT count(*) FROM part) THEN value ELSE '__rare__' END AS kept, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def ml2(t):
    """Categories that too few rows have are one category."""
    d = t.part.select(F.col("p_type").alias("value"))
    return flagged(d, [], {"value": frequent(d, "value", 0.18)}).groupBy(F.col("value_kept").alias("kept")).agg(F.count("*").alias("n"))


@query("ml3_held_back", "SELECT o_custkey AS cn, ('0x' || md5(o_custkey::VARCHAR || '|early')[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.1 AS held_back, count(*) AS n FROM orders GROUP BY 1, 2")
def ml3(t):
    """The companies on which boosting is stopped: whole companies, a tenth of them."""
    return labelled(t).groupBy("cn", held_back("cn").alias("held_back")).agg(F.count("*").alias("n"))


@query("ml4_randomised_search")
def ml4(t):
    """ML4: parameters drawn at random, each validated on later months behind the embargo."""
    return tune(labelled(t), "m", 6, NUMERIC, CATEGORICAL, "logistic", 3, 2).select("trial", "parameters", "n_folds", F.round("mean_roc_auc", 3).alias("mean_roc_auc"), "place")


@query("ml5_grouped_auc")
def ml5(t):
    """ML5: folds of whole companies, each scored by a model of the others."""
    return grouped_auc(labelled(t), "cn", NUMERIC, CATEGORICAL).select("fold", "n", F.round("roc_auc", 3).alias("roc_auc"))


@query("ml5_folds", "SELECT floor(('0x' || md5(o_custkey::VARCHAR || '|fold')[1:8])::BIGINT / 4294967296.0::DOUBLE * 3)::INTEGER AS fold, count(*) AS n, count(DISTINCT o_custkey) AS companies FROM orders GROUP BY 1")
def ml5_folds(t):
    return labelled(t).groupBy(fold_of("cn", 3).alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("cn").alias("companies"))


#: Two small trees over score and moves, with the rows that reached each node.
TREES = [
    {"feature": 0, "threshold": 4000.0, "rows": 100, "left": {"value": -1.0, "rows": 60}, "right": {"feature": 1, "threshold": 0.5, "rows": 40, "left": {"value": 0.5, "rows": 10}, "right": {"value": 2.0, "rows": 30}}},
    {"feature": 1, "threshold": 1.5, "rows": 50, "left": {"value": 0.25, "rows": 35}, "right": {"value": -0.75, "rows": 15}},
]
XM = "x AS (SELECT cn, score, coalesce(moves, 0) AS moves FROM wide)"


@query("ml12_tree_contributions", f"""WITH {WIDE}, {XM}, o AS (SELECT cn, CASE WHEN score <= 4000 THEN -1.0 WHEN moves <= 0.5 THEN 0.5 ELSE 2.0 END::DOUBLE AS f12, CASE WHEN score <= 4000 THEN -1.0 ELSE 0.25 * 0.5 + 0.75 * 2.0 END::DOUBLE AS f1,
  (0.6 * -1.0 + 0.4 * CASE WHEN moves <= 0.5 THEN 0.5 ELSE 2.0 END)::DOUBLE AS f2, (0.6 * -1.0 + 0.1 * 0.5 + 0.3 * 2.0)::DOUBLE AS f0, (CASE WHEN moves <= 1.5 THEN 0.25 ELSE -0.75 END - (0.7 * 0.25 + 0.3 * -0.75))::DOUBLE AS second FROM x)
SELECT cn, 'score' AS feature, round((f1 - f0 + f12 - f2) / 2, 9) AS contribution FROM o UNION ALL SELECT cn, 'moves', round((f2 - f0 + f12 - f1) / 2 + 0.5 * second, 9) FROM o""")
def ml12_trees(t):
    """Two fixed trees, the second at half weight, against the definition over all sets of features."""
    x = wide(t).select("cn", "score", F.coalesce("moves", F.lit(0)).alias("moves"))
    return contributions_of(x, ["score", "moves"], "cn", lambda m: tree_values(m, TREES, [1.0, 0.5])).withColumn("contribution", F.round("contribution", 9))


LOGIT = "1 / (1 + exp(-({0} / 5000 - {1} * {0} / 9000)))"


@query("ml12_kernel_contributions", f"""WITH {WIDE}, {XM}, b(s, m) AS (VALUES (1000.0::DOUBLE, 1.0::DOUBLE), (6000.0, 2.0)), o AS (SELECT cn, {LOGIT.format('score', 'moves')} AS f12, avg({LOGIT.format('score', 'm')}) AS f1, avg({LOGIT.format('s', 'moves')}) AS f2, avg({LOGIT.format('s', 'm')}) AS f0 FROM x, b GROUP BY cn, score, moves)
SELECT cn, 'score' AS feature, round((f1 - f0 + f12 - f2) / 2, 9) AS contribution FROM o UNION ALL SELECT cn, 'moves', round((f2 - f0 + f12 - f1) / 2, 9) FROM o""")
def ml12_kernel(t):
    """Any model, here a logistic one with an interaction, against two background rows."""
    x = wide(t).select("cn", "score", F.coalesce("moves", F.lit(0)).alias("moves"))
    predict = lambda m: 1 / (1 + np.exp(-(m[:, 0] / 5000 - m[:, 1] * m[:, 0] / 9000)))
    background = np.array([[1000.0, 1.0], [6000.0, 2.0]])
    return contributions_of(x, ["score", "moves"], "cn", lambda m: kernel_values(m, predict, background)).withColumn("contribution", F.round("contribution", 9))


@query("ml17_shortlist_reasons", f"{REASONS}, t AS (SELECT cn FROM x ORDER BY score DESC, cn LIMIT 50), r AS (SELECT c.*, row_number() OVER (PARTITION BY cn ORDER BY abs(v) DESC, feature) AS rank, abs(v) / sum(abs(v)) OVER (PARTITION BY cn) AS share FROM c) SELECT cn, rank, feature, v AS contribution, share FROM r WHERE cn IN (SELECT cn FROM t)")
def ml17(t):
    best = wide(t).orderBy(F.desc("score"), "cn").limit(50).select("cn")
    return top_reasons(contributions(t).join(F.broadcast(best), "cn", "left_semi"), "cn")  # fifty rows


@query("ml18_cut_ties", f"WITH {SCORED}, c AS (SELECT p FROM s ORDER BY p DESC, k LIMIT 1 OFFSET 99) SELECT (SELECT p FROM c) AS cut, count(*) FILTER (p > (SELECT p FROM c)) AS above, count(*) FILTER (p = (SELECT p FROM c)) AS tied FROM s")
def ml18(t):
    s = scored(t)
    cut = s.orderBy(F.desc("p"), "k").offset(99).limit(1).select("p")
    x = s.crossJoin(F.broadcast(cut.withColumnRenamed("p", "cut")))  # one row
    return x.groupBy("cut").agg(F.count_if(F.col("p") > F.col("cut")).alias("above"), F.count_if(F.col("p") == F.col("cut")).alias("tied"))


RUNS = '{"tag": "a", "metrics": {"lending": {"gbt": 0.87, "logistic": 0.81}, "growth": {"gbt": 0.76}}}', '{"tag": "b", "metrics": {"lending": {"gbt": 0.88}}}'


@query("ml19_run_registry", "SELECT * FROM (VALUES ('lending', 'gbt', 0.87, 0.88), ('lending', 'logistic', 0.81, NULL), ('growth', 'gbt', 0.76, NULL)) t(target, model, a, b)".replace("0.87, 0.88", "0.87::DOUBLE, 0.88::DOUBLE"))
def ml19(t):
    """Nested run records flattened, then compared side by side."""
    raw = t.spark.createDataFrame([(r,) for r in RUNS], "raw string").select(F.from_json("raw", "tag string, metrics map<string, map<string, double>>").alias("r"))
    flat = raw.select("r.tag", F.explode("r.metrics").alias("target", "m")).select("tag", "target", F.explode("m").alias("model", "value"))
    return flat.groupBy("target", "model").pivot("tag", ["a", "b"]).agg(F.first("value"))


@query("ml20_signed_sentiment", "SELECT user_id AS cn, round(avg(CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END), 9) AS tone, CASE WHEN avg(CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END) > 0.05 THEN 'positive' WHEN avg(CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END) < -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM events GROUP BY 1")
def ml20(t):
    """The signing and averaging of a classifier's labels; the classifier itself is a column that the caller brings."""
    sign = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "purchase", 1).otherwise(0)
    g = t.events.groupBy(F.col("user_id").alias("cn")).agg(F.avg(sign).alias("a"))
    return g.select("cn", F.round("a", 9).alias("tone"), F.when(F.col("a") > 0.05, "positive").when(F.col("a") < -0.05, "negative").otherwise("neutral").alias("label"))


@query("ml21_importance_ladder", f"{REASONS}, g AS (SELECT feature, avg(abs(v)) AS a, count(*) FILTER (v > 0) AS positive FROM c GROUP BY 1) SELECT feature, row_number() OVER (ORDER BY a DESC, feature) AS position, positive FROM g")
def ml21(t):
    from pyspark.sql import Window

    g = contributions(t).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("a"), F.count_if(F.col("contribution") > 0).alias("positive"))
    return g.select("feature", F.row_number().over(Window.orderBy(F.desc("a"), "feature")).cast("long").alias("position"), "positive")  # one row a feature
