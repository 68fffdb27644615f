"""The rules that are easiest to get wrong, on hand-made rows."""

import random
from datetime import date
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.operators import explain
from tidemark.operators.asof import award_features, lender_features
from tidemark.operators.compare import GuardError, require_known, require_share, require_unique
from tidemark.operators.events import append_new, cross_source_dedup, notice_features
from tidemark.operators.facets import NOT_STATED, Filter, FilterError, conditions, facet_counts, page
from tidemark.operators.matching import ladder
from tidemark.operators.metrics import bootstrap_interval, by_score, paired_delta, quantiles, ranking, running
from tidemark.operators.models import downsample, expanding_folds, fit, fold_of, grouped_auc, held_back, origin_split, prepare, score
from tidemark.operators.panel import DELTA_INPUTS, Months, deltas, forward_labels, run_starts

M = 2025 * 12  # + month


def panel_of(spark, charges=None, overdue=None):
    rows = [("c", M + m, c, 0, "O", "s", 1, (overdue or {}).get(m)) for m, c in (charges or dict.fromkeys(overdue, 1)).items()]
    return spark.createDataFrame(rows, "cn string, m int, charges bigint, outstanding bigint, status string, segment string, tier int, overdue boolean")


def test_calendar_hole(spark):
    panel = panel_of(spark, {3: 1, 4: 1, 5: 2, 7: 2, 8: 3, 9: 3})
    absent = [F.lit(None).cast("date" if x.endswith(("due", "made", "date")) else "boolean" if x in ("is_active", "stale") else "double" if x == "debt_ratio" else "bigint" if x == "satisfied" else "string").alias(x) for x in DELTA_INPUTS if x not in panel.columns]
    d = {r["m"] - M: r for r in deltas(panel.select("*", *absent)).collect()}
    want = {3: (None, None, 0, None), 4: (None, False, 0, None), 5: (None, False, 1, 0), 7: (1, None, 1, 2), 8: (1, False, 2, 0), 9: (None, False, 2, 1)}
    assert {m: (r["d_charges_3m"], r["status_changed"], r["new_charge_events_12m"], r["months_since_last_new_charge"]) for m, r in d.items()} == want


def test_labels_stop_at_the_panel_end(spark):
    y = {r["m"] - M: r["y_lending"] for r in forward_labels(panel_of(spark, {3: 1, 4: 1, 5: 2, 7: 2, 8: 3, 9: 3}), M + 9).collect()}
    assert (y[4], y[5], y[7]) == (1, 1, None)


def test_runs_pass_over_holes_and_nulls(spark):
    p = panel_of(spark, None, {3: False, 4: True, 5: True, 7: True, 8: False})
    streak = F.when(F.col("overdue"), F.col("m") - F.col("overdue_since") + 1).otherwise(0)
    got = run_starts(p, ["overdue"]).select("m", streak.alias("s")).collect()
    assert {r["m"] - M: r["s"] for r in got} == {3: 0, 4: 1, 5: 2, 7: 4, 8: 0}


def test_positional_lag_is_not_used(spark):
    got = panel_of(spark, {1: 1, 3: 5}).select("m", Months().lag(F.col("charges"), 1).alias("x")).collect()
    assert {r["m"] - M: r["x"] for r in got} == {1: None, 3: None}


def d(s):
    return date.fromisoformat(s) if s else None


def test_two_clocks(spark):
    rows = [("a", 1, "2026-01-20", "2026-01-28", None), ("b", 2, "2026-01-20", "2026-01-29", None), ("c", 3, "2025-06-01", None, "2026-03-01"), ("d", 4, "2025-06-10", "2025-06-01", None)]
    c = spark.createDataFrame([(k, n, d(x), d(y), d(z), "G1", False) for k, n, x, y, z in rows], "cn string, charge int, created date, delivered date, satisfied date, lender string, ours boolean")
    got = {(r["cn"], r["as_of"].month): r["n_open"] for r in lender_features(c, [d("2026-02-01"), d("2026-03-02")]).collect()}
    assert got == {("a", 2): 1, ("a", 3): 1, ("b", 3): 1, ("c", 2): 1, ("c", 3): 0, ("d", 2): 1, ("d", 3): 1}


def test_a_charge_of_two_lenders_counts_once(spark):
    c = spark.createDataFrame([("a", 1, d("2025-01-01"), None, None, x, False) for x in ("G1", "G2")], "cn string, charge int, created date, delivered date, satisfied date, lender string, ours boolean")
    r = lender_features(c, [d("2026-02-01")]).first()
    assert (r["n_open"], r["n_lenders"], r["main_lender"]) == (1, 2, "G1")


def test_window_edges(spark):
    days = ["2025-05-31", "2025-06-01", "2026-05-31", "2026-06-01"]
    a = spark.createDataFrame([("x", i, d(s), None) for i, s in enumerate(days)], "cn string, contract int, published date, value double")
    r = award_features(a, [d("2026-05-31")]).first()
    assert (r["won_12m"], r["d_won_12m"], r["value_12m"], r["valued_12m"]) == (2, 1, 0.0, 0)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_months_cross_boundaries(spark):
    day = lambda s: F.lit(d(s))
    assert one(spark, dates.months_between(day("2025-01-31"), day("2025-02-01"))) == 1
    assert one(spark, dates.months_between(day("2025-01-01"), day("2025-01-31"))) == 0


@pytest.mark.parametrize(("raw", "prefix", "plain"), [("1234", "00001234", "00001234"), ("SC12345", "SC012345", "0SC12345"), ("nan", None, None), ("123456789", None, "123456789")])
def test_company_number(spark, raw, prefix, plain):
    assert one(spark, text.company_number(F.lit(raw))) == prefix
    assert one(spark, text.company_number(F.lit(raw), "plain")) == plain


def test_names_and_codes(spark):
    assert [one(spark, text.company_name(F.lit("Acme Holdings, Ltd."), m)) for m in ("trailing", "anywhere")] == ["ACME HOLDINGS"] * 2
    assert [one(spark, text.company_name(F.lit("J.A. Smith & Co Ltd"), m)) for m in ("trailing", "anywhere")] == ["JA SMITH CO", "J A SMITH"]
    assert one(spark, text.postcode(F.lit("nan"))) is None
    assert one(spark, text.postcode_outward(F.lit("sl3 9eh"))) == "SL3"
    assert one(spark, dates.iso_date(F.lit("2025-08-02T10:00"))) == d("2025-08-02")
    assert one(spark, dates.iso_date(F.lit("02/08/2025"))) == d("2025-08-02")


def test_recalibration(spark):
    assert round(one(spark, numbers.recalibrated(F.lit(0.5), F.lit(0.1))), 6) == 0.090909


def test_ladder(spark):
    ref = spark.createDataFrame([("1", "ACME", "AB12CD"), ("2", "BETA", "XY34ZZ"), ("3", "BETA", "XY99ZZ"), ("4", "GAMMA STEELWORKS", "AB12CD")], "cn string, nm string, pc string")
    rows = spark.createDataFrame([(1, None, "ACME", None), (2, None, "ACME", "AB12CD"), (3, None, "ACME", "ZZ11ZZ"), (4, None, "BETA", None), (5, "2", "x", None), (6, None, "GAMMA STEELWORK", "AB12CD"), (7, None, None, None)], "id int, number string, nm string, pc string")
    got = {r["id"]: (r["cn"], r["confidence"], r["method"]) for r in ladder(rows, ref).collect()}
    assert got[1] == ("1", 0.6, "unconfirmed") and got[2] == ("1", 0.95, "exact") and got[3] == (None, None, "rejected") and got[4] == (None, None, "ambiguous")
    assert got[5] == ("2", 1.0, "number") and got[6][0] == "4" and got[6][2] == "fuzzy" and got[7] == (None, None, "none")


def test_cross_source_keeps_multiplicity(spark):
    rows = [("X", 100, "CF", d("2024-05-02")), ("X", 100, "CF", d("2024-05-20")), ("X", 100, "FTS", d("2024-05-10")), ("Y", 1, "CF", d("2024-05-02")), ("Y", 1, "CF", d("2024-05-03"))]
    df = spark.createDataFrame(rows, "cn string, value int, source string, day date")
    assert sorted(r["cn"] + r["source"] for r in cross_source_dedup(df, ["cn", "value"], "source", "day").collect()) == ["XCF", "XCF", "YCF", "YCF"]


def test_append_keeps_one_of_equal_keys(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a")], "k int, v string")
    assert sorted(tuple(r) for r in append_new(a, b, ["k"]).collect()) == [(1, "x"), (2, "a")]


def test_tied_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "p double, y int")
    r = ranking(df, "p", "y", cuts=(1, 100)).first()
    assert (r["roc_auc"], round(r["pr_auc"], 6), r["precision_1"], r["precision_100"]) == (0.625, 0.583333, 0.5, None)


def test_bootstrap_covers_the_estimate(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 20).cast("double").alias("p"), ((F.col("id") * 7 % 20) < F.col("id") % 20).cast("int").alias("y"))
    auc, b = ranking(df, "p", "y").first()["roc_auc"], bootstrap_interval(df, "p", "y", [F.col("k")], 40).first()
    assert b["low"] <= auc <= b["high"]
    same = paired_delta(df.withColumn("q", F.col("p")), "p", "q", "y", [F.col("k")], 10).first()
    assert (same["low"], same["high"]) == (0.0, 0.0)


def test_downsampling_rates(spark):
    rows = [(i, 1, 1 if i < 3 else 0) for i in range(103)] + [(i, 2, 1 if i < 20 else 0) for i in range(120)]
    got = {r["m"]: r["keep_rate"] for r in downsample(spark.createDataFrame(rows, "cn int, m int, y int"), "y", "m", ["cn", "m"], 10).select("m", "keep_rate").distinct().collect()}
    assert {m: round(x, 9) for m, x in got.items()} == {1: 0.3, 2: 1.0}


def test_splits_have_an_embargo():
    train, test = origin_split(list(range(1, 25)), 6)
    assert test == [23, 24] and max(train) + 6 < 23
    assert all(max(a) + 3 < min(b) for a, b in expanding_folds(list(range(40)), 3))


def facet_rows(spark):
    return spark.createDataFrame([(1, True, "X"), (2, False, "X"), (3, None, "Y"), (4, True, "Y"), (5, True, "X")], "k int, a boolean, s string")


def test_facets_skip_themselves(spark):
    f = [Filter("a", "tri", F.col("a")), Filter("s", "in", F.col("s"))]
    got = {(r["facet"], r["option"]): r["n"] for r in facet_counts(facet_rows(spark), f, {"a": "yes"}, {"a": F.col("a"), "s": F.col("s")}).collect()}
    assert got == {("a", "true"): 3, ("a", "false"): 1, ("a", None): 1, ("s", "X"): 2, ("s", "Y"): 1}


def test_missing_is_never_negative(spark):
    df, keys = facet_rows(spark), lambda x: sorted(r["k"] for r in x.collect())
    assert keys(df.filter(Filter("a", "tri", F.col("a")).condition("no"))) == [2]
    assert keys(df.filter(Filter("a", "tri", F.col("a")).condition(NOT_STATED))) == [3]
    assert keys(df.filter(Filter("a", "bool", F.col("a")).condition("no"))) == [2]


@pytest.mark.parametrize(("key", "value"), [("a", "maybe"), ("zz", "yes"), ("r", (float("nan"), None)), ("r", (None, None)), ("s", [])])
def test_filters_fail_closed(spark, key, value):
    f = [Filter("a", "tri", F.col("a")), Filter("s", "in", F.col("s")), Filter("r", "range", F.col("k"))]
    with pytest.raises(FilterError):
        conditions(f, {key: value})


def test_pages_cover_ties(spark):
    df = spark.range(600).withColumn("v", F.lit(1))
    seen = [r["id"] for k in range(6) for r in page(df, "v", True, "id", ["v"], 100, 100 * k).collect()]
    assert seen == list(range(600))


def test_bursts(spark):
    from datetime import timedelta

    rows = [(k, None, "petition", "p", d("2023-01-01") + timedelta(n), "AB1", f"{k}{n:04}") for k, days in (("a", (0, 40, 90)), ("b", (0, 91, 181))) for n in days]
    n = spark.createDataFrame(rows, "cn string, name string, family string, notice_type string, notice_date date, postcode string, url string")
    assert {r["cn"]: (r["notice_burst_flag"], r["recurring_distress_flag"]) for r in notice_features(n, F.lit(d("2023-12-31"))).collect()} == {"a": (1, 0), "b": (0, 1)}


def test_guards(spark):
    df = facet_rows(spark)
    assert require_unique(df, ["k"]) is df
    for bad in (lambda: require_unique(df, ["s"]), lambda: require_known(df, "s", ["X"]), lambda: require_share(df, "a", 0.9, 1.0)):
        with pytest.raises(GuardError):
            bad()


def learnable(spark):
    return spark.range(400).select("id", (F.col("id") % 20).alias("cn"), (F.col("id") % 50).cast("double").alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).cast("double").alias("u"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 90 > 0, "b").otherwise("c").alias("c"), (F.col("id") % 50 > 25).cast("double").alias("y"))


def test_model_ranks(spark):
    df = learnable(spark)
    for model, entity in (("logistic", None), ("gbt", None), ("gbt", "cn"), ("mlp", None)):
        out = score(df, fit(df, ["v", "u"], ["c"], model, entity))
        assert out.columns == [*df.columns, "p"] and ranking(out.withColumn("y", F.col("y").cast("int")), "p", "y").first()["roc_auc"] > 0.95


def test_rare_and_unseen_categories_are_one(spark):
    df = learnable(spark)
    p = prepare(df, ["v", "u"], ["c"], least_share=0.1)
    assert p.known == {"c": ["a", "b"]}
    odd = df.limit(3).withColumn("c", F.when(F.col("id") == 0, "c").when(F.col("id") == 1, "never seen"))
    rows = {r["id"]: r["features"].toArray().tolist() for r in p.transform(odd).select("id", "features").collect()}
    assert rows[0][4:] == rows[1][4:] == rows[2][4:] and sum(rows[0][4:]) == 1
    assert all(len(r) == len(rows[0]) for r in rows.values())


def test_groups_are_never_split(spark):
    df = learnable(spark)
    for part in (held_back("cn", 0.3), fold_of("cn", 3)):
        assert df.select("cn", part.alias("part")).distinct().groupBy("cn").count().filter("count > 1").count() == 0
    folds = grouped_auc(df, "cn", ["v"], [], folds=2).collect()
    assert sum(r["n"] for r in folds) == 400 and all(r["roc_auc"] > 0.95 for r in folds)


def test_search_keeps_the_embargo(spark, monkeypatch):
    from tidemark.operators import models

    df, seen = learnable(spark).withColumn("m", (F.col("id") % 12).cast("int")), []
    build = models.fit

    def fitted(train, *a, **k):
        seen.append(sorted(r[0] for r in train.select("m").distinct().collect()))
        return build(train, *a, **k)

    monkeypatch.setattr(models, "fit", fitted)
    got = models.tune(df, "m", 2, ["v"], [], "logistic", 2, 2).collect()
    assert sorted(r["place"] for r in got) == [1, 2] and len({r["parameters"] for r in got}) == 2
    cuts = expanding_folds(list(range(12)), 2, 2)
    assert seen == [early for _ in range(2) for early, _ in cuts] and all(max(e) + 2 < min(v) for e, v in cuts)
    with pytest.raises(ValueError):
        models.tune(df.filter("m < 3"), "m", 6, ["v"], [])


def shapley(value, features):
    """The definition, over all sets."""
    out = []
    for j in range(features):
        total = 0.0
        for r in range(features):
            for known in combinations([i for i in range(features) if i != j], r):
                total += factorial(r) * factorial(features - 1 - r) / factorial(features) * (value({*known, j}) - value(set(known)))
        out.append(total)
    return out


def random_tree(r, depth, rows):
    if depth == 0 or rows < 4 or r.random() < 0.15:
        return {"value": r.uniform(-2, 2), "rows": rows}
    left = r.randrange(1, rows)
    return {"feature": r.randrange(4), "threshold": r.uniform(-1, 1), "rows": rows, "left": random_tree(r, depth - 1, left), "right": random_tree(r, depth - 1, rows - left)}


def test_tree_contributions_by_definition():
    r = random.Random(4)
    x = np.array([[r.uniform(-1.5, 1.5) for _ in range(4)] for _ in range(6)])
    for _ in range(30):
        tree = random_tree(r, 4, 200)

        def expected(row, known, node):
            if "value" in node:
                return node["value"]
            low, high = node["left"], node["right"]
            if node["feature"] in known:
                return expected(row, known, low if row[node["feature"]] <= node["threshold"] else high)
            return (expected(row, known, low) * low["rows"] + expected(row, known, high) * high["rows"]) / node["rows"]

        got = explain.tree_values(x, [tree])
        for row, mine in zip(x, got, strict=True):
            assert np.allclose(mine, shapley(lambda known: expected(row, known, tree), 4))  # noqa: B023


def test_kernel_contributions_by_definition():
    r = np.random.default_rng(1)
    background, x = r.normal(size=(5, 3)), r.normal(size=(4, 3))
    predict = lambda m: np.tanh(m[:, 0] * m[:, 1]) + m[:, 2] ** 2
    got = explain.kernel_values(x, predict, background)
    for row, mine in zip(x, got, strict=True):
        def value(known):
            m = background.copy()
            for j in known:
                m[:, j] = row[j]  # noqa: B023
            return float(predict(m).mean())

        assert np.allclose(mine, shapley(value, 3))
    with pytest.raises(ValueError):
        explain.kernel_values(np.zeros((1, 13)), predict, background)


def test_fitted_models_are_explained(spark):
    from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["v", "id"], outputCol="features").transform(learnable(spark))
    x = np.array([[r["v"], r["id"]] for r in df.select("v", "id").collect()], float)
    boosted = GBTClassifier(labelCol="y", featuresCol="features", maxIter=3, maxDepth=3, seed=1).fit(df)
    trees, weights = explain.spark_trees(boosted)
    raw = np.array([r["rawPrediction"][1] for r in boosted.transform(df).select("rawPrediction").collect()])
    total = explain.tree_values(x, trees, weights).sum(1)
    assert np.allclose(total - total.mean(), (raw - raw.mean()) * np.polyfit(raw, total, 1)[0], atol=1e-6)  # raw may count the margin twice
    layers = MultilayerPerceptronClassifier(labelCol="y", featuresCol="features", layers=[2, 3, 2], maxIter=5, seed=1).fit(df)
    p = explain.perceptron_output([2, 3, 2], layers.weights.toArray())(x)
    assert np.allclose(p, [r["probability"][1] for r in layers.transform(df).select("probability").collect()], atol=1e-6)
    rows = explain.contributions(df, ["v", "id"], "id", lambda m: explain.tree_values(m, trees, weights))
    assert rows.count() == 800 and rows.columns == ["id", "feature", "contribution"]


def test_a_long_calendar_is_replayed_in_parts(spark, monkeypatch):
    from tidemark.operators import asof

    days = [date(2020 + k // 12, k % 12 + 1, 28) for k in range(30)]
    r = random.Random(2)
    born = lambda: date(2019 + r.randrange(4), r.randrange(12) + 1, r.randrange(28) + 1)
    charges = spark.createDataFrame([(k % 5, k % 17, born(), born() if k % 3 else None, born() if k % 4 else None, f"G{k % 4}" if k % 5 else "unclassified", k % 4 == 1) for k in range(90)], "cn int, charge int, created date, delivered date, satisfied date, lender string, ours boolean")
    awards = spark.createDataFrame([(k % 4, k % 13, born(), float(k) if k % 3 else None) for k in range(60)], "cn int, contract int, published date, value double")
    for f, rows in ((lender_features, charges), (award_features, awards)):
        monkeypatch.setattr(asof, "MASK_DATES", 62)
        whole = sorted(map(tuple, f(rows, days).collect()), key=repr)
        monkeypatch.setattr(asof, "MASK_DATES", 7)
        assert whole and sorted(map(tuple, f(rows, days).collect()), key=repr) == whole


def test_running_counts_in_bands(spark):
    r = random.Random(3)
    rows = [(r.choice([r.uniform(-5, 5), 0.0, r.uniform(0, 1e-9), float(r.randrange(-3, 4))]), r.randrange(2), r.choice("ab")) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, y int, g string")
    got = {(x["g"], x["s"]): (x["upto_pos"], x["upto_neg"], x["all_pos"]) for x in running(by_score(df, "s", "y", ["g"]), "s", ["g"], ["pos", "neg"]).collect()}
    for (g, s), (pos, neg, whole) in got.items():
        better = [y for v, y, h in rows if h == g and v >= s]
        assert (pos, neg, whole) == (sum(better), len(better) - sum(better), sum(y for _, y, h in rows if h == g))


def test_quantiles_in_bands(spark):
    r = random.Random(6)
    for values in ([r.gauss(0, 3) for _ in range(301)], [1.0, 1.0, 2.0], [-4.5], [0.0, 0.0, -1.0, 7.25]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = quantiles(df, "v", [0.99, 0.9, 0.5, 0.0]).first()
        assert np.allclose(list(got), np.quantile(values, [0.99, 0.9, 0.5, 0.0]))
    assert list(quantiles(df.limit(0), "v", [0.9]).first()) == [None]


def test_entities_are_read_once(spark):
    said = ["a &amp;lt; b &pound;5 &#163; &#x1F600; &bogus; & c", "&#0;&#xD800;&", "none", None]
    got = [x["t"] for x in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").select("i", text.unescaped(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == ["a &lt; b £5 £ 😀 &bogus; & c", "&#0;&#xD800;&", "none", None]


def test_zipped_csv(spark, tmp_path):
    import zipfile

    from tidemark.sources.readers import zipped_csv

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", " Number,Name\n1,Ä\n2,\"b, c\"\n")
        z.writestr("readme.txt", "no")
    assert [tuple(r) for r in zipped_csv(spark, str(tmp_path / "a.zip"), ["Name", "Number", "Absent"]).orderBy("Number").collect()] == [("Ä", "1", None), ("b, c", "2", None)]


def test_stream_drops_repeats(spark, tmp_path):
    import json

    from tidemark.streaming.ingest import notice_stream, write_by_source

    (tmp_path / "in").mkdir()
    rows = [{"notice_url": u, "notice_time": "2024-01-01T00:00:00", "source": s} for u, s in (("a", "x"), ("a", "x"), ("b", "y"))]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = write_by_source(notice_stream(spark, str(tmp_path / "in"), "notice_url string, notice_time timestamp, source string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r["notice_url"], r["source"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "x"), ("b", "y")]
