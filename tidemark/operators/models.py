"""Models with pyspark.ml: a registry, preparation, grouped splits, embargoed folds, closed-form linear explanation."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product
from random import Random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bucket_share
from .metrics import ranking


def gbt(**more) -> GBTClassifier:
    return GBTClassifier(labelCol="y", featuresCol="features", **{"seed": 7, "maxIter": 20, "maxDepth": 4} | more)


def logistic(**more) -> LogisticRegression:
    return LogisticRegression(labelCol="y", featuresCol="features", **{"maxIter": 50, "regParam": 0.01} | more)


def perceptron(inputs: int, hidden: int = 16, **more) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol="y", featuresCol="features", layers=[inputs, hidden, 2], **{"seed": 7, "maxIter": 50} | more)


REGISTRY = {"gbt": gbt, "logistic": logistic, "mlp": perceptron}
#: Values that a randomised search draws from.
SEARCH_SPACE = {
    "gbt": {"maxDepth": [2, 3, 4, 5], "stepSize": [0.05, 0.1, 0.2], "maxIter": [10, 20, 30], "subsamplingRate": [0.7, 1.0]},
    "logistic": {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "mlp": {"hidden": [8, 16, 32], "stepSize": [0.01, 0.03, 0.1]},
}
RARE = "__rare__"


def frequent(df: DataFrame, column: str, least_share: float) -> list[str]:
    """The values that at least this share of rows has: 1 / least_share of them at most, so they may reach the driver."""
    n = df.count()
    return [r[0] for r in df.groupBy(column).count().filter(F.col(column).isNotNull() & (F.col("count") >= least_share * n)).orderBy(column).select(column).collect()]


@dataclass
class Prepared:
    """Fitted preparation: transform() adds `features` to any rows."""

    numeric: list[str]
    known: dict[str, list[str]]
    pipeline: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(flagged(df, self.numeric, self.known))


def flagged(df: DataFrame, numeric: list[str], known: dict[str, list[str]]) -> DataFrame:
    """A flag beside each number that says if it is missing; rare, unseen and missing categories are one."""
    new = {f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric} | {f"{c}_number": F.col(c).cast("double") for c in numeric}
    return df.withColumns(new | {f"{c}_kept": F.when(F.col(c).isin(*own), F.col(c)).otherwise(RARE) if own else F.lit(RARE) for c, own in known.items()})


def prepare(train: DataFrame, numeric: list[str], categorical: list[str], least_share: float = 0.001) -> Prepared:
    """Median for missing numbers and a flag that says so, both scaled; categories that at least least_share of rows have
    get a column each, all others one column together."""
    known = {c: frequent(train, c, least_share) for c in categorical}
    stages = [Imputer(inputCols=[f"{c}_number" for c in numeric], outputCols=[f"{c}_filled" for c in numeric], strategy="median")]
    stages.append(VectorAssembler(inputCols=[f"{c}_filled" for c in numeric] + [f"{c}_missing" for c in numeric], outputCol="numbers"))
    stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True))
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"{c}_kept", outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_onehot", handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=["scaled", *[f"{c}_onehot" for c in categorical]], outputCol="features"))
    return Prepared(numeric, known, Pipeline(stages=stages).fit(flagged(train, numeric, known)))


def fit(train: DataFrame, numeric: list[str], categorical: list[str], model: str = "logistic", entity: str | None = None, **parameters) -> tuple[Prepared, object]:
    """(preparation, model). With an entity, a tenth of the entities is held back and boosting stops when it no longer gets
    better on them; an entity is never on both sides."""
    prepared = prepare(train, numeric, categorical)
    rows = prepared.transform(train)
    if model == "mlp":
        builder = perceptron(rows.first()["features"].size, **parameters)
    elif model == "gbt" and entity:
        rows = rows.withColumn("held_back", held_back(entity))
        builder = gbt(**{"validationIndicatorCol": "held_back", "maxIter": 100} | parameters)
    else:
        builder = REGISTRY[model](**parameters)
    return prepared, builder.fit(rows)


def score(df: DataFrame, fitted: tuple[Prepared, object]) -> DataFrame:
    """df with p, the chance of class 1."""
    prepared, model = fitted
    out = model.transform(prepared.transform(df))
    return out.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def held_back(key: str, share: float = 0.1) -> Column:
    """Whether a row is in the early-stopping part: by a hash of its entity, so no entity is in both."""
    return bucket_share(F.col(key).cast("string"), F.lit("early")) < share


def fold_of(key: str, folds: int) -> Column:
    """The fold of a row's entity, from 0; all rows of an entity are in one."""
    return F.floor(bucket_share(F.col(key).cast("string"), F.lit("fold")) * folds).cast("int")


def auc(scored: DataFrame) -> float | None:
    return ranking(scored.withColumn("y", F.col("y").cast("int")), "p", "y").first()["roc_auc"]


def grouped_auc(df: DataFrame, entity: str, numeric: list[str], categorical: list[str], model: str = "logistic", folds: int = 3) -> DataFrame:
    """fold, n, roc_auc: each fold of entities scored by a model of the others, whatever the time. One fit a fold."""
    rows = df.withColumn("_fold", fold_of(entity, folds))
    out = []
    for k in range(folds):
        test = rows.filter(F.col("_fold") == k)
        fitted = fit(rows.filter(F.col("_fold") != k), numeric, categorical, model, entity)
        r = ranking(score(test, fitted).withColumn("y", F.col("y").cast("int")), "p", "y").first()
        out.append((k, r["n"], r["roc_auc"]))
    return df.sparkSession.createDataFrame(out, "fold int, n long, roc_auc double")


def draws(space: dict[str, list], n: int, seed: int = 7) -> list[dict]:
    """n different choices of parameters, or all there are."""
    every = [dict(zip(space, x, strict=True)) for x in product(*space.values())]
    return Random(seed).sample(every, min(n, len(every)))


def tune(df: DataFrame, origin: str, horizon: int, numeric: list[str], categorical: list[str], model: str = "logistic", n: int = 6, folds: int = 3, seed: int = 7) -> DataFrame:
    """trial, parameters (JSON), mean_roc_auc, std_roc_auc, n_folds, place: a randomised search, validated on later months
    with the horizon's embargo between training and validation. Training months only belong in df. A month is a row of the
    driver's list; each trial fits one model a fold."""
    months = sorted(r[0] for r in df.select(origin).distinct().collect())  # months only
    cuts = expanding_folds(months, horizon, folds)
    if not cuts:
        raise ValueError(f"no validation month is left behind an embargo of {horizon} months")
    trials = []
    for k, parameters in enumerate(draws(SEARCH_SPACE[model], n, seed)):
        got = [auc(score(df.filter(F.col(origin).isin(*later)), fit(df.filter(F.col(origin).isin(*early)), numeric, categorical, model, **parameters))) for early, later in cuts]
        known = [x for x in got if x is not None]
        mean = sum(known) / len(known) if known else None
        trials.append((k, json.dumps(parameters, sort_keys=True), mean, (sum((x - mean) ** 2 for x in known) / len(known)) ** 0.5 if known else None, len(cuts)))
    order = {t[0]: i for i, t in enumerate(sorted(trials, key=lambda t: (-(t[2] or 0), t[0])), 1)}
    return df.sparkSession.createDataFrame([(*t, order[t[0]]) for t in trials], "trial int, parameters string, mean_roc_auc double, std_roc_auc double, n_folds int, place int")


def origin_split(origins: list[int], horizon: int, tests: int = 2) -> tuple[list[int], list[int]]:
    """Train and test months: the last `tests` origins are tests, and training stops so early that no label window
    reaches the first test."""
    origins = sorted(origins)
    test = origins[-tests:]
    return [m for m in origins if m + horizon < test[0]], test


def expanding_folds(origins: list[int], horizon: int, folds: int = 3) -> list[tuple[list[int], list[int]]]:
    """(train, validate) months in order of time, with the horizon's embargo between them."""
    origins = sorted(origins)
    size = max(1, len(origins) // (folds + 1))
    out = []
    for k in range(1, folds + 1):
        validate = origins[k * size : (k + 1) * size]
        train = [m for m in origins if validate and m + horizon < validate[0]]
        if train and validate:
            out.append((train, validate))
    return out


def downsample(labels: DataFrame, label: str, origin: str, key: list[str], ratio: float) -> DataFrame:
    """All positives and, origin by origin, a share of negatives of at most ratio for each positive; the share is carried
    as keep_rate. The choice is fixed by a hash of the key."""
    rates = labels.filter(F.col(label).isNotNull()).groupBy(origin).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    rates = rates.select(origin, F.when(F.col("neg") > 0, F.least(F.lit(1.0), ratio * F.col("pos") / F.col("neg"))).otherwise(1.0).alias("keep_rate"))
    rows = labels.filter(F.col(label).isNotNull()).join(F.broadcast(rates), origin)  # one row a month
    return rows.filter((F.col(label) == 1) | (bucket_share(*[F.col(k).cast("string") for k in key], F.lit(label)) < F.col("keep_rate")))


def linear_contributions(df: DataFrame, coefficients: dict[str, float], key: str) -> DataFrame:
    """key, feature, contribution: coefficient times distance from the mean, the exact explanation of a linear model."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in coefficients])
    rows = df.crossJoin(F.broadcast(means))  # one row
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (b * (F.col(c).cast("double") - F.col(f"_m_{c}"))).alias("contribution")) for c, b in coefficients.items()])
    return rows.select(key, F.explode(parts).alias("x")).select(key, "x.*")


def top_reasons(contributions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """key, rank, feature, contribution, share of the n largest by absolute value; ties by feature."""
    item = F.struct((-F.abs("contribution")).alias("size"), F.col("feature"), F.col("contribution"))
    g = contributions.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(item)), 1, n).alias("items"), F.sum(F.abs("contribution")).alias("total"))
    e = g.select(key, "total", F.posexplode("items").alias("pos", "i"))
    return e.select(key, (F.col("pos") + 1).cast("long").alias("rank"), F.col("i.feature").alias("feature"), F.col("i.contribution").alias("contribution"), F.try_divide(F.abs("i.contribution"), F.col("total")).alias("share"))


def importance(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))
