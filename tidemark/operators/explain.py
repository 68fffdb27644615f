"""What each feature contributes to a model's output, so that the contributions and the expected output add up to it.

A linear model has a closed form (models.linear_contributions). Trees are taken leaf by leaf: under the path-dependent
expectation a leaf's weight is a product with one factor a feature on its path, 1 or 0 for a known feature (whether the row
follows all its splits) and the share of training rows that follow for an unknown one; the Shapley values of a product
come from the sums of products by number of known features. Any other model is asked for its output with each set of
features known and the others at a background row's values, which is exact and takes 2 ** features outputs a row and
background row.

Models are small and reach every executor; rows stay where they are and pass in batches of numpy columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: A leaf: its value, and the conditions on its path as (feature, threshold, whether the row is at most that, share).
Leaf = tuple[float, list[tuple[int, float, bool, float]]]
#: Features of a model that is asked set by set.
MOST_FEATURES = 12


def leaves(tree: dict) -> list[Leaf]:
    """The leaves of a tree of nested nodes: {value} or {feature, threshold, left, right}, each with `rows`."""
    out, todo = [], [(tree, [])]
    while todo:
        node, path = todo.pop()
        if "value" in node:
            out.append((float(node["value"]), path))
            continue
        for side, low in (("left", True), ("right", False)):
            child = node[side]
            todo.append((child, [*path, (node["feature"], node["threshold"], low, child["rows"] / node["rows"])]))
    return out


def _leaf_values(x: np.ndarray, leaf: Leaf) -> Iterator[tuple[int, np.ndarray]]:
    """(feature, contribution by row) of one leaf."""
    value, path = leaf
    known, share = {}, {}
    for feature, threshold, low, part in path:
        follows = x[:, feature] <= threshold
        known[feature] = known.get(feature, True) & (follows if low else ~follows)
        share[feature] = share.get(feature, 1.0) * part
    names = list(known)
    m = len(names)
    weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
    for j in names:
        # sums[k]: products over the other features, of those with k known ones
        sums = [np.ones(len(x))]
        for i in names:
            if i != j:
                told = known[i].astype(float)
                sums = [(sums[k] * share[i] if k < len(sums) else 0) + (sums[k - 1] * told if k else 0) for k in range(len(sums) + 1)]
        yield j, value * (known[j].astype(float) - share[j]) * sum(w * s for w, s in zip(weight, sums, strict=True))


def tree_values(x: np.ndarray, trees: list[dict], weights: list[float] | None = None) -> np.ndarray:
    """Contributions (rows, features) to the weighted sum of trees."""
    out = np.zeros_like(x, dtype=float)
    for tree, w in zip(trees, weights or [1.0] * len(trees), strict=True):
        for leaf in leaves(tree):
            for j, v in _leaf_values(x, leaf):
                out[:, j] += w * v
    return out


def kernel_values(x: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray) -> np.ndarray:
    """Contributions (rows, features) to predict(x) beside its mean over the background rows."""
    n, m = x.shape
    if m > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} features")
    means = {}
    for k in range(m + 1):
        for known in combinations(range(m), k):
            total = np.zeros(n)
            for row in background:
                mixed = np.tile(row, (n, 1))
                mixed[:, known] = x[:, known]
                total += predict(mixed)
            means[known] = total / len(background)
    out = np.zeros((n, m))
    for known, v in means.items():
        for j in known:
            rest = tuple(i for i in known if i != j)
            out[:, j] += factorial(len(rest)) * factorial(m - len(known)) / factorial(m) * (v - means[rest])
    return out


def contributions(df: DataFrame, features: list[str], key: str, values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, feature, contribution of each row; values gives the contributions of a matrix of features, nulls being nan."""
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])

    def work(batches):
        for b in batches:
            x = np.stack([b.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1)
            got = values(x)
            for i in range(len(features)):
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([features[i]] * b.num_rows, pa.string()), pa.array(got[:, i])], ["key", "feature", "contribution"])

    schema = StructType([StructField("key", kind), StructField("feature", StringType()), StructField("contribution", DoubleType())])
    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)


def spark_trees(model) -> tuple[list[dict], list[float]]:
    """The trees of a pyspark.ml ensemble of decision trees, as nested nodes, and their weights."""

    def nested(node) -> dict:
        rows = float(node.impurityStats().count())
        if node.subtreeDepth() == 0:
            return {"value": node.prediction(), "rows": rows}
        split = node.split()
        return {"feature": split.featureIndex(), "threshold": split.threshold(), "rows": rows, "left": nested(node.leftChild()), "right": nested(node.rightChild())}

    return [nested(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights)


def perceptron_output(layers: list[int], weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The chance of class 1 by a pyspark.ml perceptron: logistic layers, then a softmax."""
    parts, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        parts.append((np.asarray(weights[at : at + a * b]).reshape((b, a), order="F"), np.asarray(weights[at + a * b : at + a * b + b])))
        at += a * b + b

    def predict(x: np.ndarray) -> np.ndarray:
        for k, (w, bias) in enumerate(parts):
            x = x @ w.T + bias
            if k < len(parts) - 1:
                x = 1 / (1 + np.exp(-x))
        e = np.exp(x - x.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True))[:, 1]

    return predict
