"""Model fitting and scoring as Spark jobs."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_ridge(df: DataFrame, features: list[str], label: str, weight: str, penalty: float) -> np.ndarray:
    """Weighted ridge with a free intercept (last), by the normal equations: one aggregation of sums."""
    cols = [*(F.col(f) for f in features), F.lit(1.0)]
    w, y = F.col(weight), F.col(label)
    k = len(cols)
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * cols[i] * y).alias(f"b{i}") for i in range(k)]
    row = df.agg(*sums).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    a[np.arange(k - 1), np.arange(k - 1)] += penalty
    return np.linalg.solve(a, np.array([row[f"b{i}"] for i in range(k)]))


def fit_trees(df: DataFrame, features: list[str], label: str, *, depth: int = 3, rounds: int = 10, seed: int = 1):
    """Gradient-boosted regression by MLlib; returns the model, which adds ``prediction``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="x_vector", handleInvalid="keep")
    model = GBTRegressor(featuresCol="x_vector", labelCol=label, maxDepth=depth, maxIter=rounds, seed=seed).fit(assembler.transform(df))
    return lambda rows: model.transform(assembler.transform(rows)).drop("x_vector")


def linear_score(features: list[str], weights) -> Column:
    out = F.lit(float(weights[-1]))
    for f, w in zip(features, weights):
        out = out + F.col(f) * float(w)
    return out


def blend(columns: list[str], weights: list[float]) -> Column:
    total = sum(weights)
    out = F.lit(0.0)
    for name, w in zip(columns, weights):
        out = out + F.col(name) * w / total
    return out


def calibrate(df: DataFrame, prediction: str, outcome: str) -> DataFrame:
    """Affine slope of the outcome on the prediction, within 0 and 1, and its offset (one row)."""
    var = F.var_pop(prediction)
    slope = F.when(var > 1e-18, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.covar_pop(prediction, outcome) / var))).otherwise(0.0)
    return df.agg(slope.alias("slope"), (F.avg(outcome) - slope * F.avg(prediction)).alias("offset"))


def score_trees(df: DataFrame, features: list[str], model: str) -> DataFrame:
    """Add ``score``: the sum of leaf values of a JSON list of trees; '<=' goes left, a missing value by default_left.

    Each tree is applied to whole batches: rows move from node to node in arrays.
    """
    trees = [_flatten(t) for t in json.loads(model)]
    held = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
        total = np.zeros(len(x))
        for feature, threshold, left, right, default, leaf in held.value:
            at = np.zeros(len(x), np.int64)
            while (open_ := feature[at] >= 0).any():
                rows = np.flatnonzero(open_)
                node = at[rows]
                v = x[rows, feature[node]]
                go = np.where(np.isnan(v), default[node], v <= threshold[node])
                at[rows] = np.where(go, left[node], right[node])
            total += leaf[at]
        return pd.Series(total)

    return df.withColumn("score", score(*features))


def _flatten(tree: dict):
    """A nested tree as arrays: feature (-1 for a leaf), threshold, left, right, default_left, leaf."""
    rows: list[list] = []

    def visit(node: dict) -> int:
        at = len(rows)
        rows.append([])
        if "leaf_value" in node:
            rows[at] = [-1, 0.0, 0, 0, True, node["leaf_value"]]
        else:
            left, right = visit(node["left_child"]), visit(node["right_child"])
            rows[at] = [node["split_feature"], node["threshold"], left, right, node.get("default_left", True), 0.0]
        return at

    visit(tree)
    f, t, a, b, d, v = zip(*rows)
    return np.array(f), np.array(t, float), np.array(a), np.array(b), np.array(d), np.array(v, float)
