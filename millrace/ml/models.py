"""Gradient descent, k-means, matrix factorisation and sparse matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_loss(prediction: Column, label: Column) -> tuple[Column, Column]:
    """(loss, derivative by the prediction)."""
    gap = prediction - label
    return 0.5 * gap * gap, gap


def logistic_loss(prediction: Column, label: Column) -> tuple[Column, Column]:
    """Labels are -1 and 1."""
    margin = prediction * label
    return F.log1p(F.exp(-margin)), -label / (1 + F.exp(margin))


def hinge_loss(prediction: Column, label: Column) -> tuple[Column, Column]:
    margin = prediction * label
    return F.greatest(F.lit(0.0), 1 - margin), F.when(margin <= 1, -label).otherwise(0.0)


def no_penalty(weight: float, amount: float, step: float) -> float:
    return weight


def l2_penalty(weight: float, amount: float, step: float) -> float:
    return weight * (1 - step * amount)


def l1_penalty(weight: float, amount: float, step: float) -> float:
    """Soft threshold after the gradient step."""
    return math.copysign(max(0.0, abs(weight) - step * amount), weight)


class LinearModel:
    def __init__(self, features: list[str], weights: list[float], intercept: float, rounds: int):
        self.features, self.weights, self.intercept, self.rounds = features, weights, intercept, rounds

    def predict(self) -> Column:
        terms = [F.lit(w) * F.col(f) for f, w in zip(self.features, self.weights, strict=True)]
        return sum(terms, F.lit(self.intercept))


def descend(
    df: DataFrame,
    features: list[str],
    label: str,
    loss=squared_loss,
    penalty=no_penalty,
    amount: float = 0.0,
    step: float = 0.1,
    rounds: int = 10,
    converge: float | None = None,
) -> LinearModel:
    """Full-batch gradient descent with the step ``step / sqrt(round)``.

    A round is one aggregate over the rows: the gradient is summed in every task, and only the model
    (one number per feature) reaches the driver. Ends early when the relative change of the loss falls
    below ``converge``.
    """
    weights, intercept, before = [0.0] * len(features), 0.0, None
    for turn in range(1, rounds + 1):
        prediction = LinearModel(features, weights, intercept, turn).predict()
        cost, slope = loss(prediction, F.col(label))
        sums = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(cost).alias("cost"),
            F.sum(slope).alias("g0"),
            *[F.sum(slope * F.col(f)).alias(f"g_{i}") for i, f in enumerate(features)],
        ).first()
        if not sums["n"]:
            raise ValueError("no rows to learn from")
        rate = step / math.sqrt(turn)
        weights = [
            penalty(w - rate * sums[f"g_{i}"] / sums["n"], amount, rate) if penalty is l1_penalty
            else penalty(w, amount, rate) - rate * sums[f"g_{i}"] / sums["n"]
            for i, w in enumerate(weights)
        ]
        intercept -= rate * sums["g0"] / sums["n"]
        if converge is not None and before and abs(before - sums["cost"]) / before < converge:
            return LinearModel(features, weights, intercept, turn)
        before = sums["cost"]
    return LinearModel(features, weights, intercept, rounds)


def squared_residual_sum(df: DataFrame, model: LinearModel, label: str) -> DataFrame:
    gap = F.col(label) - model.predict()
    return df.agg(F.sum(gap * gap).alias("residual"))


def kmeans(points: DataFrame, vector: str, centres: list[list[float]], rounds: int) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's rounds from given centres; the centres (k vectors) are the only thing sent to the tasks.

    Returns the rows with their ``cluster`` and the last centres. A centre without points stays.
    """
    from millrace.ml.vectors import per_dimension, squared_euclidean

    def assign(now: list[list[float]]) -> DataFrame:
        gaps = [
            F.struct(squared_euclidean(F.col(vector), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i"))
            for i, c in enumerate(now)
        ]
        return points.withColumn("cluster", F.least(*gaps)["i"] if len(gaps) > 1 else F.lit(0))

    for _ in range(rounds):
        moved = per_dimension(assign(centres), vector, ["cluster"], centre=F.avg).collect()
        found = {r["cluster"]: list(r["centre"]) for r in moved}
        centres = [found.get(i, c) for i, c in enumerate(centres)]
    return assign(centres), centres


def factorise(ratings: DataFrame, user: str, item: str, rating: str, factors: int = 10, reg: float = 0.1, rounds: int = 5, seed: int = 0):
    """Alternating least squares on explicit ratings; returns the fitted model."""
    from pyspark.ml.recommendation import ALS

    return ALS(userCol=user, itemCol=item, ratingCol=rating, rank=factors, regParam=reg, maxIter=rounds, seed=seed,
               coldStartStrategy="nan").fit(ratings)


def empirical_risk(predicted: DataFrame, rating: str, user_factors: DataFrame, item_factors: DataFrame, reg: float) -> DataFrame:
    """Squared error plus the weighted norms of the factors."""
    error = predicted.agg(F.sum(F.pow(F.col(rating) - F.col("prediction"), 2)).alias("e"))

    def norms(factors: DataFrame) -> Column:
        return factors.agg(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))).scalar()

    return error.select((F.col("e") + reg * (norms(user_factors) + norms(item_factors))).alias("risk"))


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two sparse matrices given as (i, j, v)."""
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix_combine(a: DataFrame, b: DataFrame, fn) -> DataFrame:
    """``fn(x, y)`` cell by cell; a missing cell counts as 0."""
    joined = a.withColumnRenamed("v", "_x").join(b.withColumnRenamed("v", "_y"), ["i", "j"], "full")
    return joined.select("i", "j", fn(F.coalesce("_x", F.lit(0.0)), F.coalesce("_y", F.lit(0.0))).alias("v"))


def k_fold(df: DataFrame, folds: int, identity: list[str], seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """(training, testing) pairs; the fold of a row is a hash of its identity, so it never moves."""
    fold = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(folds))
    return [(df.where(fold != i), df.where(fold == i)) for i in range(folds)]


def random_split(df: DataFrame, fractions: list[float], seed: int = 0) -> list[DataFrame]:
    return df.randomSplit(fractions, seed)
