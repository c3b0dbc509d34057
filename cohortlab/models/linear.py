"""Linear regression by batch gradient descent.

One scan gathers the second moments. Every descent step is then exact on a matrix as wide as the
features, so the number of iterations does not change the number of Spark jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.moments import centred_sums


@dataclass
class LinearModel:
    features: list[str]
    coefficients: np.ndarray
    intercept: float
    history: list[float] = field(default_factory=list)
    params: dict[str, float] = field(default_factory=dict)

    def expression(self) -> Column:
        total = F.lit(float(self.intercept))
        for name, weight in zip(self.features, self.coefficients, strict=True):
            total = total + F.lit(float(weight)) * F.col(name).cast("double")
        return total

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expression())

    def predict_cohort(self, df: DataFrame, cohort: str, region: str = "birth_region_standardized") -> DataFrame:
        return self.predict(df.filter(F.col(region) == cohort))

    def coefficient_table(self, df: DataFrame) -> DataFrame:
        """(term, coefficient) on the original scale."""
        names = ["intercept", *self.features]
        values = [float(self.intercept), *map(float, self.coefficients)]
        return df.sparkSession.createDataFrame(list(zip(names, values, strict=True)), "term string, coefficient double")

    def history_table(self, df: DataFrame) -> DataFrame:
        """(iteration, cost)."""
        return df.sparkSession.createDataFrame(list(enumerate(self.history)), "iteration int, cost double")


def descend(
    gram: np.ndarray, cross: np.ndarray, target_power: float, rate: float, iterations: int, tolerance: float
) -> tuple[np.ndarray, list[float]]:
    """Weights on standardised data and the cost of every iteration."""
    weights = np.zeros(len(cross))
    history: list[float] = []
    for _ in range(iterations):
        fitted = gram @ weights
        history.append(float(target_power - 2 * weights @ cross + weights @ fitted))
        if len(history) > 1 and abs(history[-2] - history[-1]) < tolerance:
            break
        weights = weights - rate * 2 * (fitted - cross)
    return weights, history


def fit_from_sums(
    features: list[str], shift: np.ndarray, n: float, sums: np.ndarray, products: np.ndarray,
    rate: float, iterations: int, tolerance: float,
) -> LinearModel:
    """Fit from shifted sums; the target is the last column."""
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    spread[spread < 1e-12 * np.maximum(1.0, np.abs(shift))] = 0.0
    scale = np.where(spread > 0, spread, 1.0)
    corr = cov / np.outer(scale, scale)
    weights, history = descend(corr[:-1, :-1], corr[:-1, -1], float(spread[-1] > 0), rate, iterations, tolerance)
    coefficients = weights * scale[-1] / scale[:-1]
    centre = mean + shift
    params = {"rate": rate, "iterations": iterations, "tolerance": tolerance}
    return LinearModel(features, coefficients, float(centre[-1] - coefficients @ centre[:-1]), history, params)


def fit_linear(
    df: DataFrame, features: list[str], target: str, rate: float = 0.01, iterations: int = 1000, tolerance: float = 1e-6
) -> LinearModel:
    from cohortlab.models.evaluate import validate_input

    validate_input(df, features, target)
    shift, groups = centred_sums(df, [*features, target])
    n, sums, products = groups[0]
    return fit_from_sums(features, shift, n, sums, products, rate, iterations, tolerance)


def fit_linear_folds(
    df: DataFrame, features: list[str], target: str, fold: str, rate: float = 0.01, iterations: int = 1000,
    tolerance: float = 1e-6,
) -> dict[int, LinearModel]:
    """One model per fold, fitted on the other folds; all from one scan by subtracting the fold's sums."""
    shift, groups = centred_sums(df, [*features, target], fold)
    n = sum(g[0] for g in groups.values())
    sums = sum(g[1] for g in groups.values())
    products = sum(g[2] for g in groups.values())
    return {
        f: fit_from_sums(features, shift, n - fn, sums - fs, products - fp, rate, iterations, tolerance)
        for f, (fn, fs, fp) in groups.items()
    }
