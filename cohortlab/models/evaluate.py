"""Input checks, regression metrics, cross-validation and the train-and-evaluate job."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.models.linear import LinearModel, fit_linear, fit_linear_folds
from cohortlab.operators.reshape import union_all
from cohortlab.operators.split import assign_folds, train_test
from cohortlab.session import durable
from cohortlab.together import AT_MOST, run_together


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: missing (NULL or NaN) cells of each column."""
    def missing(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.count_if(value.isNull() | F.isnan(value)).alias(c)

    return df.agg(*[missing(c) for c in columns])


def validate_input(df: DataFrame, features: list[str], target: str) -> None:
    """Stop if a feature or the target has a missing cell."""
    row = null_counts(df, [*features, target]).first()
    bad = {c: row[c] for c in row.asDict() if row[c]}
    if bad:
        raise ValueError(f"missing values in {bad}")


def regression_metrics(df: DataFrame, target: str, prediction: str, by: str | None = None) -> DataFrame:
    """R², MAE, RMSE and MAPE (per cent) in one aggregate, per group if ``by`` is given."""
    y, p = F.col(target).cast("double"), F.col(prediction)
    residual = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(spread > 0, 1 - residual / F.nullif(spread, F.lit(0.0))).when(residual == 0, 1.0).otherwise(0.0)
    rows = df.groupBy(by) if by else df.groupBy()
    return rows.agg(
        r2.alias("r2"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (F.avg(F.abs((y - p) / (y + 1e-10))) * 100).alias("mape"),
    )


Fit = Callable[[DataFrame, list[str], str], Any]


def cross_validate(
    df: DataFrame, row_id: str, features: list[str], target: str, fit: Fit, k: int = 5, seed: int = 42, at_most: int = AT_MOST
) -> DataFrame:
    """R², MAE and RMSE per fold for any model, refitted on the other folds; the fits run as concurrent jobs."""
    folded = durable(assign_folds(df, row_id, k, seed=seed))
    fitted = run_together(df.sparkSession, {f"fold-{f}": lambda f=f: fit(folded.filter(F.col("fold") != f), features, target) for f in range(k)}, at_most)
    parts = [fitted[f"fold-{f}"].predict(folded.filter(F.col("fold") == f)) for f in range(k)]
    return regression_metrics(union_all(parts), target, "prediction", "fold").drop("mape")


def cross_validate_linear(
    df: DataFrame, row_id: str, features: list[str], target: str, k: int = 5, seed: int = 42, **params: Any
) -> DataFrame:
    """As :func:`cross_validate` for gradient descent: one scan fits every fold, one scan measures them."""
    validate_input(df, features, target)
    folded = assign_folds(df, row_id, k, seed=seed)
    models: dict[int, LinearModel] = fit_linear_folds(folded, features, target, "fold", **params)
    prediction = F.lit(None).cast("double")
    for f, model in models.items():
        prediction = F.when(F.col("fold") == f, model.expression()).otherwise(prediction)
    scored = folded.withColumn("prediction", prediction)
    return regression_metrics(scored, target, "prediction", "fold").drop("mape")


def train_and_evaluate(
    df: DataFrame, row_id: str, features: list[str], target: str, fit: Fit = fit_linear, test_size: float = 0.2,
    seed: int = 42,
) -> tuple[DataFrame, Any]:
    """Random split, fit, and metrics of both parts: one row per part with its size; also the model."""
    train, test = train_test(df, row_id, test_size, seed=seed)
    model = fit(train, features, target)
    parts = union_all([train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test"))])
    scored = model.predict(parts)
    sizes = scored.groupBy("part").agg(F.count("*").alias("n"))
    return regression_metrics(scored, target, "prediction", "part").join(sizes, "part"), model
