"""Cohort job: merge sources, fill, summarise, and the figure tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.names import drop_artefacts
from cohortlab.functions.predicates import drop_values, years_between
from cohortlab.operators.aggregate import aggregate_by_region, distinct_counts, group_mean
from cohortlab.operators.impute import fill_missing
from cohortlab.operators.merge import KEYS, merge_on_keys, non_empty, proxy_fill
from cohortlab.operators.ranked import latest_periods
from cohortlab.session import durable
from cohortlab.sources.cells import load_counts
from cohortlab.sources.io import optional_source, save_table
from cohortlab.sources.settings import OUTCOMES, PLOT_EXCLUDED, REGION
from cohortlab.sources.statistics import load_statistics
from cohortlab.sources.welfare import load_welfare


@dataclass
class CohortPaths:
    """Locations of the sources; a path that does not exist leaves its source out."""

    statistics: dict[str, str]
    counts: dict[str, str]
    welfare: str


def load_sources(spark: SparkSession, paths: CohortPaths, start: int = 2013, end: int = 2024) -> list[DataFrame]:
    """Sources in merge order; the year range applies to the statistics only."""
    found: list[DataFrame | None] = []
    for indicator, path in paths.statistics.items():
        table = optional_source(spark, path, load_statistics, indicator)
        found.append(None if table is None else years_between(table, start, end))
    found += [optional_source(spark, path, load_counts, kind) for kind, path in paths.counts.items()]
    found.append(optional_source(spark, paths.welfare, load_welfare))
    return non_empty(found)


def merge_and_fill(sources: list[DataFrame], total: str | None = None, exempt: tuple[str, ...] | None = None) -> DataFrame:
    """Outer merge, proxy fill, median fill of the non-outcome columns, artefact columns dropped.

    The merged table is stored once, as the proxies, the medians and the result all read it.
    """
    merged = durable(merge_on_keys(sources, KEYS, "outer", unique_keys=True))
    options = {k: v for k, v in (("total", total), ("exempt", exempt)) if v is not None}
    filled = proxy_fill(merged, **options)
    return drop_artefacts(fill_missing(filled, "median", exclude=[*KEYS, *OUTCOMES]))


def region_summary(merged: DataFrame) -> DataFrame:
    return aggregate_by_region(merged, [c for c in OUTCOMES if c in merged.columns])


def plot_rows(merged: DataFrame) -> DataFrame:
    """Rows shown in figures, by year and region."""
    return drop_values(merged, REGION, PLOT_EXCLUDED).orderBy("year", REGION)


def varying_outcomes(rows: DataFrame, outcomes: list[str]) -> list[str]:
    """Outcomes with more than one distinct value, from one aggregate."""
    found = {r["column"] for r in distinct_counts(rows, outcomes).filter("varies").collect()}
    return [c for c in outcomes if c in found]


def outcome_by_region(rows: DataFrame, outcome: str) -> DataFrame:
    """Mean outcome of each region, lowest first."""
    means = group_mean(rows, [REGION], [outcome]).filter(F.col(outcome).isNotNull())
    return means.orderBy(outcome, REGION)


def outcome_trend(rows: DataFrame, outcome: str) -> DataFrame:
    """Mean outcome of each region and year."""
    return group_mean(rows, [REGION, "year"], [outcome]).filter(F.col(outcome).isNotNull())


def recent_comparison(rows: DataFrame, first: str, second: str, periods: int = 3) -> DataFrame:
    """Means of two outcomes over the latest years, highest first outcome on top; the second also divided by 10."""
    means = group_mean(latest_periods(rows, periods), [REGION], [first, second]).na.drop(how="any", subset=[first, second])
    return means.withColumn(f"{second}_scaled", F.col(second) / 10).orderBy(F.col(first).desc(), REGION)


def run(spark: SparkSession, paths: CohortPaths, out: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Whole job: (merged table, region summary, figure tables); the first two are also written under ``out``."""
    sources = load_sources(spark, paths)
    if not sources:
        raise ValueError("no source found")
    merged = durable(merge_and_fill(sources))
    save_table(merged, f"{out}/merged")
    summary = region_summary(merged)
    save_table(summary, f"{out}/summary")
    outcomes = [c for c in OUTCOMES if c in merged.columns]
    figures: dict[str, DataFrame] = {}
    if outcomes:
        rows = drop_values(merged, REGION, PLOT_EXCLUDED)
        for outcome in varying_outcomes(rows, outcomes):
            figures[f"by_region_{outcome}"] = outcome_by_region(rows, outcome)
            figures[f"trend_{outcome}"] = outcome_trend(rows, outcome)
        if {"median_income", "welfare_amount_avg"} <= set(outcomes):
            figures["income_and_welfare"] = recent_comparison(rows, "median_income", "welfare_amount_avg")
    return merged, summary, figures
