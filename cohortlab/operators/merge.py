"""Multi-source merge on shared keys and proxy fill from a total cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.session import broadcast_if_small

KEYS = ["birth_region_standardized", "year"]
TOTAL_COHORT = "Foreign Born (Total)"
EXEMPT_COHORTS = ("Sweden", "Total")
PROXY_FRAGMENTS = ("_rate", "_avg", "_income")


def non_empty(sources: list[DataFrame | None]) -> list[DataFrame]:
    """Leave out missing and empty sources."""
    return [s for s in sources if s is not None and not s.isEmpty()]


def first_source_wins(sources: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Drop from each later source the non-key columns an earlier one already brought."""
    seen: set[str] = set()
    pruned = []
    for source in sources:
        own = [c for c in source.columns if c in keys or c not in seen]
        pruned.append(source.select(*own))
        seen.update(own)
    return pruned


def merge_on_keys(
    sources: list[DataFrame], keys: list[str] | None = None, how: str = "outer", unique_keys: bool = False
) -> DataFrame:
    """Merge the sources in order.

    ``unique_keys`` says every source has one row per key (group-aggregated sources do). An outer
    merge is then one union and one aggregate with map-side combine, so the number of shuffles does
    not grow with the number of sources; a repeated key stops the job.
    """
    if not sources:
        raise ValueError("no source to merge")
    keys = keys or KEYS
    pruned = first_source_wins(sources, keys)
    if how == "outer" and unique_keys:
        return _merge_by_union(pruned, keys)
    return reduce(lambda a, b: a.join(b, keys, how), pruned)


def merge_stored(spark: SparkSession, name: str, tables: list[str], keys: list[str] | None = None) -> DataFrame:
    """Outer merge, in order, of tables that ``save_for_merge`` wrote under ``name``; a repeated key stops the job.

    The stored keys are joined with each table bucket by bucket. All are bucketed and sorted alike, and a left join keeps
    its left side's buckets, so the plan has no exchange.
    """
    keys = keys or KEYS
    merged = spark.table(f"{name}_keys")
    for source in first_source_wins([spark.table(t) for t in tables], keys):
        values = [c for c in source.columns if c not in keys]
        single = F.when(F.count("*") == 1, F.lit(0)).otherwise(F.raise_error(F.lit("a source repeats a key")).cast("int"))
        rows = source.groupBy(*keys).agg(*[F.max(f"`{c}`").alias(c) for c in values], single.alias("_single"))
        merged = merged.join(rows.filter("_single = 0").drop("_single").hint("merge"), keys, "left")
    return merged


def _merge_by_union(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    values = [c for c in stacked.columns if c not in keys and c != "_source"]
    copies = [F.count_if(F.col("_source") == i) for i in range(len(sources))]
    merged = stacked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in values], F.greatest(*copies, F.lit(0)).alias("_copies")
    )
    checked = F.when(F.col("_copies") > 1, F.raise_error(F.lit("a source repeats a key"))).otherwise(F.lit(True))
    return merged.filter(checked.cast("boolean")).drop("_copies")


def proxy_columns(columns: list[str], fragments: tuple[str, ...] = PROXY_FRAGMENTS) -> list[str]:
    return [c for c in columns if any(f in c for f in fragments)]


def proxy_fill(
    df: DataFrame,
    total: str = TOTAL_COHORT,
    exempt: tuple[str, ...] = EXEMPT_COHORTS,
    region: str = "birth_region_standardized",
    year: str = "year",
    columns: list[str] | None = None,
) -> DataFrame:
    """Fill a missing outcome from the total cohort's value of the same year.

    The total cohort has one row per year; the filter reaches the scans and the few rows found are
    broadcast after their number was checked, so the large side is neither shuffled nor sorted.
    """
    columns = proxy_columns(df.columns) if columns is None else columns
    if not columns:
        return df
    proxies = (
        df.filter((F.col(region) == total) & F.col(year).isNotNull())
        .groupBy(F.col(year).alias("_year"))
        .agg(*[F.max(c).alias(f"_proxy_{c}") for c in columns])
    )
    joined = df.join(broadcast_if_small(proxies), F.col(year) == F.col("_year"), "left")
    open_row = ~F.coalesce(F.col(region).isin(*exempt), F.lit(False))
    filled = {c: F.when(F.col(c).isNull() & open_row, F.col(f"_proxy_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(filled).select(*df.columns)
