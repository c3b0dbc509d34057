"""Cohort tables: region of the customer by order year, from several sources with gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.predicates import drop_values
from cohortlab.operators.aggregate import (
    aggregate_by_region, aggregate_by_region_and_year, composite_score, distinct_counts, group_mean, group_sum,
)
from cohortlab.operators.merge import KEYS, merge_on_keys, merge_stored, proxy_fill
from cohortlab.operators.ranked import latest_periods
from cohortlab.plans.cohort import merge_and_fill, outcome_by_region, outcome_trend, plot_rows, recent_comparison, region_summary
from cohortlab.queries.registry import new_path, order_year, query, rounded, table
from cohortlab.session import durable
from cohortlab.sources.io import save_for_merge

TOTAL, EXEMPT = "AMERICA", ("EUROPE",)
MEASURES = ["median_income", "employment_rate", "mv_permits_count", "welfare_amount_avg"]
MONEY = ["median_income", "employment_rate", "welfare_amount_avg"]


def cohort_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (region, year). Orders are reduced per customer and year before the join, so one
    customer with very many orders brings a few rows to it."""
    low = F.col("o_orderpriority") == "5-LOW"
    orders = table(spark, sf, "orders").groupBy("o_custkey", order_year().alias("year")).agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("price"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(low).alias("n_low"),
        F.sum(F.when(low, F.col("o_totalprice"))).alias("price_low"),
    )
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = orders.join(customers.select("c_custkey", "c_acctbal", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    facts = rows.groupBy(F.col("r_name").alias("birth_region_standardized"), "year").agg(
        (F.sum("price") / F.sum("n")).alias("median_income"),
        (F.sum(F.col("c_acctbal") * F.col("n")) / F.sum("n")).alias("employment_rate"),
        F.sum("n_f").cast("double").alias("mv_permits_count"),
        (F.sum("price_low") / F.nullif(F.sum("n_low"), F.lit(0))).alias("welfare_amount_avg"),
    )
    return durable(facts)


def cohort_sources(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Four sources, each with its own years and regions."""
    facts = cohort_facts(spark, sf)
    region, year = F.col("birth_region_standardized"), F.col("year")

    def source(measure: str, start: int, end: int, absent: str) -> DataFrame:
        return facts.filter(year.between(start, end) & (region != absent)).select(*KEYS, measure)

    return [
        source("median_income", 1995, 1999, "AFRICA"), source("employment_rate", 1997, 2001, "ASIA"),
        source("mv_permits_count", 1996, 1998, "EUROPE"), source("welfare_amount_avg", 1998, 2000, "MIDDLE EAST"),
    ]


def merged_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return durable(merge_on_keys(cohort_sources(spark, sf), unique_keys=True))


FACTS_SQL = """
facts AS (
  SELECT r_name AS birth_region_standardized, CAST(year(o_orderdate) AS INTEGER) AS year,
         avg(o_totalprice) AS median_income, avg(c_acctbal) AS employment_rate,
         CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS mv_permits_count,
         avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS welfare_amount_avg
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2),
s1 AS (SELECT birth_region_standardized, year, median_income FROM facts
       WHERE year BETWEEN 1995 AND 1999 AND birth_region_standardized <> 'AFRICA'),
s2 AS (SELECT birth_region_standardized, year, employment_rate FROM facts
       WHERE year BETWEEN 1997 AND 2001 AND birth_region_standardized <> 'ASIA'),
s3 AS (SELECT birth_region_standardized, year, mv_permits_count FROM facts
       WHERE year BETWEEN 1996 AND 1998 AND birth_region_standardized <> 'EUROPE'),
s4 AS (SELECT birth_region_standardized, year, welfare_amount_avg FROM facts
       WHERE year BETWEEN 1998 AND 2000 AND birth_region_standardized <> 'MIDDLE EAST')"""


def merge_sql(kind: str) -> str:
    joins = " ".join(f"{kind} JOIN {s} USING (birth_region_standardized, year)" for s in ("s2", "s3", "s4"))
    return f"merged AS (SELECT * FROM s1 {joins})"


OUTER_SQL = f"{FACTS_SQL}, {merge_sql('FULL')}"
ROUNDED_SQL = """birth_region_standardized, year, round(median_income, 4) AS median_income,
round(employment_rate, 4) AS employment_rate, mv_permits_count, round(welfare_amount_avg, 4) AS welfare_amount_avg"""
PROXY_SQL = f"""{OUTER_SQL},
proxied AS (
  SELECT m.birth_region_standardized, m.year,
    CASE WHEN m.median_income IS NULL AND m.birth_region_standardized <> 'EUROPE' THEN t.median_income ELSE m.median_income END AS median_income,
    CASE WHEN m.employment_rate IS NULL AND m.birth_region_standardized <> 'EUROPE' THEN t.employment_rate ELSE m.employment_rate END AS employment_rate,
    m.mv_permits_count,
    CASE WHEN m.welfare_amount_avg IS NULL AND m.birth_region_standardized <> 'EUROPE' THEN t.welfare_amount_avg ELSE m.welfare_amount_avg END AS welfare_amount_avg
  FROM merged m LEFT JOIN (SELECT * FROM merged WHERE birth_region_standardized = 'AMERICA') t ON m.year = t.year)"""
FILLED_SQL = f"""{PROXY_SQL},
filled AS (SELECT birth_region_standardized, year, median_income, employment_rate,
  coalesce(mv_permits_count, (SELECT median(mv_permits_count) FROM proxied)) AS mv_permits_count, welfare_amount_avg FROM proxied)"""


@query(f"""WITH {FILLED_SQL} SELECT birth_region_standardized, round(avg(employment_rate), 4) AS employment_rate,
round(avg(median_income), 4) AS median_income, round(avg(welfare_amount_avg), 4) AS welfare_amount_avg
FROM filled GROUP BY 1""")
def cohort_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Merge, proxy fill, median fill and region summary."""
    merged = merge_and_fill(cohort_sources(spark, sf), TOTAL, EXEMPT)
    return rounded(region_summary(merged), ["employment_rate", "median_income", "welfare_amount_avg"], 4)


@query(f"WITH {FILLED_SQL} SELECT {ROUNDED_SQL} FROM filled")
def cohort_filled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(merge_and_fill(cohort_sources(spark, sf), TOTAL, EXEMPT), MONEY, 4)


@query(f"WITH {OUTER_SQL} SELECT {ROUNDED_SQL} FROM merged")
def cohort_merge_outer(spark: SparkSession, sf: str) -> DataFrame:
    """One union and one aggregate, as the sources have unique keys."""
    return rounded(merge_on_keys(cohort_sources(spark, sf), unique_keys=True), MONEY, 4)


@query(f"WITH {OUTER_SQL} SELECT {ROUNDED_SQL} FROM merged")
def cohort_merge_outer_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The same by joins, for sources that may repeat a key."""
    return rounded(merge_on_keys(cohort_sources(spark, sf)), MONEY, 4)


@query(f"WITH {OUTER_SQL} SELECT {ROUNDED_SQL} FROM merged")
def merge_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Sources stored once in buckets of their keys, then merged without a shuffle."""
    names = ["income", "employment", "permits", "welfare"]
    name = f"merge_{uuid.uuid4().hex}"
    tables = save_for_merge(dict(zip(names, cohort_sources(spark, sf), strict=True)), KEYS, name, new_path(spark, "merge"), 8)
    return rounded(merge_stored(spark, name, tables), MONEY, 4)


@query(f"WITH {FACTS_SQL}, {merge_sql('INNER')} SELECT {ROUNDED_SQL} FROM merged")
def cohort_merge_inner(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(merge_on_keys(cohort_sources(spark, sf), how="inner"), MONEY, 4)


@query(f"WITH {FACTS_SQL}, {merge_sql('LEFT')} SELECT {ROUNDED_SQL} FROM merged")
def cohort_merge_left(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(merge_on_keys(cohort_sources(spark, sf), how="left"), MONEY, 4)


@query(f"WITH {FACTS_SQL}, {merge_sql('RIGHT')} SELECT {ROUNDED_SQL} FROM merged")
def cohort_merge_right(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(merge_on_keys(cohort_sources(spark, sf), how="right"), MONEY, 4)


@query(f"""WITH {FACTS_SQL} SELECT birth_region_standardized, year, round(s1.median_income, 4) AS median_income,
round(s2.employment_rate, 4) AS employment_rate FROM s1 FULL JOIN s2 USING (birth_region_standardized, year)""")
def merge_first_source_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The second source also brings ``median_income``; the first one's column stays."""
    first, second = cohort_sources(spark, sf)[:2]
    again = second.withColumn("median_income", F.lit(0.0))
    return rounded(merge_on_keys([first, again], unique_keys=True), ["median_income", "employment_rate"], 4)


@query(f"WITH {PROXY_SQL} SELECT {ROUNDED_SQL} FROM proxied")
def proxy_filled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(proxy_fill(merged_cohort(spark, sf), TOTAL, EXEMPT), MONEY, 4)


@query("""SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year,
round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 3) AS o_totalprice
FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2""", name="group_mean")
def group_mean_query(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values skipped, rows with a missing key left out."""
    rows = table(spark, sf, "orders").select(
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"), order_year().alias("year"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
    )
    return rounded(group_mean(rows, ["o_orderpriority", "year"], ["o_totalprice"]), ["o_totalprice"], 3)


@query("""SELECT o_orderpriority, o_orderstatus, round(coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 0), 2) AS total
FROM orders GROUP BY 1, 2""", name="group_sum")
def group_sum_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("total", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return rounded(group_sum(rows, ["o_orderpriority", "o_orderstatus"], "total"), ["total"], 2)


@query("""SELECT o_orderpriority, round(avg(o_totalprice), 3) AS p_mean, round(sum(o_totalprice), 2) AS p_sum, min(o_totalprice) AS p_min,
max(o_totalprice) AS p_max, round(median(o_totalprice), 4) AS p_median, round(stddev_samp(o_totalprice), 3) AS p_std,
round(var_samp(o_totalprice), 0) AS p_var, count(o_totalprice) AS p_count, count(DISTINCT o_custkey) AS p_nunique,
arg_min(o_totalprice, o_orderkey) AS p_first, arg_max(o_totalprice, o_orderkey) AS p_last
FROM orders GROUP BY 1""")
def region_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A function per column."""
    names = ["mean", "sum", "min", "max", "median", "std", "var", "count", "first", "last"]
    rows = table(spark, sf, "orders").withColumns({f"p_{n}": F.col("o_totalprice") for n in names})
    rows = rows.withColumn("p_nunique", F.col("o_custkey"))
    functions = {f"p_{n}": n for n in [*names, "nunique"]}
    found = aggregate_by_region(rows, [], functions, "o_orderpriority", "o_orderkey")
    for digits, columns in ((3, ["p_mean", "p_std"]), (2, ["p_sum"]), (4, ["p_median"]), (0, ["p_var"])):
        found = rounded(found, columns, digits)
    return found


@query(f"""WITH {OUTER_SQL} SELECT birth_region_standardized, year, round(avg(median_income), 4) AS median_income,
round(avg(employment_rate), 4) AS employment_rate FROM merged GROUP BY 1, 2""")
def region_year_agg(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["median_income", "employment_rate"]
    return rounded(aggregate_by_region_and_year(merged_cohort(spark, sf), columns), columns, 4)


def score_sql(weights: tuple[float, float]) -> str:
    return f"""WITH {OUTER_SQL},
m AS (SELECT birth_region_standardized, avg(median_income) AS a, avg(employment_rate) AS b FROM merged GROUP BY 1),
e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM m),
n AS (SELECT *, CASE WHEN a1 > a0 THEN (a - a0) / (a1 - a0) ELSE 0 END AS na,
             CASE WHEN b1 > b0 THEN (b - b0) / (b1 - b0) ELSE 0 END AS nb FROM m, e)
SELECT birth_region_standardized, round(a, 4) AS median_income, round(b, 4) AS employment_rate, round(na, 6) AS median_income_norm,
round(nb, 6) AS employment_rate_norm, round(na * {weights[0]} + nb * {weights[1]}, 6) AS integration_score FROM n"""


def _score(merged: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    columns = ["median_income", "employment_rate"]
    scored = rounded(composite_score(merged, columns, weights), columns, 4)
    return rounded(scored, ["median_income_norm", "employment_rate_norm", "integration_score"], 6)


@query(score_sql((0.5, 0.5)), name="composite_score")
def composite_score_query(spark: SparkSession, sf: str) -> DataFrame:
    return _score(merged_cohort(spark, sf), None)


@query(score_sql((0.8, 0.2)))
def composite_score_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _score(merged_cohort(spark, sf), {"median_income": 0.8, "employment_rate": 0.2})


@query("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY 1 DESC LIMIT 3)
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate) IN (SELECT year FROM y) GROUP BY 1""", name="latest_periods")
def latest_periods_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(order_year().alias("year"), "o_totalprice")
    found = latest_periods(rows, 3).groupBy("year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(found, ["total"], 2)


@query(f"""WITH {OUTER_SQL} SELECT birth_region_standardized, round(avg(median_income), 4) AS median_income,
round(avg(employment_rate), 4) AS employment_rate, round(avg(employment_rate) / 10, 4) AS employment_rate_scaled
FROM merged WHERE year IN (SELECT DISTINCT year FROM merged ORDER BY 1 DESC LIMIT 3) GROUP BY 1
HAVING avg(median_income) IS NOT NULL AND avg(employment_rate) IS NOT NULL""")
def recent_pair(spark: SparkSession, sf: str) -> DataFrame:
    found = recent_comparison(merged_cohort(spark, sf), "median_income", "employment_rate")
    return rounded(found, ["median_income", "employment_rate", "employment_rate_scaled"], 4)


@query(f"""WITH {OUTER_SQL} SELECT birth_region_standardized, round(avg(welfare_amount_avg), 4) AS welfare_amount_avg
FROM merged GROUP BY 1 HAVING avg(welfare_amount_avg) IS NOT NULL""")
def outcome_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outcome_by_region(merged_cohort(spark, sf), "welfare_amount_avg"), ["welfare_amount_avg"], 4)


@query(f"""WITH {OUTER_SQL} SELECT birth_region_standardized, year, round(avg(welfare_amount_avg), 4) AS welfare_amount_avg
FROM merged GROUP BY 1, 2 HAVING avg(welfare_amount_avg) IS NOT NULL""")
def trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outcome_trend(merged_cohort(spark, sf), "welfare_amount_avg"), ["welfare_amount_avg"], 4)


@query(f"""WITH {OUTER_SQL} SELECT {ROUNDED_SQL} FROM merged
WHERE birth_region_standardized NOT IN ('Total', 'Other') ORDER BY year, birth_region_standardized""", name="plot_rows")
def plot_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(plot_rows(merged_cohort(spark, sf)), MONEY, 4)


@query("""SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_distinct, count(DISTINCT o_orderstatus) > 1 AS varies FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT o_custkey) > 1 FROM orders
UNION ALL SELECT 'priority', count(DISTINCT nullif(o_orderpriority, '5-LOW')), count(DISTINCT nullif(o_orderpriority, '5-LOW')) > 1 FROM orders""")
def distinct_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return distinct_counts(rows, ["o_orderstatus", "o_custkey", "priority"])


@query("""SELECT r_name AS birth_region_standardized, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE') GROUP BY 1""")
def cohort_anti_filter(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = drop_values(rows.select(F.col("r_name").alias("birth_region_standardized")), "birth_region_standardized", ["ASIA", "EUROPE"])
    return rows.groupBy("birth_region_standardized").agg(F.count("*").alias("n"))
