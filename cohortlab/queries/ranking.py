"""Ranking curves and metrics of three score columns of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.scalars import predicted_label
from cohortlab.operators.correlation import correlation_matrix
from cohortlab.operators.ranked import (
    average_precision, confusion_at_limit, confusion_matrix, curve_points, model_scores, model_table, operating_points, pr_curve,
    roc_auc, roc_curve, threshold_sweep,
)
from cohortlab.operators.reshape import metrics_long
from cohortlab.queries.registry import query, rounded, table

SCORES = ["s_value", "s_key", "s_mix"]


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Label (1 for errors) and three scores: all but distinct, heavily tied, and in between."""
    key = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return table(spark, sf, "events").select(
        (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("s_value"), key.alias("s_key"),
        F.round(F.col("value") / 10, 1).alias("s_mix"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return curve_points(model_scores(wide_scores(spark, sf), "y", SCORES))


WIDE_SQL = """wide AS (SELECT CAST(event_type = 'error' AS INTEGER) AS y, value AS s_value,
CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS s_key, round(value / 10, 1) AS s_mix FROM events)"""
POINTS_SQL = f"""WITH {WIDE_SQL},
tall AS (SELECT 's_value' AS model, y, s_value AS score FROM wide UNION ALL SELECT 's_key', y, s_key FROM wide
         UNION ALL SELECT 's_mix', y, s_mix FROM wide),
g AS (SELECT model, score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM tall GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS p, CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS n,
  lead(pos) OVER (PARTITION BY model ORDER BY score DESC) AS npos, lead(neg) OVER (PARTITION BY model ORDER BY score DESC) AS nneg,
  row_number() OVER (PARTITION BY model ORDER BY score DESC) AS rn
  FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
roc AS (SELECT model, score AS threshold, fp, tp, p, n FROM c WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL SELECT DISTINCT model, 'Infinity'::DOUBLE, 0, 0, p, n FROM c)"""


def at_sql(limits: str) -> str:
    return f"""{POINTS_SQL}, lim AS ({limits}),
ops AS (SELECT model, max_fpr, max(fp) AS fp, max(tp) AS tp, min(threshold) AS threshold, any_value(p) AS p, any_value(n) AS n
  FROM roc JOIN lim ON fp / n <= max_fpr GROUP BY 1, 2)"""


@query(f"{POINTS_SQL} SELECT model, threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM roc")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roc_curve(points(spark, sf)), ["fpr", "tpr"], 9)


@query(f"""{POINTS_SQL} SELECT model, score AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM c
UNION ALL SELECT DISTINCT model, 'Infinity'::DOUBLE, 0, 0 FROM c""")
def roc_points_all(spark: SparkSession, sf: str) -> DataFrame:
    """Points on straight stretches kept."""
    return rounded(roc_curve(points(spark, sf), drop_straight=False), ["fpr", "tpr"], 9)


@query(f"""{POINTS_SQL} SELECT model, score AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM c
UNION ALL SELECT DISTINCT model, 'Infinity'::DOUBLE, 1.0, 0.0 FROM c""")
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pr_curve(points(spark, sf)), ["precision", "recall"], 9)


@query(f"{POINTS_SQL} SELECT model, round(sum(neg * (tp - pos / 2)) / max(p * n), 9) AS roc_auc FROM c GROUP BY 1", name="roc_auc")
def roc_auc_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roc_auc(points(spark, sf)), ["roc_auc"], 9)


@query(f"{POINTS_SQL} SELECT model, round(sum(pos * (tp / (tp + fp))) / max(p), 9) AS average_precision FROM c GROUP BY 1")
def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(average_precision(points(spark, sf)), ["average_precision"], 9)


THREE = "SELECT unnest([0.001, 0.005, 0.01])::DOUBLE AS max_fpr"


@query(f"""{at_sql(THREE)} SELECT model, max_fpr, threshold, round(tp / p, 9) AS recall FROM ops""")
def recall_at_fpr(spark: SparkSession, sf: str) -> DataFrame:
    found = operating_points(points(spark, sf), [0.001, 0.005, 0.01]).select("model", "max_fpr", "threshold", "recall")
    return rounded(found, ["recall"], 9)


SWEEP = "SELECT CASE WHEN range = 49 THEN 0.05 ELSE 0.001 + range * (0.049::DOUBLE / 49) END AS max_fpr FROM range(50)"


@query(f"""{at_sql(SWEEP)} SELECT model, round(max_fpr, 6) AS max_fpr, round(tp / p, 9) AS recall,
CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 9) END AS precision FROM ops""", name="threshold_sweep")
def threshold_sweep_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(threshold_sweep(points(spark, sf)), ["max_fpr"], 6), ["recall", "precision"], 9)


@query(f"""{at_sql("SELECT 0.01::DOUBLE AS max_fpr")} SELECT model, threshold, n - fp AS true_negative, fp AS false_positive,
p - tp AS false_negative, tp AS true_positive FROM ops""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return confusion_at_limit(points(spark, sf), 0.01)


@query(f"""WITH {WIDE_SQL} SELECT count(*) FILTER (WHERE y = 0 AND s_value < 60) AS true_negative,
count(*) FILTER (WHERE y = 0 AND s_value >= 60) AS false_positive, count(*) FILTER (WHERE y = 1 AND s_value < 60) AS false_negative,
count(*) FILTER (WHERE y = 1 AND s_value >= 60) AS true_positive FROM wide""")
def confusion_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = wide_scores(spark, sf).withColumn("flagged", predicted_label(F.col("s_value"), 60.0))
    return confusion_matrix(rows, "y", "flagged")


TABLE_SQL = f"""{at_sql(THREE)},
m AS (SELECT model, sum(pos * (tp / (tp + fp))) / max(p) AS auprc, sum(neg * (tp - pos / 2)) / max(p * n) AS roc_auc FROM c GROUP BY 1),
r AS (SELECT model, max(tp / p) FILTER (WHERE max_fpr = 0.001) AS r1, max(tp / p) FILTER (WHERE max_fpr = 0.005) AS r2,
  max(tp / p) FILTER (WHERE max_fpr = 0.01) AS r3 FROM ops GROUP BY 1),
mt AS (SELECT model, round(auprc, 9) AS auprc, round(roc_auc, 9) AS roc_auc, round(r1, 9) AS recall_at_0_1_pct_fpr,
  round(r2, 9) AS recall_at_0_5_pct_fpr, round(r3, 9) AS recall_at_1_0_pct_fpr FROM m JOIN r USING (model))"""


def _table(spark: SparkSession, sf: str) -> DataFrame:
    found = model_table(points(spark, sf))
    return rounded(found, [c for c in found.columns if c != "model"], 9)


@query(f"{TABLE_SQL} SELECT * FROM mt", name="model_table")
def model_table_query(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf)


@query(f"{TABLE_SQL} UNPIVOT mt ON COLUMNS(* EXCLUDE model) INTO NAME metric VALUE value".replace(
    "UNPIVOT mt", "SELECT model, metric, value FROM (UNPIVOT mt") + ")")
def model_table_long(spark: SparkSession, sf: str) -> DataFrame:
    return metrics_long(_table(spark, sf))


@query(f"""WITH {WIDE_SQL} """ + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE AS corr" if a == b else f"round(corr({a}, {b}), 8) AS corr FROM wide")
    for a in SCORES for b in SCORES))
def score_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation_matrix(wide_scores(spark, sf), SCORES), ["corr"], 8)
