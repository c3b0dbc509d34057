"""Imputation, scaling, quantile, correlation, distribution and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.aggregate import class_balance, column_statistics
from cohortlab.operators.correlation import correlation_matrix, label_correlation
from cohortlab.operators.distribution import histogram, kernel_density, percentile
from cohortlab.operators.impute import (
    apply_standard, class_weights, clip_outliers, fill_missing, fit_standard, min_max_scale, positive_weight, with_class_weight,
)
from cohortlab.operators.quantiles import box_statistics, exact_quantiles, merge_sketches, quantile_sketches, rank_error, sketched_quantiles
from cohortlab.operators.split import assign_folds, fixed_sample, sample_keeping, split_rows
from cohortlab.plans.anomaly import clean
from cohortlab.queries.registry import query, rounded, table
from cohortlab.session import broadcast_if_small, durable

GAPS_SQL = "gaps AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)"
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", price.alias("price"))


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric lineitem columns with label 1 for returned lines."""
    y = (F.col("l_returnflag") == "R").cast("int")
    return table(spark, sf, "lineitem").select(*FEATURES, y.alias("y"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events with label 1 for errors and the value as score."""
    y = (F.col("event_type") == "error").cast("int")
    return table(spark, sf, "events").select(F.col("event_id").alias("row_id"), y.alias("y"), F.col("value").alias("score"))


SCORED_SQL = "scored AS (SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS y, value AS score FROM events)"


def _filled(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    return rounded(fill_missing(gaps(spark, sf), strategy, ["o_orderkey"]), ["price"], 4)


@query(f"WITH {GAPS_SQL} SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM gaps)), 4) AS price FROM gaps")
def fill_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "mean")


@query(f"WITH {GAPS_SQL} SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM gaps)), 4) AS price FROM gaps")
def fill_median(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "median")


@query(f"WITH {GAPS_SQL} SELECT o_orderkey, round(coalesce(price, 0), 4) AS price FROM gaps")
def fill_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf, "zero")


@query(f"""WITH {GAPS_SQL} SELECT o_orderkey, round((price - (SELECT min(price) FROM gaps)) /
((SELECT max(price) FROM gaps) - (SELECT min(price) FROM gaps)), 8) AS price, 7.0::DOUBLE AS constant FROM gaps""")
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = gaps(spark, sf).withColumn("constant", F.lit(7.0))
    return rounded(min_max_scale(rows, ["price", "constant", "absent"]), ["price"], 8)


@query(f"""WITH {GAPS_SQL}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS d FROM gaps)
SELECT o_orderkey, round(CASE WHEN price > m + 1.5 * d THEN m + 1.5 * d WHEN price < m - 1.5 * d THEN m - 1.5 * d ELSE price END, 3) AS price
FROM gaps, s""", name="clip_outliers")
def clip_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clip_outliers(gaps(spark, sf), "price", 1.5), ["price"], 3)


SPLIT_SQL = f"""{SCORED_SQL}, counts AS (SELECT y, count(*) AS n FROM scored GROUP BY 1),
size AS (SELECT CAST(ceil(round(sum(n) * 0.2, 9)) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n FROM counts),
quota AS (SELECT y, floor(counts.n * k / size.n) AS base, counts.n * k / size.n - floor(counts.n * k / size.n) AS rest, k FROM counts, size),
quotas AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= k - sum(base) OVER () THEN 1 ELSE 0 END AS q FROM quota),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || row_id), row_id) AS place FROM scored),
parts AS (SELECT r.*, place <= q AS is_test FROM ranked r JOIN quotas USING (y))"""


@query(f"""WITH {SPLIT_SQL}, s AS (SELECT avg(score) AS m, stddev_pop(score) AS d FROM parts WHERE NOT is_test)
SELECT row_id, is_test, round((score - m) / d, 7) AS score FROM parts, s""")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Scaler fitted on the training part only."""
    parts = split_rows(scored(spark, sf), "row_id", 0.2, "y")
    stats = fit_standard(parts.filter("not is_test"), ["score"])
    return rounded(apply_standard(parts, stats), ["score"], 7).select("row_id", "is_test", "score")


@query(f"WITH {SPLIT_SQL} SELECT row_id, y, is_test FROM parts")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(scored(spark, sf), "row_id", 0.2, "y").select("row_id", "y", "is_test")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) <= ceil(round((SELECT count(*) FROM orders) * 0.25, 9))
AS is_test FROM orders""")
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.25, seed=7)


@query(f"""WITH {SCORED_SQL} SELECT row_id, CAST(ntile(5) OVER (ORDER BY md5('42|' || row_id), row_id) - 1 AS INTEGER) AS fold FROM scored""")
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return assign_folds(scored(spark, sf).select("row_id"), "row_id", 5)


@query(f"""WITH {SCORED_SQL} SELECT row_id, y, CAST(ntile(3) OVER (PARTITION BY y ORDER BY md5('42|' || row_id), row_id) - 1 AS INTEGER) AS fold
FROM scored""")
def kfold_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return assign_folds(scored(spark, sf).select("row_id", "y"), "row_id", 3, "y")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000", name="fixed_sample")
def fixed_sample_query(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


@query(f"""WITH {SCORED_SQL} (SELECT row_id, y FROM scored WHERE y = 0 ORDER BY md5('42|' || row_id), row_id LIMIT 500)
UNION ALL SELECT row_id, y FROM scored WHERE y = 1""", name="sample_keeping")
def sample_keeping_query(spark: SparkSession, sf: str) -> DataFrame:
    return sample_keeping(scored(spark, sf).select("row_id", "y"), "row_id", "y", 500)


@query(f"WITH {SCORED_SQL} SELECT y, count(*) AS n, round((SELECT count(*) FROM scored) / (2.0 * count(*)), 8) AS weight FROM scored GROUP BY 1",
    name="class_weights")
def class_weights_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(class_weights(scored(spark, sf), "y"), ["weight"], 8)


@query(f"""WITH {SCORED_SQL} SELECT y, round(sum((SELECT count(*) FROM scored) / (2.0 * (SELECT count(*) FROM scored t WHERE t.y = s.y))), 4) AS total,
round((SELECT count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1) FROM scored), 8) AS positive_weight FROM scored s GROUP BY 1""")
def weighted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Weights attached to the rows add up to n / classes in each class."""
    rows = scored(spark, sf)
    total = with_class_weight(rows, "y").groupBy("y").agg(F.round(F.sum("weight"), 4).alias("total"))
    return total.withColumn("positive_weight", F.round(F.lit(positive_weight(rows, "y")), 8))


@query(f"WITH {SCORED_SQL} SELECT y, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored), 8) AS rate FROM scored GROUP BY 1",
    name="class_balance")
def class_balance_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(class_balance(scored(spark, sf), "y"), ["rate"], 8)


def _per_feature(template: str) -> str:
    return " UNION ALL ".join(template.format(f=f) for f in FEATURES)


TXN_SQL = "txn AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"


@query(f"""WITH {TXN_SQL}, tall AS ({_per_feature("SELECT y, '{f}' AS feature, {f} AS v FROM txn")}),
q AS (SELECT y, feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM tall GROUP BY 1, 2)
SELECT y, feature, round(q1, 5) AS q1, round(med, 5) AS median, round(q3, 5) AS q3,
round(least(q1, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))), 5) AS whisker_low,
round(greatest(q3, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))), 5) AS whisker_high
FROM tall JOIN q USING (y, feature) GROUP BY y, feature, q1, med, q3""")
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = box_statistics(transactions(spark, sf), FEATURES, "y")
    return rounded(found, ["q1", "median", "q3", "whisker_low", "whisker_high"], 5)


@query(f"""WITH {TXN_SQL} {_per_feature("SELECT '{f}' AS feature, round(abs(corr({f}, y)), 8) AS abs_corr FROM txn")}""")
def label_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(label_correlation(transactions(spark, sf), FEATURES, "y"), ["abs_corr"], 8)


def _pairs() -> str:
    cells = [(a, b) for a in FEATURES for b in FEATURES]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE AS corr" if a == b else f"round(corr({a}, {b}), 8) AS corr FROM txn")
        for a, b in cells)


@query(f"WITH {TXN_SQL} {_pairs()}")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(correlation_matrix(transactions(spark, sf), FEATURES), ["corr"], 8)


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT 'e' || p.i AS a, 'e' || q.i AS b, round(CASE WHEN p.i = q.i THEN 1.0 ELSE corr(p.v, q.v) END, 7)::DOUBLE AS corr
FROM x p JOIN x q USING (vec_id) GROUP BY p.i, q.i""")
def corr_matrix_wide(spark: SparkSession, sf: str) -> DataFrame:
    """64 columns: block products inside the tasks."""
    columns = [f"e{i}" for i in range(64)]
    rows = table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    return rounded(correlation_matrix(rows, columns), ["corr"], 7)


@query(f"""WITH {SCORED_SQL}, u AS (SELECT quantile_cont(score, 0.99) AS top FROM scored),
b AS (SELECT y, CAST(least(floor(score / (top / 59)), 58) AS INTEGER) AS bin FROM scored, u WHERE score BETWEEN 0 AND top),
c AS (SELECT y, bin, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT y, sum(n) AS total FROM c GROUP BY 1),
g AS (SELECT y, total, CAST(range AS INTEGER) AS bin FROM t CROSS JOIN range(59))
SELECT g.y, g.bin, round(g.bin * (top / 59), 6) AS low, round((g.bin + 1) * (top / 59), 6) AS high, coalesce(n, 0)::BIGINT AS n,
round(coalesce(n, 0) / (total * (top / 59)), 8) AS density FROM g LEFT JOIN c USING (y, bin) CROSS JOIN u""", name="histogram")
def histogram_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(histogram(scored(spark, sf), "score", "y"), ["low", "high"], 6), ["density"], 8)


@query("""WITH r AS (SELECT CAST(event_type = 'error' AS INTEGER) AS y, ln(1 + value) AS x FROM events),
s AS (SELECT y, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi FROM r GROUP BY 1),
g AS (SELECT y, n, h, CAST(range AS INTEGER) AS point, lo - 3 * h + range * ((hi - lo + 6 * h) / 199) AS gx FROM s CROSS JOIN range(200))
SELECT g.y, g.point, round(gx, 6) AS x, round(sum(exp(-0.5 * pow((gx - r.x) / h, 2))) / (n * h * sqrt(2 * pi())), 7) AS density
FROM g JOIN r USING (y) GROUP BY g.y, g.point, gx, n, h""")
def kde(spark: SparkSession, sf: str) -> DataFrame:
    """Density of the logged value by class."""
    rows = scored(spark, sf).withColumn("logged", F.log1p("score"))
    return rounded(rounded(kernel_density(rows, "logged", "y"), ["x"], 6), ["density"], 7)


@query("""SELECT 'l_extendedprice' AS "column", p AS probability, (SELECT count(l_extendedprice) FROM lineitem) AS n, TRUE AS close
FROM (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS p)""")
def merged_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches stored per return flag and merged: is the exact rank of each sketched quantile within three times the stated error?"""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    stored = durable(quantile_sketches(rows, ["l_extendedprice"], ["l_returnflag"]))
    merged = merge_sketches(stored)
    found = broadcast_if_small(sketched_quantiles(merged, [0.01, 0.25, 0.5, 0.75, 0.99]).join(merged.select("column", "n"), "column"))
    x, q = F.col("l_extendedprice"), F.col("value")
    ranks = rows.crossJoin(found).groupBy("column", "probability", "n").agg(F.avg((x < q).cast("double")).alias("low"), F.avg((x <= q).cast("double")).alias("high"))
    slack = 3 * rank_error()
    return ranks.select("column", "probability", "n", ((F.col("low") - slack <= F.col("probability")) & (F.col("probability") <= F.col("high") + slack)).alias("close"))


@query("SELECT round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events")
def percentile99(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.agg(F.round(F.lit(percentile(rows, "value", 0.99)), 6).alias("p99"), F.count("*").alias("n"))


@query("""SELECT event_type, 'value' AS "column", 0.0::DOUBLE AS probability, round(quantile_cont(value, 0.0), 6) AS value FROM events GROUP BY 1
UNION ALL SELECT event_type, 'value', 0.1, round(quantile_cont(value, 0.1), 6) FROM events GROUP BY 1
UNION ALL SELECT event_type, 'value', 0.5, round(quantile_cont(value, 0.5), 6) FROM events GROUP BY 1
UNION ALL SELECT event_type, 'value', 0.99, round(quantile_cont(value, 0.99), 6) FROM events GROUP BY 1
UNION ALL SELECT event_type, 'value', 1.0, round(quantile_cont(value, 1.0), 6) FROM events GROUP BY 1""")
def quantiles_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rounded(exact_quantiles(rows, ["value"], [0.0, 0.1, 0.5, 0.99, 1.0], ["event_type"]), ["value"], 6)


@query("""SELECT 'o_totalprice' AS "column", round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 4) AS median,
round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders
UNION ALL SELECT 'o_custkey', round(avg(o_custkey), 3), round(median(o_custkey), 4), round(stddev_samp(o_custkey), 3),
min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE FROM orders""", name="column_statistics")
def column_statistics_query(spark: SparkSession, sf: str) -> DataFrame:
    found = column_statistics(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return rounded(rounded(found, ["mean", "std"], 3), ["median"], 4)


@query("""SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2, 3""")
def clean_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a missing cell dropped, then exact duplicates apart from the id."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("o_orderstatus"))
    return clean(rows, "o_orderkey")
