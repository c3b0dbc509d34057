"""Regression and scorer queries.

Scorers read the embeddings (label 1 for cluster 0). Regressions with a closed form have SQL; the
stochastic fits have none and are held to invariants in the tests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.models.autoencoder import ReconstructionScorer, fit_autoencoder, fit_variational, latent_projection
from cohortlab.models.evaluate import cross_validate_linear, null_counts, regression_metrics, train_and_evaluate
from cohortlab.models.features import unsupervised_data
from cohortlab.models.linear import LinearModel, fit_linear
from cohortlab.models.oneclass import fit_oneclass
from cohortlab.models.stack import fit_stacked, out_of_fold_scores
from cohortlab.models.supervised import fit_boosted, fit_forest, fit_forest_regression, fit_logistic
from cohortlab.operators.distribution import feature_error_by_class
from cohortlab.operators.split import train_test
from cohortlab.plans.anomaly import AnomalySettings, run
from cohortlab.queries.registry import query, rounded, table
from cohortlab.session import durable

ID = "vec_id"
CONVERGED = {"rate": 0.2, "iterations": 400, "tolerance": 0.0}


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    y = (F.col("label") == 0).cast("int")
    return table(spark, sf, "embeddings").select(ID, F.col("embedding").cast("array<double>").alias("features"), y.alias("y"))


def split_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train, test = train_test(vectors(spark, sf), ID, 0.2, "y")
    return durable(train), test


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", "l_returnflag")


def _line_model(spark: SparkSession, sf: str) -> LinearModel:
    return fit_linear(lines(spark, sf), ["l_quantity", "l_discount"], "l_extendedprice", **CONVERGED)


PLANE_SQL = """m AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS d,
  covar_pop(l_quantity, l_extendedprice) AS e, covar_pop(l_discount, l_extendedprice) AS f,
  avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my FROM lineitem),
w AS (SELECT (e * d - f * b) / (a * d - b * b) AS wq, (f * a - e * b) / (a * d - b * b) AS wd, * FROM m),
model AS (SELECT wq, wd, my - wq * mq - wd * md AS w0 FROM w)"""


@query(f"""WITH {PLANE_SQL} SELECT 'intercept' AS term, round(w0, 4) AS coefficient FROM model
UNION ALL SELECT 'l_quantity', round(wq, 4) FROM model UNION ALL SELECT 'l_discount', round(wd, 4) FROM model""")
def gd_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient descent run to convergence equals the least-squares plane."""
    return rounded(_line_model(spark, sf).coefficient_table(lines(spark, sf)), ["coefficient"], 4)


@query("""WITH RECURSIVE g AS (SELECT corr(l_quantity, l_discount) AS r, corr(l_quantity, l_extendedprice) AS c1,
  corr(l_discount, l_extendedprice) AS c2 FROM lineitem),
step(iteration, w1, w2, cost, prev) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 'Infinity'::DOUBLE
  UNION ALL
  SELECT iteration + 1, n1, n2, 1 - 2 * (n1 * c1 + n2 * c2) + n1 * n1 + 2 * r * n1 * n2 + n2 * n2, cost FROM (
    SELECT *, w1 - 0.02 * (w1 + r * w2 - c1) AS n1, w2 - 0.02 * (r * w1 + w2 - c2) AS n2 FROM step, g
    WHERE abs(prev - cost) >= 1e-6 AND iteration < 999))
SELECT CAST(iteration AS INTEGER) AS iteration, round(cost, 9) AS cost FROM step""")
def gd_history(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of every iteration with the default step, limit and tolerance."""
    model = fit_linear(lines(spark, sf), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(model.history_table(lines(spark, sf)), ["cost"], 9)


@query(f"""WITH {PLANE_SQL} SELECT l_quantity, l_discount, round(w0 + wq * l_quantity + wd * l_discount, 3) AS prediction, count(*) AS n
FROM lineitem, model WHERE l_returnflag = 'R' GROUP BY 1, 2, 3""")
def gd_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction for one cohort."""
    found = rounded(_line_model(spark, sf).predict_cohort(lines(spark, sf), "R", "l_returnflag"), ["prediction"], 3)
    return found.groupBy("l_quantity", "l_discount", "prediction").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_returnflag, l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)
SELECT l_returnflag, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 7) AS r2, round(avg(abs(y - p)), 4) AS mae,
round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs((y - p) / (y + 1e-10))) * 100, 5) AS mape FROM p GROUP BY 1""")
def reg_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).withColumn("prediction", F.col("l_quantity") * 1500)
    found = regression_metrics(rows, "l_extendedprice", "prediction", "l_returnflag")
    return rounded(rounded(rounded(found, ["r2"], 7), ["mae", "rmse"], 4), ["mape"], 5)


@query("""SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS price, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS key, 0 AS o_custkey FROM orders""")
def input_check(spark: SparkSession, sf: str) -> DataFrame:
    """Missing cells (NULL or NaN) that would stop a fit."""
    rows = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"), "o_custkey",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(float("nan"))).otherwise(F.col("o_orderkey").cast("double")).alias("key"))
    return null_counts(rows, ["price", "key", "o_custkey"])


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a target that depends on the key and the value."""
    key = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return table(spark, sf, "events").select("event_id", key.alias("k"), (F.col("value") + 2 * key).alias("t"))


PAIRS_SQL = """x AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
value + 2 * CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS t FROM events)"""


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT *, CAST(ntile(5) OVER (ORDER BY md5('42|' || event_id), event_id) - 1 AS INTEGER) AS fold FROM x),
m AS (SELECT g.fold, regr_slope(f.t, f.k) AS s, regr_intercept(f.t, f.k) AS i FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY 1),
p AS (SELECT f.fold, t, i + s * k AS p FROM f JOIN m USING (fold))
SELECT fold, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 7) AS r2, round(avg(abs(t - p)), 6) AS mae,
round(sqrt(avg((t - p) * (t - p))), 6) AS rmse FROM p GROUP BY 1""")
def cv_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds, fitted from one scan of moments."""
    found = cross_validate_linear(pairs(spark, sf), "event_id", ["k"], "t", 5, **CONVERGED)
    return rounded(rounded(found, ["r2"], 7), ["mae", "rmse"], 6)


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42|' || event_id), event_id)
  <= ceil(round((SELECT count(*) FROM x) * 0.2, 9)) THEN 'test' ELSE 'train' END AS part FROM x),
m AS (SELECT regr_slope(t, k) AS s, regr_intercept(t, k) AS i FROM f WHERE part = 'train'),
p AS (SELECT part, t, i + s * k AS p FROM f, m)
SELECT part, count(*) AS n, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 7) AS r2, round(avg(abs(t - p)), 6) AS mae,
round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(avg(abs((t - p) / (t + 1e-10))) * 100, 4) AS mape FROM p GROUP BY 1""")
def train_eval(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = train_and_evaluate(
        pairs(spark, sf), "event_id", ["k"], "t", lambda d, x, y: fit_linear(d, x, y, **CONVERGED))
    return rounded(rounded(rounded(found, ["r2"], 7), ["mae", "rmse"], 6), ["mape"], 4)


@query()
def rf_reg_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf)
    return fit_forest_regression(rows, ["l_quantity", "l_discount"], "l_extendedprice").importances(rows)


@query()
def rf_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split_vectors(spark, sf)
    return fit_forest(train, "y").score(test).select(ID, "y", "score")


@query()
def lr_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split_vectors(spark, sf)
    return fit_logistic(train, "y").score(test).select(ID, "y", "score")


@query()
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split_vectors(spark, sf)
    return fit_boosted(train, "y").score(test).select(ID, "y", "score")


SPLIT_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _candidates(rows: str, key: str) -> str:
    """SQL for the best split of each ``key`` of ``rows`` (key, f, v, g, h): every value of every feature is tried."""
    return f"""SELECT {key}, f, v, gl, hl, gt, ht, gain FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, f, v) AS place FROM (
  SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM (
    SELECT {key}, f, v, sum(g) OVER (PARTITION BY {key}, f ORDER BY v) AS gl, sum(h) OVER (PARTITION BY {key}, f ORDER BY v) AS hl,
      sum(g) OVER (PARTITION BY {key}, f) AS gt, sum(h) OVER (PARTITION BY {key}, f) AS ht
    FROM (SELECT {key}, f, v, sum(g) AS g, sum(h) AS h FROM {rows} GROUP BY 1, 2, 3)) WHERE hl >= 1 AND ht - hl >= 1)) WHERE place = 1"""


LONG_SQL = """t AS (SELECT row_number() OVER () AS id, l_quantity, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
u AS (SELECT id, y, unnest([0, 1, 2]) AS f, unnest([l_quantity, l_discount, l_tax]) AS v FROM t)"""
NAMES_SQL = "['l_quantity', 'l_discount', 'l_tax'][f + 1]"


def _first_tree(spark: SparkSession, sf: str, rounds: int, depth: int) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.array(*[F.col(c).cast("double") for c in SPLIT_FEATURES]).alias("features"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    model = fit_boosted(rows, "y", rounds=rounds, depth=depth, rows_share=1.0, column_share=1.0, weight=1.0)
    return rounded(rounded(model.split_table(rows, SPLIT_FEATURES), ["gain"], 4), ["value"], 7)


@query(f"""WITH {LONG_SQL}, r AS (SELECT *, 0 AS node, 0.5 - y AS g, 0.25 AS h FROM u), a AS ({_candidates("r", "node")}),
w AS (SELECT u.id, CASE WHEN u.v <= a.v THEN 1 ELSE 2 END AS node FROM u JOIN a ON u.f = a.f),
r2 AS (SELECT r.id, r.f, r.v, r.g, r.h, w.node FROM r JOIN w USING (id)), b AS ({_candidates("r2", "node")}),
n AS (SELECT DISTINCT node FROM b)
SELECT 0 AS tree, node::INTEGER AS node, {NAMES_SQL} AS feature, v::DOUBLE AS cut, round(gain, 4) AS gain, NULL::DOUBLE AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
UNION ALL SELECT 0, (2 * node + 1)::INTEGER, NULL, NULL, NULL, round(-0.1 * gl / (hl + 1), 7) FROM b
UNION ALL SELECT 0, (2 * node + 2)::INTEGER, NULL, NULL, NULL, round(-0.1 * (gt - gl) / (ht - hl + 1), 7) FROM b""")
def gbt_depth_two(spark: SparkSession, sf: str) -> DataFrame:
    """One tree of two levels: splits, gains and leaf weights against every possible split."""
    return _first_tree(spark, sf, 1, 2)


@query(f"""WITH {LONG_SQL}, r AS (SELECT *, 0 AS tree, 0.5 - y AS g, 0.25 AS h FROM u), a AS ({_candidates("r", "tree")}),
m AS (SELECT u.id, CASE WHEN u.v <= a.v THEN -0.1 * gl / (hl + 1) ELSE -0.1 * (gt - gl) / (ht - hl + 1) END AS margin FROM u JOIN a ON u.f = a.f),
r2 AS (SELECT 1 AS tree, f, v, 1 / (1 + exp(-margin)) - y AS g, 1 / (1 + exp(-margin)) * (1 - 1 / (1 + exp(-margin))) AS h FROM u JOIN m USING (id)),
b AS (SELECT * FROM a UNION ALL {_candidates("r2", "tree")})
SELECT tree::INTEGER AS tree, 0 AS node, {NAMES_SQL} AS feature, v::DOUBLE AS cut, round(gain, 4) AS gain, NULL::DOUBLE AS value FROM b
UNION ALL SELECT tree::INTEGER, 1, NULL, NULL, NULL, round(-0.1 * gl / (hl + 1), 7) FROM b
UNION ALL SELECT tree::INTEGER, 2, NULL, NULL, NULL, round(-0.1 * (gt - gl) / (ht - hl + 1), 7) FROM b""")
def gbt_two_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two trees of one level: the second is grown on the gradients and hessians that the first leaves."""
    return _first_tree(spark, sf, 2, 1)


@query()
def oof_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = split_vectors(spark, sf)
    fits = {"rf": fit_forest, "lr": fit_logistic}
    return out_of_fold_scores(train, ID, "y", fits).select(ID, "y", "rf", "lr")


@dataclass(frozen=True)
class ShareScorer:
    """Scores every row by the share of ones and the number of rows it was fitted on."""

    share: float
    rows: int

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, F.lit(self.share) if out == "share" else F.lit(self.rows).cast("double"))


def _fit_share(df: DataFrame, label: str) -> ShareScorer:
    row = df.agg(F.avg(label).alias("share"), F.count("*").alias("n")).first()
    return ShareScorer(row["share"], row["n"])


@query("""WITH r AS (SELECT vec_id, CAST(label = 0 AS INTEGER) AS y FROM embeddings),
k AS (SELECT *, ntile(3) OVER (PARTITION BY y ORDER BY md5('42|' || vec_id), vec_id) AS fold FROM r)
SELECT a.vec_id, a.y, round(avg(b.y), 9) AS share, count(*)::DOUBLE AS rows FROM k a JOIN k b ON a.fold <> b.fold GROUP BY 1, 2""")
def oof_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold coverage: every row is scored once, by what the other folds hold."""
    found = out_of_fold_scores(vectors(spark, sf), ID, "y", {"share": _fit_share, "rows": _fit_share})
    return rounded(found.select(ID, "y", "share", "rows"), ["share"], 9)


@query()
def stacked_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores train the ensemble; full-model scores feed it on the test part."""
    train, test = split_vectors(spark, sf)
    stacking = durable(out_of_fold_scores(train, ID, "y", {"lr": fit_logistic}))
    scored = fit_logistic(train, "y").score(test, "lr")
    return fit_stacked(stacking, "y", ["lr"]).score(scored, "score").select(ID, "y", "lr", "score")


def _plain(spark: SparkSession, sf: str) -> tuple[ReconstructionScorer, DataFrame]:
    train, test = split_vectors(spark, sf)
    return fit_autoencoder(unsupervised_data(train, ID, "y"), ID), test


def _variational(spark: SparkSession, sf: str) -> tuple[ReconstructionScorer, DataFrame]:
    train, test = split_vectors(spark, sf)
    return fit_variational(unsupervised_data(train, ID, "y"), ID), test


@query()
def ae_scores(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _plain(spark, sf)
    return model.score(test).select(ID, "y", "score")


@query()
def vae_scores(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _variational(spark, sf)
    return model.score(test).select(ID, "y", "score")


@query()
def ae_history(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _plain(spark, sf)
    return model.history_table(test)


@query()
def feature_error(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _plain(spark, sf)
    return feature_error_by_class(model.feature_errors(test), "errors", [f"e{i}" for i in range(64)], "y")


@query()
def latent_pca(spark: SparkSession, sf: str) -> DataFrame:
    model, test = _variational(spark, sf)
    return latent_projection(model, test, ID, "y")


@query()
def ocsvm_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split_vectors(spark, sf)
    return fit_oneclass(unsupervised_data(train, ID, "y"), ID, nu=0.05).score(test).select(ID, "y", "score")


@query()
def anomaly_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The whole anomaly job on order lines: all eight scorers, one metric row each."""
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lineitem = table(spark, sf, "lineitem")
    rows = lineitem.groupBy("l_orderkey").agg(
        *[F.avg(c).alias(c) for c in features], (F.count_if(F.col("l_returnflag") == "R") >= 4).cast("int").alias("y"))
    return run(rows, "l_orderkey", features, "y").metrics
