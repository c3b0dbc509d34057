"""URL rules as a sort-merge range join over reversed hosts. DataFrame functions only.

A host's labels in reverse, each followed by a dot, make its key, so a rule's host and all its subdomains are the keys of
one interval that begins at the rule's key, and intervals are nested or apart. Each rule key carries the stack of the
rules that are open there: its own and those of its ancestors. A sweep over rule keys and distinct hosts, sorted together,
hands every host the stack of the last rule key before it; the rules whose interval already ended are popped, as
their key no longer begins the host's. A page then takes the longest rule left whose path begins its own.

Distinct hosts go through the sweep, so a hot host is one row there. Buckets follow the first two labels and a salt;
rules of one label are put in every bucket, longer ones in the salts of their own.

Cases: null urls and urls without ``://`` have an empty host and path; a rule with an empty host fits nothing; of equally
long rules ``block`` wins; a repeated rule or page stays as it is; without rules or pages every verdict is the default, or
there is no row; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _bucket(key: Column, salt: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.regexp_extract(key, r"^[^.]*\.[^.]*\.", 0), salt), F.lit(buckets)).cast("int")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``verdict, host, path`` rows of a list of rules."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule key with all rules open at it, its ancestors' included."""
    keyed = rules.where(F.length("host") > 0).select(
        reversed_key(F.col("host")).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "verdict")
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    ancestors = keyed.select("key").distinct().select(
        F.col("key").alias("at"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("key"))
    return ancestors.join(keyed, "key").groupBy(F.col("at").alias("key")).agg(F.collect_list(F.struct("key", "path", "rule", "verdict")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``)."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", reversed_key(F.col("host")))
    buckets = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * SALTS
    hosts = seen.select("key").distinct().select(
        "key", _bucket(F.col("key"), F.pmod(F.xxhash64("key"), F.lit(SALTS)), buckets).alias("bucket"), F.lit(1).alias("kind"))
    stacks = _stacks(rules)
    short = F.length(F.regexp_extract("key", r"^[^.]*\.[^.]*\.", 0)) == 0
    everywhere = stacks.where(short).select("key", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "stack")
    own = stacks.where(~short).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "stack")
    own = own.select("key", _bucket(F.col("key"), F.col("salt"), buckets).alias("bucket"), "stack").distinct()
    starts = everywhere.unionByName(own).withColumn("kind", F.lit(0))
    line = hosts.unionByName(starts, allowMissingColumns=True)
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_rules = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]))
    held = line.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").select("key", open_rules.alias("stack"))
    joined = seen.join(held.where(F.size("stack") > 0), "key", "left")
    fitting = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("long"), F.length(r["key"]).alias("deep"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return joined.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
