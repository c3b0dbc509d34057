"""Exact seeded splits, folds and samples by hash order.

Rows are ordered by md5(seed | id). The k-th smallest hash of a stratum is found by counting rows
per (stratum, hash prefix) and ranking only inside the prefix that holds it; the split itself is a
comparison with that hash, so the full table is never shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import broadcast_if_small


def hash_order(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def _keyed(df: DataFrame, row_id: str, stratum: str | None, seed: int) -> DataFrame:
    group = F.col(stratum) if stratum else F.lit(0)
    return df.select(group.alias("_group"), F.col(row_id).alias("_id"), hash_order(row_id, seed).alias("_hash"))


def _prefix() -> Column:
    return F.substring("_hash", 1, 4)


def _hash_at_rank(keyed: DataFrame, ranks: DataFrame) -> DataFrame:
    """(group, slot, cut) with the (hash, id) of each wanted 1-based rank; rank 0 gives no row."""
    counts = keyed.groupBy("_group", _prefix().alias("_prefix")).agg(F.count("*").alias("_n"))
    # At most 65,536 prefixes per stratum.
    upto = Window.partitionBy("_group").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_end", F.sum("_n").over(upto))
    wanted = placed.join(ranks, "_group").filter(
        (F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_n"))
    )
    wanted = wanted.select("_group", "_slot", "_prefix", (F.col("_rank") - F.col("_end") + F.col("_n")).alias("_local"))
    wanted = broadcast_if_small(wanted)
    inside = Window.partitionBy("_group", "_prefix").orderBy("_hash", "_id")
    held = keyed.withColumn("_prefix", _prefix()).join(
        wanted.select("_group", "_prefix").distinct(), ["_group", "_prefix"], "left_semi"
    )
    ranked = held.withColumn("_place", F.row_number().over(inside))
    hits = ranked.join(wanted, ["_group", "_prefix"]).filter("_place = _local")
    return hits.select("_group", "_slot", F.struct("_hash", "_id").alias("_cut"))


def test_quota(df: DataFrame, stratum: str | None, test_size: float) -> DataFrame:
    """(group, rank): test rows per stratum, ceil(test_size · n) in all, shared by largest remainder."""
    group = F.col(stratum) if stratum else F.lit(0)
    counts = df.groupBy(group.alias("_group")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    size = F.ceil(F.round(total * F.lit(test_size), 9))
    share = F.col("_n") * size / total
    quota = counts.select("_group", F.floor(share).alias("_base"), (share - F.floor(share)).alias("_rest"))
    # One row per stratum.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_rest").desc(), F.col("_group"))
    spare = size - F.sum("_base").over(Window.partitionBy(F.lit(0)))
    extra = F.when(F.row_number().over(order) <= spare, 1).otherwise(0)
    return quota.select("_group", (F.col("_base") + extra).cast("long").alias("_rank"))


test_quota.__test__ = False  # not a test case


def split_rows(
    df: DataFrame, row_id: str, test_size: float = 0.2, stratum: str | None = None, seed: int = 42, out: str = "is_test"
) -> DataFrame:
    """Add a boolean test flag: exact size, class shares kept, the same rows on any cluster."""
    keyed = _keyed(df, row_id, stratum, seed)
    ranks = test_quota(df, stratum, test_size).withColumn("_slot", F.lit(0))
    cuts = broadcast_if_small(_hash_at_rank(keyed, ranks).drop("_slot"))
    group = F.col(stratum) if stratum else F.lit(0)
    here = F.struct(hash_order(row_id, seed).alias("_hash"), F.col(row_id).alias("_id"))
    joined = df.join(cuts, group.eqNullSafe(F.col("_group")), "left")
    return joined.withColumn(out, F.coalesce(here <= F.col("_cut"), F.lit(False))).drop("_group", "_cut")


def train_test(
    df: DataFrame, row_id: str, test_size: float = 0.2, stratum: str | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    flagged = split_rows(df, row_id, test_size, stratum, seed)
    return flagged.filter("not is_test").drop("is_test"), flagged.filter("is_test").drop("is_test")


def assign_folds(
    df: DataFrame, row_id: str, k: int = 5, stratum: str | None = None, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1: consecutive blocks of the hash order, the first n mod k one row longer."""
    keyed = _keyed(df, row_id, stratum, seed)
    counts = keyed.groupBy("_group").agg(F.count("*").alias("_n"))
    ends = counts.select("_group", "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 2))).alias("_slot"))
    block = F.floor(F.col("_n") / k)
    longer = F.least(F.col("_slot") + 1, F.col("_n") % k)
    ranks = ends.select("_group", "_slot", ((F.col("_slot") + 1) * block + longer).alias("_rank"))
    cuts = _hash_at_rank(keyed, ranks.filter("_rank > 0"))
    # At most k - 1 cuts per stratum.
    cuts = cuts.groupBy("_group").agg(F.collect_list("_cut").alias("_cuts"))
    cuts = broadcast_if_small(cuts)
    group = F.col(stratum) if stratum else F.lit(0)
    here = F.struct(hash_order(row_id, seed).alias("_hash"), F.col(row_id).alias("_id"))
    joined = df.withColumn("_here", here).join(cuts, group.eqNullSafe(F.col("_group")), "left")
    passed = F.size(F.filter("_cuts", lambda c: c < F.col("_here")))
    fold = F.when(F.col("_cuts").isNull(), 0).otherwise(passed).cast("int")
    return joined.withColumn(out, fold).drop("_group", "_cuts", "_here")


def fixed_sample(df: DataFrame, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows (or all, if there are fewer), the first in hash order."""
    keyed = _keyed(df, row_id, None, seed)
    n = keyed.groupBy("_group").agg(F.count("*").alias("_n"))
    ranks = n.select("_group", F.least(F.col("_n"), F.lit(size)).alias("_rank"), F.lit(0).alias("_slot"))
    found = _hash_at_rank(keyed, ranks).first()
    if found is None:
        return df.limit(0)
    own = hash_order(row_id, seed)
    last_hash, last_id = F.lit(found["_cut"]["_hash"]), F.lit(found["_cut"]["_id"])
    return df.filter((own < last_hash) | ((own == last_hash) & (F.col(row_id) <= last_id)))


def sample_keeping(df: DataFrame, row_id: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` label-0 rows and every label-1 row."""
    return fixed_sample(df.filter(F.col(label) == 0), row_id, size, seed).unionByName(df.filter(F.col(label) == 1))
