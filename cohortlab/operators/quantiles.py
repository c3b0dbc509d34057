"""Exact order statistics without gathering a group in one place.

A first scan makes one mergeable KLL sketch per (group, column). A sketch tells between which two values a quantile lies; a second
scan counts the values inside these probes one by one and those between probes together, in one aggregate with
map-side combine. Ranks are looked up in that small stored table: the sketch decides how much is counted, never the result. Where
the table has many rows, they are ranked by value ranges, cut at global quantiles, so that no window holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from cohortlab.session import broadcast_if_small, bucket_count, durable, release

SKETCH_K = 4096
ROWS_IN_ORDER = 1_000_000


def value_ranges(df: DataFrame, value: str, out: str = "_range") -> DataFrame:
    """Add the number of the value range; ``value`` must hold neither NULL nor NaN."""
    n = bucket_count(df.sparkSession)
    probabilities = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(value, probabilities, max(10_000, 10 * n))).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) + 0.0 for c in cuts if abs(c) != float("inf")}), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    # -0.0 and 0.0 are one value to a group, so they must be one value to the ranges too.
    one_zero = df.withColumn(value, F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col(value)))
    ranged = Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(one_zero)
    # Never NULL, so a later join on it adds no filter and both of its sides can share one shuffle.
    return ranged.withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(-1)))


def quantile_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """(by..., column, sketch, n): one mergeable KLL sketch of each group and column, from one scan.

    NULL and NaN values are skipped, rows with a NULL group key are left out. Stored sketches of parts of a table answer for
    the whole through :func:`merge_sketches`.
    """
    by = by or []
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    sketches = [F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(k)).alias(f"_s{i}") for i, x in enumerate(numbers)]
    grouped = _keyed(df, by).groupBy(*by).agg(*sketches)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return grouped.select(*by, F.inline(each)).withColumn("n", F.kll_sketch_get_n_double("sketch")).filter("n > 0")


def merge_sketches(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of the whole from those of its parts, as :func:`quantile_sketches` returns them."""
    merged = parts.groupBy(*(by or []), "column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def rank_error(k: int = SKETCH_K) -> float:
    """Share of a group's rows by which a sketch's rank is off at most, in 99 cases of 100 (fixed values of the sketch's authors)."""
    return 2.296 / k**0.9723


def sketched_quantiles(sketches: DataFrame, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., column, probability, value): quantiles as a sketch knows them, off by about :func:`rank_error` of the rows."""
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("probability"),
                         F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probabilities])).alias("value"))
    return sketches.select(*(by or []), "column", F.inline(pairs))


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    for key in by:
        df = df.filter(F.col(f"`{key}`").isNotNull())
    return df


def _reach(probabilities: list[float], spread: float) -> list[Column]:
    """Lower and upper value between which each quantile and its neighbours lie, by the sketch; open where ranks end or rows are few."""
    few = F.col("n") * spread <= 2

    def value(rank: float, end: str) -> Column:
        if not 0 < rank < 1:
            return F.lit(float(end))
        return F.when(few, float(end)).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(rank)))

    return [F.struct(value(p - 2 * spread, "-inf").alias("low"), value(p + 2 * spread, "inf").alias("high")) for p in probabilities]


def tally(df: DataFrame, columns: list[str], by: list[str], probes: DataFrame) -> DataFrame:
    """(by..., column, value, top, n, inside): values inside a probe are counted one by one, those between probes together.

    ``probes`` has (by..., column, probes array of low and high). ``value`` and ``top`` are the least and greatest value of a row; the
    rows of a group lie in order and don't overlap. One scan, one aggregate with map-side combine.
    """
    size = len(probes.select("probes").first()["probes"])
    ends = [(f"low{j}", f"high{j}") for j in range(size)]
    flat = F.struct(*[F.col("probes")[j][end].alias(f"{end}{j}") for j in range(size) for end in ("low", "high")])
    wide = probes.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, flat)).alias(f"_p{i}") for i, c in enumerate(columns)])
    wide = broadcast_if_small(wide.select(*[F.col(f"`{k}`").alias(f"_by{i}") for i, k in enumerate(by)], *[f"_p{i}" for i in range(len(columns))]))
    rows = _keyed(df, by).select(*[F.col(f"`{k}`") for k in by], *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    same = [F.col(f"`{k}`") == F.col(f"_by{i}") for i, k in enumerate(by)]
    joined = rows.join(wide, same) if by else rows.crossJoin(F.broadcast(wide))
    # A cell takes its probes along, so they are compared once after the cells are laid out: comparing them column by column makes
    # one method of all columns, too long for the JVM to compile.
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("_v"), F.col(f"_p{i}").alias("_p")) for i, c in enumerate(columns)]
    tall = joined.select(*[F.col(f"`{k}`") for k in by], F.inline(F.array(*cells))).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    v, p = F.col("_v"), F.col("_p")
    place = sum(((v >= p[low]).cast("int") + (v > p[high]).cast("int") for low, high in ends), F.lit(0))
    inside = reduce(lambda a, b: a | b, [(v >= p[low]) & (v <= p[high]) for low, high in ends])
    tall = tall.select(*[F.col(f"`{k}`") for k in by], "column", "_v", place.alias("_place"), inside.alias("inside"))
    tall = tall.withColumn("_kept", F.when(F.col("inside"), F.col("_v")))
    counted = tall.groupBy(*by, "column", "_place", "inside", "_kept").agg(F.min("_v").alias("value"), F.max("_v").alias("top"), F.count("*").alias("n"))
    return counted.drop("_place", "_kept")


def _ranked(tallied: DataFrame, keys: list[str], probabilities: list[float], ranged: bool) -> DataFrame:
    """(keys..., probability, value, sure) from tallied rows: running totals, by value ranges first where there are many rows."""
    if ranged:
        rows = value_ranges(tallied, "value")
        upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        bases = rows.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
        bases = bases.withColumn("_base", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
        line = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_end", F.sum("n").over(line)).join(bases.drop("_n"), [*keys, "_range"]).withColumn("_end", F.col("_base") + F.col("_end"))
    else:
        group = Window.partitionBy(*keys)
        line = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = tallied.withColumn("_end", F.sum("n").over(line)).withColumn("_all", F.sum("n").over(group))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    ranks = rows.select(*keys, "value", "top", "inside", "n", "_end", "_all", wanted.alias("probability")).withColumn("_at", F.col("probability") * (F.col("_all") - 1))
    holds = lambda rank: (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("n"))
    low, high = holds(F.floor("_at")), holds(F.ceil("_at"))
    # A row between probes is as good as a counted one if all its values are equal.
    sure = F.col("inside") | (F.col("value") == F.col("top"))
    ends = ranks.filter(low | high).groupBy(*keys, "probability").agg(
        F.max(F.when(low, F.col("value"))).alias("_low"), F.max(F.when(high, F.col("value"))).alias("_high"),
        F.max(F.col("_at") - F.floor("_at")).alias("_part"), F.every(sure).alias("sure"))
    return ends.select(*keys, "probability", (F.col("_low") + F.when(F.col("_part") > 0, (F.col("_high") - F.col("_low")) * F.col("_part")).otherwise(0.0)).alias("value"), "sure")


def _probed(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str], fences: bool) -> tuple[DataFrame, DataFrame]:
    """Stored (quantiles, tally) of a table read twice: for the sketches, then for the counts inside what they leave open.

    A sketch that was off by more than its probes reach shows as a rank outside them; the probes are then widened.
    """
    keys = [*by, "column"]
    sketches = durable(quantile_sketches(df, columns, by))
    spread = 4 * rank_error()
    while True:
        probes = _reach(probabilities, spread)
        if fences:
            lower, upper = probes[0], probes[-1]
            wide = lambda a, b: 1.5 * (a - b)
            probes += [
                F.struct((lower["low"] - wide(upper["high"], lower["low"])).alias("low"), (lower["high"] - wide(upper["low"], lower["high"])).alias("high")),
                F.struct((upper["low"] + wide(upper["low"], lower["high"])).alias("low"), (upper["high"] + wide(upper["high"], lower["low"])).alias("high"))]
        open_probes = sketches.select(*keys, F.array(*probes).alias("probes"))
        if open_probes.isEmpty():
            schema = tally_schema(df, by)
            empty = df.sparkSession.createDataFrame([], schema)
            return _ranked(empty, keys, probabilities, False), empty
        tallied = durable(tally(df, columns, by, open_probes))
        found = durable(_ranked(tallied, keys, probabilities, tallied.count() > ROWS_IN_ORDER))
        if spread >= 1 or found.filter(~F.col("sure")).isEmpty():
            release(sketches)
            return found, tallied
        release(tallied)
        release(found)
        spread = min(1.0, 16 * spread)


def tally_schema(df: DataFrame, by: list[str]) -> StructType:
    """Schema of :func:`tally`."""
    keys = [StructField(k, df.select(F.col(f"`{k}`")).schema[0].dataType) for k in by]
    return StructType([*keys, StructField("column", StringType()), StructField("value", DoubleType()), StructField("top", DoubleType()),
                       StructField("n", LongType()), StructField("inside", BooleanType())])


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None
) -> DataFrame:
    """Linear-interpolation quantiles: one row per (by..., column, probability).

    NULL and NaN values are skipped, rows with a NULL group key are left out. ``df`` is read twice.
    """
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must lie in [0, 1]")
    found, _ = _probed(df, columns, sorted(set(probabilities)), by or [], False)
    return found.drop("sure")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of whole columns as plain numbers (one per column)."""
    found = {r["column"]: r["value"] for r in exact_quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(c) for c in columns}


def box_statistics(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Quartiles and whiskers per (class, feature); whiskers end at data within 1.5 IQR of the box. ``df`` is read twice."""
    tall, tallied = _probed(df, columns, [0.25, 0.5, 0.75], [by], True)
    quartiles = tall.groupBy(by, "column").agg(
        *[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    reach = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    floor = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    ends = tallied.join(broadcast_if_small(quartiles), [by, "column"]).groupBy(by, "column", "q1", "median", "q3").agg(
        F.min(F.when(F.col("value") >= floor, F.col("value"))).alias("_low"),
        F.max(F.when(F.col("top") <= reach, F.col("top"))).alias("_high"),
    )
    return ends.select(
        by, F.col("column").alias("feature"), "q1", "median", "q3",
        F.least("_low", "q1").alias("whisker_low"), F.greatest("_high", "q3").alias("whisker_high"),
    )
