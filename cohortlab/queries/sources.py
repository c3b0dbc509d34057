"""Scans and sinks: files are written from the tables under the checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.queries.registry import new_path, order_year, order_years, query, rounded, table
from cohortlab.sources.io import optional_source, save_table, scan_transactions
from cohortlab.sources.statistics import load_statistics, scan_delimited
from cohortlab.sources.welfare import load_welfare

FILES = 4
WELFARE_SQL = """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderstatus WHEN 'F' THEN 'Sweden' WHEN 'O' THEN 'Foreign Born (Total)' ELSE 'Other' END
AS birth_region_standardized, round(avg(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE floor(o_totalprice) END), 4) AS welfare_amount_avg
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2"""


def write_titled(rows: DataFrame, id_column: str, years: list[int], title: bool, reverse: bool, path: str) -> None:
    """Stand-in input: ``FILES`` wide files of ``;`` lines, each with an optional title line, its header, its rows and a footer."""
    columns = [id_column, *map(str, years)]
    columns = columns[::-1] if reverse else columns
    line = F.concat_ws(";", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    body = rows.select(F.pmod(F.xxhash64("key"), F.lit(FILES)).cast("int").alias("file"), F.lit(2).alias("place"), line.alias("value"))
    fixed = [(1, ";".join(columns)), (3, "Source: welfare statistics")] + ([(0, "Amounts by year, kronor")] if title else [])
    frame = rows.sparkSession.createDataFrame([(f, p, v) for f in range(FILES) for p, v in fixed], "file int, place int, value string")
    body.unionByName(frame).repartitionById(FILES, "file").sortWithinPartitions("place").select("value").write.mode("append").text(path)


def titled_files(spark: SparkSession, sf: str) -> str:
    """A folder of files in two layouts: the earlier years with a title line, the later ones without and in reverse order."""
    orders = table(spark, sf, "orders").withColumn("year", order_year()).where("year is not null")
    years, path = order_years(orders), new_path(spark, "titled")
    born = F.when(F.col("o_orderstatus") == "F", "Inrikes födda").when(F.col("o_orderstatus") == "O", "Utrikes födda").otherwise("Okänt")
    amount = F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.floor("o_totalprice").cast("string"))
    half = len(years) // 2
    for part, title in ((years[:half], True), (years[half:], False)):
        wide = orders.where(F.col("year").isin(part)).select(F.col("o_orderkey").alias("key"), born.alias("Född i"), *[F.when(F.col("year") == y, amount).alias(str(y)) for y in part])
        write_titled(wide, "Född i", part, title, not title, path)
    return path


@query(WELFARE_SQL)
def titled_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of wide files with different years, titles and column orders, read by name, melted, mapped and averaged."""
    return rounded(load_welfare(spark, titled_files(spark, sf)), ["welfare_amount_avg"], 4)


@query(f"""SELECT year, birth_region_standardized, welfare_amount_avg, 2 AS n_absent FROM ({WELFARE_SQL})""", name="optional_source")
def optional_source_query(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose path may be absent: those found are merged, the others left out."""
    folder = titled_files(spark, sf)
    found = [optional_source(spark, folder, load_welfare), optional_source(spark, folder + "-absent", load_welfare), optional_source(spark, folder + "-absent", load_statistics, "income")]
    there = [df for df in found if df is not None]
    return rounded(there[0], ["welfare_amount_avg"], 4).withColumn("n_absent", F.lit(len(found) - len(there)))


@query("""SELECT kind, count(*) AS n, sum(id)::BIGINT AS ids, count(amount) AS amounts, round(sum(amount), 2) AS total, count(DISTINCT label) AS labels FROM (
SELECT unnest(['csv', 'parquet']) AS kind, o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS amount, o_orderstatus AS label FROM orders) GROUP BY 1""")
def write_read(spark: SparkSession, sf: str) -> DataFrame:
    """Both sinks, overwritten once, read back with the explicit schema of labelled transactions."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).cast("double").alias("amount"), F.col("o_orderstatus").alias("label"))
    back = []
    for kind in ("csv", "parquet"):
        path = f"{new_path(spark, 'sink')}.{kind}"
        save_table(rows.limit(1), path, kind)
        save_table(rows, path, kind)
        back.append(scan_transactions(spark, path, "id long, amount double, label string").withColumn("kind", F.lit(kind)))
    totals = back[0].unionByName(back[1]).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("id").alias("ids"), F.count("amount").alias("amounts"), F.sum("amount").alias("total"), F.countDistinct("label").alias("labels"))
    return rounded(totals, ["total"], 2)


@query("""SELECT n_nationkey AS nation, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey END::DOUBLE AS even_region, CASE WHEN n_regionkey % 2 = 1 THEN n_regionkey END::DOUBLE AS odd_region FROM nation""")
def files_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of delimited files with different columns and column orders, each read by its own header."""
    nation, path = table(spark, sf, "nation"), new_path(spark, "named")
    even = nation.where("n_regionkey % 2 = 0").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("even_region"))
    odd = nation.where("n_regionkey % 2 = 1").select(F.col("n_regionkey").alias("odd_region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    for part in (even, odd):
        part.write.mode("append").csv(path, header=True)
    rows = scan_delimited(spark, path)
    return rows.select(F.col("nation").cast("int").alias("nation"), "name", F.col("even_region").cast("double").alias("even_region"), F.col("odd_region").cast("double").alias("odd_region"))
