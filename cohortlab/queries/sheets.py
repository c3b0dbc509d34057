"""Workbook queries on a cell table that Spark derives from customers and nations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.queries.registry import query, table
from cohortlab.session import durable
from cohortlab.sources.cells import base_name, file_year, harmonise_counts, header_rows, select_files, select_sheets

NAMES_SQL = """CASE n_regionkey WHEN 0 THEN 'asyl_avgjorda_' WHEN 1 THEN 'beviljade_arbet_' WHEN 2 THEN 'asyl_arbet-' ELSE 'ovrigt_' END
|| CAST(2000 + n_nationkey AS VARCHAR) || '.xlsx'"""
LABEL_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Syrien' WHEN 'BUILDING' THEN ' Chile ' WHEN 'FURNITURE' THEN 'Summa' WHEN 'MACHINERY' THEN 'Polen' ELSE 'Atlantis' END"


def _file() -> Column:
    region = F.col("n_regionkey")
    stem = (
        F.when(region == 0, "asyl_avgjorda_").when(region == 1, "beviljade_arbet_").when(region == 2, "asyl_arbet-").otherwise("ovrigt_")
    )
    return F.concat(F.lit("drop/"), stem, (F.col("n_nationkey") + 2000).cast("string"), F.lit(".xlsx"))


def _cell(sheet: str, sheet_pos: int, row: Column, col: int, value: Column) -> Column:
    return F.struct(
        F.lit(sheet).alias("sheet"), F.lit(sheet_pos).alias("sheet_pos"), row.cast("int").alias("row_idx"),
        F.lit(col).alias("col_idx"), value.alias("value"))


def workbook_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook per nation: an information sheet, a nationality sheet with a title row above the
    header, and in some a preferred nationality sheet. Each customer is a row."""
    nations = table(spark, sf, "nation").withColumn("path", _file())
    zero, one = F.lit(0), F.lit(1)
    main, preferred = "Medborgarskap", "Medborgarskap första"
    heads = [
        _cell("Info", 0, zero, 0, F.lit("notes")), _cell(main, 1, zero, 0, F.lit("Medborgarskap")),
        _cell(main, 1, one, 0, F.lit(" Medborgarskap ")), _cell(main, 1, one, 1, F.lit("Kön")), _cell(main, 1, one, 2, F.lit("Totalt")),
        _cell(preferred, 2, zero, 0, F.lit("Nationality list")), _cell(preferred, 2, one, 0, F.lit("Medborgarskap")),
        _cell(preferred, 2, one, 1, F.lit("Kön")), _cell(preferred, 2, one, 2, F.lit("Totalt")),
    ]
    wanted = lambda c: (c["sheet"] != preferred) | (F.col("n_nationkey") < 12)
    top = nations.select("path", F.inline(F.filter(F.array(*heads), wanted)))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.col("c_mktsegment")
    label = (
        F.when(segment == "AUTOMOBILE", "Syrien").when(segment == "BUILDING", " Chile ").when(segment == "FURNITURE", "Summa")
        .when(segment == "MACHINERY", "Polen").otherwise("Atlantis")
    )
    whole = F.floor(F.abs("c_acctbal")).cast("string")
    count = F.when(F.col("c_acctbal") < 0, "-").otherwise(F.concat(F.substring(whole, 1, 1), F.lit(" "), F.substring(whole, 2, 20)))
    sheet = F.when(F.col("n_nationkey") < 12, preferred).otherwise(main)
    pos = F.when(F.col("n_nationkey") < 12, 2).otherwise(1)
    body = customers.select("path", sheet.alias("sheet"), pos.alias("sheet_pos"), (F.col("c_custkey") + 2).cast("int").alias("row_idx"),
        F.posexplode(F.array(label, F.lit("K"), count)).alias("col_idx", "value"))
    return top.unionByName(body)


def counts_sql(kind: str, region: int) -> str:
    return f"""SELECT CAST(2000 + n_nationkey AS INTEGER) AS year, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Asia' WHEN 'BUILDING' THEN 'South America'
ELSE 'EU/EFTA (excl. Nordic)' END AS birth_region_standardized,
CAST(sum(CASE WHEN c_acctbal < 0 THEN 0 ELSE floor(abs(c_acctbal)) END) AS DOUBLE) AS mv_{kind}_count
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN ({region}) AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
GROUP BY 1, 2"""


@query(counts_sql("asylum", "0, 2"))
def counts_asylum(spark: SparkSession, sf: str) -> DataFrame:
    """File choice, sheet choice, header detection, label mapping and sum in one job."""
    return harmonise_counts(durable(workbook_cells(spark, sf)), "asylum")


@query(counts_sql("permits", "1"))
def counts_permits(spark: SparkSession, sf: str) -> DataFrame:
    return harmonise_counts(durable(workbook_cells(spark, sf)), "permits")


CELLS_SQL = f"""n AS (SELECT *, {NAMES_SQL} AS file FROM nation),
c AS (SELECT file, count(*) AS customers FROM n JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"""


@query(f"""WITH {CELLS_SQL} SELECT file, 3 * coalesce(customers, 0) + CASE WHEN n_nationkey < 12 THEN 9 ELSE 5 END AS cells
FROM n LEFT JOIN c USING (file) WHERE n_regionkey = 1""")
def file_pattern(spark: SparkSession, sf: str) -> DataFrame:
    found = select_files(workbook_cells(spark, sf), "permits")
    return found.groupBy(base_name(F.col("path")).alias("file")).agg(F.count("*").alias("cells"))


@query(f"WITH {CELLS_SQL} SELECT file, CAST(2000 + n_nationkey AS INTEGER) AS year FROM n", name="file_year")
def file_year_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = workbook_cells(spark, sf).select("path").distinct()
    return rows.select(base_name(F.col("path")).alias("file"), file_year(F.col("path")).alias("year"))


@query(f"""WITH {CELLS_SQL} SELECT file, CASE WHEN n_nationkey < 12 THEN 'Medborgarskap första' ELSE 'Medborgarskap' END AS sheet,
3 * coalesce(customers, 0) + 4 AS cells FROM n LEFT JOIN c USING (file)""")
def sheet_pick(spark: SparkSession, sf: str) -> DataFrame:
    found = select_sheets(workbook_cells(spark, sf))
    return found.groupBy(base_name(F.col("path")).alias("file"), "sheet").agg(F.count("*").alias("cells"))


@query(f"""WITH {CELLS_SQL}, s AS (SELECT file, 'Info' AS sheet, 0 AS header_idx FROM n UNION ALL SELECT file, 'Medborgarskap', 1 FROM n
UNION ALL SELECT file, 'Medborgarskap första', 1 FROM n WHERE n_nationkey < 12) SELECT * FROM s""")
def header_detect(spark: SparkSession, sf: str) -> DataFrame:
    found = header_rows(workbook_cells(spark, sf))
    return found.select(base_name(F.col("path")).alias("file"), "sheet", "header_idx")
