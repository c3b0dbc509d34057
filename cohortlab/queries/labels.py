"""Projection, cleaning, label and reshape queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.labels import label_map, map_default, map_keep, map_rules
from cohortlab.functions.names import (
    drop_artefacts, find_column, find_count_column, rename_all, rename_last, statistics_name, welfare_name, workbook_name,
)
from cohortlab.functions.parsing import clean_missing, count_or_zero, tolerant_number, tolerant_year
from cohortlab.functions.predicates import drop_null_rows, drop_totals, keep_matching, years_between
from cohortlab.functions.scalars import mean_squared_error, predicted_label
from cohortlab.operators.measure import prefer_measure, preferred_group_mean
from cohortlab.operators.reshape import (
    distinct_values, drop_exact_duplicates, duplicate_count, melt_years, stack_columns, union_all,
)
from cohortlab.queries.registry import order_year, order_years, query, rounded, table
from cohortlab.sources.statistics import harmonise_statistics
from cohortlab.sources.welfare import harmonise_welfare

SEGMENTS = {"Automobile": "Vehicles", "BUILDING": "Construction", "machinery": "Industry"}
LANGUAGES = {"EN": "English", "fr": "French"}
TYPE_RULES = ((("eco", "promo"), "Budget"), (("stand", "promo", "large"), "Bulk"))


@query("""SELECT CASE lower(c_mktsegment) WHEN 'automobile' THEN 'Vehicles' WHEN 'building' THEN 'Construction'
WHEN 'machinery' THEN 'Industry' ELSE c_mktsegment END AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer GROUP BY 1""")
def label_map_keep(spark: SparkSession, sf: str) -> DataFrame:
    rows = map_keep(table(spark, sf, "customer"), "c_mktsegment", label_map(spark, SEGMENTS), "segment")
    return rounded(rows.groupBy("segment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")), ["balance"], 2)


@query("""SELECT CASE lower(trim(' ' || upper(lang) || ' ')) WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'Other' END AS language,
count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def label_map_default(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").withColumn("lang", F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")))
    rows = map_default(rows, "lang", label_map(spark, LANGUAGES), "language")
    return rows.groupBy("language").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT CASE WHEN lower(p_type) LIKE '%eco%' OR lower(p_type) LIKE '%promo%' THEN 'Budget'
WHEN lower(p_type) LIKE '%stand%' OR lower(p_type) LIKE '%promo%' OR lower(p_type) LIKE '%large%' THEN 'Bulk' ELSE 'Other' END AS kind,
count(*) AS n FROM part GROUP BY 1""")
def label_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("kind", map_rules(F.col("p_type"), TYPE_RULES, "Other"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT event_id, event_type, value FROM events
WHERE CASE WHEN (SELECT count(*) FROM events WHERE event_type ILIKE '%refund%') > 0 THEN event_type ILIKE '%refund%'
ELSE event_type ILIKE '%Sign%' OR event_type ILIKE '%view%' END""")
def measure_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """No row has the preferred measure, so the fallback rows are kept."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return prefer_measure(rows, "event_type", "refund", "Sign|view")


@query("SELECT event_id, event_type, value FROM events WHERE event_type ILIKE '%PURCHASE%'")
def measure_preferred(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return prefer_measure(rows, "event_type", "PURCHASE", "view")


@query("""SELECT user_id, round(avg(value), 5) AS value FROM events WHERE event_type ILIKE '%Sign%' OR event_type ILIKE '%view%' GROUP BY 1""")
def measure_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Choice of measure and group mean in one scan."""
    rows = table(spark, sf, "events")
    return rounded(preferred_group_mean(rows, ["user_id"], "value", "event_type", "refund", "Sign|view"), ["value"], 5)


RAW_TEXT_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN '..' WHEN '2-HIGH' THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' 00'
WHEN '3-MEDIUM' THEN 'n.a.' WHEN '5-LOW' THEN '-' ELSE CAST(o_orderkey AS VARCHAR) END"""


def _raw_text(spark: SparkSession, sf: str) -> DataFrame:
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", "..").when(priority == "2-HIGH", F.concat(F.lit(" "), key, F.lit(" 00")))
        .when(priority == "3-MEDIUM", "n.a.").when(priority == "5-LOW", "-").otherwise(key)
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("raw"))


@query(f"""SELECT o_orderkey, TRY_CAST(replace({RAW_TEXT_SQL}, ' ', '') AS DOUBLE) AS parsed,
coalesce(TRY_CAST(replace({RAW_TEXT_SQL}, ' ', '') AS DOUBLE), 0) AS counted,
CAST(TRY_CAST(replace({RAW_TEXT_SQL}, ' ', '') AS DOUBLE) AS INTEGER) AS year FROM orders""")
def parse_numeric(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    return _raw_text(spark, sf).select(
        "o_orderkey", tolerant_number(raw).alias("parsed"), count_or_zero(raw).alias("counted"),
        tolerant_year(F.regexp_replace(raw, " ", "")).alias("year"),
    )


@query(f"""SELECT count(*) AS n, count(nullif(nullif({RAW_TEXT_SQL}, '..'), '-')) AS present FROM orders""")
def missing_markers(spark: SparkSession, sf: str) -> DataFrame:
    return clean_missing(_raw_text(spark, sf)).agg(F.count("*").alias("n"), F.count("raw").alias("present"))


@query("SELECT p_type, count(*) AS n, min(p_retailprice) AS low FROM part WHERE p_name ILIKE '%RED%' OR p_name ILIKE '%small%' GROUP BY 1")
def regex_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = keep_matching(table(spark, sf, "part"), {"p_name": "RED|small", "no_such_column": "x"})
    return rows.groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"))


@query("""SELECT p_type, count(*) AS n FROM part WHERE nullif(p_brand, 'Brand#2') IS NOT NULL
AND lower(p_type) NOT IN ('promo', 'economy') GROUP BY 1""")
def anti_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_type", F.nullif("p_brand", F.lit("Brand#2")).alias("brand"))
    rows = drop_totals(drop_null_rows(rows, ["brand"]), "p_type", ["promo", "economy"])
    return rows.groupBy("p_type").agg(F.count("*").alias("n"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1""")
def year_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(order_year().alias("year"))
    return years_between(rows, 1996, 1998).groupBy("year").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS "order_status", o_orderpriority AS region_of_birth, count(*) AS n, round(sum(o_totalprice), 2) AS income
FROM orders GROUP BY 1, 2""")
def rename_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Awkward names normalised, artefact columns dropped, the last column renamed as the value."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias(' Order Status"'), F.col("o_orderpriority").alias("Region of Birth"),
        F.lit(1).alias("Unnamed: 3"), F.lit("x").alias("Other Region"), F.col("o_totalprice").alias("Value 1"),
    )
    rows = rename_last(drop_artefacts(rename_all(rows, statistics_name), "region_of_birth"), "income")
    status = find_column(rows.columns, ["status"])
    value = find_count_column(rows.columns, ["no such fragment"])
    found = rows.groupBy(status, "region_of_birth").agg(F.count("*").alias("n"), F.sum(value).alias(value))
    return rounded(found, [value], 2)


@query("""SELECT l_returnflag AS "return_flag", l_linestatus AS "line status", count(*) AS n FROM lineitem GROUP BY 1, 2""")
def rename_variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias(" Return-Flag"), F.col("l_linestatus").alias(" Line Status "))
    welfare = rename_all(rows.select(" Return-Flag"), welfare_name).columns[0]
    workbook = rename_all(rows.select(" Line Status "), workbook_name).columns[0]
    return rows.toDF(welfare, workbook).groupBy(welfare, workbook).agg(F.count("*").alias("n"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders WHERE o_orderdate IS NOT NULL), p AS (SELECT DISTINCT o_orderpriority FROM orders)
SELECT p.o_orderpriority, CAST(y.year AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total
FROM p CROSS JOIN y LEFT JOIN orders o ON o.o_orderpriority = p.o_orderpriority AND year(o.o_orderdate) = y.year GROUP BY 1, 2""",
    name="melt_years")
def melt_years_query(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderpriority", order_year().alias("year"), "o_totalprice")
    wide = orders.groupBy("o_orderpriority").pivot("year", order_years(orders)).agg(F.sum("o_totalprice"))
    return rounded(melt_years(wide, "total"), ["total"], 2)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return drop_exact_duplicates(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query("""SELECT coalesce(sum(c - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    name="duplicate_count")
def duplicate_count_query(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_count(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("""SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents) GROUP BY 1, 2""")
def dedupe_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct documents: digests decide which texts are shuffled at all."""
    rows = drop_exact_duplicates(table(spark, sf, "documents").select("text", "lang", "source", "n_chars"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT coalesce(sum(c - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang)")
def duplicate_count_wide(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_count(table(spark, sf, "documents").select("text", "lang"))


@query("SELECT DISTINCT source FROM documents", name="distinct_values")
def distinct_values_query(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(table(spark, sf, "documents"), "source")


@query("""SELECT nation, count(*) AS n, count(segment) AS with_segment, round(sum(balance), 2) AS balance FROM (
SELECT c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM customer
UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier) GROUP BY 1""")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    found = union_all([customers, suppliers]).groupBy("nation").agg(
        F.count("*").alias("n"), F.count("segment").alias("with_segment"), F.sum("balance").alias("balance"))
    return rounded(found, ["balance"], 2)


@query("SELECT event_id AS row_id, value AS s_value, CAST(user_id AS DOUBLE) AS s_user, event_type FROM events", name="stack_columns")
def stack_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumnRenamed("event_id", "row_id")
    parts = [events.select("row_id", F.col("user_id").cast("double").alias("s_user")), events.select("row_id", "event_type")]
    return stack_columns(events.select("row_id", F.col("value").alias("s_value")), parts)


@query("SELECT event_id, round(ln(1 + value), 8) AS log_value, CAST(value >= 50 AS INTEGER) AS flagged FROM events")
def log_and_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.round(F.log1p("value"), 8).alias("log_value"), predicted_label(F.col("value"), 50.0).alias("flagged"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(v) AS c FROM x GROUP BY 1)
SELECT vec_id, round(avg((v - c) * (v - c)), 8) AS error FROM x JOIN m USING (i) GROUP BY 1""")
def row_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared distance of each vector from the mean vector."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    centre = rows.agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(64)]).alias("c")).scalar()
    rows = rows.withColumn("c", centre)
    return rows.select("vec_id", F.round(mean_squared_error(F.col("x"), F.col("c")), 8).alias("error"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
CASE o_orderpriority WHEN '1-URGENT' THEN 'Africa' WHEN '2-HIGH' THEN 'Nordic (excl. Sweden)' WHEN '3-MEDIUM' THEN 'Nordic (excl. Sweden)'
ELSE 'Atlantis' END AS birth_region_standardized, round(avg(floor(o_totalprice)), 4) AS employment_rate
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def statistics_table(spark: SparkSession, sf: str) -> DataFrame:
    """A raw statistical table of text cells, harmonised: two labels share a category, one is unmapped, one is a total."""
    orders = table(spark, sf, "orders")
    label = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "AFRICA").when(F.col("o_orderpriority") == "2-HIGH", "Nordic countries except Sweden")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "nordic countries excluding sweden")
        .when(F.col("o_orderpriority") == "5-LOW", "All regions of birth").otherwise("Atlantis")
    )
    price = F.floor("o_totalprice").cast("string")
    raw = orders.select(
        F.lit("00 Sweden (Riket)").alias("Region"), F.lit("Total").alias("sex"), F.lit("20-64 years").alias("Age"),
        label.alias("region of birth"), F.when(F.col("o_orderstatus") == "F", "Employment rate").otherwise("Number of employed").alias("Observations"),
        order_year().cast("string").alias("year"), F.concat(F.substring(price, 1, 2), F.lit(" "), F.substring(price, 3, 20)).alias("Value, per cent"),
    )
    return rounded(harmonise_statistics(raw, "employment"), ["employment_rate"], 4)


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE o_orderstatus WHEN 'F' THEN 'Sweden' WHEN 'O' THEN 'Foreign Born (Total)' ELSE 'Other' END
AS birth_region_standardized, round(avg(t), 4) AS welfare_amount_avg FROM (
  SELECT o_orderstatus, o_orderdate, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE floor(o_totalprice) END AS t FROM orders
  WHERE o_orderdate IS NOT NULL) GROUP BY 1, 2""")
def welfare_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A wide-by-year table of text cells with suppressed values, melted, mapped and averaged."""
    orders = table(spark, sf, "orders").withColumn("year", order_year())
    amount = F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.floor("o_totalprice").cast("string"))
    born = F.when(F.col("o_orderstatus") == "F", "Inrikes födda").when(F.col("o_orderstatus") == "O", "Utrikes födda").otherwise("Okänt")
    wide = orders.filter("year is not null").select(born.alias("Född i"), *[F.when(F.col("year") == y, amount).alias(str(y)) for y in order_years(orders)])
    return rounded(harmonise_welfare(wide), ["welfare_amount_avg"], 4)
