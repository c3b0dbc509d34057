import pytest
from pyspark.sql import functions as F

from cohortlab.functions.labels import label_map, map_default, map_keep, map_rules
from cohortlab.functions.names import (
    digit_columns, drop_artefacts, find_column, find_count_column, statistics_name, welfare_name, workbook_name,
)
from cohortlab.functions.parsing import clean_missing, count_or_zero, tolerant_number, tolerant_year
from cohortlab.functions.predicates import drop_totals, drop_values, keep_matching, years_between
from cohortlab.functions.scalars import mean_squared_error, predicted_label
from cohortlab.sources.settings import WELFARE_RULES


def test_names():
    assert statistics_name(' Region of Birth"') == "region_of_birth"
    assert welfare_name(" Re-Gion X ") == "re_gion_x"
    assert workbook_name("  Kön ") == "kön"
    assert digit_columns(["a", "2021", "20x", "2022"]) == ["2021", "2022"]
    assert find_column(["x" * 70 + "nation", "nationality"], ["nation"], 60) == "nationality"
    assert find_column(["a"], ["b"]) is None
    assert find_count_column(["a", "b"], ["summa"]) == "b"


def test_artefacts(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Unnamed: 0", "birth_region_standardized", "Region_x", "v"])
    assert drop_artefacts(df).columns == ["birth_region_standardized", "v"]


@pytest.mark.parametrize(
    "text, number, count, year",
    [
        ("1 234", 1234.0, 1234.0, None), ("..", None, 0.0, None), ("-", None, 0.0, None), ("", None, 0.0, None),
        (None, None, 0.0, None), ("12d", None, 0.0, None), ("2021", 2021.0, 2021.0, 2021), ("nan", None, 0.0, None),
        ("2021.0", 2021.0, 2021.0, 2021), ("­­", None, 0.0, None), ("X", None, 0.0, None),
    ],
)
def test_parsing(spark, text, number, count, year):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(tolerant_number(F.col("t")).alias("n"), count_or_zero(F.col("t")).alias("c"), tolerant_year(F.col("t")).alias("y")).first()
    assert (row.n, row.c) == (number, count)
    assert row.y == year


def test_clean_missing(spark):
    df = spark.createDataFrame([("..", 1.0), ("-", float("nan")), ("N/A", 2.0), ("", None), ("a-b", 3.0)], "t string, v double")
    assert [(r.t, r.v) for r in clean_missing(df).collect()] == [(None, 1.0), (None, None), (None, 2.0), (None, None), ("a-b", 3.0)]


def test_predicates(spark):
    df = spark.createDataFrame([("00 sweden", 2012), ("RIKET", 2013), (None, 2024), ("Lund", 2025)], "region string, year int")
    assert keep_matching(df, {"region": "Sweden|Riket", "sex": "total"}).count() == 2
    assert [r.year for r in years_between(df, 2013, 2024).collect()] == [2013, 2024]
    assert drop_totals(df, "region", ["riket"]).count() == 3
    assert drop_values(df, "region", ["Riket", "Lund"]).count() == 3


def test_label_maps(spark):
    df = spark.createDataFrame([("AFRICA",), ("Atlantis",), (" asia ",), (None,)], "l string")
    lookup = label_map(spark, {"Africa": "Africa", "asia": "Asia"})
    kept = {r.l: r.o for r in map_keep(df, "l", lookup, "o").collect()}
    assert kept == {"AFRICA": "Africa", "Atlantis": "Atlantis", " asia ": " asia ", None: None}
    defaulted = {r.l: r.o for r in map_default(df, "l", lookup, "o").collect()}
    assert defaulted == {"AFRICA": "Africa", "Atlantis": "Other", " asia ": "Asia", None: "Other"}


def test_rules(spark):
    df = spark.createDataFrame([("Inrikes födda",), ("UTRIKES",), ("Foreign in Sweden",), ("x",), (None,)], "l string")
    found = [r.o for r in df.select(map_rules(F.col("l"), WELFARE_RULES, "Other").alias("o")).collect()]
    assert found == ["Sweden", "Foreign Born (Total)", "Sweden", "Other", "Other"]


def test_row_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0], 0.5)], "a array<double>, b array<double>, s double")
    row = df.select(mean_squared_error(F.col("a"), F.col("b")).alias("e"), predicted_label(F.col("s"), 0.5).alias("p")).first()
    assert (row.e, row.p) == (2.0, 1)
