import pytest
from pyspark.sql import functions as F

from cohortlab.functions.predicates import years_between
from cohortlab.plans.cohort import CohortPaths, load_sources, run
from cohortlab.sources.cells import (
    CELL_SCHEMA, column_roles, file_year, harmonise_counts, header_rows, named_cells, select_files, select_sheets,
)
from cohortlab.sources.io import optional_source, save_table, scan_transactions
from cohortlab.sources.statistics import load_statistics, scan_delimited
from cohortlab.sources.welfare import load_welfare, scan_titled
from tests_support import line, statistics_file, table

def test_statistics(spark, tmp_path):
    path = statistics_file(tmp_path, [
        line("Africa", 2013, "1 2.5"), line("Africa", 2013, "20.5", age="15-74 years"), line("Africa", 2013, "99", age="75+"),
        line("Africa", 2013, "99", sex="men"), line("Africa", 2013, "99", region="Lund"), line("Africa", 2013, "99", stay="0-3"),
        line("Foreign Born", 2013, "50"), line("foreign-born total", 2013, "60"), line("Atlantis, Deep", 2013, "7"),
        line("TOTAL", 2013, "80"), line("All regions of birth", 2013, "80"), line("Asia", 2013, ".."), line("Asia", 2025, "4"),
        line("Asia", 2012, "3"), line("Inrikes födda", 2024, "77"), line("Asia", 2013, "1000", "Number of employed"),
    ])
    found = table(load_statistics(spark, path, "employment"))
    assert found == {
        (2013, "Africa"): 16.5, (2013, "Foreign Born (Total)"): 55.0, (2013, "Atlantis, Deep"): 7.0, (2025, "Asia"): 4.0,
        (2012, "Asia"): 3.0, (2024, "Sweden"): 77.0,
    }
    assert sorted(k[0] for k in table(years_between(load_statistics(spark, path, "employment"), 2013, 2024))) == [2013] * 3 + [2024]


def test_statistics_fallback_and_failures(spark, tmp_path):
    path = statistics_file(tmp_path, [line("Africa", 2013, "10", "Number of employed"), line("Africa", 2013, "90", "Other")])
    assert table(load_statistics(spark, path, "employment")) == {(2013, "Africa"): 10.0}
    with pytest.raises(ValueError):
        load_statistics(spark, path, "income")
    plain = load_statistics(spark, path, "anything")
    assert plain.columns[-1] == "value" and table(plain) == {(2013, "Africa"): 50.0}


TITLE = "﻿Title, with commas"
FOOTER = "Some database 2026-02-28"


def welfare_file(folder, lines, name="welfare.csv"):
    path = folder / name
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("title", [True, False])
def test_welfare_without_a_region_column(spark, tmp_path, title):
    body = ["Region;Kön;2021;2022", "Riket;Män;1 00;200", "Kiruna;Kvinnor;­­;X", "Lund;Båda könen;300;-"]
    path = welfare_file(tmp_path, ([TITLE] if title else []) + body + [FOOTER])
    rows = scan_titled(spark, path)
    assert rows.columns == ["Region", "Kön", "2021", "2022"] and rows.count() == 3
    assert table(load_welfare(spark, path)) == {(2021, "Foreign Born (Total)"): 200.0, (2022, "Foreign Born (Total)"): 200.0}


def test_welfare_with_a_region_column(spark, tmp_path):
    path = welfare_file(tmp_path, [TITLE, "Född i;2021", "Inrikes födda;10", "Utrikes födda;20", "Utrikes födda;40", "Okänt;5"])
    assert table(load_welfare(spark, path)) == {(2021, "Sweden"): 10.0, (2021, "Foreign Born (Total)"): 30.0, (2021, "Other"): 5.0}


def test_welfare_without_years(spark, tmp_path):
    with pytest.raises(ValueError):
        load_welfare(spark, welfare_file(tmp_path, ["a;b", "c;d", "1;2"]))


def sheet(path, name, pos, *rows):
    return [(path, name, pos, i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)]


@pytest.fixture
def cells(spark):
    asylum = "drop/Asyl beslut-2021.xlsx"
    data = [
        *sheet(asylum, "Info", 0, ["Medborgarskap", "wrong sheet", "Totalt"], ["Syrien", "x", "999"]),
        *sheet(asylum, "Medborgarskap", 1, ["Medborgarskap", "x", "Totalt"], ["Syrien", "x", "888"]),
        *sheet(asylum, "Medborgarskap första", 2, ["Title", None, None], ["Medborgarskap", "Nationality", None],
               [" Medborgarskap ", "Kön", "Totalt"], ["Syrien", "K", "1 234"], ["IRAK ", "M", "-"], ["Irak", "K", None],
               ["Summa", "K", "5000"], [None, "K", "7"], ["Atlantis", "K", "9"], ["Chile", "K", "text"]),
        *sheet(asylum, "Medborgarskap första again", 3, ["Medborgarskap", "x"], ["Syrien", "777"]),
        *sheet("drop/avgjorda_2022_x.xlsx", "A", 0, ["Nationality", "Total"], ["Syrien", "10"], ["Polen", "4"]),
        *sheet("drop/avgjorda_2022_x.xlsx", "B", 1, ["Nationality", "Total"], ["Syrien", "11"]),
        *sheet("drop/avgjorda no year.xlsx", "Nationality", 0, ["Medborgarskap", "Totalt"], ["Syrien", "3"]),
        *sheet("drop/arbet 2020.xlsx", "x", 0, ["Nationality", "Year", "beviljade"], ["Norge", "2019", "5"], ["Norge", None, "6"]),
        *sheet("drop/arbet asyl 2020.xlsx", "x", 0, ["Nationality", "beviljade"], ["Norge", "50"]),
    ]
    return spark.createDataFrame(data, CELL_SCHEMA)


def test_asylum_counts(cells):
    found = table(harmonise_counts(select_files(cells, "asylum").filter("path not like '%asyl 2020%'"), "asylum"))
    assert found == {
        (2021, "Asia"): 1234.0, (2021, "South America"): 0.0,
    }


def test_other_files(cells):
    two = cells.filter("path like '%avgjorda%'")
    assert table(select_sheets(two).groupBy("path").agg(F.max("sheet").alias("s"))) == {
        ("drop/avgjorda_2022_x.xlsx",): "A", ("drop/avgjorda no year.xlsx",): "Nationality"}
    assert table(harmonise_counts(two.filter("path like '%2022%'"), "asylum")) == {
        (2022, "Asia"): 10.0, (2022, "EU/EFTA (excl. Nordic)"): 4.0}


def test_permits(cells):
    assert table(harmonise_counts(cells, "permits")) == {(2019, "Nordic (excl. Sweden)"): 5.0, (2020, "Nordic (excl. Sweden)"): 6.0}


def test_headers_and_roles(spark, cells):
    first = cells.filter("sheet = 'Medborgarskap första'")
    assert header_rows(first).first().header_idx == 2
    assert column_roles(named_cells(first)) == {"nationality": "medborgarskap", "count": "totalt", "year": None}
    lost = spark.createDataFrame(sheet("p", "s", 0, ["a", "b"], ["c", "d"]), CELL_SCHEMA)
    assert header_rows(lost).first().header_idx == 0
    assert column_roles(named_cells(lost))["count"] == "b"
    with pytest.raises(ValueError):
        harmonise_counts(lost.withColumn("path", F.lit("asyl")), "asylum")


def test_file_year(spark):
    df = spark.createDataFrame([("a/b_2021-x.xlsx",), ("a/20211 99.xlsx",), ("a 1999/b_2021.xlsx",)], "p string")
    assert [r.y for r in df.select(file_year(F.col("p")).alias("y")).collect()] == [2021, None, 2021]


def test_optional_and_save(spark, tmp_path):
    assert optional_source(spark, str(tmp_path / "absent.csv"), load_statistics, "income") is None
    assert optional_source(spark, str(tmp_path / "absent.csv"), load_welfare) is None
    with pytest.raises(ValueError):
        save_table(None, str(tmp_path / "x"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "a int, b string")
    for kind in ("csv", "parquet"):
        save_table(df, str(tmp_path / kind), kind)
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "parquet")).collect()) == [1, 2]
    assert sorted(r.a for r in scan_delimited(spark, str(tmp_path / "csv")).collect()) == ["1", "2"]
    assert scan_transactions(spark, str(tmp_path / "csv"), "a int, b string").agg(F.sum("a")).first()[0] == 3


def test_whole_cohort_job(spark, tmp_path, cells):
    t = "foreign born"
    years = range(2013, 2016)
    income = [line(label, y, f"{100 + i + y - 2013}", "Median value") for y in years for i, label in enumerate((t, "Sweden", "Africa"))]
    work = [line(label, y, f"{50 + i}") for y in years for i, label in enumerate((t, "Sweden"))]
    counts = str(tmp_path / "cells")
    cells.write.parquet(counts)
    paths = CohortPaths(
        {"employment": statistics_file(tmp_path, work, "a.csv"), "income": statistics_file(tmp_path, income, "b.csv"),
         "self_sufficiency": str(tmp_path / "absent.csv")},
        {"permits": counts},
        welfare_file(tmp_path, ["Region;2014;2015", "Riket;7;9"]),
    )
    assert len(load_sources(spark, paths)) == 4
    merged, summary, figures = run(spark, paths, str(tmp_path / "out"))
    found = {(r.birth_region_standardized, r.year): r for r in merged.collect()}
    assert found[("Africa", 2013)].employment_rate == 50.0  # proxy
    assert found[("Africa", 2014)].welfare_amount_avg == 7.0  # proxy
    assert found[("Sweden", 2014)].welfare_amount_avg is None  # exempt
    assert found[("Sweden", 2014)].mv_permits_count == 5.5  # median fill
    assert "trend_employment_rate" in figures and "income_and_welfare" in figures
    stored = spark.read.csv(str(tmp_path / "out" / "summary"), header=True, inferSchema=True)
    assert {r[0] for r in stored.collect()} == {r[0] for r in summary.collect()} == {k[0] for k in found}
    with pytest.raises(ValueError):
        run(spark, CohortPaths({}, {}, str(tmp_path / "absent.csv")), str(tmp_path / "none"))
