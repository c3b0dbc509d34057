from cohortlab.sources.statistics import load_statistics
from cohortlab.streaming.statistics import read_statistics, stream_statistics
from tests_support import line, statistics_file, table

SCHEMA = ", ".join(f"`{c}` string" for c in ("Region", "Sex", "Age", "Number of years in Sweden", "Region of birth", "Observations", "Year", "Value"))


def test_files_in_steps_equal_one_scan(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    first = [line("Africa", 2013, "10", "Number of employed"), line("Asia", 2013, "30", "Number of employed"), line("Total", 2013, "9")]
    second = [line("Africa", 2013, "20", "Number of employed"), line("Asia", 2014, "..", "Number of employed")]
    third = [line("Asia", 2014, "55.5"), line("Atlantis", 2014, "1 0")]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, lines in enumerate((first[:2], second, third)):
        statistics_file(folder, lines, f"{i}.csv")
        query = stream_statistics(spark, str(folder), SCHEMA, "employment", out, state, 1)
        query.awaitTermination()
        found = table(read_statistics(spark, out, "employment"))
        assert found == table(load_statistics(spark, str(folder), "employment"))
    assert found == {(2014, "Asia"): 55.5, (2014, "Atlantis"): 10.0}
