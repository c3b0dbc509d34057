import pytest

from cohortlab.sources import titled
from cohortlab.sources.welfare import load_welfare, scan_titled
from tests_support import table

OLD = "Welfare by year\nRegion;Född i;2021;2022\nA;Inrikes födda;10;20\nB;Utrikes födda;X;1 00\nC;Okänt;7\nSource: board\n"
NEW = "2023;2022;Född i;Region\n5;;Inrikes födda;A\r\n\r\n9;\"4\";Utrikes födda;\"B;b\";extra\nfooter;;;\n"


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_each_file_keeps_its_own_header(spark, tmp_path):
    path = folder(tmp_path, a=OLD, b=NEW, c="", _hidden="x")
    df = scan_titled(spark, path)
    assert df.columns == ["Region", "Född i", "2021", "2022", "2023"]
    assert rows(df) == sorted([
        ("10", "20", None, "Inrikes födda", "A"), ("X", "1 00", None, "Utrikes födda", "B"), ("7", None, None, "Okänt", "C"),
        (None, None, "5", "Inrikes födda", "A"), (None, "4", "9", "Utrikes födda", "B;b")], key=str)
    assert table(load_welfare(spark, path)) == {
        (2021, "Sweden"): 10.0, (2022, "Sweden"): 20.0, (2023, "Sweden"): 5.0, (2021, "Foreign Born (Total)"): None,
        (2022, "Foreign Born (Total)"): 52.0, (2023, "Foreign Born (Total)"): 9.0, (2021, "Other"): 7.0, (2022, "Other"): None, (2023, "Other"): None}


@pytest.mark.parametrize("size", [1, 3, 17, 40, 1000])
def test_ranges_cut_at_line_ends(spark, tmp_path, size):
    path = folder(tmp_path, a=OLD, b=NEW)
    assert rows(titled.scan_by_name(spark, path, ";", header="year", split_bytes=size)) == rows(scan_titled(spark, path))


def test_first_line_as_header_keeps_every_row(spark, tmp_path):
    path = folder(tmp_path, a="a,b\n1,\n,2\n", b="b,a,c,c\nx,y,z,w\n\"q,\"\"q\",,,\n")
    df = titled.scan_by_name(spark, path)
    assert df.columns == ["a", "b", "c", "c.1"]
    assert rows(df) == sorted([("1", None, None, None), (None, "2", None, None), ("y", "x", "z", "w"), (None, 'q,"q', None, None)], key=str)


def test_encodings_and_byte_order_mark(spark, tmp_path):
    path = folder(tmp_path, a="Född;2020\nÅ;1\n".encode("ISO-8859-1"))
    assert rows(titled.scan_by_name(spark, path, ";", "ISO-8859-1", "year")) == [("1", "Å")]
    marked = tmp_path / "m"
    marked.mkdir()
    path = folder(marked, a=b"\xef\xbb\xbfF\xc3\xb6dd;2020\n\xc3\x85;1\n")
    assert titled.scan_by_name(spark, path, ";", header="year").columns == ["Född", "2020"]


def test_year_column_after_a_title(spark, tmp_path):
    df = scan_titled(spark, folder(tmp_path, a="A title\nRegion;Year;amount\nA;2020;3\n"))
    assert df.columns == ["Region", "Year", "amount"] and df.count() == 1


def test_patterns_and_errors(spark, tmp_path):
    path = folder(tmp_path, a=OLD, b=NEW, d="no;yeah\nin;here\n")
    assert scan_titled(spark, path + "/[ab].csv").count() == 5
    assert scan_titled(spark, "file:" + path + "/a.csv").count() == 3
    with pytest.raises(ValueError, match="d.csv"):
        scan_titled(spark, path)
    with pytest.raises(FileNotFoundError):
        scan_titled(spark, path + "/none")
    with pytest.raises(ValueError, match="empty"):
        scan_titled(spark, folder(tmp_path, e="") + "/e.csv")


def test_read_range_takes_each_line_once(tmp_path):
    data = b"one\ntwo\r\n\nthe fourth line\nlast without end"
    (tmp_path / "x").write_bytes(data)
    for step in (1, 2, 5, 11, 100):
        with titled.pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file:
            assert b"".join(titled.read_range(file, len(data), at, min(at + step, len(data))) for at in range(0, len(data), step)) == data
