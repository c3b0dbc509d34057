"""Delimited text as a Spark data source that finds each file's own header and reads rows by column name.

``spark.read.format("titled_csv").options(sep=";", encoding="UTF-8", header="year").load(path)`` reads a file, a folder or
a pattern. With ``header="year"`` a file's header is the first of its two leading lines that has an all-digit name or a
``year`` column, so a title line may stand before it; with ``header="first"`` it is the first line. The
schema is the union of all headers, as text, in order of first sight. Files may differ in columns and in their order.

Large files are cut into byte ranges of about ``splitBytes`` at line ends, one Spark partition each, so a worker
holds one range. A range is parsed by the Arrow CSV reader; lines with too few or too many fields go through
:mod:`csv` one by one. Files are listed and opened through the Arrow file systems (local, HDFS, S3, GCS), from any executor.

Cases: a line with fewer fields has nulls at the end, one with more loses the further ones; a line with one filled field in a
table of several columns, or none, is a title or footer and left out (``header="year"`` only); blank lines are left out; a repeated
name gets a number behind; an empty field is null; an empty file has no row; a file without a header, or a path without
files, is an error that names it. Fields can't hold line ends.
"""

from __future__ import annotations

import csv
import fnmatch
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

SPLIT_BYTES = 32 << 20
HEAD_BYTES = 64 << 10


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] or path.startswith("/") else (pa.fs.LocalFileSystem(), path)


def find_files(path: str) -> list[tuple[str, int]]:
    """Path and size of the visible files at ``path``: a file, all files below a folder, or a pattern in the last part."""
    system, inner = _file_system(path)
    pattern = posixpath.basename(inner)
    if any(c in pattern for c in "*?["):
        found = [f for f in system.get_file_info(pa.fs.FileSelector(posixpath.dirname(inner))) if fnmatch.fnmatchcase(f.base_name, pattern)]
    else:
        info = system.get_file_info(inner)
        found = system.get_file_info(pa.fs.FileSelector(inner, recursive=True)) if info.type == pa.fs.FileType.Directory else [info]
    visible = [f for f in found if f.type == pa.fs.FileType.File and not any(part[:1] in "._" for part in f.path[len(inner):].split("/") if part)]
    if not visible:
        raise FileNotFoundError(f"no file at {path}")
    return sorted((f.path, f.size) for f in visible)


def read_range(file: pa.NativeFile, size: int, start: int, stop: int) -> bytes:
    """The whole lines that begin in ``[start, stop)``."""
    begin = start
    if start:
        file.seek(start - 1)
        begin = start + len(_up_to_line_end(file)) - 1
    if begin >= stop:
        return b""
    file.seek(begin)
    data = file.read(stop - begin)
    return data if data.endswith(b"\n") or stop >= size else data + _up_to_line_end(file)


def _up_to_line_end(file: pa.NativeFile) -> bytes:
    out = b""
    while piece := file.read(HEAD_BYTES):
        at = piece.find(b"\n")
        if at >= 0:
            return out + piece[: at + 1]
        out += piece
    return out


def unique_names(names: Sequence[str]) -> list[str]:
    """Names with a number behind each one seen before."""
    out: list[str] = []
    for name in names:
        n, free = 0, name
        while free in out:
            n += 1
            free = f"{name}.{n}"
        out.append(free)
    return out


def _fields(line: bytes, sep: str, encoding: str) -> list[str]:
    text = line.decode(encoding).lstrip("﻿").rstrip("\r\n")
    return [c.strip() for c in next(csv.reader([text], delimiter=sep), [])]


def find_header(file: pa.NativeFile, kind: str, sep: str, encoding: str) -> tuple[list[str], int] | None:
    """Column names and the byte after the header line; None if no leading line is a header."""
    at = 0
    for _ in range(1 if kind == "first" else 2):
        file.seek(at)
        line = _up_to_line_end(file)
        at += len(line)
        names = _fields(line, sep, encoding)
        if names and (kind == "first" or any(n.isdigit() or n.lower() == "year" for n in names)):
            return unique_names(names), at
    return None


@dataclass
class FileRange(InputPartition):
    path: str
    size: int
    start: int
    stop: int


def parse_lines(data: bytes, names: list[str], sep: str, encoding: str) -> Iterator[pa.RecordBatch]:
    """Text columns of whole lines; odd lines last, padded or cut to the header."""
    from pyarrow import csv as fast

    odd: list[str] = []

    def keep(row: fast.InvalidRow) -> str:
        odd.append(row.text)
        return "skip"

    if not data.strip():
        return
    text = pa.string()
    table = fast.read_csv(
        pa.BufferReader(data), read_options=fast.ReadOptions(column_names=names, encoding=encoding, use_threads=False),
        parse_options=fast.ParseOptions(delimiter=sep, invalid_row_handler=keep),
        convert_options=fast.ConvertOptions(column_types=dict.fromkeys(names, text), null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True))
    yield from table.to_batches()
    rows = [(row + [""] * len(names))[: len(names)] for row in csv.reader(odd, delimiter=sep)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([v or None for v in column], text) for column in zip(*rows, strict=True)], names=names)


def body_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Without titles and footers: rows in which only the first of several columns is filled, or none."""
    rest = batch.columns[1:] if batch.num_columns > 1 else batch.columns
    mask = rest[0].is_valid()
    for column in rest[1:]:
        mask = pa.compute.or_(mask, column.is_valid())
    return batch.filter(mask)


class TitledReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[FileRange]:
        step = int(self.options["splitbytes"])
        return [FileRange(path, size, at, min(at + step, size)) for path, size in find_files(self.options["path"]) for at in range(0, max(size, 1), step)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        sep, encoding = self.options["sep"], self.options["encoding"]
        system, _ = _file_system(self.options["path"])
        with system.open_input_file(partition.path) as file:
            if not partition.size:
                return
            found = find_header(file, self.options["header"], sep, encoding)
            if found is None:
                raise ValueError(f"no header line in {partition.path}")
            names, first = found
            if partition.stop <= first:
                return
            data = read_range(file, partition.size, first, partition.stop) if partition.start <= first else read_range(file, partition.size, partition.start, partition.stop)
        for batch in parse_lines(data, names, sep, encoding):
            kept = body_rows(batch) if self.options["header"] == "year" else batch
            nulls = pa.nulls(kept.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([kept.column(n) if n in names else nulls for n in self.names], names=self.names)


class TitledCsv(DataSource):
    """The ``titled_csv`` format."""

    @classmethod
    def name(cls) -> str:
        return "titled_csv"

    def _options(self) -> dict[str, str]:
        return {"sep": ",", "encoding": "UTF-8", "header": "year", "splitbytes": str(SPLIT_BYTES)} | {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> StructType:
        options = self._options()
        system, _ = _file_system(options["path"])
        names: dict[str, None] = {}
        for path, size in find_files(options["path"]):
            if not size:
                continue
            with system.open_input_file(path) as file:
                found = find_header(file, options["header"], options["sep"], options["encoding"])
            if found is None:
                raise ValueError(f"no header line in {path}")
            names |= dict.fromkeys(found[0])
        if not names:
            raise ValueError(f"only empty files at {options['path']}")
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> TitledReader:
        return TitledReader(schema, self._options())


def scan_by_name(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", header: str = "first", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of all files at ``path`` by column name, as text; see the module's description. Headers are read here, so that errors are raised here."""
    options = {"path": path, "sep": sep, "encoding": encoding, "header": header, "splitBytes": str(split_bytes)}
    schema = TitledCsv(options).schema()
    spark.dataSource.register(TitledCsv)
    return spark.read.format("titled_csv").schema(schema).options(**options).load()
