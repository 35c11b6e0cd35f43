"""Specification files: delimited text, workbooks and project sheets as one data source (S1..S3, P5).

`spark.read.format("specification")` lists the files under a path, deals them to partitions by their bytes
and reads each by its kind.  A file's own first row names its columns; quoted fields may hold line breaks.
Nothing reads a file before the scan, and a task holds one row of a delimited file (a workbook lies in
memory packed).  Every file gives rows or says why not: rows of kind `error` name files and rows that
cannot be read.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ductlake import fixed_values as fv
from ductlake.operators import grid, schema
from ductlake.session import spread

WORKBOOK_SUFFIXES = (".xlsx", ".xlsm")
LEGACY_SUFFIXES = (".xls",)
TAB_SUFFIXES = (".tsv", ".tab")
CELLS = "doc_id string, row_no bigint, col_no int, text string, error string"
SPEC_ROWS = f"doc_id string, kind string, line_no long, {', '.join(f'{t} string' for t in schema.TARGETS)}, cells array<string>, error string"
FORMAT = "specification"
PARTITION_BYTES = 64 << 20
# A quoted field that never ends is an error here, not a file in memory.
MAX_FIELD = 16 << 20
BATCH_ROWS = 2000


@dataclass
class SpecPartition(InputPartition):
    """Files of one task, by full path."""

    files: list[str]


def file_system(path: str):
    """(file system, path in it, what turns a listed path into a full one) for a local path or a URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, lambda listed: listed
    if path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), local, lambda listed: f"file://{listed}"
    system, inside = fs.FileSystem.from_uri(path)
    before = path[: path.index(inside.strip("/"))] if inside.strip("/") else path.rstrip("/") + "/"
    return system, inside, lambda listed: before + listed.lstrip("/")


def listed_files(paths: list[str]) -> list[tuple[str, int]]:
    """(full path, bytes) of all files under the paths; names that begin with a dot or an underscore are no data."""
    from pyarrow import fs

    out: list[tuple[str, int]] = []
    for path in paths:
        system, inside, full = file_system(path)
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
        root = inside.rstrip("/")
        for f in found:
            below = f.path[len(root) :] if f.path != inside else "/" + f.base_name
            if f.type == fs.FileType.File and not re.search(r"/[._]", below):
                out.append((full(f.path), f.size or 0))
    return sorted(out)


def dealt_files(files: list[tuple[str, int]], partition_bytes: int) -> list[SpecPartition]:
    """Neighbouring files together up to `partition_bytes`; a file is read by one task, as a quote may open anywhere in it."""
    out: list[SpecPartition] = []
    held, size = [], 0
    for path, n in files:
        if held and size + n > partition_bytes:
            out.append(SpecPartition(held))
            held, size = [], 0
        held.append(path)
        size += n
    return [*out, SpecPartition(held)] if held else out


class SpecificationSource(DataSource):
    """Options: path or paths (a JSON list), delimiter (`;`), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SPEC_ROWS

    def reader(self, schema) -> DataSourceReader:
        return SpecificationReader(dict(self.options))


class SpecificationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = options.get("paths")
        self.paths = json.loads(given) if given else [options["path"]]
        self.delimiter = options.get("delimiter", ";")
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[SpecPartition]:
        return dealt_files(listed_files(self.paths), self.partition_bytes)

    def read(self, partition: SpecPartition) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kind", "line_no", *schema.TARGETS, "cells", "error"]
        kinds = pa.schema([(n, pa.int64() if n == "line_no" else pa.list_(pa.string()) if n == "cells" else pa.string()) for n in names])
        held: list[tuple] = []
        for path in partition.files if partition else []:
            for row in file_rows(path, self.delimiter):
                held.append((path, *row))
                if len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)


def error_row(message: str, line_no: int | None = None) -> tuple:
    return ("error", line_no, *[None] * len(schema.TARGETS), None, message)


def file_rows(path: str, delimiter: str) -> Iterator[tuple]:
    """(kind, line_no, targets, cells, error) of one file, by its suffix."""
    system, inside, _ = file_system(path)
    name = path.lower()
    if name.endswith(LEGACY_SUFFIXES):
        yield error_row("a legacy workbook cannot be read")
        return
    try:
        if is_workbook(name):
            with system.open_input_stream(inside) as stream:
                content = stream.readall()
            yield from workbook_rows(lambda: _sheet_rows(content))
        else:
            separator = "\t" if name.endswith(TAB_SUFFIXES) else delimiter
            yield from table_rows(lambda: delimited_rows(system.open_input_stream(inside), separator))
    except (OSError, UnicodeDecodeError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as fault:
        yield error_row(f"{type(fault).__name__}: {fault}")


def delimited_rows(stream, delimiter: str) -> Iterator[tuple[int, list[str]]]:
    """(number, fields) of the rows of a delimited file, without blank ones."""
    csv.field_size_limit(MAX_FIELD)
    with stream, io.TextIOWrapper(stream, encoding="utf-8-sig", newline="") as text:
        for number, fields in enumerate(csv.reader(text, delimiter=delimiter)):
            if fields:
                yield number, fields


def table_rows(rows: Callable[[], Iterator[tuple[int, list[str]]]]) -> Iterator[tuple]:
    """Rows below a header row as the six targets; `rows` starts the file anew.

    N3: a column without any cell below its header takes no part in the mapping.  Looking for one ends as
    soon as each column has a cell.  A row with more fields than the header is kept, and an error names it.
    """
    first = rows()
    _, header = next(first, (0, None))
    if header is None:
        yield error_row("no header row")
        return
    empty = {c for c, h in enumerate(header)}
    for _, fields in first:
        empty -= {c for c in empty if c < len(fields) and fields[c]}
        if not empty:
            break
    first.close()
    targets = schema.header_targets(["" if c in empty else h for c, h in enumerate(header)])
    places = [targets.index(t) if t in targets else None for t in schema.TARGETS]
    body = rows()
    next(body)
    for number, fields in body:
        if any(fields):
            yield ("table", number, *[fields[p] or None if p is not None and p < len(fields) else None for p in places], None, None)
        if len(fields) > len(header) and any(fields[len(header) :]):
            yield error_row(f"row {number} has {len(fields)} fields, its header {len(header)}", number)


def workbook_rows(rows: Callable[[], Iterator[tuple[int, list[str]]]]) -> Iterator[tuple]:
    """P5: a sheet with a marker below its first row is a project sheet, whose rows stay cells; others are tables."""
    marked = any(marker in cell.lower() for k, (_, cells) in enumerate(rows()) if k for cell in cells for marker in fv.PROJECT_SHEET_MARKERS)
    if not marked:
        yield from table_rows(rows)
        return
    for number, cells in rows():
        yield ("project", number, *[None] * len(schema.TARGETS), cells, None)


def read_spec_rows(spark: SparkSession, path: str | list[str], delimiter: str = ";", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows of all specification files under a path, `SPEC_ROWS`."""
    spark.dataSource.register(SpecificationSource)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format(FORMAT).option("paths", json.dumps(paths)).option("delimiter", delimiter).option("partitionBytes", partition_bytes).load()


def spec_lines_of(rows: DataFrame) -> DataFrame:
    """Specification lines (N2..N5) of read rows, with doc_id and line_no; project sheets by their own headers."""
    columns = ["doc_id", "line_no", *schema.TARGETS]
    cells = rows.where("kind = 'project'").select("doc_id", F.col("line_no").alias("row_no"), F.posexplode("cells").alias("col_no", "text"))
    sheets = grid.project_sheet_lines(cells, ["doc_id"])
    return schema.spec_rows(rows.where("kind = 'table'").select(*columns).unionByName(sheets.select(*columns)))


def read_delimited_spec(spark: SparkSession, path: str | list[str], delimiter: str = ";") -> DataFrame:
    """Files with free headers -> specification lines, each file by its own header."""
    return spec_lines_of(read_spec_rows(spark, path, delimiter))


def read_spec_files(spark: SparkSession, path: str | list[str], delimiter: str = ";") -> tuple[DataFrame, DataFrame]:
    """S1..S3, P5: (specification lines, what cannot be read) of a folder of delimited files, workbooks and project sheets.

    A file is a workbook by its suffix (`is_workbook`), tab-separated by its suffix, and else delimited text.
    Both results scan the files; a caller who needs both of a large folder writes `read_spec_rows` as a table first.
    """
    rows = read_spec_rows(spark, path, delimiter)
    return spec_lines_of(rows), rows.where("kind = 'error'").select("doc_id", F.col("line_no").alias("row_no"), "error")


def read_delimited(spark: SparkSession, path: str | list[str], delimiter: str = ";") -> DataFrame:
    """A headed text file as strings; column names lower-cased, a byte-order mark removed."""
    df = spark.read.csv(path, sep=delimiter, header=True, encoding="UTF-8", quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.lstrip("\ufeff").strip().strip('"').lower() for c in df.columns])


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group(0):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the workbook's first sheet; the lowest number where no list of sheets is there."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_NS + "sheet"):
            target = next((parts.get(v) for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            part = target.lstrip("/") if target and target.startswith("/") else f"xl/{target}"
            if part in names:
                return part
    return min(
        (n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)),
        key=lambda n: int(re.search(r"\d+", n).group(0)),
    )


def _sheet_cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the first sheet of a workbook, streamed.  References may be left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(_NS + "t")) for item in root]
        with book.open(_first_sheet(book)) as sheet:
            row_no = -1
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != _NS + "row":
                    continue
                row_no = int(row.get("r")) - 1 if row.get("r") else row_no + 1
                col_no = -1
                for cell in row.iter(_NS + "c"):
                    col_no = _column_number(cell.get("r")) if cell.get("r") else col_no + 1
                    value = cell.find(_NS + "v")
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(_NS + "t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    yield row_no, col_no, text
                row.clear()


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of the rows of the first sheet that hold a cell; a missing cell is ''."""
    number, cells = None, []
    for row_no, col_no, text in _sheet_cells(content):
        if row_no != number:
            if cells:
                yield number, cells
            number, cells = row_no, []
        cells += [""] * (col_no + 1 - len(cells))
        cells[col_no] = text
    if cells:
        yield number, cells


def read_workbook_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S3: first sheet of every workbook under a path as long cells; one task reads whole files.

    A file that is no workbook gives one row with `error` and no cell.
    """
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(doc, r, c, t, None) for r, c, t in _sheet_cells(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as fault:
                    rows = [(doc, None, None, None, f"{type(fault).__name__}: {fault}")]
                yield pd.DataFrame(rows, columns=["doc_id", "row_no", "col_no", "text", "error"]).astype({"row_no": "Int64", "col_no": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,XLSX,XLSM}").load(path)
    return files.select("path", "content").mapInPandas(cells, CELLS)


def workbook_spec_rows(cells: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """Cells of tables (by `keys`) whose first row is a header -> specification lines (N2..N5)."""
    filled = cells.filter(F.coalesce("text", F.lit("")) != "")
    starts = filled.groupBy(*keys).agg(F.min("row_no").alias("header_row"))
    located = filled.join(spread(starts, *keys), keys)
    body = located.filter(F.col("row_no") > F.col("header_row"))
    # A column without any cell below its header takes no part in the mapping.
    places = [*keys, "col_no"]
    in_use = spread(body.select(*places).distinct(), *places)
    header = located.filter(F.col("row_no") == F.col("header_row")).select(*places, "text")
    targets = schema.map_header_cells(header.join(in_use, places, "left_semi"), keys)
    named = body.join(spread(targets, *places), places)
    wide = named.groupBy(*keys, "row_no").agg(
        *[F.max(F.when(F.col("target") == t, F.col("text"))).alias(t) for t in schema.TARGETS]
    )
    return schema.spec_rows(wide).withColumnRenamed("row_no", "line_no")


def is_workbook(name: str) -> bool:
    """Whether a file is read as a workbook; everything else is delimited text."""
    return name.lower().endswith(WORKBOOK_SUFFIXES)
