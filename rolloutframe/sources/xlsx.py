"""Cells of .xlsx workbooks: one row a cell, with cached value, formula and style.

Files are read by Spark as binary rows, or by the data source ``xlsx``, which has
a partition for each sheet and opens only what a filter on ``workbook`` or
``sheet`` lets through; one task parses one sheet or workbook at a time with the
standard library. A sheet without cells gives one row without a cell; a file that
cannot be parsed gives one row of the type ``unreadable``, with the reason as its
value. Numbers are shown as Python shows them. Those in a date format are of the
type ``date``, or ``time`` below one day; their values stay serial numbers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from ..session import ship_package
from .filesystem import listed, opened

SCHEMA = (
    "workbook string, sheet string, sheet_idx int, row int, col int, ref string, value string, value_type string, "
    "formula string, fill_fg string, fill_bg string, font_rgb string, bold boolean, italic boolean, underline boolean"
)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times; what is no format code in a custom one.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
NO_CODE = r'"[^"]*"|\\.|_.|\[(?!h|hh|m|mm|s|ss)[^\]]*\]|(?i:general)'
NO_STYLE = {"fill_fg": None, "fill_bg": None, "font_rgb": None, "bold": False, "italic": False, "underline": False, "dated": False}
BATCH_CELLS = 4096
_KINDS = {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "e": "error"}


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _styles(book: zipfile.ZipFile) -> list[dict]:
    """What each cell format shows."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))

    def rgb(node: ElementTree.Element | None, tag: str) -> str | None:
        found = node.find(f".//{_MAIN}{tag}") if node is not None else None
        return found.get("rgb") if found is not None else None

    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter(f"{_MAIN}numFmt")}

    def dated(number: int) -> bool:
        code = re.sub(NO_CODE, "", own[number]).split(";")[0] if number in own else ""
        return bool(re.search("[dmhysDMHYS]", code)) if number in own else number in DATE_FORMATS

    fonts, fills = root.findall(f"{_MAIN}fonts/{_MAIN}font"), root.findall(f"{_MAIN}fills/{_MAIN}fill")
    out = []
    for xf in root.findall(f"{_MAIN}cellXfs/{_MAIN}xf"):
        font, fill = fonts[int(xf.get("fontId", 0))] if fonts else None, fills[int(xf.get("fillId", 0))] if fills else None
        marks = {k: font is not None and font.find(f"{_MAIN}{t}") is not None for k, t in (("bold", "b"), ("italic", "i"), ("underline", "u"))}
        colours = {"fill_fg": rgb(fill, "fgColor"), "fill_bg": rgb(fill, "bgColor"), "font_rgb": rgb(font, "color")}
        out.append({**colours, **marks, "dated": dated(int(xf.get("numFmtId", 0)))})
    return out


def _shown(number: str) -> str:
    """A number as Python shows it: whole where the file spells no point and no exponent."""
    return repr(float(number)) if re.search("[.eE]", number) else str(int(number))


def sheets_of(file: io.IOBase) -> list[str]:
    """The names of a workbook's sheets; the rest of the file is not read."""
    with zipfile.ZipFile(file) as book:
        return [x.get("name") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def cells_of(file: io.IOBase, name: str, only: str | None = None) -> list[dict]:
    """The cells of a workbook, or of the sheet ``only``."""
    with zipfile.ZipFile(file) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        styles = _styles(book)
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for number, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            if only is not None and sheet.get("name") != only:
                continue
            target = links[sheet.get(_LINK)].lstrip("/")
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            place = {"workbook": name, "sheet": sheet.get("name"), "sheet_idx": number}
            if root.find(f".//{_MAIN}c") is None:
                out.append(place)
            for cell in root.iter(f"{_MAIN}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                col = 0
                for letter in letters:
                    col = col * 26 + ord(letter) - 64
                kind, formula = cell.get("t", "n"), cell.findtext(f"{_MAIN}f")
                value = _text(cell) if kind == "inlineStr" else cell.findtext(f"{_MAIN}v")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                style = int(cell.get("s", 0))
                own = dict(styles[style] if style < len(styles) else NO_STYLE)
                shown = _KINDS.get(kind, "number")
                if shown == "number" and value is not None:
                    value = _shown(value.strip())
                if own.pop("dated") and shown == "number" and value is not None:
                    shown = "time" if 0 <= float(value) < 1 else "date"
                out.append({
                    **place, "row": int(row), "col": col, "ref": cell.get("r"), "value": value,
                    "value_type": shown if value is not None else None, "formula": None if formula is None else f"={formula}", **own,
                })
    return out


UNPARSED = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, AttributeError, TypeError)


def _readable(file: io.IOBase, book: str, only: str | None = None) -> list[dict]:
    try:
        return cells_of(file, book, only)
    except UNPARSED as reason:
        return [{"workbook": book, "value": repr(reason), "value_type": "unreadable"}]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def parse_cells(books: DataFrame) -> DataFrame:
    """The cells of (workbook, content) rows; a null content is an unreadable workbook."""
    ship_package(books.sparkSession)
    schema = _arrow(SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[dict] = []
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                cells += _readable(io.BytesIO(content.as_py() or b""), name.as_py())
                if len(cells) >= BATCH_CELLS:
                    yield pa.RecordBatch.from_pylist(cells, schema)
                    cells = []
            yield pa.RecordBatch.from_pylist(cells, schema)

    return books.select("workbook", "content").mapInArrow(parse, SCHEMA)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of every workbook below ``path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return parse_cells(found.select(F.element_at(F.split("path", "/"), -1).alias("workbook"), "content"))


@dataclass
class Sheet(InputPartition):
    """A sheet of a workbook; all of it, where no sheet is named."""

    path: str
    sheet: str | None


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equalities of ``workbook`` and ``sheet`` choose partitions; the others are left to Spark."""
        for given in filters:
            if isinstance(given, IsNotNull) and given.attribute == ("workbook",):
                continue  # each row has one
            column = given.attribute[0] if isinstance(given, (EqualTo, EqualNullSafe, In)) and len(given.attribute) == 1 else None
            if column not in ("workbook", "sheet") or (isinstance(given, EqualNullSafe) and given.value is None):
                yield given
                continue
            values = set(given.value if isinstance(given, In) else [given.value])
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[Sheet]:
        found = []
        for path in listed(self.path, ".xlsx"):
            if "workbook" in self.wanted and path.rsplit("/", 1)[-1] not in self.wanted["workbook"]:
                continue
            try:
                with opened(self.path, path) as file:
                    sheets: list = sheets_of(file)
            except UNPARSED:
                sheets = [None]  # the task says why
            found += [Sheet(path, s) for s in sheets if "sheet" not in self.wanted or s in self.wanted["sheet"]]
        return found

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is wanted
            return
        schema = _arrow(SCHEMA)
        with opened(self.path, partition.path) as file:
            whole = file if partition.sheet is not None else io.BytesIO(file.read())
            cells = _readable(whole, partition.path.rsplit("/", 1)[-1], partition.sheet)
        yield pa.RecordBatch.from_pylist(cells, schema).select(self.names)


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(path)``: the columns of ``SCHEMA``, or those of a schema that names some of them."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(schema, self.options)


def register_source(spark: SparkSession) -> None:
    """Make the format ``xlsx`` known, with its filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxSource)
