"""Spreadsheet workbooks: a Spark data source with one partition per sheet, and a writer.

Only the standard library parses and writes the format; sheets are streamed, a row at a time.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby, islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import headers

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_ROWS = 1_048_576
STAMP = (1980, 1, 1, 0, 0, 0)  # of the archive's entries: equal input makes equal files
NUMBER = re.compile(r"^-?(0|[1-9]\d{0,14})(\.\d+)?$")
CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def kind_of(name: str) -> str | None:
    """csv or xlsx by a file's name; None for others."""
    lower = name.lower()
    return "csv" if lower.endswith(".csv") else "xlsx" if lower.endswith((".xlsx", ".xls")) else None


def is_zip(data: bytes) -> bool:
    """False for workbooks of the old binary format."""
    return data[:2] == b"PK"


def column_index(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, entry) in workbook order; by entry names where the workbook part is missing."""
    names = set(book.namelist())
    try:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")
        found = [(s.get("name", ""), targets.get(s.get(f"{_REL}id"), "")) for s in listed]
        paths = [(n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, t in found if t]
        found = [(n, p) for n, p in paths if p in names]
        if found:
            return found
    except (KeyError, ElementTree.ParseError):
        pass
    plain = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    return [(n.rsplit("/", 1)[1], n) for n in plain]


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, item in ElementTree.iterparse(f):
            if item.tag == f"{_NS}si":
                out.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
                item.clear()
    return out


def rows(book: zipfile.ZipFile, entry: str, strings: list[str]) -> Iterator[list[str]]:
    """The cells of each row, trimmed; '' where there is none."""
    with book.open(entry) as f:
        held = None  # the element that holds the rows: read ones leave it
        for event, row in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                held = row if row.tag == f"{_NS}sheetData" else held
                continue
            if row.tag != f"{_NS}row":
                continue
            cells: list[str] = []
            for cell in row.iter(f"{_NS}c"):
                anchor = re.match("[A-Z]+", cell.get("r", ""))
                at = column_index(anchor[0]) if anchor else len(cells)
                kind, value = cell.get("t"), cell.find(f"{_NS}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                elif value is None:
                    text = ""
                elif kind == "s":
                    text = strings[int(value.text)] if value.text and int(value.text) < len(strings) else ""
                else:
                    text = value.text or ""
                cells += [""] * (at + 1 - len(cells))
                cells[at] = text.strip()
            if held is not None:
                held.clear()
            yield cells


class Sheet(InputPartition):
    def __init__(self, number: int, name: str, entry: str):
        self.number, self.name, self.entry = number, name, entry


class _Reader(DataSourceReader):
    def __init__(self, path: str, chosen: set[int] | None, limit: int | None):
        self.path, self.chosen, self.limit = path, chosen, limit

    @contextmanager
    def _book(self) -> Iterator[zipfile.ZipFile]:
        """The workbook, read where it lies: entries are streamed."""
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with fs.open_input_file(path) as f:
            if not is_zip(f.read(2)):
                raise ValueError("UNSUPPORTED: save the workbook as .xlsx")
            f.seek(0)
            with zipfile.ZipFile(f) as book:
                yield book

    def partitions(self):
        with self._book() as book:
            found = [Sheet(i, name, entry) for i, (name, entry) in enumerate(sheets(book))]
        return [s for s in found if self.chosen is None or s.number in self.chosen]

    def read(self, partition: Sheet):
        with self._book() as book:
            for i, cells in enumerate(islice(rows(book, partition.entry, shared_strings(book)), self.limit)):
                yield partition.number, partition.name, i, cells


class XlsxSource(DataSource):
    """spark.read.format("veritab_xlsx").load(path): sheet, name, line, cells. Options: sheet, the
    numbers of those to read, joined by commas; limit, the rows to read of each."""

    @classmethod
    def name(cls) -> str:
        return "veritab_xlsx"

    def schema(self) -> str:
        return "sheet int, name string, line int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        chosen, limit = self.options.get("sheet"), self.options.get("limit")
        return _Reader(self.options["path"], {int(n) for n in chosen.split(",")} if chosen else None, int(limit) if limit else None)


def read_cells(spark: SparkSession, path: str, **options: int | str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("veritab_xlsx").options(**options).load(path)


def _layouts(spark: SparkSession, path: str, scan: int) -> list[tuple[int, headers.Layout]]:
    """The sheets that have a header, in workbook order, by one scan of the first rows of all."""
    top = read_cells(spark, path, limit=scan).orderBy("sheet", "line").toLocalIterator()
    found = [(number, headers.find([r.cells for r in rows], scan)) for number, rows in groupby(top, key=lambda r: r.sheet)]
    found = [(number, layout) for number, layout in found if layout]
    if not found:
        raise ValueError("BAD_SCHEMA: no sheet with an id, a category or a region")
    return found


def _body(spark: SparkSession, path: str, numbers: list[int], layout: headers.Layout) -> DataFrame:
    """The data rows of sheets of one layout, by one scan."""
    from pyspark.sql import functions as F

    from .csv import is_footer

    names = {name: i for i, name in enumerate(layout.headers) if name}
    body = read_cells(spark, path, sheet=",".join(map(str, numbers))).where(F.col("line") > layout.row)
    key = F.concat(F.lpad(F.col("sheet").cast("string"), 6, "0"), F.lpad(F.col("line").cast("string"), 14, "0"))
    body = body.select(key.alias("row_id"), *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for n, i in names.items()])
    return body.where(~is_footer(list(names), layout.roles.get("entity_raw")))


def read(spark: SparkSession, path: str, scan: int = headers.SCAN_ROWS) -> list[tuple[DataFrame, headers.Layout]]:
    """Each sheet that has a header, in workbook order, as its data rows and layout; others are skipped.

    The first scan rows of all sheets are read for their headers, then each sheet by a scan of its own."""
    return [(_body(spark, path, [number], layout), layout) for number, layout in _layouts(spark, path, scan)]


def read_alike(spark: SparkSession, path: str, scan: int = headers.SCAN_ROWS) -> list[tuple[DataFrame, headers.Layout]]:
    """As read, but sheets of one layout are one frame and one scan, however many they are; in the
    order of their first sheets."""
    alike: dict[str, tuple[headers.Layout, list[int]]] = {}
    for number, layout in _layouts(spark, path, scan):
        alike.setdefault(repr((layout.row, layout.headers, sorted(layout.roles.items()))), (layout, []))[1].append(number)
    return [(_body(spark, path, numbers, layout), layout) for layout, numbers in alike.values()]


def _escape(text: str) -> str:
    return CONTROLS.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def cell_xml(text: str) -> str:
    """A number only where its text comes back unchanged: no leading zeros, at most 15 digits."""
    if NUMBER.match(text) and len(text) <= 16 and sum(c.isdigit() for c in text) <= 15:
        return f"<c><v>{text}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_escape(text)}</t></is></c>'


def write_rows(target, header: list[str], data: Iterator, max_rows: int = MAX_ROWS, base: str = "Base") -> int:
    """Writes a workbook to a binary stream, row by row; a full sheet is followed by 'Base 2' and so
    on, each with the header. Returns the number of sheets."""
    data = iter(data)
    pending = next(data, None)
    count = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:

        def entry(name: str) -> zipfile.ZipInfo:
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type = zipfile.ZIP_DEFLATED
            return info

        line = lambda values: ("<row>" + "".join(cell_xml("" if v is None else str(v)) for v in values) + "</row>").encode()
        while count == 0 or pending is not None:
            count += 1
            with book.open(entry(f"xl/worksheets/sheet{count}.xml"), "w", force_zip64=True) as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode() + line(header))
                for _ in range(max_rows - 1):
                    if pending is None:
                        break
                    f.write(line(pending))
                    pending = next(data, None)
                f.write(b"</sheetData></worksheet>")
        numbers = range(1, count + 1)
        listed = "".join(f'<sheet name="{base if n == 1 else f"{base} {n}"}" sheetId="{n}" r:id="rId{n}"/>' for n in numbers)
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_NS[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers) + "</Relationships>",
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{main}.worksheet+xml"/>' for n in numbers) + "</Types>",
        }
        for name, xml in parts.items():
            book.writestr(entry(name), '<?xml version="1.0" encoding="UTF-8"?>' + xml)
    return count


def write(df: DataFrame, path: str, order: str | None = None, max_rows: int = MAX_ROWS) -> int:
    """One workbook from a frame, streamed through the driver a partition at a time."""
    from pyarrow import fs as pafs

    ordered = df.orderBy(order) if order else df
    columns = [c for c in df.columns if c != order]
    fs, own = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_output_stream(own) as f:
        return write_rows(f, columns, ([r[c] for c in columns] for r in ordered.toLocalIterator(prefetchPartitions=True)), max_rows)
