"""XLSX: the first sheet as rows, and writers; zip archives of XML, nothing more.

A sheet is one compressed stream, which can't be entered in its middle, but taking it apart costs far more than unpacking it.
So one task unpacks a workbook and cuts the stream between rows into pieces of 1 MB, which many tasks take apart; what
a task holds is the packed workbook and a piece, however many rows there are. Strings that cells share are a table of their own, joined
by number. Many rows are written as many workbooks, each by one task.
"""

from __future__ import annotations

import datetime
import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import IO, Any, NamedTuple
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that are dates.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _text(node: ElementTree.Element) -> str:
    """Plain or rich text, its runs joined."""
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_NS}numFmt")}
    cells = root.find(f"{_NS}cellXfs")
    formats = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {i for i, f in enumerate(formats) if f in _DATES or re.search(r"[dmyhs]", own.get(f, ""), re.I)}


class Shared(NamedTuple):
    """A cell whose text is the shared string of that number."""

    number: int


def _value(cell: ElementTree.Element, dates: set[int]) -> Any:
    """A cell: dates as ISO texts, rich text and links as text, formulas as their result, errors as nothing."""
    kind, raw = cell.get("t", "n"), cell.findtext(f"{_NS}v")
    if kind == "inlineStr":
        return _text(cell)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return Shared(int(raw))
    if kind == "b":
        return raw == "1"
    if kind in ("str", "d"):
        return raw
    number = float(raw)
    if int(cell.get("s", 0)) in dates:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(milliseconds=round(number * 86_400_000))
        return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"
    return int(number) if number.is_integer() else number


class Piece(NamedTuple):
    """Elements of one kind that stand together in a document: `first` is the number of the first, head all that precedes any."""

    first: int
    head: bytes
    body: bytes


def cut(stream: IO[bytes], tag: str, size: int = PIECE) -> Iterator[Piece]:
    """The elements of that name, in pieces of about `size` bytes, each as it stands in the document.

    The places of elements are those that the parser reports, so comments and character data that look like elements are
    none. Rows carry numbers, which may skip some; other elements count from 0. A piece begins where the one before ended."""
    parser = expat.ParserCreate(namespace_separator=" ")
    name, starts, held, base = f"{_NS[1:-1]} {tag}", [], bytearray(), 0
    head, last, depth = None, 0 if tag == "row" else -1, 0

    def opened(found: str, attributes: dict[str, str]) -> None:
        nonlocal last, depth
        if found == name:
            depth += 1
            if depth == 1:
                starts.append((parser.CurrentByteIndex, last + 1))
                last = int(attributes.get("r", last + 1)) if tag == "row" else last + 1

    def closed(found: str) -> None:
        nonlocal depth
        depth -= found == name

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    while True:
        chunk = stream.read(size)
        held += chunk
        parser.Parse(chunk, not chunk)
        if starts and head is None:
            head = bytes(held[: starts[0][0]])
        # the element that opened last may be unfinished: it stays
        if starts and (not chunk or starts[-1][0] - starts[0][0] >= size):
            until = starts[-1] if chunk else (base + len(held), 0)
            yield Piece(starts[0][1], head, bytes(held[starts[0][0] - base : until[0] - base]))
            del held[: until[0] - base]
            base, starts[:] = until[0], starts[-1:]
        if not chunk:
            return


def _elements(piece: Piece, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a piece. What the head opens is never closed, so nothing needs to be known about it."""
    parser = ElementTree.XMLPullParser(["end"])
    for part in (piece.head, piece.body):
        parser.feed(part)
        for _, element in parser.read_events():
            if element.tag == f"{_NS}{tag}":
                yield element
                element.clear()


def rows_of(piece: Piece, dates: set[int]) -> Iterator[tuple[int, list[Any]]]:
    """(row number, values) of a piece of a sheet; rows that aren't stored are empty."""
    following = piece.first
    for row in _elements(piece, "row"):
        number = int(row.get("r", following))
        for skipped in range(following, number):
            yield skipped, []
        values: list[Any] = []
        for cell in row.iter(f"{_NS}c"):
            at = _column(cell.get("r")) if cell.get("r") else len(values)
            values += [None] * (at + 1 - len(values))
            values[at] = _value(cell, dates)
        yield number, values
        following = number + 1


def shared_strings(book: zipfile.ZipFile) -> Iterator[tuple[int, str]]:
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as stream:
            for piece in cut(stream, "si"):
                for i, element in enumerate(_elements(piece, "si")):
                    yield piece.first + i, _text(element)


def _first_sheet(book: zipfile.ZipFile) -> str | None:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet")
    if first is None:
        return None
    target = links[first.get(_REL)].lstrip("/")
    return target if target.startswith("xl/") else f"xl/{target}"


def sheet_pieces(book: zipfile.ZipFile, size: int = PIECE) -> Iterator[Piece]:
    name = _first_sheet(book)
    if name:
        with book.open(name) as stream:
            yield from cut(stream, "row", size)


def header_names(cells: list[Any]) -> list[str]:
    """Names for columns: trimmed; column_i where blank, name_i where taken."""
    names: list[str] = []
    for i, cell in enumerate(cells, 1):
        name = "" if cell is None else str(cell).strip()
        name = name or f"column_{i}"
        names.append(f"{name}_{i}" if name in names else name)
    return names


def records(data: bytes) -> Iterator[dict[str, Any]]:
    """Rows below the header; blank rows inside are kept, one at the end isn't. For workbooks that one process reads."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared, dates, names, held = dict(shared_strings(book)), _date_styles(book), None, None
        for piece in sheet_pieces(book):
            for _, values in rows_of(piece, dates):
                values = [shared[v.number] if isinstance(v, Shared) else v for v in values]
                if names is None:
                    names = header_names(values)
                    continue
                if held is not None:
                    yield held[1]
                held = values, {name: values[i] if i < len(values) else None for i, name in enumerate(names)}
        if held is not None and any(v is not None for v in held[0]):
            yield held[1]


class XlsxSource(DataSource):
    """spark.dataSource.register(XlsxSource); spark.read.format("xlsx").load(path). Files of the machine, one task each; `read` splits them."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "row_index bigint, raw string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        with open(partition.value, "rb") as file:
            for i, record in enumerate(records(file.read())):
                yield i, json.dumps(record, ensure_ascii=False)


def pieces(books: DataFrame, size: int = PIECE) -> DataFrame:
    """books (path, content) to (path, first, head, body, dates): the rows of each first sheet in pieces."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as book:
                    dates = sorted(_date_styles(book))
                    for piece in sheet_pieces(book, size):
                        yield pd.DataFrame({"path": [path], "first": [piece.first], "head": [piece.head], "body": [piece.body], "dates": [dates]})

    return books.select("path", "content").mapInPandas(of, "path string, first bigint, head binary, body binary, dates array<int>")


def _strings(books: DataFrame) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as book:
                    yield from _framed(((path, i, json.dumps(text, ensure_ascii=False)) for i, text in shared_strings(book)), ["path", "shared", "text"])

    return books.select("path", "content").mapInPandas(of, "path string, shared bigint, text string")


def _framed(rows: Iterable[tuple], names: list[str], most: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def cells(cut_pieces: DataFrame) -> DataFrame:
    """pieces to (path, row, cells): a row number from 1, and (at, value, shared) for each cell that isn't empty, value as JSON."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, head, body, dates in batch.itertuples(index=False):
                rows = rows_of(Piece(first, head, body), set(dates))
                yield from _framed(((path, number, [_stored(at, v) for at, v in enumerate(values) if v is not None]) for number, values in rows), ["path", "row", "cells"])

    return cut_pieces.mapInPandas(of, "path string, row bigint, cells array<struct<at: int, value: string, shared: bigint>>")


def _stored(at: int, value: Any) -> dict[str, Any]:
    if isinstance(value, Shared):
        return {"at": at, "value": None, "shared": value.number}
    return {"at": at, "value": json.dumps(value, ensure_ascii=False), "shared": None}


def _named(rows: pd.Series) -> pd.Series:
    """Header cells (at, JSON) as the names of columns, each as JSON."""
    def names(found: Any) -> list[str]:
        values = {c["at"]: json.loads(c["value"]) for c in found}
        return [json.dumps(n, ensure_ascii=False) for n in header_names([values.get(i) for i in range(max(values, default=-1) + 1)])]

    return rows.map(names)


def parsed(books: DataFrame, size: int = PIECE) -> DataFrame:
    """books (path, content) to (path, row_index, raw): the rows below the header as JSON objects, numbered from 0 in each workbook.

    Blank rows inside a sheet are kept, one at its end isn't. A workbook without rows gives none. The same path twice is read
    as one workbook of repeated rows, so paths are to be distinct. Cells beyond the last header name have no name and drop out."""
    tasks = books.sparkSession.sparkContext.defaultParallelism
    rows = cells(pieces(books, size).repartition(tasks, "path", "first"))
    each = rows.select("path", "row", F.explode_outer("cells").alias("c")).select("path", "row", "c.*")
    # cells with a value of their own look for a number that no string has, each in a place of its own
    each = each.withColumn("shared", F.coalesce("shared", -1 - F.col("row")))
    filled = each.join(_strings(books), ["path", "shared"], "left").withColumn("value", F.coalesce("value", "text"))
    by_row = filled.groupBy("path", "row").agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value"))).alias("cells"))
    # no task can tell which row is the last of its workbook
    ends = by_row.groupBy("path").agg(F.max("row").alias("last"), F.max(F.when(F.col("row") == 1, F.col("cells"))).alias("header"))
    ends = ends.select("path", "last", F.pandas_udf(_named, "array<string>")("header").alias("names"))
    body = by_row.where("row > 1").join(ends, "path").where((F.col("row") < F.col("last")) | (F.size("cells") > 0))
    return body.select("path", (F.col("row") - 2).alias("row_index"), _object(F.col("names"), F.map_from_entries("cells")).alias("raw"))


def _object(names: Column, values: Column) -> Column:
    pairs = F.transform(names, lambda name, i: F.concat(name, F.lit(": "), F.coalesce(F.try_element_at(values, i), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, raw) of a workbook anywhere Spark reads, through its binary files."""
    return parsed(spark.read.format("binaryFile").load(path)).drop("path")


def _cell(value: Any, at: str, style: str = "") -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"{style}><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"{style}><v>{value}</v></c>'
    if not isinstance(value, str):
        value = json.dumps(value, ensure_ascii=False)
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", value)
    return f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write(path: str | IO[bytes], names: list[str], rows: Iterable[list[Any]]) -> None:
    """A workbook of one sheet: a bold header that stays in view, with filters; objects as JSON."""
    kinds = "http://schemas.openxmlformats.org"
    main, package = f"{kinds}/spreadsheetml/2006/main", f"{kinds}/package/2006"
    body = ["".join(_cell(n, f"{_letters(i)}1", ' s="1"') for i, n in enumerate(names))]
    body += ["".join(_cell(v, f"{_letters(i)}{r}") for i, v in enumerate(row)) for r, row in enumerate(rows, 2)]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{kinds}/officeDocument/2006/relationships"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{kinds}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>' + "".join(f'<row r="{i}">{x}</row>' for i, x in enumerate(body, 1)) + f'</sheetData><autoFilter ref="A1:{_letters(max(len(names) - 1, 0))}{len(body)}"/></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)


def books(frame: DataFrame, book: Column, order: Column, names: list[str]) -> DataFrame:
    """(path, content): a workbook for each value of `book`, its rows in that order, the columns `names` as cells.

    A workbook is made by one task, which holds its rows: keep to what a sheet can hold, 1,048,575 rows."""
    def made(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        values = rows.sort_values("order__")[names].astype(object)
        write(out, names, values.where(values.notna(), None).values.tolist())
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    keyed = frame.select(book.cast("string").alias("book__"), order.alias("order__"), *names)
    return keyed.groupBy("book__").applyInPandas(made, "path string, content binary")
