"""Workbooks (xlsx): cells of all sheets as a table, typed sheets, sheet lists.

Spark hands the files of a folder to its tasks; a task unzips one workbook at
a time and streams its sheets row by row. Everything after that, including
column types, is worked out by Spark over the table of rows.
"""

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import SourceError
from tablewright.scratch import written

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = set(range(14, 23)) | {45, 46, 47}  # built-in number formats that show dates or times
_EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
_ROWS_PER_BATCH = 5_000

ROWS = "path string, sheet string, sheet_no int, row_no int, kinds array<string>, cells array<string>"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("sheet", pa.string()),
        ("sheet_no", pa.int32()),
        ("row_no", pa.int32()),
        ("kinds", pa.list_(pa.string())),
        ("cells", pa.list_(pa.string())),
    ]
)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, item in ElementTree.iterparse(f):
            if item.tag == _MAIN + "si":
                out.append(_text(item))
                item.clear()
    return out


def _text(item) -> str:
    """Text of an item without phonetic runs."""
    parts = [t.text or "" for t in item.findall(_MAIN + "t")]
    parts += [t.text or "" for t in item.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(parts)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for f in root.iter(_MAIN + "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        own[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", code, re.IGNORECASE))
    out = set()
    for i, style in enumerate(root.findall(f"{_MAIN}cellXfs/{_MAIN}xf")):
        number = int(style.get("numFmtId", 0))
        if own.get(number, number in _DATE_FORMATS):
            out.add(i)
    return out


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) of each sheet in order, and whether days count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    parts = {link.get("Id"): link.get("Target").lstrip("/") for link in links}
    settings = root.find(_MAIN + "workbookPr")
    since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    found = []
    for sheet in root.iter(_MAIN + "sheet"):
        part = parts[sheet.get(_LINK)]
        found.append((sheet.get("name"), part if part.startswith("xl/") else "xl/" + part))
    return found, since_1904


def _column_index(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _cell(c, strings: list[str], dates: set[int], epoch: datetime.datetime) -> tuple[str | None, str | None]:
    kind, value = c.get("t", "n"), c.find(_MAIN + "v")
    if kind == "inlineStr":
        inner = c.find(_MAIN + "is")
        return "text", _text(inner) if inner is not None else ""
    if value is None or value.text is None or kind == "e":
        return None, None
    if kind == "s":
        return "text", strings[int(value.text)]
    if kind == "b":
        return "boolean", "true" if value.text == "1" else "false"
    if kind in ("str", "d"):
        return "text" if kind == "str" else "date", value.text
    if int(c.get("s", 0)) in dates:
        micros = round(float(value.text) * 86_400_000_000)
        return "date", (epoch + datetime.timedelta(microseconds=micros)).isoformat(" ")
    number = float(value.text)
    if number.is_integer() and abs(number) < 2**53:
        return "integer", str(int(number))
    return "float", repr(number)


def _rows(path: str, content: bytes, only: str | None) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        sheets, since_1904 = _sheets(book)
        for sheet_no, (sheet, part) in enumerate(sheets):
            if only is not None and sheet != only:
                continue
            empty = True
            with book.open(part) as f:
                row_no = 0
                for _, row in ElementTree.iterparse(f):
                    if row.tag != _MAIN + "row":
                        continue
                    row_no = int(row.get("r", row_no + 1))
                    kinds: list = []
                    cells: list = []
                    for c in row.findall(_MAIN + "c"):
                        at = _column_index(c.get("r")) if c.get("r") else len(cells)
                        kinds += [None] * (at - len(kinds)) + [None]
                        cells += [None] * (at - len(cells)) + [None]
                        kinds[at], cells[at] = _cell(c, strings, dates, _EPOCHS[since_1904])
                    row.clear()
                    empty = False
                    yield path, sheet, sheet_no, row_no, kinds, cells
            if empty:  # an empty sheet is still listed
                yield path, sheet, sheet_no, 0, [], []


def _decode(only: str | None):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                for row in _rows(path, content.as_py(), only):
                    pending.append(row)
                    if len(pending) >= _ROWS_PER_BATCH:
                        yield _batch(pending)
                        pending = []
        if pending:
            yield _batch(pending)

    return decode


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, f.type) for values, f in zip(zip(*rows), _ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def workbook_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """All rows of all workbooks under ``path`` (or of one sheet of each): see ``ROWS`` for the columns."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS]*").load(path)
    old = found.filter(~F.lower("path").endswith(".xlsx")).select("path").first()
    if old is not None:
        raise SourceError(f"'{old['path']}' is not a workbook of the newer format")
    files = found.select("path", "content")
    # Spark packs small files into a task up to spark.sql.files.maxPartitionBytes; a larger one has a task of its own.
    return files.mapInArrow(_decode(sheet), ROWS)


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheets of each workbook in order, with their exact number of rows below the header."""
    rows = workbook_rows(spark, path)
    counted = rows.groupBy("path", "sheet_no", "sheet").agg(F.count_if(F.col("row_no") > 0).alias("filled"))
    return counted.select("path", "sheet_no", "sheet", F.greatest(F.lit(0), F.col("filled") - 1).alias("row_count"))


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of every workbook under ``path`` as a typed table; the first row names the columns.

    Without a name the first sheet is read. All workbooks must share one
    header. A column of integers, floats, booleans or dates gets that type;
    anything mixed is text.
    """
    rows = workbook_rows(spark, path, sheet)
    if sheet is None:
        rows = rows.filter("sheet_no = 0")
    # Decoding is the costly part: the rows are written once and then read for header, types and values.
    filled = written(rows.filter("row_no > 0"))
    first = filled.groupBy("path").agg(F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("header_row"))
    headers = first.select("header").distinct().limit(2).collect()
    if not headers:
        raise SourceError(f"no sheet '{sheet}' in '{path}'" if sheet else f"no rows in '{path}'")
    if len(headers) > 1:
        raise SourceError("the workbooks do not share one header")
    names = [name or f"__UNNAMED__{i}" for i, name in enumerate(headers[0]["header"])]
    # One line per workbook: a path and a number each.
    body = filled.join(first.select("path", "header_row"), "path").filter(F.col("row_no") > F.col("header_row"))
    dtypes = _column_types(body, len(names))
    cells = [_typed(F.get("cells", F.lit(i)), dtype).alias(name) for i, (name, dtype) in enumerate(zip(names, dtypes))]
    return body.select(*cells)


def _column_types(body: DataFrame, width: int) -> list[T.DataType]:
    wanted: list[Column] = []
    for i in range(width):
        kind = F.get("kinds", F.lit(i))
        wanted += [F.count_if(kind == k) for k in ("integer", "float", "boolean", "date", "text")]
    found = list(body.agg(*wanted).first()) if wanted else []
    out: list[T.DataType] = []
    for i in range(width):
        integers, floats, booleans, dates, texts = found[5 * i : 5 * i + 5]
        some = integers + floats + booleans + dates + texts
        if some and integers == some:
            out.append(T.LongType())
        elif some and integers + floats == some:
            out.append(T.DoubleType())
        elif some and booleans == some:
            out.append(T.BooleanType())
        elif some and dates == some:
            out.append(T.TimestampNTZType())
        else:
            out.append(T.StringType())
    return out


def _typed(cell: Column, dtype: T.DataType) -> Column:
    return cell if isinstance(dtype, T.StringType) else cell.cast(dtype)
