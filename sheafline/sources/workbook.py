"""Bulk ingest of many spreadsheet workbooks: one task per file, sheet rows streamed out.

The format caps a sheet at 1,048,576 rows, so a file is a bounded unit of work; parallelism comes
from the number of files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = (
    "file string, sheet string, sheet_ord int, row_idx long, columns array<string>, "
    "cells array<string>, error string"
)
ROWS_PER_FRAME = 5000

# Cell texts that spreadsheet readers in Python take for a missing value.
NULL_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Names of the workbook format (ECMA-376).
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text_of(node) -> str:
    """Visible text of a string item: its runs, without phonetic hints."""
    parts = []
    for child in node:
        if child.tag == f"{MAIN}t":
            parts.append(child.text or "")
        elif child.tag == f"{MAIN}r":
            parts += [t.text or "" for t in child.findall(f"{MAIN}t")]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(parts))


def _column_index(ref: str) -> int:
    index = 0
    for ch in ref:
        if not ch.isalpha():
            break
        index = index * 26 + ord(ch.upper()) - 64
    return index - 1


def _cell_value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        item = cell.find(f"{MAIN}is")
        return None if item is None else _text_of(item)
    raw = cell.findtext(f"{MAIN}v")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "1" if raw == "1" else "0"
    return raw


def _sheet_rows(stream, shared: list[str]) -> Iterator[list[str | None]]:
    expected = 1
    for _, node in ElementTree.iterparse(stream):
        if node.tag != f"{MAIN}row":
            continue
        number = int(node.get("r", expected))
        for _gap in range(expected, number):
            yield []
        expected = number + 1
        values: list[str | None] = []
        for cell in node.findall(f"{MAIN}c"):
            at = _column_index(cell.get("r", "")) if cell.get("r") else len(values)
            values += [None] * (at - len(values)) + [_cell_value(cell, shared)]
        while values and values[-1] is None:  # formatted cells without content
            values.pop()
        yield values
        node.clear()


def _without_trailing_blanks(rows: Iterator[list[str | None]]) -> Iterator[list[str | None]]:
    """Blank rows in the middle stay; those after the last cell with content go."""
    waiting = 0
    for values in rows:
        if not values:
            waiting += 1
            continue
        for _blank in range(waiting):
            yield []
        waiting = 0
        yield values


def _open_sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    found = []
    for sheet in sheets:
        target = targets[sheet.get(REL_ID)]
        found.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as stream:
        return [_text_of(node) for _, node in ElementTree.iterparse(stream) if node.tag == f"{MAIN}si"]


def _column_names(cells: list[str | None]) -> list[str]:
    """Header cells as unique names: blanks become ``Unnamed: i``, repeats get ``.1``, ``.2`` …"""
    names: list[str] = []
    for i, cell in enumerate(cells):
        base = f"Unnamed: {i}" if cell is None else cell
        name, repeat = base, 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return names


def _decode_file(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of one file. A broken sheet, or file, yields one row with ``error`` set."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        sheets, shared = _open_sheets(book), _shared_strings(book)
    except Exception as exc:
        yield path, None, None, None, None, None, f"Error opening file: {exc}"
        return
    for order, (name, member) in enumerate(sheets, start=1):
        try:
            with book.open(member) as stream:  # a cell right of the header widens the sheet
                width = max(map(len, _sheet_rows(stream, shared)), default=0)
            with book.open(member) as stream:
                rows = _sheet_rows(stream, shared)
                first = next(rows, [])
                header = _column_names(first + [None] * (width - len(first)))
                yield path, name, order, None, header, None, None
                for index, values in enumerate(_without_trailing_blanks(rows)):
                    yield path, name, order, index, header, values + [None] * (width - len(values)), None
        except Exception as exc:
            yield path, name, order, None, None, None, f"Error reading sheet {name}: {exc}"


def decode_workbooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "sheet", "sheet_ord", "row_idx", "columns", "cells", "error"]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            rows: list[tuple] = []
            for row in _decode_file(path, content):
                rows.append(row)
                if len(rows) >= ROWS_PER_FRAME:
                    yield pd.DataFrame(rows, columns=columns).astype(object)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype(object)


def ingest_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Raw rows of all workbooks below ``path``.

    Per sheet one header row (``row_idx`` null) comes with the column names, so empty sheets stay
    visible; an unreadable sheet or file is a row with ``error``. Write this once; ``corpus_rows``,
    ``sheet_headers`` and ``ingest_errors`` are cheap views of the written table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return decode(files)


def decode(files: DataFrame) -> DataFrame:
    """``ingest_workbooks`` for a table of ``path, content``."""
    return files.select("path", "content").mapInPandas(decode_workbooks, ROW_SCHEMA)


def corpus_rows(raw: DataFrame) -> DataFrame:
    """``file, sheet, sheet_ord, row_idx, text, label STRING`` and all other cells in ``extra``.

    Labels stay text so that validation sees what was written. A cell that a sheet has no column for
    is null.
    """
    data = raw.filter(F.col("row_idx").isNotNull())
    named = F.map_from_arrays("columns", "cells")

    def cell(name: str):
        at = F.array_position("columns", name)
        value = F.when(at > 0, F.get("cells", (at - 1).cast("int")))
        return F.when(~value.isin(*NULL_MARKERS), value)

    rest = F.map_filter(named, lambda k, v: ~k.isin("text", "label"))
    return data.select(
        "file",
        "sheet",
        "sheet_ord",
        "row_idx",
        cell("text").alias("text"),
        cell("label").alias("label"),
        F.array_contains("columns", "label").alias("has_label"),
        rest.alias("extra"),
    )


def sheet_headers(raw: DataFrame) -> DataFrame:
    """Readable sheets with their column names."""
    header = F.col("row_idx").isNull() & F.col("error").isNull()
    return raw.filter(header).select("file", "sheet", "sheet_ord", "columns")


def ingest_errors(raw: DataFrame) -> DataFrame:
    """Unreadable sheets and files."""
    return raw.filter(F.col("error").isNotNull()).select("file", "sheet", "sheet_ord", "error")


def encode_workbook(sheets: list[tuple[str, list[str], list[list]]]) -> bytes:
    """A minimal workbook: ``(sheet name, header, rows)``; numbers stay numbers, None is a blank."""

    def cell(value) -> str:
        if value is None or value != value:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c><v>{value}</v></c>"
        safe = re.sub(r"[\x00-\x08\x0b-\x1f]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", str(value))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(safe)}</t></is></c>'

    space = MAIN.strip("{}")
    rels = REL_ID[1:].partition("}")[0]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as book:
        listing, links = "", ""
        for i, (name, header, rows) in enumerate(sheets, start=1):
            listing += f"<sheet name={quoteattr(name)} sheetId=\"{i}\" r:id=\"rId{i}\"/>"
            links += f'<Relationship Id="rId{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>'
            lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [header, *rows])
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{space}"><sheetData>{lines}</sheetData></worksheet>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{rels}"><sheets>{listing}</sheets></workbook>')
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        )
    return packed.getvalue()


def pack_workbooks(df: DataFrame, rows_per_book: int = 500) -> DataFrame:
    """``path, content``: the rows of ``sheet, row_idx, text, label`` as workbooks of bounded size.

    A book holds one run of ``rows_per_book`` rows of one sheet, so a hot sheet becomes many books.
    """

    @F.pandas_udf("binary")
    def pack(sheet: pd.Series, rows: pd.Series) -> pd.Series:
        packed = []
        for name, records in zip(sheet, rows):
            table = [[r["text"], r["label"]] for r in records]
            packed.append(encode_workbook([(name, ["text", "label"], table)]))
        return pd.Series(packed)

    book = F.floor(F.col("row_idx") / F.lit(rows_per_book)).alias("book")
    grouped = df.groupBy("sheet", book).agg(F.sort_array(F.collect_list(F.struct("row_idx", "text", "label"))).alias("rows"))
    name = F.concat_ws("/", "sheet", F.concat(F.col("book").cast("string"), F.lit(".xlsx")))
    return grouped.select(name.alias("path"), pack("sheet", "rows").alias("content"))
