"""Workbooks of zipped XML sheets as tables.

Spark reads the files, from whatever store, and deals them to tasks; a task reads a sheet's XML row by row, so only
the workbook's bytes and its shared strings are held.  All columns are text, as those of a CSV are.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 4096
_CELL = re.compile(r"([A-Z]+)\d+")


def _plain(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The shared strings, runs of rich text joined and phonetic guides left out."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if _plain(node.tag) == "rPh":
                node.clear()
            elif _plain(node.tag) == "si":
                out.append("".join(t.text or "" for t in node.iter() if _plain(t.tag) == "t"))
                node.clear()
    return out


def _target(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The part that holds a sheet, by its name or its place."""
    main = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [n for n in main.iter() if _plain(n.tag) == "sheet"]
    found = sheets[sheet] if isinstance(sheet, int) else next(n for n in sheets if n.get("name") == sheet)
    key = next(v for k, v in found.attrib.items() if _plain(k) == "id")
    for n in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if n.get("Id") == key:
            path = n.get("Target")
            return path.lstrip("/") if path.startswith("/") else f"xl/{path}"
    raise ValueError(f"no part for sheet {sheet}")


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts, empty cells as null; rows without any cell are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _texts(book)
        with book.open(_target(book, sheet)) as f:
            for _, node in ElementTree.iterparse(f):
                if _plain(node.tag) != "row":
                    continue
                row: list[str | None] = []
                for cell in node:
                    at = _CELL.match(cell.get("r") or "")
                    place = _column(at[1]) if at else len(row)
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter() if _plain(t.tag) == "t")
                    else:
                        value = next((v.text for v in cell if _plain(v.tag) == "v"), None)
                        if kind == "s" and value is not None:
                            value = shared[int(value)]
                        elif kind == "b" and value is not None:
                            value = "true" if value == "1" else "false"
                    row += [None] * (place + 1 - len(row))
                    row[place] = value
                node.clear()
                if any(v is not None for v in row):
                    yield row


def read_sheets(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """The table of a sheet in the workbook at path, or of the same sheet in all workbooks of a folder or pattern.

    The first row of a workbook names its columns.  Workbooks may have them in any order; a column that one lacks is
    null there; cells without a name above them are left out; without a workbook, or with empty ones only, there is no column."""
    files = spark.read.format("binaryFile").load(path)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                names = [n.strip() for n in next(sheet_rows(content, sheet), []) if n and n.strip()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(range(len(names)), pa.int32())], ["name", "place"])

    found = files.select("content").mapInArrow(heads, "name string, place int").groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()
    names = [r["name"] for r in found]  # columns of a table
    if not names:
        return spark.createDataFrame([], "struct<>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(rows: list[list[str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = sheet_rows(content, sheet)
                own = {(n or "").strip(): x for x, n in reversed(list(enumerate(next(rows, []))))}
                places, held = [own.get(n, -1) for n in names], []
                for row in rows:
                    held.append([row[p] if 0 <= p < len(row) else None for p in places])
                    if len(held) == BATCH:
                        yield send(held)
                        held = []
                if held:
                    yield send(held)

    return files.select("content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
