"""Rows of CSV files: by lines, so that many tasks share a file, or whole where a quoted cell spans lines.

csv_lines() reads the files as text, in splits. A first pass, in columns, learns of each file its first line, whether
all of it is UTF-8, and whether a line has an odd number of quotes, as where a quoted cell goes on in the next line. All other files are
parsed line by line in Arrow batches, so a task holds a batch whatever the file's size; headers, one row a file, meet the rows
afterwards. What has such a line is read whole, one file at a time.

row_seq rises with the row: it counts the rows of a file's first split from 0, and those of a later split from the byte at which
that begins, so no pass is needed to number them.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as missing in a cell.
NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Headers of so many files are sent to every task; more meet the rows by a join.
MAX_BROADCAST_FILES = 200_000


def _endless_cells() -> None:
    """A cell may be as long as it is."""
    csv.field_size_limit(1 << 62)


def whole_rows(content: bytes) -> Iterator[dict]:
    """The cells of every row of a file by lower-cased header."""
    _endless_cells()
    try:
        body = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        body = content.decode("latin-1")
    for i, row in enumerate(csv.DictReader(io.StringIO(body, newline=""))):
        yield {"row_seq": i, "cells": {str(k).lower().strip(): None if v in NA else v for k, v in row.items() if k is not None}}


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, place, line): every line of the CSV files, as bytes, with the first byte of its split and a number that rises in it."""
    scan = spark.read.option("recursiveFileLookup", "true").text(paths)
    return scan.filter(F.lower("_metadata.file_name").endswith(".csv")).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))


def survey(lines: DataFrame) -> DataFrame:
    """(path, first, latin, spans): per file its first line, whether it isn't UTF-8, and whether it must be read whole."""
    line = F.col("line").cast("string")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1
    return lines.groupBy("path").agg(F.min_by("line", F.struct("block", "place")).alias("first"), F.bool_or(~F.is_valid_utf8(line)).alias("latin"), F.bool_or(odd).alias("spans"))


def _cells(line: bytes) -> tuple[list[str], bool]:
    """A line's cells and whether it isn't UTF-8."""
    try:
        text, latin = line.decode(), False
    except UnicodeDecodeError:
        text, latin = line.decode("latin-1"), True
    return next(csv.reader([text]), []), latin


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of every row that isn't blank, numbered in its split; a file's first line is left out."""
    _endless_cells()
    at, k = None, 0
    for batch in batches:
        rows = []
        for path, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (path, block):
                at, k = (path, block), 0
                if block == 0:
                    continue
            cells, latin = _cells(line)
            if cells:
                rows.append((path, block + k, cells, latin))
                k += 1
        path, number, cells, latin = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(number, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array(latin, pa.bool_())], names=["path", "row_seq", "row", "odd"])


def _headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file the different names of its header and the last column of each."""
    for batch in batches:
        names, places = [], []
        for first, latin in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = (first or b"").decode("latin-1" if latin else "utf-8-sig")
            found = {c.lower().strip(): i for i, c in enumerate(next(csv.reader([text]), []))}
            names.append(list(found))
            places.append(list(found.values()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], names=["path", "latin", "names", "places"])


def csv_lines(lines: DataFrame, found: DataFrame, few: bool = True) -> DataFrame:
    """(path, row_seq, cells) of the files that can be read by lines; `found` is survey()'s table, of few files if its rows may go to every task."""
    rows = lines.select("path", "block", "line").mapInArrow(_numbered, "path string, row_seq long, row array<string>, odd boolean")
    heads = found.filter("NOT spans").select("path", "first", "latin").mapInArrow(_headers, "path string, latin boolean, names array<string>, places array<int>")
    each = rows.join(F.broadcast(heads) if few else heads, "path")
    again = F.transform("row", lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"))  # a line that happens to be UTF-8 in a file that isn't
    row = F.when(F.col("latin") & ~F.col("odd"), again).otherwise(F.col("row"))
    each = each.withColumn("row", row)
    value = F.transform("places", lambda i: F.get("row", i))
    return each.select("path", "row_seq", F.map_from_arrays("names", F.transform(value, lambda v: F.when(~v.isin(NA), v))).alias("cells"))
