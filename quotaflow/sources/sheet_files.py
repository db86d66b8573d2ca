"""Sheets as files: one folder of CSV files per portfolio.

Layout: ``root/portfolio_id=<id>/<files>``, the files of a folder being one
sheet in name order; names that end in .gz are compressed. A record is one line; cells are parted by commas
and may be quoted with doubled inner quotes. Rows may be ragged; a sheet is as
wide as its widest row and shorter rows end in empty cells.

Many small sheets come packed instead: ``root/packed=1/<files>.txt``, plain text
whose records begin with the sheet's portfolio id and a comma. A sheet's records
stand together in a file and go on in the next file by name, so the number of
files follows the bytes, not the sheets. Records without an id belong to no
sheet; compressed files are not read there.

Sheets are read by byte ranges, so a sheet that holds a third of all rows is
read by many tasks. A row's number comes from where it was read: the ranges of
a sheet stand in the order (file, start of range), a range's first row follows
the rows of all ranges before it (a running sum over ranges, not rows), and
within a range rows keep the order of reading.

``source_ledger`` says of every expected source whether it can be used. A source
that can't contributes nothing and fails nobody else (P4).

Defined results: blank lines are rows of empty cells; a byte-order mark at a
sheet's start is dropped; bytes that are no UTF-8 become U+FFFD; a file that
cannot be decompressed to its end makes its whole source unusable; an expected
source without a row is listed as missing; folders that nobody expects are read
and listed only where no list of sources is given.
"""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotaflow.session import stage

USABLE, MISSING, EMPTY, NARROW, UNREADABLE = "ok", "missing", "empty", "narrow", "unreadable"
MANUAL_COLUMNS = 4  # the manual sheet's columns, whatever their names (fixed value)
_ROWS = "portfolio_id long, row_idx long, width int, cells array<string>"
_CELL = r',("[^"]*(?:""[^"]*)*"|[^,]*)'

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def csv_cells(line: Column) -> Column:
    """The cells of one CSV record. Lines without a quote are split only; in the
    others each cell is matched with the comma before it, then unquoted."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), 1)
    plain = lambda c: F.when(
        c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(line.contains('"'), F.transform(quoted, plain)).otherwise(F.split(line, ",", -1))


def csv_line(cells: Column) -> Column:
    """One CSV record of an array of cells; null cells are empty."""
    def quoted(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        return F.when(c == "", c).when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.array_join(F.transform(cells, quoted), ",")


def read_sheets(spark: SparkSession, root: str) -> DataFrame:
    """All rows of all sheets under ``root``: (portfolio_id, row_idx, width,
    cells), ``row_idx`` from 0 in sheet order and ``width`` the sheet's. The
    lines are written once to the shared folder, so that ranges and rows are
    those of one reading."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(root)
    portfolio, record = F.col("portfolio_id").cast("long"), F.col("value")
    if "packed" in lines.columns:
        lines = spark.read.option("pathGlobFilter", "*.txt").text(root)
        head = F.substring_index("value", ",", 1)
        portfolio, record = head.try_cast("long"), F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    elif "portfolio_id" not in lines.columns:  # no file at all
        return spark.createDataFrame([], _ROWS)
    read = stage(lines.select(
        portfolio.alias("portfolio_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), csv_cells(record).alias("cells")).withColumn(
            "task", F.shiftright("seq", 33)), "sheet-rows")
    # A task reads a file's range at one go, so the ranges' numbers of reading do not
    # overlap: rows meet their range by these, without the file's name.
    key = ["portfolio_id", "task", "block"]
    ranges = read.groupBy(*key, "file").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"),
                                            F.max(F.size("cells")).alias("widest"))
    sheet = Window.partitionBy("portfolio_id")
    before = sheet.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*key, "first", "last", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                           F.max("widest").over(sheet).alias("width"))
    rows = read.drop("file").join(ranges, key).where(F.col("seq").between(F.col("first"), F.col("last")))
    rows = rows.withColumn("row_idx", F.col("start") + F.col("seq") - F.col("first"))
    mark = F.transform("cells", lambda c, i: F.when(i == 0, F.regexp_replace(c, "^﻿", "")).otherwise(c))
    return rows.select("portfolio_id", "row_idx", "width", F.when(F.col("row_idx") == 0, mark).otherwise(F.col("cells")).alias("cells"))


def _cut_short(batches):
    """Names of the gzip files that do not decompress to their end; only a
    window of each file's decompressed bytes is held."""
    for batch in batches:
        bad = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            left, good = content, len(content) > 0
            while good and left:
                unpacker = zlib.decompressobj(zlib.MAX_WBITS | 16)
                try:
                    while left and not unpacker.eof:
                        unpacker.decompress(left, 1 << 20)
                        left = unpacker.unconsumed_tail if not unpacker.eof else unpacker.unused_data
                except zlib.error:
                    good = False
                good = good and unpacker.eof
            if not good:
                bad.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["path"])


def unreadable_sources(spark: SparkSession, root: str) -> DataFrame:
    """(portfolio_id) of the sheets with a file that is no whole gzip stream."""
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(root)
    if "portfolio_id" not in packed.columns:  # no such file
        return spark.range(0).withColumnRenamed("id", "portfolio_id")
    bad = packed.select("path", "content").mapInArrow(_cut_short, "path string")
    return bad.select(F.regexp_extract("path", r"portfolio_id=(\d+)/", 1).cast("long").alias("portfolio_id")).distinct()


def source_ledger(spark: SparkSession, root: str, rows: DataFrame, min_width: int, sources: DataFrame | None = None,
                  header: bool = False) -> DataFrame:
    """(portfolio_id, status, n_rows, width) of every source: those of
    ``sources`` (portfolio_id), or all that have a folder. ``n_rows`` counts data
    rows, without a headed sheet's first; ``min_width`` columns are needed."""
    found = rows.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"))
    bad = unreadable_sources(spark, root).withColumn("bad", F.lit(True))
    expected = (sources.select("portfolio_id") if sources is not None
                else found.select("portfolio_id").unionByName(bad.select("portfolio_id"))).distinct()
    n_rows = F.coalesce(F.col("n") - (1 if header else 0), F.lit(0))
    status = (F.when(F.col("bad"), UNREADABLE).when(F.col("n").isNull(), MISSING).when(F.col("width") < min_width, NARROW)
              .when(n_rows <= 0, EMPTY).otherwise(USABLE))
    return expected.join(found, "portfolio_id", "left").join(bad, "portfolio_id", "left").select(
        "portfolio_id", status.alias("status"), n_rows.alias("n_rows"), F.coalesce("width", F.lit(0)).alias("width"))


def usable(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of usable sources only: an unusable one contributes nothing. The
    ids of the unusable ones are written first, so that few of them are broadcast
    and the rows are not shuffled for them."""
    return rows.join(stage(ledger.where(F.col("status") != USABLE).select("portfolio_id"), "unusable"), "portfolio_id", "left_anti")


def positional(rows: DataFrame, n_columns: int) -> DataFrame:
    """(portfolio_id, row_idx, _c0, _c1, ...), every cell as text; null
    stands for a column that the sheet does not have."""
    cell = lambda i: F.when(F.col("width") > i, F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(f"_c{i}")
    return rows.select("portfolio_id", "row_idx", *[cell(i) for i in range(n_columns)])


def headed(rows: DataFrame) -> DataFrame:
    """(portfolio_id, row_idx, ticker, asset_type_raw, quantity_raw,
    value_raw): a sheet's first four columns without its header row."""
    names = ["ticker", "asset_type_raw", "quantity_raw", "value_raw"]
    data = positional(rows.where(F.col("row_idx") > 0), MANUAL_COLUMNS)
    return data.select("portfolio_id", F.col("row_idx") - 1, *[f"_c{i}" for i in range(MANUAL_COLUMNS)]).toDF(
        "portfolio_id", "row_idx", *names)
