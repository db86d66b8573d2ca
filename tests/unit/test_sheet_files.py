"""Sheets as ragged CSV files, read by byte ranges."""

import csv
import gzip
import io
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quotaflow.operators import positions as P
from quotaflow.session import scratch_path
from quotaflow.sources import sheet_files as SF


@pytest.fixture
def root(spark):
    path = scratch_path(spark, f"sheets-{uuid.uuid4().hex}").removeprefix("file://").removeprefix("file:")
    os.makedirs(path)
    return path


def put(root, portfolio, name, rows, pack=False, cut=None):
    """Write rows as one CSV file; ``cut`` bytes of a packed file are left off."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    data = out.getvalue().encode()
    data = gzip.compress(data) if pack else data
    folder = f"{root}/portfolio_id={portfolio}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data[:-cut] if cut else data)


def read(spark, root):
    return {(r.portfolio_id, r.row_idx): (r.width, list(r.cells)) for r in SF.read_sheets(spark, root).collect()}


def test_rows_keep_their_order_over_files_and_ranges(spark, root):
    r = random.Random(1)
    want = {}
    for p in range(5):
        at = 0
        rows = [[f"{p}-{i}", *("x" * r.randint(0, 9) for _ in range(r.randint(0, 6)))] for i in range(r.choice([1, 40, 900]))]
        width = max(map(len, rows))
        for k in range(3):  # three files in name order
            part = rows[k * len(rows) // 3:(k + 1) * len(rows) // 3]
            put(root, p, f"part-{k}.csv", part)
            for row in part:
                want[p, at] = (width, row)
                at += 1
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # many ranges a file
    try:
        assert read(spark, root) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_cells_equal_the_csv_module(spark, root):
    r = random.Random(2)
    cells = ["", "a", "R$ 1.234,56", 'say "x"', ",", '"', '""', " b ", "é,ü", "'", "\t", "a\"b,c"]
    rows = [[r.choice(cells) for _ in range(r.randint(1, 7))] for _ in range(300)]
    put(root, 1, "sheet.csv", rows)
    got = read(spark, root)
    assert [got[1, i][1] for i in range(len(rows))] == rows
    line = spark.createDataFrame([(x,) for x in rows], "cells array<string>").select(SF.csv_line(F.col("cells")).alias("v"))
    assert [x or [""] for x in csv.reader([r.v for r in line.collect()])] == rows


def test_byte_order_mark_blank_lines_and_line_ends(spark, root):
    os.makedirs(f"{root}/portfolio_id=1")
    with open(f"{root}/portfolio_id=1/a.csv", "wb") as f:
        f.write("﻿T,1\r\n\r\nU,﻿2".encode())
    assert read(spark, root) == {(1, 0): (2, ["T", "1"]), (1, 1): (2, [""]), (1, 2): (2, ["U", "﻿2"])}


def fund_row(ticker, width=25):
    row = [""] * 25
    row[0], row[5], row[8], row[9], row[11], row[17], row[20], row[24] = ticker, "10,00", "R$ 1.000,50", "9", "8", "8,0%", "31/07", "Shoppings"
    return row[:width]


def test_ledger_and_positions_of_broken_sources(spark, root):
    put(root, 1, "a.csv", [fund_row("AAAA11")])
    put(root, 2, "a.csv", [fund_row("BBBB11", 12)])  # no yield column
    put(root, 3, "a.csv.gz", [fund_row(f"C{a}{b}C11") for a in "ABCDEFGHIJ" for b in "ABCDEFGHIJ"], pack=True, cut=12)
    put(root, 4, "a.csv.gz", [fund_row("DDDD11", 18)], pack=True)  # no date, no sector
    put(root, 5, "a.csv", [])
    put(root, 7, "a.csv", [[*fund_row("EEEE11"), "more", "cells"], fund_row("FFFF11", 18)])
    rows = SF.read_sheets(spark, root)
    sources = spark.createDataFrame([(i,) for i in range(1, 8)], "portfolio_id long")
    ledger = SF.source_ledger(spark, root, rows, P.COL_DY + 1, sources)
    got = {r.portfolio_id: (r.status, r.width) for r in ledger.collect()}
    assert got == {1: ("ok", 25), 2: ("narrow", 12), 3: ("unreadable", got[3][1]), 4: ("ok", 18), 5: ("missing", 0), 6: ("missing", 0),
                   7: ("ok", 27)}
    pos = P.fund_positions(SF.positional(SF.usable(rows, ledger), P.COL_SECTOR + 1)).collect()
    assert {(r.portfolio_id, r.ticker, r.sector, r.ex_date_text, r.price) for r in pos} == {
        (1, "AAAA11", "Shoppings", "31/07", 1000.5), (4, "DDDD11", "Indefinido", "-", 1000.5),
        (7, "EEEE11", "Shoppings", "31/07", 1000.5), (7, "FFFF11", "Indefinido", "", 1000.5)}
    everything = {r.portfolio_id: r.status for r in SF.source_ledger(spark, root, rows, P.COL_DY + 1).collect()}
    assert everything == {1: "ok", 2: "narrow", 3: "unreadable", 4: "ok", 7: "ok"}


def test_headed_sheets(spark, root):
    put(root, 1, "a.csv", [["Papel", "Tipo", "Qtd", "Total", "Obs"], ["ABCD3", "Ação", "2", "R$ 10,00"], ["Total", "", "", ""], ["CDB", "RF", "1", "5,0", "x"]])
    put(root, 2, "a.csv", [["Papel", "Tipo", "Qtd"], ["ABCD3", "Ação", "2"]])
    put(root, 3, "a.csv", [["Papel", "Tipo", "Qtd", "Total"]])
    rows = SF.read_sheets(spark, root)
    ledger = SF.source_ledger(spark, root, rows, SF.MANUAL_COLUMNS, header=True)
    assert {r.portfolio_id: (r.status, r.n_rows) for r in ledger.collect()} == {1: ("ok", 3), 2: ("narrow", 1), 3: ("empty", 0)}
    pos = P.manual_positions(SF.headed(SF.usable(rows, ledger))).orderBy("row_idx").collect()
    assert [(r.portfolio_id, r.row_idx, r.ticker, r.asset_type, r.price) for r in pos] == [
        (1, 0, "ABCD3", "Ação", 10.0), (1, 2, "CDB", "Outros", 5.0)]


def test_an_empty_root_has_no_rows(spark, root):
    rows = SF.read_sheets(spark, root)
    assert rows.count() == 0
    assert SF.source_ledger(spark, root, rows, 4).count() == 0
