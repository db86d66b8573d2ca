"""The position build at size: methods that are compiled, sheets parsed once,
files that follow the bytes."""

import datetime
import glob
import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
from quotaflow.functions import dates as D
from quotaflow.functions import text as T
from quotaflow.operators import positions as P
from quotaflow.session import scratch_path
from quotaflow.sources import sheet_files as SF
from quotaflow.sources import sheet_fixtures as SX

COMPILED = 8000  # bytes of code up to which the JVM compiles a method


def largest_method(df):
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    return max((parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())), default=0)


def test_parses_stay_small_enough_to_be_compiled(spark):
    cells = [f"cast(id as string) _c{i}" for i in range(25)]
    sheet = spark.range(10).selectExpr("id portfolio_id", "id row_idx", *cells)
    path = scratch_path(spark, f"small-{uuid.uuid4().hex}")
    sheet.write.parquet(path)
    sheet = spark.read.parquet(path)
    assert largest_method(P.fund_positions(sheet)) < COMPILED
    assert largest_method(D.with_ex_date(sheet, "_c20", datetime.date(2024, 6, 15))) < COMPILED


def test_plain_and_rare_numbers_read_alike(spark):
    texts = ["12", "12.50", "012", "12\n", "12\u0085", "1_2", "1__2", "12d", ".5", "5.", ".", "", "+3", "-nan", "inf", "1e3", " 7", "٣", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.to_number(F.col("t")).alias("v"))

    def python(t):
        try:
            return None if t is None else float(t)
        except ValueError:
            return None

    for r in df.collect():
        if r.t != "٣":  # Spark's grammar has ASCII digits only
            assert repr(r.v) == repr(python(r.t)), r.t


def test_sheets_are_parsed_once_for_totals_and_rows(spark, sf_small):
    df = E.queries()["weights"](spark, sf_small)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_c5" not in plan.split("Initial Plan")[0]


def test_many_sheets_are_few_files(spark):
    root = scratch_path(spark, f"packed-{uuid.uuid4().hex}")
    cells = [F.concat(F.lit('x,"'), F.col("row_idx").cast("string")).alias(f"_c{i}") for i in range(25)]
    sheet = spark.range(4000).select((F.col("id") % 500).alias("portfolio_id"), F.col("id").alias("row_idx")).select("*", *cells)
    SX.write_sheets(SX.fund_lines(sheet), root)
    assert len(glob.glob(f"{root.removeprefix('file://').removeprefix('file:')}/**/*.txt", recursive=True)) < 50
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # sheets over several ranges
    try:
        got = {}
        for r in SF.read_sheets(spark, root).collect():
            got.setdefault(r.portfolio_id, {})[r.row_idx] = r
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert sorted(got) == [p for p in range(500) if p % 13 != 4]
    for p, rows in got.items():
        assert [rows[i].cells[0] for i in range(8)] == [f'x,"{p + 500 * i}' for i in range(8)]
        assert rows[0].width == (12 if p % 11 == 3 else 18 if p % 11 == 5 else 30 if p % 11 == 7 else 25)


def test_sheet_rows_meet_their_range_by_numbers(spark):
    """neither the file's name nor all cells are sorted and shuffled for the ledger."""
    root = scratch_path(spark, f"packed-{uuid.uuid4().hex}")
    cells = [F.col("row_idx").cast("string").alias(f"_c{i}") for i in range(25)]
    sheet = spark.range(400).select((F.col("id") % 50).alias("portfolio_id"), F.col("id").alias("row_idx")).select("*", *cells)
    SX.write_sheets(SX.fund_lines(sheet), root)
    rows = SF.read_sheets(spark, root)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "file" not in join and "task" in join
    kept = SF.usable(rows, SF.source_ledger(spark, root, rows, 18))
    outer = kept._jdf.queryExecution().executedPlan().toString()
    assert any("BroadcastHashJoin" in line and "LeftAnti" in line for line in outer.splitlines())
    assert kept.select("portfolio_id").distinct().count() == len([p for p in range(50) if p % 13 != 4 and p % 11 != 3])


def scanned(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), " ".join(df.inputFiles())


def test_single_readers_stage_no_positions(spark, sf_small):
    qs = E.queries()
    for name in ["real_income", "agenda", "hierarchy_rollup", "dividend_calendar", "valuation"]:
        plan, files = scanned(qs[name](spark, sf_small))
        assert "/positions-" not in files and "fund_sheet" in files, name
        assert "pf_total_value" not in plan, name  # weights that nobody reads


def test_staged_positions_hold_what_is_read(spark, sf_small):
    qs = E.queries()
    for name, unread in {"opportunities": {"ex_date_text", "quantity", "profit"}, "risk_classify": {"link", "ex_date_text", "invested"},
                         "inventory": {"ex_date_text", "book_value"}, "private_sections": {"monthly_income", "return_pct"}}.items():
        files = [f for f in qs[name](spark, sf_small).inputFiles() if "/positions-" in f]
        assert files and not unread & set(spark.read.parquet(files[0]).columns), name


def test_snapshot_and_agenda_leave_no_row_checkpoint(spark, sf_small):
    for name in ["agenda_month", "agenda_metrics"]:
        plan, files = scanned(E.queries()[name](spark, sf_small))
        assert "/agenda-" in files and "ExistingRDD" not in plan and "LogicalRDD" not in plan, name


def test_brick_sectors_with_blanks_at_the_ends(spark):
    rows = [("  Log\u00edstica\u00a0", True), ("\u2003h\u00edbrido", True), ("Pap\u00e9is / CRI", False), ("", False), (None, False), ("  ", False)]
    df = spark.createDataFrame(rows, "s string, want boolean").select("want", T.is_brick(F.col("s")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
