"""Scans and sinks.

Sheets are CSV files read as all-text columns; rate payloads are JSON arrays
parsed on the executors; snapshots are Parquet datasets partitioned by a
snapshot id, so a reader picks the newest complete snapshot and a writer never
clears the target in place.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quotaflow.functions import text as T
from quotaflow.sources import commits as CM
from quotaflow.sources.sheet_files import csv_cells

# Fixed values (must equal the reference's).
SELIC_NAME = "SELIC"
SNAPSHOT_COLUMNS = ["ticker", "asset_type", "price", "market_value", "price_to_book", "dy_12m", "sector"]
_JSON_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\)|BOOLEAN)$"


# ------------------------------------------------------------------ sheets
def read_sheet(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """One sheet, every cell as text. Headerless sheets get positional
    names ``_c0.._cN``, as many as the widest row has cells; headed sheets keep
    their header names. For many sheets with their row order see ``sheet_files``."""
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if header:
        return reader.option("inferSchema", False).csv(path)
    width = spark.read.text(path).agg(F.max(F.size(csv_cells(F.col("value"))))).first()[0] or 0
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
    return reader.schema(schema).csv(path)


def headed_first_four(sheet: DataFrame) -> DataFrame | None:
    """The first four columns, whatever their names, renamed; ``None``
    when the sheet has fewer than four (the source is then not used)."""
    cols = [c for c in sheet.columns if c not in ("portfolio_id", "row_idx")]
    if len(cols) < 4:
        return None
    keep = [c for c in ("portfolio_id", "row_idx") if c in sheet.columns]
    return sheet.select(*keep, *[F.col(f"`{c}`") for c in cols[:4]]).toDF(
        *keep, "ticker", "asset_type_raw", "quantity_raw", "value_raw")


# ----------------------------------------------------------------- locator
def locate(url: Column) -> Column:
    """S3: URL -> struct(doc_id, tab_id). doc_id = segment after '/d/' (after
    '/d/e/' for published links), the whole URL when there is no '/d/';
    tab_id = first 'gid=<digits>'; empty URL -> (null, null)."""
    after = F.split_part(url, F.lit("/d/"), F.lit(2))
    rest = F.substring(after, 3, F.length(after))
    part = F.when(after.startswith("e/"),
                  F.when(rest.contains("/"), F.split_part(after, F.lit("/"), F.lit(2))).otherwise(rest)).otherwise(after)
    doc = F.when(url.contains("/d/"), F.split_part(part, F.lit("/"), F.lit(1))).otherwise(url)
    gid = F.nullif(F.regexp_extract(url, r"gid=(\d+)", 1), F.lit("")).try_cast("bigint")
    empty = url.isNull() | (url == "")
    return F.struct(F.when(~empty, doc).alias("doc_id"), F.when(~empty, gid).alias("tab_id"))


# ------------------------------------------------------------------- rates
def _entries(payloads: DataFrame) -> DataFrame:
    """(series_id, data, rate_date, valor) of all entries; ``valor`` and
    ``rate_date`` are null when their text is no number or date."""
    entries = payloads.select("series_id", F.inline(F.from_json("payload", "array<struct<data:string,valor:string>>")))
    return entries.select("series_id", "data", F.try_to_date("data", "dd/MM/yyyy").alias("rate_date"),
                          T.to_number(F.col("valor")).alias("valor"))


def _last(entries: DataFrame, last_n: int) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy(F.col("rate_date").desc())
    return entries.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last_n).drop("_rn")


def rate_series(payloads: DataFrame, last_n: int | None = None) -> DataFrame:
    """``(series_id, payload)`` rows, each a JSON array of
    ``{data: 'dd/MM/yyyy', valor: text}`` -> ``(series_id, rate_date, valor)``:
    the last ``last_n`` entries by date, then non-numeric values dropped,
    valor as a percent number (divide by 100 for a fraction). A series with a
    date that can't be read has failed as a whole: it gives no rows."""
    bad = F.max(F.col("data").isNotNull() & F.col("rate_date").isNull()).over(Window.partitionBy("series_id"))
    e = _entries(payloads).withColumn("_bad", bad).where(~F.col("_bad")).drop("_bad", "data")
    if last_n is not None:
        e = _last(e, last_n)
    return e.where(F.col("valor").isNotNull() & ~F.isnan("valor") & F.col("rate_date").isNotNull())


def last_entries(payloads: DataFrame, last_n: int) -> DataFrame:
    """The last ``last_n`` entries per series, numeric or not (``valor`` is
    null when the text is not a number)."""
    return _last(_entries(payloads).drop("data"), last_n)


def named_rates(payload: DataFrame) -> DataFrame:
    """S5 input: a JSON array of ``{nome, valor}`` -> ``(pos, nome, valor)``
    where valor is a double only when the JSON value is a number (or a
    boolean, which counts as a number), else null."""
    items = payload.select(F.posexplode(F.from_json("payload", "array<variant>")).alias("pos", "v"))
    raw = F.variant_get("v", "$.valor", "variant")
    numeric = F.coalesce(F.schema_of_variant(raw).rlike(_JSON_NUMBER), F.lit(False))
    return items.select("pos", F.coalesce(F.variant_get("v", "$.nome", "string"), F.lit("")).alias("nome"),
                        F.when(numeric, F.try_variant_get("v", "$.valor", "double")).alias("valor"))


def named_rate(named: DataFrame) -> DataFrame:
    """The first entry (in order) whose upper-cased name holds SELIC and
    whose value is a number -> valor / 100. One row (null when none)."""
    hit = named.where(F.upper(F.col("nome")).contains(SELIC_NAME) & F.col("valor").isNotNull())
    return hit.agg(F.min_by(F.col("valor") / 100, F.col("pos")).alias("rate"))


# --------------------------------------------------------------- snapshots
def write_snapshot(positions: DataFrame, kpis: DataFrame, path: str, ts: _dt.datetime) -> str:
    """Positions (seven columns, nulls -> 0) and totals under one
    snapshot id, each a new partition, then the commit that makes both visible.
    Readers never see an empty, half-cleared or half-written snapshot; writing
    the same id again replaces it."""
    sid = ts.strftime("%Y%m%d%H%M%S")
    stamp = F.lit(ts).cast("timestamp")
    numeric = {"price", "market_value", "price_to_book", "dy_12m"}
    cols = [F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) if c in numeric
            else F.coalesce(F.col(c), F.lit("0")).alias(c) for c in SNAPSHOT_COLUMNS]
    (positions.select("portfolio_id", *cols).withColumn("snapshot_ts", stamp).withColumn("snapshot_id", F.lit(sid))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_id").parquet(f"{path}/positions"))
    (kpis.select("portfolio_id", "total_value", "total_invested").withColumn("snapshot_ts", stamp)
     .withColumn("snapshot_id", F.lit(sid))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_id").parquet(f"{path}/totals"))
    CM.commit(positions.sparkSession, path, sid)
    return sid


def read_latest_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(totals, positions) of the newest committed snapshot. A position row
    whose portfolio has no totals row raises when evaluated (the reference
    fails the whole read, never returning partial data)."""
    found = CM.newest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no committed snapshot under {path}")
    t = CM.at_version(spark.read.parquet(f"{path}/totals"), "snapshot_id", found[0])
    p = CM.at_version(spark.read.parquet(f"{path}/positions"), "snapshot_id", found[0])
    checked = p.join(t.select("portfolio_id", F.lit(True).alias("_has_totals")), "portfolio_id", "left")
    checked = checked.where(F.when(F.col("_has_totals"), F.lit(True))
                            .otherwise(F.raise_error(F.lit("snapshot has no totals row")).cast("boolean"))
                            ).drop("_has_totals")
    return t, checked
