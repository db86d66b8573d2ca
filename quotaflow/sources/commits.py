"""Commit pointers: which version of a dataset readers may see.

A writer first writes a version's data under its id and then, as its last step,
one small file with that id in the dataset's ``commits`` folder. Readers take
the greatest committed id and scan that version's partition only: a version
whose writer died before the commit is never seen, and no reader opens the
data of all versions to find the newest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "version string, facts string"


def commit(spark: SparkSession, root: str, version: str, facts: str = "") -> None:
    """Make ``version`` visible, with what readers should know of it. Committing
    an id again replaces its file."""
    spark.createDataFrame([(version, facts)], _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{version}")


def newest(spark: SparkSession, root: str, before: str | None = None) -> tuple[str, str] | None:
    """(version, facts) of the greatest committed id (below ``before``); None
    when there is none."""
    try:
        marks = spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    top = marks.where(F.lit(True) if before is None else F.col("version") < before).agg(F.max(F.struct("version", "facts")).alias("top")).first()["top"]
    return (top["version"], top["facts"]) if top else None


def at_version(df: DataFrame, column: str, version: str) -> DataFrame:
    """The rows of one version: a literal on the partition column, so that the
    scan lists that partition's files only."""
    return df.where(F.col(column) == F.lit(version).cast(df.schema[column].dataType))
