"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixkin.operators.skew import HEAVY_SHARE, attach, attach_left, cut as cut_lineage, shared_folder, unused

__all__ = ["BATCH_ROWS", "HEAVY_SHARE", "LOWER", "UPPER", "WORD", "WS", "ascii_lower", "attach", "attach_left", "cut_lineage", "set_aside", "shared_folder", "small_batches", "table", "unused"]

#: White space of the contracts: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after making sure that its session's Arrow batches hold BATCH_ROWS rows at most: texts may be long, and a worker holds a batch at a time."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names renamed, and the names to call them again."""
    there = [c for c in df.columns if c in names]
    other = dict(zip(there, unused(df, *(f"own_{c}" for c in there))))
    return df.withColumnsRenamed(other), {v: k for k, v in other.items()}
