"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import HOT, discard, shared_root, spread_join, stage

__all__ = ["HOT", "bounded_batches", "digest_of", "discard", "packed", "shared_root", "spread_join", "stage", "table", "text_of", "unpacked"]

#: Rows in a batch that goes to a Python worker: texts are long, and workers keep the memory of their largest batch.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size for Python workers to BATCH_ROWS, if it is above; bytes are bounded by its maxBytesPerBatch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with all its columns in one struct, so that the columns that an
    operator adds beside it can't clash with those of the caller."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def unpacked(df: DataFrame, name: str = "__row") -> DataFrame:
    return df.select(f"{name}.*")


def text_of(row: str, column: str) -> Column:
    return F.col(f"{row}.`{column}`")


def digest_of(row: str) -> Column:
    """A 128-bit hash of all values of a struct, nulls and their places included: rows with the same one are the same."""
    return F.unhex(F.md5(F.to_json(F.col(row), {"ignoreNullFields": "false"})))
