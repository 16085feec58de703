"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from brindle.store import discard, hinted, kept, matched, salted, shared_dir, small, tidy, unused, written

__all__ = ["batches", "discard", "hinted", "kept", "matched", "salted", "shared_dir", "small", "table", "tidy", "unused", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions hand Python workers at most so many rows at a time: for rows of many bytes, which else fill both sides' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
