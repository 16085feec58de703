"""Bulk loads of records that may be broken, repeated or loaded already, and loops that a failing row does not end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.store import _place, written

#: Characters of an error that are kept.
ERROR_CHARS = 120


def classified(lines: DataFrame, schema: str, key: str, needed: tuple[str, ...] = (), loaded: DataFrame | None = None) -> DataFrame:
    """Rows (seq, value, record, status, reason) of lines (seq, value): each is new, repeated, loaded or broken.

    value is one JSON object. A line is broken if it cannot be read as the schema
    says (reason malformed) or lacks its key or one of needed (missing and its
    name); of equal keys the first is new and the others repeated; keys in loaded
    are loaded. Blank lines are none.
    """
    kinds = T._parse_datatype_string(schema)
    whole = T.StructType([*kinds.fields, T.StructField("_broken", T.StringType())])
    read = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.where(F.trim("value") != "").select("seq", "value", read.alias("r"))
    empty = lambda name: F.coalesce(F.trim(F.col(f"r.{name}").cast("string")), F.lit("")) == ""
    reason = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), "malformed")
    for name in (key, *needed):
        reason = reason.when(empty(name), f"missing {name}")
    told = rows.select("seq", "value", F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in kinds.fields]).alias("record"), reason.alias("reason")).withColumn("key", F.when(F.col("reason").isNull(), F.col(f"record.{key}")))
    # the first of each key by one aggregation, so a key that comes very often is not gathered
    first = told.where("key is not null").groupBy("key").agg(F.min("seq").alias("first"))
    told = told.join(first, "key", "left")
    known = F.lit(False)
    if loaded is not None:
        told = told.join(loaded.select(F.col(key).alias("key"), F.lit(True).alias("known")).distinct(), "key", "left")
        known = F.coalesce("known", F.lit(False))
    status = F.when(F.col("reason").isNotNull(), "broken").when(known, "loaded").when(F.col("seq") == F.col("first"), "new").otherwise("repeated")
    return told.select("seq", "value", "record", status.alias("status"), "reason")


def loaded_so_far(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All records of the batches that have been finished; a batch that broke off is not there."""
    place, files = _place(spark, target)
    done = [str(x.getPath()) for x in (files.listStatus(place) if files.exists(place) else []) if files.exists(_place(spark, f"{x.getPath()}/_SUCCESS")[0])]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def load(spark: SparkSession, source: str, target: str, schema: str, key: str, needed: tuple[str, ...] = (), limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Load JSON lines of all files below source into target, a folder of Parquet batches, and return classified() of them.

    The batches that are finished are the ledger: what is in one is loaded already,
    so a load that failed is simply run again, and one that is run twice adds
    nothing. limit takes the first lines only; a dry run writes nothing.
    """
    lines = spark.read.text(source).select(F.monotonically_increasing_id().alias("seq"), "value")
    if limit is not None:
        lines = lines.orderBy("seq").limit(limit)
    found = written(classified(lines, schema, key, needed, loaded_so_far(spark, target, schema)), "bulk")
    fresh = found.where("status = 'new'").select("record.*")
    if not dry_run and not fresh.isEmpty():
        fresh.write.parquet(f"{target.rstrip('/')}/batch-{uuid.uuid4().hex}")
    return found


def isolated(rows: DataFrame, work: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """rows with a struct column found, what work says of each row, and error, what it raised instead; null and null if it says nothing.

    A row that fails costs no other row. Null in found means nothing was found.
    """
    kinds = T.StructType([*rows.schema.fields, T.StructField("found", T._parse_datatype_string(schema)), T.StructField("error", T.StringType())])
    columns = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for row in batch.to_pylist():
                try:
                    found.append(pa.scalar(work(row), columns.field("found").type).as_py())
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever one row raises is that row's result
                    found.append(None)
                    errors.append(f"{type(error).__name__}: {str(error)[:ERROR_CHARS]}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, columns.field("found").type), pa.array(errors, pa.string())], schema=columns)

    return rows.mapInArrow(run, kinds)


def backfill(papers: DataFrame, work: Callable[[dict], dict | None], schema: str, text: str = "text", done: str = "has_metadata", force: bool = False) -> DataFrame:
    """papers with found, error and outcome: kept (has it already, unless force), skipped (no text), stored, none (nothing found) or failed."""
    asked = (F.lit(force) | ~F.coalesce(done, F.lit(False))) & (F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != "")
    tried = isolated(papers.where(asked), work, schema)
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("found").isNull(), "none").otherwise("stored")
    rest = papers.where(~asked).select("*", F.lit(None).cast(tried.schema["found"].dataType).alias("found"), F.lit(None).cast("string").alias("error"))
    left = F.when(F.coalesce(done, F.lit(False)) & ~F.lit(force), "kept").otherwise("skipped")
    return tried.withColumn("outcome", outcome).unionByName(rest.withColumn("outcome", left))
