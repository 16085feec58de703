"""Running sums by key in an order, also where one key has more rows than a task should hold.

Rows are sorted into ranges of (key, order), so a large key lies in several of them.
Each range is summed on its own, what the ranges before have of a key is carried into
those that go on with it (one row for each range at most), and only then the rows are
told their sums. No window covers more than a range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.store import unused, written

#: Rows of one key up to which a plain window is taken.
ROWS_AT_ONCE = 1_000_000


def _largest(rows: DataFrame, key: str) -> int:
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _ranged(rows: DataFrame, key: str, order: list[str], part: str) -> DataFrame:
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(ranges, key, *order).withColumn(part, F.spark_partition_id()), "scan")


def _carried(ranges: DataFrame, carry: DataFrame, key: str, part: str, names: list[str]) -> DataFrame:
    """ranges with what carry (part, key, names) says of them; carry has a row for each range at most, which is its bound."""
    other = carry.select(F.col(part).alias("__part"), F.col(key).alias("__key"), *names)
    return ranges.join(F.broadcast(other), (F.col(part) == F.col("__part")) & F.col(key).eqNullSafe(F.col("__key")), "left").drop("__part", "__key")


def running(rows: DataFrame, key: str, order: list[str], sums: Mapping[str, Column], at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """rows with a column for each of sums: the sum of a column of whole numbers over its key's rows up to and with it, in order.

    Order must be total within a key. Null keys are one key; null numbers count as 0.
    """
    given = rows.withColumns({f"__{name}": F.coalesce(value, F.lit(0)).cast("long") for name, value in sums.items()})
    hidden = [f"__{name}" for name in sums]
    if _largest(rows, key) <= at_once:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return given.withColumns({name: F.sum(f"__{name}").over(w) for name in sums}).drop(*hidden)
    part = unused("part", given)
    ranges = _ranged(given, key, order, part)
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(part, key).agg(*[F.sum(h).alias(h) for h in hidden])
    carry = totals.select(part, key, *[F.sum(h).over(before).alias(f"{h}_carry") for h in hidden]).where(F.col(f"{hidden[0]}_carry").isNotNull())
    w = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = _carried(ranges, carry, key, part, [f"{h}_carry" for h in hidden])
    return told.withColumns({name: F.sum(f"__{name}").over(w) + F.coalesce(f"__{name}_carry", F.lit(0)) for name in sums}).drop(part, *hidden, *[f"{h}_carry" for h in hidden])


def previous(rows: DataFrame, key: str, order: list[str], value: str, name: str, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """rows with the value of the row before it of the same key, in order; null for a key's first row."""
    if _largest(rows, key) <= at_once:
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    part = unused("part", rows)
    ranges = _ranged(rows, key, order, part)
    last = ranges.groupBy(part, key).agg(F.max(F.struct(*order, F.col(value).alias("__value")))["__value"].alias("__last"))
    carry = last.select(part, key, F.lag("__last").over(Window.partitionBy(key).orderBy(part)).alias("__carry")).where(F.col("__carry").isNotNull())
    w = Window.partitionBy(part, key).orderBy(*order)
    told = _carried(ranges, carry, key, part, ["__carry"]).withColumn("__first", F.row_number().over(w) == 1)
    return told.withColumn(name, F.when(F.col("__first"), F.col("__carry")).otherwise(F.lag(value).over(w))).drop(part, "__carry", "__first")


def sessions(rows: DataFrame, key: str, order: list[str], at: str, gap: Column, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """rows with session, from 1 for each key: one ends where the next row is more than gap later."""
    near = previous(rows, key, order, at, "__before", at_once)
    fresh = F.when(F.col(at) - F.col("__before") <= gap, 0).otherwise(1)
    return running(near, key, order, {"session": fresh}, at_once).drop("__before")


def counts_within(rows: DataFrame, key: str, seq: str, at: str, span: int, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Rows (seq, key, hits): how many rows of the key lie in the span that ends at each row's time, rows of the same time included.

    at holds whole numbers and seq is unique. The count is the difference of two
    running counts, at the end of the span and before its beginning.
    """
    if _largest(rows, key) <= at_once:
        w = Window.partitionBy(key).orderBy(at).rangeBetween(-span, 0)
        return rows.select(seq, key, F.count("*").over(w).alias("hits"))
    mark = lambda time, kind, n, sign: F.struct(time.alias("__at"), F.lit(kind).alias("__kind"), F.lit(n).alias("__n"), F.lit(sign).alias("__sign"))
    # at equal times rows come before the questions about them
    marks = rows.select(key, seq, F.inline(F.array(mark(F.col(at), 0, 1, 0), mark(F.col(at), 1, 0, 1), mark(F.col(at) - span - 1, 1, 0, -1))))
    told = running(marks, key, ["__at", "__kind", seq, "__sign"], {"__count": F.col("__n")}, at_once)
    return told.where("__kind = 1").groupBy(seq, key).agg(F.sum(F.col("__count") * F.col("__sign")).alias("hits"))
