"""Tables that are written once and read again, joins that do not choke on a hot key, and numbers in order."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts into which the rows of any one key are dealt where a side is too large to be broadcast.
SALTS = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session of one machine gets one of its own where none is named."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, folders: list[str] | None = None, rows_a_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives a lost executor. The files go when the session's JVM ends.

    folders: columns that stand last, by whose values the files are kept apart.
    rows_a_file: rows of a file at most, where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path, partitionBy=folders)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_KEPT: dict[tuple[str, ...], object] = {}


def once(spark: SparkSession, name: str, paths: list[str], make: Callable[[], object]) -> object:
    """What make() returns, made once for a session and the state of the files below paths (sizes, number, time of the last change)."""
    states = []
    for path in paths:
        place, files = _place(spark, path)
        total = files.getContentSummary(place)
        states.append(f"{path}:{total.getLength()}:{total.getFileCount()}:{files.getFileStatus(place).getModificationTime()}")
    key = (spark.sparkContext.applicationId, name, *states)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def discard(*frames: DataFrame) -> None:
    """Delete what written() and kept() have written of frames that nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "written_to", None):
            place, files = _place(frame.sparkSession, path)
            files.delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Have the driver drop what is no longer referred to, so that Spark's cleaner deletes the shuffles and checkpoints of steps that are done."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def kept(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, for tables of few bytes a row that are read again and again. Like written(), deleted by discard(), or when the session's JVM ends."""
    shared_dir(df.sparkSession)
    found = df.checkpoint()
    path = found._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        found.written_to = path.get()
        place, files = _place(found.sparkSession, found.written_to)
        files.deleteOnExit(place)
    return found


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it has to."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has been counted to be small (rows of a bounded width only); otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def salted(left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join in which one key's rows of left are dealt over several tasks by a hash of spread; right should have few rows a key."""
    salt = unused("salt", left, right)
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [on, salt], how).drop(salt)


def matched(left: DataFrame, right: DataFrame, on: str, spread: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, which is broadcast if it has at most so many rows; beyond that, hot keys of left are dealt over several tasks."""
    return left.join(F.broadcast(right), on, how) if small(right, rows) else salted(left, right, on, spread, how)


def unused(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front until no frame has a column of that name."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_order(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their number from 0 in the order of all of them, as a column.

    Rows are sorted into ranges, which are written; a range's first number is the
    sum of the sizes of those before, one number for each range, and no window
    covers more than a range.
    """
    part = unused("part", rows)
    ranges = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ordered")
    sizes = {r[part]: r["count"] for r in ranges.groupBy(part).count().collect()}
    starts, at = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(k, 0)
    if not starts:
        return ranges.drop(part).withColumn(name, F.lit(0).cast("long"))
    place = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col(part))
    return ranges.withColumn(name, place + F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1).drop(part)
