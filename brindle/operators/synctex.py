"""SyncTeX lookups: from a line of the source to a place on a page, and from a place on a page to the line that made it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Height of a band of a page; a box is filed under every band that it touches.
BAND = 48.0


def forward(records: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (run, file, line) with page, x, y, width and height of the first record of their line; null where it made nothing.

    records: run, seq, file, line, page, x, y, width, height. The first record of
    each line is found before anything is joined.
    """
    place = F.struct("seq", "page", "x", "y", "width", "height")
    first = records.groupBy("run", "file", "line").agg(F.min(place).alias("at"))
    return asks.join(first, ["run", "file", "line"], "left").select(*asks.columns, "at.page", "at.x", "at.y", "at.width", "at.height")


def reverse(records: DataFrame, points: DataFrame, band: float = BAND) -> DataFrame:
    """points (point, run, page, x, y) with file and line of the smallest box around them; of equal ones the first record counts, null outside all boxes.

    Edges belong to a box. Boxes and points meet by page and band, so a point is
    only held against the boxes at its height. point must be unique.
    """
    level = lambda c: F.floor(c / F.lit(band))
    boxes = records.where("width >= 0 and height >= 0 and file is not null").select("run", "page", F.explode(F.sequence(level(F.col("y")), level(F.col("y") + F.col("height")))).alias("band"), F.col("x").alias("left"), F.col("y").alias("top"), "width", "height", "seq", "file", "line")
    asked = points.select("point", "run", "page", "x", "y", level(F.col("y")).alias("band"))
    inside = F.col("x").between(F.col("left"), F.col("left") + F.col("width")) & F.col("y").between(F.col("top"), F.col("top") + F.col("height"))
    best = asked.join(boxes, ["run", "page", "band"]).where(inside).groupBy("point").agg(F.min(F.struct((F.col("width") * F.col("height")).alias("area"), "seq", "file", "line")).alias("box"))
    return points.join(best, "point", "left").select(*points.columns, "box.file", "box.line")
