"""Exact nearest rows with fewer comparisons: rows filed under pivots, and whole cells skipped by the triangle inequality.

Angles between vectors are a distance. Each row is filed under the pivot with the
smallest angle to it; a cell knows the least and the largest angle of its rows. A row
of a cell is at least as far from a question as the question's angle to the pivot lies
outside that range, so a cell beyond a question's k-th best so far is never looked at.
The k-th best so far comes from the cells nearest to the question. Results are those of
nearest(); how much is skipped depends on how the vectors lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.vector import _unit, nearest
from brindle.store import written

#: Pivots, which are a bounded draw of the rows, and what rounding may cost a bound.
PIVOTS, SLACK = 64, 1e-8


@dataclass(frozen=True)
class Cells:
    """rows: id, paper_id, embedding, pivot, written in a folder for each pivot. ranges: pivot, low, high, n. pivots: unit vectors."""

    rows: DataFrame
    ranges: DataFrame
    pivots: np.ndarray


def _angles(pivots: np.ndarray, all_of_them: bool):
    """Rows (id, vector) to (id, pivot, angle): of the nearest pivot, or of every one. Vectors without a direction, or of another width, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array([x.is_valid and len(x) == pivots.shape[1] for x in batch.column(1)], pa.bool_()))
            units = _unit(part.column(1))
            good = ~np.isnan(units).any(1)
            ids = part.column(0).to_numpy(zero_copy_only=False)[good].astype(np.int64)
            found = np.arccos(np.clip(units[good] @ pivots.T, -1, 1)) if good.any() else np.zeros((0, len(pivots)))
            if all_of_them:
                columns = np.repeat(ids, len(pivots)), np.tile(np.arange(len(pivots)), len(ids)), found.reshape(-1)
            else:
                best = found.argmin(1) if len(ids) else np.zeros(0, np.int64)
                columns = ids, best, found[np.arange(len(ids)), best]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2])], ["id", "pivot", "angle"])

    return run


def file_under_pivots(corpus: DataFrame, pivots: int = PIVOTS) -> Cells:
    """Cells of corpus (id, paper_id, embedding; unique ids). Rows without a direction, or of a width that the first pivot has not, are in no cell and are found by no search."""
    rows = corpus.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), "paper_id", F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = rows.where(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").limit(pivots).select("embedding").collect()
    chosen = [r.embedding for r in drawn if len(r.embedding) == len(drawn[0].embedding)]
    units = _unit(pa.array(chosen, pa.list_(pa.float64()))) if chosen else np.zeros((0, 1))
    units = units[~np.isnan(units).any(1)]
    if not len(units):
        units = np.ones((1, 1))
    placed = rows.select("id", "embedding").mapInArrow(_angles(units, False), "id bigint, pivot int, angle double")
    filed = written(rows.join(placed, "id").select("id", "paper_id", "embedding", "angle", "pivot"), "cells", ["pivot"])
    return Cells(filed, written(filed.groupBy("pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")), "cell-ranges"), units)


def visited(cells: Cells, questions: DataFrame, keep: int, gate: float | None = None) -> DataFrame:
    """Rows (question_id, pivot, n) of the cells that can hold one of the keep nearest rows of a question; all others are proven not to."""
    asked = questions.select(F.col("question_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    seen = asked.mapInArrow(_angles(cells.pivots, True), "id bigint, pivot int, angle double").withColumnRenamed("id", "question_id")
    # a row for each pivot, which is their bound
    near = written(seen.join(F.broadcast(cells.ranges), "pivot").withColumn("least", F.greatest(F.col("angle") - F.col("high"), F.col("low") - F.col("angle"), F.lit(0.0))), "question-angles")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("question_id").orderBy("angle", "pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = near.withColumn("before", before).where(F.col("before") < keep).select("question_id", F.col("pivot").alias("paper_id"))
    found = _in_cells(cells, questions, keep, gate, first)
    worst = found.where(F.col("d_rank") == keep).select("question_id", F.col("distance").alias("worst"))
    reach = F.least(F.coalesce("worst", F.lit(2.0)), F.lit(2.0 if gate is None else gate)) + SLACK
    return near.join(worst, "question_id", "left").where(1 - F.cos("least") <= reach).select("question_id", "pivot", "n")


def _in_cells(cells: Cells, questions: DataFrame, keep: int, gate: float | None, scope: DataFrame) -> DataFrame:
    folders = [r[0] for r in scope.select("paper_id").distinct().collect()]
    rows = cells.rows.where(F.col("pivot").isin(folders)).select("id", F.col("pivot").alias("paper_id"), "embedding")
    return nearest(rows, questions, keep, gate=gate, scope=scope)


def nearest_pruned(cells: Cells, questions: DataFrame, keep: int, gate: float | None = None) -> DataFrame:
    """What nearest() finds for questions (question_id, embedding), from the cells that can matter alone."""
    scope = written(visited(cells, questions, keep, gate).select("question_id", F.col("pivot").alias("paper_id")), "visited")
    found = _in_cells(cells, questions, keep, gate, scope).drop("paper_id")
    return found.join(cells.rows.select("id", "paper_id"), "id").select("question_id", "id", F.col("paper_id").cast("long").alias("paper_id"), "distance", "d_rank")
