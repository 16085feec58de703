"""Cosine distance: as a column for one vector, and in blocks of questions for exact searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals of a distance that count; ties beyond them go by id.
DECIMALS = 9
#: Questions of a block, rows of a pack (fewer if they are wide), and bytes of a pack.
QUESTIONS_AT_ONCE, ROWS_AT_ONCE, PACK_BYTES = 1024, 4096, 8 << 20
#: Bytes of all questions up to which they are broadcast, and blocks whose state a task remembers.
BROADCAST_BYTES, BLOCKS_AT_ONCE = 32 << 20, 64
#: Questions that are held against a pack at a time.
STEP = 256


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine of two arrays, as double, never negative; null if a length is 0 or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    found = 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.round(F.when(found < 0, 0.0).otherwise(found), DECIMALS)


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of a list column, each divided by its length; a null list or one of length 0 becomes a row of nan."""
    width = max((len(x) for x in lists if x.is_valid), default=0)
    if lists.null_count == 0 and len(lists.flatten()) == width * len(lists):
        rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)
    else:
        rows = np.full((len(lists), width), np.nan)
        for i, x in enumerate(lists):
            if x.is_valid and len(x) == width:
                rows[i] = x.values.to_numpy(zero_copy_only=False)
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _cut(found: list[np.ndarray], keep: int, by_group: bool) -> list[np.ndarray]:
    """Of columns (question, id, group, distance) the nearest of each question, or of each question and group."""
    question, ids, group, distance = found
    keys = (question, group) if by_group else (question,)
    order = np.lexsort((ids, distance, *reversed(keys)))
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([key[order][1:] == key[order][:-1] for key in keys])
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    stay = order[np.arange(len(order)) - begin < keep]
    return [c[stay] for c in found]


class _Block:
    """Questions of one block: ids, unit vectors, the scope of each (the groups that it may find; all, if None), and how far each may look.

    A block outlives the batch that it came in, so nothing in it may be a view of the batch, which would stay in memory as a whole.
    """

    def __init__(self, asked: pa.StructArray, gate: float | None):
        self.ids = np.array(asked.field("question_id").to_numpy(zero_copy_only=False))
        self.vectors = _unit(asked.field("embedding"))
        named = [None if s is None else tuple(sorted(s)) for s in asked.field("scope").to_pylist()]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(named))}
        # many questions share a scope: each is looked up once a pack
        self.scopes, self.scope_of = [None if s is None else np.array(s, np.int64) for s in kinds], np.array([kinds[s] for s in named], np.int64)
        gates = [gate if g is None else g for g in asked.field("gate").to_pylist()]
        self.gates = np.array([np.inf if g is None else g for g in gates])
        self.nearest: dict[int, np.ndarray] = {}
        self.last: dict[int, tuple[int, np.ndarray]] = {}
        self.finds: dict[int, list[np.ndarray]] = {}

    def steps(self) -> Iterator[slice]:
        """The block's questions, some at a time."""
        return (slice(k, k + STEP) for k in range(0, len(self.ids), STEP))

    def distances(self, at: slice, ids: np.ndarray, groups: np.ndarray, units: np.ndarray, skip_self: bool) -> np.ndarray:
        """Questions x rows; what must not be found is nan."""
        here, scope_of, asked = np.unique(groups), self.scope_of[at], self.ids[at]
        live = np.array([s is None or np.isin(here, s).any() for s in self.scopes], bool)[scope_of]
        found = np.full((len(asked), len(ids)), np.nan)
        # questions that may find none of the pack's groups are not compared with it
        found[live] = np.round(np.maximum(1 - self.vectors[at][live] @ units.T, 0), DECIMALS)
        found[~(found < self.gates[at, None])] = np.nan
        for k in np.unique(scope_of[live]) if len(here) > 1 else ():
            if self.scopes[k] is not None:
                found[np.ix_(scope_of == k, ~np.isin(groups, self.scopes[k]))] = np.nan
        if skip_self:
            found[asked[:, None] == ids[None, :]] = np.nan
        return found

    def bound(self, at: slice, found: np.ndarray, keep: int) -> np.ndarray:
        """The keep-th least distance of each question among all rows that this task has seen."""
        seen = np.where(np.isnan(found), np.inf, found)
        if at.start in self.nearest:
            seen = np.hstack([self.nearest[at.start], seen])
        # a copy, for a part of the whole array would keep all of it
        near = np.partition(seen, keep - 1, axis=1)[:, :keep].copy() if seen.shape[1] > keep else seen
        self.nearest[at.start] = near
        return near.max(1) if near.shape[1] == keep else np.full(len(found), np.inf)

    def near_in_groups(self, at: slice, found: np.ndarray, groups: np.ndarray, keep: int) -> np.ndarray:
        """Which finds may be among the keep nearest of a question and group.

        Packs come in the order of their groups, so a group of several packs ends one
        and begins the next: only the group that a pack ends with is remembered.
        """
        good = ~np.isnan(found)
        for group in dict.fromkeys((groups[0], groups[-1])):
            part = groups == group
            here = found[:, part]
            seen = np.where(np.isnan(here), np.inf, here)
            if at.start in self.last and self.last[at.start][0] == group:
                seen = np.hstack([self.last[at.start][1], seen])
            near = np.partition(seen, keep - 1, axis=1)[:, :keep].copy() if seen.shape[1] > keep else seen
            if near.shape[1] == keep:
                good[:, part] &= here <= near.max(1)[:, None]
            if group == groups[-1]:
                self.last[at.start] = group, near
        return good


    def take(self, at: slice, found: list[np.ndarray], keep: int) -> None:
        """Remember finds (question, id, group, distance), at most twice as many of each question as are kept."""
        if at.start in self.finds:
            found = [np.concatenate(x) for x in zip(self.finds[at.start], found, strict=True)]
        self.finds[at.start] = _cut(found, keep, False) if len(found[0]) > 2 * keep * len(self.ids[at]) else found

    def told(self, keep: int) -> Iterator[pa.RecordBatch]:
        """The nearest of each question among all that this task has seen."""
        for found in self.finds.values():
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _cut(found, keep, False)], _FOUND)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, group, vector) to packs of many rows: arrays as bytes. Null and zero vectors are left out."""
    for batch in batches:
        widths = np.array([len(x) if x.is_valid else 0 for x in batch.column(2)])
        for width in np.unique(widths[widths > 0]):
            part = batch.filter(pa.array(widths == width))
            units = _unit(part.column(2))
            good = ~np.isnan(units).any(1)
            units, ids, groups = units[good], part.column(0).to_numpy(zero_copy_only=False)[good], part.column(1).to_numpy(zero_copy_only=False)[good]
            step = max(1, min(ROWS_AT_ONCE, PACK_BYTES // (8 * int(width))))
            for k in range(0, len(ids), step):
                packed = [pa.array([x[k : k + step].tobytes()], pa.binary()) for x in (ids, groups, units)]
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *packed], ["width", "ids", "groups", "units"])


def _met(batches: Iterator[pa.RecordBatch], gate: float | None, gone: list[_Block] | None = None) -> Iterator[tuple[_Block, np.ndarray, np.ndarray, np.ndarray]]:
    """Each pack with each block of questions that it has been dealt; a block that comes again soon keeps what it knows. Blocks that are not kept, in the end all, are added to gone."""
    gone = [] if gone is None else gone
    blocks: dict[tuple[int, int], _Block] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            ids, groups, units = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((1, np.int64), (2, np.int64), (3, np.float64)))
            key = batch.column(4)[i].as_py(), batch.column(0)[i].as_py()
            if key not in blocks:
                if len(blocks) >= BLOCKS_AT_ONCE:
                    gone.append(blocks.pop(next(iter(blocks))))
                blocks[key] = _Block(batch.column(5)[i].values, gate)
            yield blocks[key], ids, groups, units.reshape(len(ids), -1)
    gone.extend(blocks.values())


_FOUND = ["question_id", "id", "paper_id", "distance"]


def _search(keep: int, by_group: bool, skip_self: bool, gate: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: list[_Block] = []
        for block, ids, groups, units in _met(batches, gate, gone):
            while gone:
                yield from gone.pop().told(keep)
            for at in block.steps():
                found = block.distances(at, ids, groups, units, skip_self)
                q, r = np.nonzero(block.near_in_groups(at, found, groups, keep) if by_group else found <= block.bound(at, found, keep)[:, None])
                best = _cut([block.ids[at][q], ids[r], groups[r], found[q, r]], keep, by_group)
                if not by_group:
                    block.take(at, best, keep)
                elif len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], _FOUND)
        while gone:
            yield from gone.pop().told(keep)

    return run


def _counted(gates: list[float], skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, groups, units in _met(batches, None):
            total = np.concatenate([np.stack([(found < g).sum(1) for g in gates], 1) for found in (block.distances(at, ids, groups, units, skip_self) for at in block.steps())]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, len(gates))), pa.array(np.tile(np.array(gates), len(block.ids))), pa.array(total.reshape(-1))], ["question_id", "gate", "n"])

    return run


def _dealt(corpus: DataFrame, questions: DataFrame, scope: DataFrame | None, by_group: bool = False) -> DataFrame:
    """Packs of corpus rows, each with each block of questions: one plan, whatever the number of questions.

    Questions are rows, gathered into blocks of about QUESTIONS_AT_ONCE. While
    they are few by their counted bytes, the blocks are broadcast and the corpus
    is never shuffled; beyond that, packs are shuffled once, each to one of as many
    parts as there are shuffle partitions, and only the questions are copied, a
    copy of every block for each part.
    """
    spark = corpus.sparkSession
    gate = F.col("gate").cast("double") if "gate" in questions.columns else F.lit(None).cast("double")
    rows = questions.where("question_id is not null").select(F.col("question_id").cast("long").alias("question_id"), F.col("embedding").cast("array<double>").alias("embedding"), gate.alias("gate"))
    if scope is None:
        rows = rows.withColumn("scope", F.lit(None).cast("array<bigint>"))
    else:
        # a question without a row in scope finds nothing
        rows = rows.join(scope.groupBy("question_id").agg(F.collect_set(F.col("paper_id").cast("long")).alias("scope")), "question_id", "left").withColumn("scope", F.coalesce("scope", F.array().cast("array<bigint>")))
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-total // QUESTIONS_AT_ONCE))
    asked = rows.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(blocks)).alias("block"), F.size("embedding").alias("width")).agg(F.collect_list(F.struct("question_id", "embedding", "gate", "scope")).alias("asked"))
    rows = corpus.select(F.col("id").cast("long"), F.coalesce(F.col("paper_id").cast("long"), F.lit(-1)).alias("paper_id"), "embedding").where("id is not null")
    # a pack passes on some rows of each of its groups, so groups must lie in few packs; a large group is split by id
    packs = rows.repartitionByRange("paper_id", "id").sortWithinPartitions("paper_id", "id") if by_group else rows
    packs = packs.mapInArrow(_pack, "width int, ids binary, groups binary, units binary")
    if total * width * 8 <= BROADCAST_BYTES:
        both = packs.join(F.broadcast(asked), "width")
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        both = packs.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts))).join(asked.withColumn("part", numbers(parts)), ["part", "width"])
    return both.select("width", "ids", "groups", "units", F.col("block").cast("long"), "asked")


def nearest(corpus: DataFrame, questions: DataFrame, keep: int, gate: float | None = None, scope: DataFrame | None = None, by_group: bool = False, skip_self: bool = False) -> DataFrame:
    """Exact nearest rows of corpus (id, paper_id, embedding) for every question (question_id, embedding[, gate]).

    Rows (question_id, id, paper_id, distance, d_rank): at most keep of each question, or of
    each question and paper; nearer than the gate, ties by id. A task passes on one list of
    each question when it has seen all its packs, so what is shuffled depends on the number of
    tasks, not of rows; by group, the corpus is first ranged by paper, so that it depends on
    the number of papers and tasks. Null and zero vectors find nothing and are not found, and neither do
    vectors of different lengths. Question ids must be unique.
    """
    found = _dealt(corpus, questions, scope, by_group).mapInArrow(_search(keep, by_group, skip_self, gate), "question_id bigint, id bigint, paper_id bigint, distance double")
    if not by_group:
        # lists are cut where they are made: dealt first, they are not sorted as a whole in the task that searches
        found = found.repartition("question_id")
    order = Window.partitionBy("question_id", *(["paper_id"] if by_group else [])).orderBy("distance", "id")
    return found.withColumn("d_rank", F.row_number().over(order).cast("long")).where(F.col("d_rank") <= keep)


def counts_below(corpus: DataFrame, questions: DataFrame, gates: list[float], scope: DataFrame | None = None, skip_self: bool = False) -> DataFrame:
    """Rows (question_id, gate, n): how many rows are strictly nearer than each gate; counted in the tasks, and none for an empty corpus."""
    found = _dealt(corpus, questions, scope).mapInArrow(_counted(gates, skip_self), "question_id bigint, gate double, n bigint")
    return found.groupBy("question_id", "gate").agg(F.sum("n").alias("n"))
