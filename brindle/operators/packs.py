"""The best chunks of every question, found in packs of postings: what leaves a task is at most a list of each question.

All that a question needs to know of a chunk lies in one pack. Without places, packs
are those that the index has stored, of which the asked units' postings (a unit is a token,
or a stem with all its tokens) are taken: no posting is shuffled. With places, the asked
units' postings are shuffled once, dealt by chunk into packs. Every block of questions meets every pack, and a task keeps the best of each
question over its packs: pairs of question and chunk are neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.postings import TERMS_AT_ONCE, Index, lookup
from brindle.store import hinted, small, written

#: Postings of a pack, questions of a block, blocks whose finds a task remembers, and rows of questions that are broadcast at most.
PACK_ROWS, QUESTIONS_AT_ONCE, BLOCKS_AT_ONCE, ASKED_AT_ONCE = 400_000, 4096, 16, 500_000
#: Tasks for each core of the cluster: each passes on a list of each question.
TASKS_A_CORE = 3
_SHIFT = 32


_PACKED = ["pack", "unit", "chunk", "tf", "sizes", "places", "ids", "papers"]


def _as_bytes(number: int, unit: np.ndarray, ids: np.ndarray, papers: np.ndarray, tf: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """One row of bytes of the postings of a pack, sorted by unit and id."""
    chunks, first, chunk = np.unique(ids, return_index=True, return_inverse=True)
    columns = unit, chunk, tf, sizes, places, chunks, papers[first]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c.astype(np.int64).tobytes()], pa.binary()) for c in columns)], _PACKED)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack, unit, id, paper_id, tf, places), sorted by pack, unit and id, to one row of bytes for each pack, where a unit's tokens in a chunk are one."""

    def pack(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        unit, ids, papers, tf = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (1, 2, 3, 4))
        sizes = np.concatenate([p.column(5).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for p in parts])
        places = np.concatenate([p.column(5).flatten().to_numpy(zero_copy_only=False) for p in parts])
        new = np.append(True, (unit[1:] != unit[:-1]) | (ids[1:] != ids[:-1]))
        if not new.all():
            # several tokens of a unit in one chunk
            begin = np.flatnonzero(new)
            places = places[np.lexsort((places, np.repeat(np.cumsum(new), sizes)))]
            tf, sizes = np.add.reduceat(tf, begin), np.add.reduceat(sizes, begin)
            unit, ids, papers = unit[new], ids[new], papers[new]
        return _as_bytes(number, unit, ids, papers, tf, sizes, places)

    now, parts = None, []
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if parts and numbers[a] != now:
                yield pack(now, parts)
                parts = []
            now = int(numbers[a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pack(now, parts)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack, unit, ids, papers, tf), where a pack's rows are next to each other, to rows of bytes as of _packed(): stored packs are put together until they have PACK_ROWS."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << _SHIFT
    now, parts, rows = None, [], 0

    def pack() -> pa.RecordBatch:
        unit, ids, papers, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, unit))
        unit, ids, papers, tf = (x[order] for x in (unit, ids, papers, tf))
        begin = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (ids[1:] != ids[:-1])))
        # several tokens of a unit in one chunk count as one
        return _as_bytes(number, unit[begin], ids[begin], papers[begin], np.add.reduceat(tf, begin), np.zeros(len(begin), np.int64), np.zeros(0, np.int64))

    for batch in batches:
        packs = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(packs)) + 1).tolist(), len(packs)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if packs[a] != now and rows >= PACK_ROWS:
                yield pack()
                number, parts, rows = number + 1, [], 0
            now = packs[a]
            part = batch.slice(a, b - a)
            lists = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4)]
            # copies, for a part of a batch would keep all of it
            parts.append([np.repeat(part.column(1).to_numpy(), part.column(2).value_lengths().to_numpy(zero_copy_only=False)), *(x.copy() for x in lists)])
            rows += len(lists[0])
    if parts:
        yield pack()


class _Pack:
    """Postings of some chunks, by unit."""

    def __init__(self, row: list[np.ndarray]):
        self.unit, self.chunk, self.tf, self.sizes, places, self.ids, self.papers = row
        self.units, begin = np.unique(self.unit, return_index=True)
        self.span = dict(zip(self.units.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(self.unit)], strict=True), strict=True))
        ends = np.cumsum(self.sizes)
        self.place_at = np.concatenate([[0], ends])
        #: Chunk and place in one number, ascending within a unit.
        self.keys = (np.repeat(self.chunk, self.sizes) << _SHIFT) + places

    def places(self, unit: int) -> np.ndarray:
        a, b = self.span[unit]
        return self.keys[self.place_at[a] : self.place_at[b]]

    def atom(self, words: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray] | None:
        """Chunks that hold an atom, ascending, and how often; words are its (place, unit)."""
        if any(u not in self.span for _, u in words):
            return None
        if len(words) == 1:
            a, b = self.span[words[0][1]]
            return self.chunk[a:b], self.tf[a:b]
        words = sorted(words, key=lambda w: self.place_at[self.span[w[1]][1]] - self.place_at[self.span[w[1]][0]])
        start = self.places(words[0][1]) - words[0][0]
        for place, unit in words[1:]:
            other = self.places(unit)
            at = np.searchsorted(other, start + place)
            start = start[other[np.minimum(at, len(other) - 1)] == start + place]
        chunks, n = np.unique((start + words[0][0]) >> _SHIFT, return_counts=True)
        return chunks, n


def _within(some: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some (chunks) are among others, and where."""
    if not len(all_):
        return np.zeros(len(some), bool), np.zeros(len(some), np.int64)
    at = np.minimum(np.searchsorted(all_, some), len(all_) - 1)
    return all_[at] == some, at


def _together(pack: _Pack, atoms: list[tuple[bool, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Chunks that hold every atom and none that is refused, and the sum of the finds."""
    wanted = [pack.atom(words) for no, words in atoms if not no]
    if not wanted or any(w is None for w in wanted):
        return None
    wanted.sort(key=lambda w: len(w[0]))
    chunks, score = wanted[0]
    for others, tf in wanted[1:]:
        good, at = _within(chunks, others)
        chunks, score = chunks[good], score[good] + tf[at[good]]
    for no, words in atoms:
        if no and (refused := pack.atom(words)) is not None:
            good = ~_within(chunks, refused[0])[0]
            chunks, score = chunks[good], score[good]
    return chunks, score


def by_sum(pack: _Pack, parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that some part of a question finds, with the most that one part finds."""
    found = [f for atoms in parts if (f := _together(pack, atoms)) is not None]
    if len(found) == 1:
        return found[0]
    most = np.zeros(len(pack.ids), np.int64)
    for chunks, score in found:
        most[chunks] = np.maximum(most[chunks], score)
    chunks = np.flatnonzero(most)
    return chunks, most[chunks]


def by_any(pack: _Pack, parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that hold any atom of a question, with the sum of the finds."""
    total = np.zeros(len(pack.ids), np.int64)
    for atoms in parts:
        for _, words in atoms:
            if (f := pack.atom(words)) is not None:
                total[f[0]] += f[1]
    chunks = np.flatnonzero(total)
    return chunks, total[chunks]


def by_cover(pack: _Pack, parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that hold every word of a question, with the sum over all minimal runs that hold them all of 1 / (1 + other words in the run)."""
    units = {unit for atoms in parts for _, words in atoms for _, unit in words}
    none = np.zeros(0, np.int64), np.zeros(0)
    if not units <= pack.span.keys():
        return none
    spans = sorted((pack.span[u] for u in units), key=lambda s: s[1] - s[0])
    chunks = pack.chunk[slice(*spans[0])]
    for a, b in spans[1:]:
        chunks = chunks[_within(chunks, pack.chunk[a:b])[0]]
    if not len(chunks):
        return none
    held = np.zeros(len(pack.ids), bool)
    held[chunks] = True
    places = [pack.keys[pack.place_at[a] : pack.place_at[b]] for a, b in spans]
    places = [x[held[x >> _SHIFT]] for x in places]
    keys = np.concatenate(places)
    order = np.argsort(keys, kind="stable")
    keys, term = keys[order], np.repeat(np.arange(len(places)), [len(x) for x in places])[order]
    at, chunk = np.arange(len(keys)), keys >> _SHIFT
    # the run that ends at a place begins where the word begins that was last seen longest ago
    first = np.minimum.reduce([np.maximum.accumulate(np.where(term == k, at, -1)) for k in range(len(places))])
    begin = np.searchsorted(chunk, chunk)
    # it is minimal if it begins later than the one before
    new = (first >= begin) & (first > np.concatenate([[-1], first[:-1]]))
    at, first = at[new], first[new]
    total = np.bincount(chunk[new], 1.0 / (1 + keys[at] - keys[first] - (at - first)), len(pack.ids))
    return chunks, total[chunks]


class _Block:
    """Questions of one block, and the best of each so far: score, id and paper, at most keep."""

    def __init__(self, asked: list[dict], keep: int):
        self.keep, self.best, self.bound = keep, {}, {}
        self.questions = []
        for q in asked:
            parts: dict[int, dict] = {}
            for x in q["words"]:
                parts.setdefault(x["part"], {}).setdefault((x["no"], x["atom"]), []).append((x["place"], x["unit"]))
            self.questions.append((q["question_id"], q["scope"], [[(no, words) for (no, _), words in atoms.items()] for atoms in parts.values()]))

    def meet(self, pack: _Pack, score: Callable) -> None:
        for question, scope, parts in self.questions:
            chunks, scores = score(pack, parts)
            if scope is not None and len(chunks):
                good = np.isin(pack.papers[chunks], scope)
                chunks, scores = chunks[good], scores[good]
            ids = pack.ids[chunks]
            if question in self.bound:
                least, last = self.bound[question]
                good = (scores > least) | ((scores == least) & (ids < last))
                chunks, scores, ids = chunks[good], scores[good], ids[good]
            if not len(chunks):
                continue
            new = [scores, ids, pack.papers[chunks]]
            if question in self.best:
                new = [np.concatenate(x) for x in zip(self.best[question], new, strict=True)]
            if len(new[0]) >= self.keep:
                order = np.lexsort((new[1], -new[0]))[: self.keep]
                new = [x[order] for x in new]
                self.bound[question] = new[0][-1], new[1][-1]
            # copies, for a part of a pack would keep all of it
            self.best[question] = [x.copy() for x in new]

    def told(self) -> Iterator[pa.RecordBatch]:
        if self.best:
            sizes = [len(x[0]) for x in self.best.values()]
            score, ids, papers = (np.concatenate([x[c] for x in self.best.values()]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(self.best), sizes)), pa.array(ids), pa.array(papers), pa.array(score.astype(np.float64))], ["question_id", "id", "paper_id", "score"])


def _search(score: Callable, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        number, pack = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != number:
                    number = batch.column(0)[i].as_py()
                    pack = _Pack([np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in range(1, 8)])
                key = batch.column(8)[i].as_py()
                if key not in blocks:
                    if len(blocks) >= BLOCKS_AT_ONCE:
                        yield from blocks.pop(next(iter(blocks))).told()
                    blocks[key] = _Block(batch.column(9)[i].as_py(), keep)
                blocks[key].meet(pack, score)
        for block in blocks.values():
            yield from block.told()

    return run


def best(index: Index, asked: DataFrame, keep: int, score: Callable = by_sum, scope: DataFrame | None = None, placed: bool = True) -> DataFrame:
    """Rows (question_id, id, paper_id, score) among which are the keep best chunks of each question, and at most keep from each task.

    asked: question_id, part, no, atom, place, term and unit, where rows of one unit
    are tokens that count as one. scope: question_id, paper_id; a question without a
    row there finds nothing. Equal scores go by id. placed: whether the words' places
    are needed, as they are by atoms of several words.
    """
    spark = asked.sparkSession
    # read again and again below, and made of texts as a rule
    asked = written(asked, "asked-words")
    # numbers stand for units, and are written so that both sides have the same
    units = written(asked.select("unit").distinct().repartition(1).select("unit", F.monotonically_increasing_id().alias("number")), "units")
    named = asked.join(hinted(units, TERMS_AT_ONCE), "unit")
    tokens = named.select("term", "number").distinct()
    tasks = TASKS_A_CORE * max(1, spark.sparkContext.defaultParallelism)
    schema = ", ".join([f"{_PACKED[0]} bigint", *(f"{c} binary" for c in _PACKED[1:])])
    if placed:
        rows = lookup(index, tokens).where("id is not null")
        packs = max(1, -(-rows.select("number").count() // PACK_ROWS))
        rows = rows.select("number", F.col("id").cast("long").alias("id"), F.coalesce(F.col("paper_id").cast("long"), F.lit(-1).cast("long")).alias("paper_id"), "tf", "places")
        tasks = min(packs, tasks)
        dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("pack"), "number", "id", "paper_id", "tf", "places").repartition(tasks, "pack").sortWithinPartitions("pack", "number", "id")
        packed = dealt.mapInArrow(_packed, schema)
    else:
        rows = index.packs.coalesce(tasks).select("pack", F.inline("postings"))
        if small(tokens, TERMS_AT_ONCE):
            # a stored pack is one row, so its tokens are met by one task, one behind the other
            rows = rows.join(F.broadcast(tokens), "term")
        else:
            rows = rows.join(tokens, "term").repartition(tasks, "pack").sortWithinPartitions("pack")
        packed = rows.select("pack", "number", "ids", "papers", "tf").mapInArrow(_taken, schema)
    words = F.collect_list(F.struct(F.col("part").cast("int").alias("part"), "no", "atom", F.col("place").cast("long").alias("place"), F.col("number").alias("unit")))
    by_question = named.select("question_id", "part", "no", "atom", "place", "number").distinct().groupBy("question_id").agg(words.alias("words"))
    if scope is None:
        by_question = by_question.withColumn("scope", F.lit(None).cast("array<bigint>"))
    else:
        by_question = by_question.join(scope.groupBy("question_id").agg(F.collect_set(F.col("paper_id").cast("long")).alias("scope")), "question_id")
    by_question = written(by_question.select(F.col("question_id").cast("long").alias("question_id"), "words", "scope"), "asked")
    total, n = by_question.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-n // QUESTIONS_AT_ONCE))
    asked = by_question.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("question_id", "words", "scope")).alias("asked"))
    if total <= ASKED_AT_ONCE:
        both = packed.crossJoin(F.broadcast(asked))
    else:
        copies = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
        both = packed.withColumn("part", F.pmod("pack", F.lit(tasks)).cast("int")).join(asked.withColumn("part", copies), "part").drop("part")
    found = both.select("pack", "unit", "chunk", "tf", "sizes", "places", "ids", "papers", "block", "asked").mapInArrow(_search(score, keep), "question_id bigint, id bigint, paper_id bigint, score double")
    return found.withColumn("paper_id", F.when(F.col("paper_id") >= 0, F.col("paper_id")))
