"""Ranked lexical search with block-max pruning.

The index holds shards of a few thousand documents. A shard has its documents in
blocks (ranges of BLOCK documents as they were read), a forward index of each block
(term, document, occurrences) and a directory: for each term the blocks that hold it
and the most that it can be worth there, exact for the corpus it was built from.

A search meets every shard with every block of queries, in one join. In a shard, each
query's blocks are put in order of their bound (the sum of weight times maximum over
its terms), and their documents are scored until a bound drops below the query's
threshold, its k-th best score so far. Nothing but a shard's k best of each query
leaves it. A hashed part of the shards is searched first: the k-th best scores there
are the thresholds with which all others begin.

Terms are known by 64-bit hashes; a query's term meets another one of the corpus by
chance with a likelihood of (terms of queries x terms of the corpus) / 2^64.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.llm.common import batches, discard, table, written

#: Results of a query, documents of a block, and documents and postings of a shard (at least one document).
TOP, BLOCK, SHARD_DOCS, SHARD_POSTINGS = 20, 32, 2048, 150_000
#: Maxima are kept in steps, rounded up; blocks that are scored first, then twice as many each time.
COARSE, AT_FIRST = 4000, 4
#: Texts and shards that a Python worker is handed at a time.
TEXTS_AT_ONCE, SHARDS_AT_ONCE = 1000, 8
#: One shard in so many is searched first; queries of a block; bytes of all queries up to which they are broadcast; blocks of queries that a task remembers.
FIRST, QUERIES_AT_ONCE, BROADCAST_BYTES, REMEMBERED = 16, 256, 32 << 20, 16
#: Worth of a term without length; share of a document's length in it, in hundredths; steepness; scale.
LENGTH_SHARE, STEEP, FULL = 25, 12, 1_000_000_000

#: Bytes that belong to a term stay (A-Z as a-z), all others become a blank.
_FOLDED = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text as UTF-8, in order and piece by piece: maximal runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased."""
    folded = (text or "").encode("utf-8", "replace").translate(_FOLDED)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def word_counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for piece in word_pieces(text):
        found.update(piece)
    return found


def term_hash(term: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(term), "big", signed=True)


def measure(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """The part of a document's length in the score of its terms."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * length * n) // total


def worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (FULL * tf) // (1000 * tf + STEEP * m)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 as bytes, each in as few as the largest needs; the first byte says how many."""
    most = int(x.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if most < 1 << 8 * n)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def unpacked(data: pa.Buffer | bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{np.frombuffer(data, np.uint8, 1)[0]}", offset=1)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    sizes = end - begin
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(begin) else np.zeros(0, np.int64)


class _Shard:
    """Documents gathered for one shard, until it is full."""

    def __init__(self) -> None:
        self.keys: list = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, key, found: Counter) -> None:
        self.keys.append(key)
        self.lengths.append(found.total())
        self.terms.append(np.fromiter(map(term_hash, found), np.int64, len(found)))
        self.tfs.append(np.fromiter(found.values(), np.int64, len(found)))
        self.postings += len(found)

    def full(self) -> bool:
        return len(self.keys) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def row(self, n: int, total: int) -> dict:
        lengths = np.array(self.lengths, np.int64)
        hashes, tf = np.concatenate(self.terms), np.concatenate(self.tfs)
        doc = np.repeat(np.arange(len(lengths)), [len(t) for t in self.terms])
        terms, term = np.unique(hashes, return_inverse=True)
        value = worth(tf, measure(lengths, n, total)[doc])
        block = doc // BLOCK
        # forward: by block and term; directory: by term and block
        ahead = np.lexsort((doc, term, block))
        by_term = np.lexsort((block, term))
        first = np.flatnonzero(np.diff(term[by_term], prepend=-1) | np.diff(block[by_term], prepend=-1))
        numbers = {
            "lengths": lengths,
            "f_start": np.searchsorted(block[ahead], np.arange(block[-1] + 2)), "f_term": term[ahead], "f_doc": (doc % BLOCK)[ahead], "f_tf": tf[ahead],
            "d_start": np.searchsorted(term[by_term][first], np.arange(len(terms) + 1)), "d_block": block[by_term][first], "d_most": -(-np.maximum.reduceat(value[by_term], first) // COARSE),
        }
        told = {"keys": self.keys, "vocabulary": terms.tobytes(), "df": packed(np.bincount(term, minlength=len(terms)))}
        return told | {name: packed(x) for name, x in numbers.items()}


#: The arrays of a shard that a search reads, as bytes, besides its vocabulary.
_ARRAYS = ("lengths", "f_start", "f_term", "f_doc", "f_tf", "d_start", "d_block", "d_most")


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all of them have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for t in batch.column(0):
                found = sum(map(len, word_pieces(t.as_py())))
                n, total = n + (found > 0), total + found
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    with batches(docs.sparkSession, TEXTS_AT_ONCE):
        found = docs.select(F.col(text).alias("text")).mapInArrow(run, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def index(docs: DataFrame, n: int, total: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of docs, one row a shard; n and total as totals() gives them. Documents without terms are in no shard."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = T.StructType([T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), *[T.StructField(a, T.BinaryType()) for a in ("vocabulary", "df", *_ARRAYS)]])
    columns = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        out = lambda: pa.RecordBatch.from_pylist([shard.row(n, total)], schema=columns)
        for batch in batches:
            keys = batch.column(0)
            for i, t in enumerate(batch.column(1)):
                found = word_counts(t.as_py())
                if found:
                    shard.add(keys[i].as_py(), found)
                    if shard.full():
                        yield out()
                        shard = _Shard()
        if shard.keys:
            yield out()

    with batches(docs.sparkSession, TEXTS_AT_ONCE):
        return written(rows.mapInArrow(run, kinds).withColumn("shard", F.monotonically_increasing_id()), "shards")


def query_terms(items: DataFrame) -> DataFrame:
    """Rows (item, term, times) of rows (item, text): how often each term stands in a query. None for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_counts(t.as_py()) for t in batch.column(1)]
            items = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array([term_hash(t) for f in found for t in f], pa.int64()), pa.array([c for f in found for c in f.values()], pa.int64())], ["item", "term", "times"])

    return items.mapInArrow(run, "item bigint, term bigint, times bigint")


def _met(shards: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """Every shard with every block of queries (with n_terms). They are broadcast while their counted bytes are few; beyond that they are copied for each part of the shards."""
    size = asked.agg(F.coalesce(F.sum(F.lit(64) + 24 * F.col("n_terms")), F.lit(0))).first()[0]
    parts = 1 if size <= BROADCAST_BYTES else int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards.select(*columns, F.pmod("shard", F.lit(parts)).alias("part"))
    copies = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(F.broadcast(copies) if parts == 1 else copies, "part").drop("part")


def _frequencies(shards: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (term, df): in how many documents each of the asked terms stands. Tasks add up their shards' directories first."""
    blocks = terms.groupBy(F.pmod(F.xxhash64("term"), F.lit(64)).alias("block")).agg(F.sort_array(F.collect_set("term")).alias("terms")).withColumn("n_terms", F.size("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary, df = np.frombuffer(batch.column(0)[i].as_buffer(), np.int64), unpacked(batch.column(1)[i].as_buffer())
                block = batch.column(2)[i].as_py()
                if block not in sums:
                    asked = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                    sums[block] = asked, np.zeros(len(asked), np.int64)
                asked, total = sums[block]
                at = np.minimum(np.searchsorted(vocabulary, asked), len(vocabulary) - 1)
                total += np.where(vocabulary[at] == asked, df[at], 0)
        for asked, total in sums.values():
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(total)], ["term", "df"])

    both = _met(shards, blocks, ["vocabulary", "df"]).select("vocabulary", "df", "block", "terms")
    with batches(shards.sparkSession, SHARDS_AT_ONCE):
        return written(both.mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")


class _Queries:
    """A block of queries: terms and weights of each, and the score below which it needs no document."""

    def __init__(self, asked: pa.StructArray, top: int) -> None:
        self.items = asked.field("item").to_numpy(zero_copy_only=False)
        parts = asked.field("parts")
        offsets = parts.offsets.to_numpy()
        flat = parts.values
        terms, weights = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("term", "weight"))
        self.terms, places = np.unique(terms[offsets[0] : offsets[-1]], return_inverse=True)
        self.places = np.split(places, offsets[1:-1] - offsets[0])
        self.weights = np.split(weights[offsets[0] : offsets[-1]], offsets[1:-1] - offsets[0])
        self.best = [np.full(top, x - 1, np.int64) for x in asked.field("least").to_numpy(zero_copy_only=False)]

    def search(self, s: dict[str, np.ndarray], ranks: np.ndarray, n: int, total: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores) of a shard: each query's best here, none worse than its best so far."""
        top, size = len(self.best[0]), len(s["vocabulary"])
        at = np.minimum(np.searchsorted(s["vocabulary"], self.terms), size - 1)
        held = s["vocabulary"][at] == self.terms
        starts, d_start = s["f_start"].astype(np.int64), s["d_start"].astype(np.int64)
        blocks = len(starts) - 1
        # block and term in one number, ascending; each posting's document and worth
        block = np.repeat(np.arange(blocks), np.diff(starts))
        place = block * size + s["f_term"]
        doc = block * BLOCK + s["f_doc"]
        value = worth(s["f_tf"].astype(np.int64), measure(s["lengths"].astype(np.int64), n, total)[doc])
        most = s["d_most"].astype(np.int64) * COARSE
        for q, (places, weights) in enumerate(zip(self.places, self.weights, strict=True)):
            there = held[places]
            terms, weight = at[places][there], weights[there]
            begin, end = d_start[terms], d_start[terms + 1]
            each = _ranges(begin, end)
            bound = np.zeros(blocks, np.int64)
            np.add.at(bound, s["d_block"][each], np.repeat(weight, end - begin) * most[each])
            order = np.argsort(-bound, kind="stable")
            docs, scores, done, step = [], [], 0, AT_FIRST
            while True:
                # an equal score may still come first by its key
                some = order[done : done + step]
                some = some[(bound[some] > 0) & (bound[some] >= self.best[q][0])]
                if not len(some):
                    break
                done, step = done + step, 2 * step
                wanted = (some[:, None] * size + terms[None, :]).ravel()
                begin, end = np.searchsorted(place, wanted, "left"), np.searchsorted(place, wanted, "right")
                each = _ranges(begin, end)
                got = np.zeros(len(s["lengths"]), np.int64)
                np.add.at(got, doc[each], np.repeat(np.tile(weight, len(some)), end - begin) * value[each])
                good = np.flatnonzero((got > 0) & (got >= self.best[q][0]))
                if len(good):
                    docs.append(good)
                    scores.append(got[good])
                    self.best[q] = np.sort(np.concatenate([self.best[q], got[good]]))[-top:]
            if docs:
                found, score = np.concatenate(docs), np.concatenate(scores)
                stay = score >= self.best[q][0]
                found, score = found[stay], score[stay]
                stay = np.lexsort((ranks[found], -score))[:top]
                yield q, found[stay], score[stay]


def _ranks(keys: pa.Array) -> np.ndarray:
    """Places of a shard's documents in the order of their keys; null keys come last."""
    rank = np.empty(len(keys), np.int64)
    rank[pc.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(len(keys))
    return rank


def _searched(shards: DataFrame, asked: DataFrame, n: int, total: int, top: int) -> DataFrame:
    """Rows (item, key, score), written: the best of each query in each shard, as far as they may be among the best of all."""
    key = shards.schema["keys"].dataType.elementType
    kinds = T.StructType([T.StructField("item", T.LongType()), T.StructField("key", key), T.StructField("score", T.LongType())])
    columns = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Queries] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block not in known:
                    if len(known) >= REMEMBERED:
                        known.pop(next(iter(known)))
                    known[block] = _Queries(batch.column("asked")[i].values, top)
                s = {a: unpacked(batch.column(a)[i].as_buffer()) for a in _ARRAYS} | {"vocabulary": np.frombuffer(batch.column("vocabulary")[i].as_buffer(), np.int64)}
                keys = batch.column("keys")[i].values
                found = list(known[block].search(s, _ranks(keys), n, total))
                if found:
                    items = np.repeat(known[block].items[[q for q, _, _ in found]], [len(d) for _, d, _ in found])
                    docs = np.concatenate([d for _, d, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), keys.take(pa.array(docs)).cast(columns.field("key").type), pa.array(np.concatenate([x for _, _, x in found]))], schema=columns)

    both = _met(shards, asked, ["keys", "vocabulary", *_ARRAYS])
    with batches(shards.sparkSession, SHARDS_AT_ONCE):
        return written(both.mapInArrow(run, kinds), "finds")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(shards: DataFrame, items: DataFrame, n: int, total: int, item: str = "item_id", text: str = "text", top: int = TOP, first: int = FIRST) -> DataFrame:
    """Rows (item, rank, key, score): the top documents of each row of items; equal scores by key, null keys last.

    Each row of items is a query, also where keys are null or repeated; one
    without terms, or whose terms stand nowhere, has no rows. Scores are exact.
    """
    told = written(items.select(F.col(item).alias("name"), F.col(text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "queries")
    terms = written(query_terms(told.select("item", "text")), "terms")
    df = _frequencies(shards, terms.select("term").distinct())
    weight = F.floor(1000 * F.log((F.lit(2 * n + 2)).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # a term that stands nowhere adds nothing to any score
    weighed = written(terms.join(df.where("df > 0"), "term").select("item", F.struct("term", (F.col("times") * weight).alias("weight")).alias("part")), "weights")
    discard(terms)
    parts = weighed.groupBy("item").agg(F.collect_list("part").alias("parts"))
    blocks = max(1, -(-weighed.select("item").distinct().count() // QUERIES_AT_ONCE))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "least", "parts")).alias("asked"), F.sum(1 + F.size("parts")).alias("n_terms"))

    sample = shards.where(F.pmod(F.xxhash64("shard"), F.lit(first)) == 0)
    begun = _best(_searched(sample, in_blocks(parts.withColumn("least", F.lit(1).cast("long"))), n, total, top), top)
    least = begun.where(F.col("rank") == top).select("item", F.col("score").alias("least"))
    told_least = written(parts.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))), "thresholds")
    found = _best(_searched(shards, in_blocks(told_least), n, total, top), top)
    return found.join(told.select("item", F.col("name").alias("__name")), "item").select(F.col("__name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key"), "score")


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, total = totals(docs)
    shards = index(docs, n, total)
    return search(shards, table(spark, sf_dir, "benchmark"), n, total).withColumnRenamed("key", "doc_id")


QUERIES = {"op12_block_max": op12_block_max}

_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = {
    "op12_block_max": f"""
WITH split AS MATERIALIZED (SELECT doc_id, {_TERMS_SQL} AS ts FROM documents),
docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, ts, len(ts) AS n FROM split WHERE len(ts) > 0),
sums AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM docs),
items AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_TERMS_SQL} AS ts FROM benchmark),
asked AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(ts) AS term FROM items) GROUP BY i, term),
tfs AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY d, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, sums GROUP BY term, n_all),
worth AS (SELECT t.d, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * d.n * s.n_all) // s.l_all))) AS x FROM tfs t JOIN weights w USING (term) JOIN docs d USING (d), sums s),
scored AS (SELECT a.i, x.d, CAST(sum(a.times * x.x) AS BIGINT) AS score FROM asked a JOIN worth x USING (term) GROUP BY a.i, x.d HAVING sum(a.times * x.x) > 0),
ranked AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN docs USING (d) QUALIFY rank <= 20)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (i)
"""
}
