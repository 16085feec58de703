"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last WINDOW bytes is rolled over the UTF-8 text; where its value
modulo the block size is the block size less one, a piece ends, so pieces depend
on what is near and not on where it stands. A piece's hash gives one of 64
letters, and the letters are the signature. The block size is the smallest
power-of-two multiple of LEAST for which a text would have at most LENGTH
pieces; a fingerprint is "size:signature:signature at twice the size". Two
fingerprints can be compared where they have a signature at the same size, by
edit distance.

All hashes of a text come from prefix sums modulo 2^64, so a text is a few array
operations, and long ones go through in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table, written

WINDOW, LEAST, LENGTH = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes that are hashed at once, and of texts in a range of keys; ranges at most (each has a row on the driver), beyond which they grow.
BLOCK, RANGE, MOST_RANGES = 1 << 20, 32 << 20, 20_000
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.cumprod(np.full(n - 1, _BASE, np.uint64), out=out[1:])
    return out


_POWERS = _powers(BLOCK + 1)


def _rolled(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """32-bit hashes of the WINDOW bytes that end at each byte; before: the bytes in front of data."""
    padded = np.concatenate([np.zeros(WINDOW - 1 - len(before), np.uint8), before, data]).astype(np.uint32)
    total = np.zeros(len(data), np.uint32)
    for i in range(WINDOW):
        total = total * np.uint32(0x01000193) + padded[i : i + len(data)] + np.uint32(1)
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    return total ^ total >> np.uint32(13)


def _ends(raw: bytes, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block of the text: its bytes and where pieces end in it (behind the last byte of each)."""
    out, data = [], np.frombuffer(raw, np.uint8)
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK]
        rolled = _rolled(part, data[max(0, start - WINDOW + 1) : start])
        out.append((part, np.flatnonzero(rolled % np.uint32(size) == size - 1) + 1))
    return out


def _letters(blocks: list[tuple[np.ndarray, np.ndarray]]) -> str:
    """One letter for each piece, the rest behind the last end included."""
    found, open_hash, open_length = [], np.uint64(0), 0
    for part, ends in blocks:
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)], out=sums[1:])
        starts = np.concatenate([[0], ends]).astype(np.int64)
        stops = np.concatenate([ends, [len(part)]]).astype(np.int64)
        # a piece's sum times the power that it lacks to BLOCK does not depend on where it stands
        hashes = (sums[stops] - sums[starts]) * _POWERS[BLOCK - starts]
        lengths = stops - starts
        if open_length:
            # what the block before left open goes on here: the same sum as if the piece lay in one block
            hashes[:1] = np.array([open_hash]) + hashes[:1] * np.array([pow(int(_BASE), int(open_length), 1 << 64)], np.uint64)
            lengths[0] += open_length
        found.append(hashes[:-1] + lengths[:-1].astype(np.uint64))
        open_hash, open_length = hashes[-1], lengths[-1]
    if open_length:
        found.append(np.array([open_hash]) + np.array([open_length]).astype(np.uint64))
    if not found:
        return ""
    h = np.concatenate(found)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return _LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text; null and empty texts have '3::'."""
    raw = (text or "").encode()
    size = LEAST
    while size * LENGTH < len(raw):
        size *= 2
    blocks = _ends(raw, size)
    # as pieces are cut at random places, there can be fewer or more of them than expected
    while size > LEAST and sum(len(e) for _, e in blocks) < LENGTH // 2:
        size //= 2
        blocks = _ends(raw, size)
    return f"{size}:{_letters(blocks)}:{_letters(_ends(raw, 2 * size))}"


def distance(a: str, b: str) -> int:
    """Edit distance, with one bit for each letter of a and a few operations on whole numbers for each of b."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, found = full, 0, len(a)
    for letter in b:
        here = places.get(letter, 0)
        zero = ((here & plus) + plus ^ plus) | here | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        found += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(zero | up)) & full, up & zero & full
    return found


def likeness(one: str, other: str) -> float:
    """1 for equal fingerprints, 0 where no block size is common; else 1 less the share of letters to edit."""
    if one == other:
        return 1.0
    (s, a, a2), (t, b, b2) = one.split(":"), other.split(":")
    x, y = {int(s): a, 2 * int(s): a2}, {int(t): b, 2 * int(t): b2}
    best = 0.0
    for size in x.keys() & y.keys():
        if x[size] and y[size]:
            best = max(best, 1 - distance(x[size], y[size]) / max(len(x[size]), len(y[size])))
    return best


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, fingerprint) for every row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])], ["key", "n_chars", "fingerprint"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_chars bigint, fingerprint string").withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _row(key, text: str, mark: str, following: str, next_mark: str) -> tuple:
    mixed = edited(text, following)
    changed = fingerprint(mixed)
    return key, len(text), hashlib.sha256(mixed.encode()).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, next_mark)


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows in order to its results, and at its end one row more with its first and its last text and their places in the order."""
    first, before, names = None, None, [*_NAMES, "head", "head_order", "head_text", "tail_order", "tail_text"]
    more = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        out = []
        for key, order, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = value.as_py() or ""
            mark = fingerprint(text)
            if before is None:
                first = (key, order, text)
            else:
                out.append(_row(before[0], before[2], before[3], text, mark))
            before = (key, order, text, mark)
        yield pa.RecordBatch.from_arrays([*_columns(out, _KINDS), *[pa.nulls(len(out), k) for k in more]], names)
    if before is not None:
        ends = (before[0], *[None] * (len(_NAMES) - 1), *first, before[1], before[2])
        yield pa.RecordBatch.from_arrays(_columns([ends], [*_KINDS, *more]), names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, following) to results."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, following = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            row = _row(batch.column(0)[i].as_py(), text, fingerprint(text), following, fingerprint(following))
            yield pa.RecordBatch.from_arrays(_columns([row], _KINDS), list(_NAMES))


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE) -> DataFrame:
    """Each document's fingerprint held against its edited text's and the next document's, in descending order of key.

    Rows with a null key come last; equal keys are in the order of a hash of their
    texts, so repeated rows follow each other. The last document is followed by
    the first. Keys are whole numbers (ValueError for others). Texts are dealt by
    ranges of about range_bytes, one shuffle for all; each range hands on its
    first and its last text, and those of neighbouring ranges meet in a join, so
    no window covers the order.
    """
    spark = docs.sparkSession
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("keys are put in order as whole numbers")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("order"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-size // range_bytes)))
    placed = [F.desc_nulls_last("key"), F.asc("order")]
    plain = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = rows.repartitionByRange(ranges, *placed).sortWithinPartitions(*placed)
    found = written(dealt.mapInArrow(_compare, f"key bigint, {plain}, head bigint, head_order bigint, head_text string, tail_order bigint, tail_text string"), "ranges")
    ends = found.where("tail_text is not null")
    # the ranges in order: a row of two keys for each, as many as there are ranges
    order = sorted(ends.select("head", "head_order", "key", "tail_order").collect(), key=lambda r: (r["head"] is None, -(r["head"] or 0), r["head_order"]))
    after = [(x["key"], x["tail_order"], y["head"], y["head_order"]) for x, y in zip(order, [*order[1:], *order[:1]], strict=True)]
    result = found.where("tail_text is null").select(*_NAMES)
    if after:
        links = F.broadcast(spark.createDataFrame(after, "tail bigint, tail_at bigint, next bigint, next_at bigint"))
        tails = ends.select("key", "tail_order", "tail_text").join(links, F.col("key").eqNullSafe(F.col("tail")) & (F.col("tail_order") == F.col("tail_at")))
        pairs = tails.join(ends.select("head", "head_order", "head_text"), F.col("next").eqNullSafe(F.col("head")) & (F.col("next_at") == F.col("head_order"))).select("key", "tail_text", "head_text")
        result = result.unionByName(pairs.mapInArrow(_joined, f"key bigint, {plain}"))
    return result.withColumnRenamed("key", key)


def op8_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))


QUERIES = {"op8_piecewise": op8_piecewise}
