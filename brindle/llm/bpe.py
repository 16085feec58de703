"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks that overlap. Around each chunk border two
pre-tokenisations start at different places, and the border is moved to the
first place where both have a boundary, i.e. where they have fallen into step.
Both neighbours look at the same overlap, so they choose the same place without
talking to each other, and each piece is encoded on its own, on any executor.
Where an overlap has no such place (one giant pre-token), the pieces beside it
are joined again and encoded together, so results never depend on the chunks.

A border is taken only where no match of the pattern can go on: between a
character that is no white space and one that is, or behind a letter or a digit
whose neighbour is not of the same kind (punctuation, also in scripts without
spaces). No match spans such a place and none looks back or ahead across it, so
the pieces' pre-tokens are those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a chunk, and of the overlap on each side of a border.
CHUNK, OVERLAP = 32_768, 512
#: Characters that are encoded before a batch is handed on.
FLUSH = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _codec(path: str):
    """The encoder, each id's bytes, and the compiled pattern; made once in each worker."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoder = tiktoken.Encoding("brindle", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spelled[rank] = token
    return encoder, spelled, regex.compile(public_tokenizers.PATTERN)


def _ids(encoder, text: str) -> np.ndarray:
    """Ids of a text; lone surrogates cannot occur in Spark's UTF-8."""
    return encoder.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


@cache
def _safe():
    """Places between two characters that no match of the tokenizer's pattern joins."""
    import regex

    return regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=[ \t\n\r])")


def resynchronised(pattern, window: str, border: int) -> int | None:
    """Where in window (which starts before the border) scans from its start and from the border first agree."""
    if not border or border >= len(window):
        return None
    early = {m.end() for m in pattern.finditer(window)}
    for match in pattern.finditer(window, border):
        at = match.end()
        if at in early and at < len(window) and _safe().match(window, at):
            return at
    return None


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _spell(spelled: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(spelled.__getitem__, ids))


def _encode_whole(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spelled, _ = _codec(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, size, out = 0, 0, []
            for i, text in enumerate(texts):
                out.append(_ids(encoder, text.as_py() or ""))
                size += len(out[-1])
                if size >= FLUSH or i + 1 == len(texts):
                    more = [pa.array([_spell(spelled, x.tolist()) for x in out], pa.binary())] if decoded else []
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(out)), _lists(out), *more], ["key", "ids", "decoded"][: 2 + decoded])
                    start, size, out = i + 1, 0, []

    return run


def _chunk(size: int, overlap: int):
    """Long texts to rows (key, print of the text, chunk, text with both overlaps, whether it is the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "print", "chunk", "window", "last"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py()
                mark = xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
                count = -(-len(text) // size)
                for k in range(count):
                    window = text[max(0, k * size - overlap) : (k + 1) * size + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], kind), pa.array([mark]), pa.array([k]), pa.array([window]), pa.array([k + 1 == count])], names)

    return run


def _encode_pieces(path: str, size: int, overlap: int):
    """Chunks to pieces: ids, or the text where a border beside it has not been found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _, pattern = _codec(path)
        for batch in batches:
            rows = []
            for k, value, last in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                begin = overlap if k else 0
                begin = min(begin, k * size)
                head = resynchronised(pattern, value[: begin + overlap], begin) if k else 0
                tail_at = begin + size - overlap
                tail = len(value) if last else resynchronised(pattern, value[tail_at : tail_at + 2 * overlap], overlap)
                end = None if tail is None else tail if last else tail_at + tail
                if head is None or end is None:
                    rows.append((None, value[begin if head is None else head : begin + size if end is None else end]))
                else:
                    rows.append((_ids(encoder, value[head:end]), None))
            ids = [np.empty(0, np.int32) if x is None else x for x, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(ids), pa.array([t for _, t in rows], pa.string())], ["key", "print", "chunk", "ids", "open"])

    return run


def _stitch(path: str, decoded: bool):
    """Pieces in order of key, print and chunk to a row of ids for each text; repeated rows bring each piece as often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spelled, _ = _codec(path)
        owner, parts, text, kind, at, copies = None, [], "", None, -1, 0

        def close():
            nonlocal text
            if text:
                parts.append(_ids(encoder, text))
                text = ""

        def rows():
            close()
            ids = np.concatenate(parts or [np.empty(0, np.int32)])
            more = [pa.array([_spell(spelled, ids.tolist())], pa.binary())] if decoded else []
            for _ in range(copies):
                yield pa.RecordBatch.from_arrays([pa.array([owner[0]], kind), _lists([ids]), *more], ["key", "ids", "decoded"][: 2 + decoded])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, mark, chunk, ids, open_text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(3), batch.column(4).to_pylist(), strict=True):
                if (key, mark) != owner:
                    if owner is not None:
                        yield from rows()
                    owner, parts, text, at, copies = (key, mark), [], "", -1, 0
                copies += chunk == 0
                if chunk == at:
                    continue
                at = chunk
                if open_text is None:
                    close()
                    parts.append(ids.values.to_numpy(zero_copy_only=False))
                else:
                    text += open_text
        if owner is not None:
            yield from rows()

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """Ids of every text: rows (key, ids array<int>), one for each row of docs; if decoded, with the bytes that decode() makes of the ids.

    A null or empty text has no ids. Keys may be null or repeated: chunks are told
    apart by key and text. Other columns are neither read nor passed on. Needs
    2 * overlap < chunk.
    """
    if 2 * overlap >= chunk:
        raise ValueError("chunks must be longer than both overlaps")
    path = path or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    out = f"key {kind}, ids array<int>{', decoded binary' if decoded else ''}"
    whole = rows.where(size <= chunk).mapInArrow(_encode_whole(path, decoded), out)
    pieces = (
        rows.where(size > chunk)
        .mapInArrow(_chunk(chunk, overlap), f"key {kind}, print bigint, chunk bigint, window string, last boolean")
        .repartition("key", "print", "chunk")
        .mapInArrow(_encode_pieces(path, chunk, overlap), f"key {kind}, print bigint, chunk bigint, ids array<int>, open string")
    )
    stitched = pieces.repartition("key", "print").sortWithinPartitions("key", "print", "chunk").mapInArrow(_stitch(path, decoded), out)
    return whole.unionByName(stitched).withColumnRenamed("key", key)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _codec(path)[1]
        for batch in batches:
            start, size, out = 0, 0, []
            for i, ids in enumerate(batch.column(1)):
                out.append(_spell(spelled, ids.values.to_pylist()) if ids.is_valid else None)
                size += len(out[-1] or b"")
                if size >= 4 * FLUSH or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(out)), batch.column(1).slice(start, len(out)), pa.array(out, pa.binary())], ["key", "ids", "decoded"])
                    start, size, out = i + 1, 0, []

    return run


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """The bytes of every list of ids: rows (key, ids, decoded binary); null ids stay null."""
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_decode(path or vocabulary_path()), f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the ids are decoded by the worker that has made them
    found = encode(table(spark, sf_dir, "documents"), decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document with its ids and the digest of the bytes they decode to; texts are whole, so nothing is dropped here."""
    found = encode(docs, decoded=True)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_bpe": op9_bpe}
