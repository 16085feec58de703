"""Language identification with a string kernel.

The kernel of two texts is the cosine of the sets of their character n-grams
(blended spectrum of lengths 1 to 3, presence only, hashed to BUCKETS). It is
approximated by Nystrom landmarks: a text is described by its kernel with a few
landmark texts of each language, whitened by the landmarks' own kernel matrix,
and one ridge regression for each language says how likely it is.

Fitting uses a bounded sample, PER_LANGUAGE rows of each language in expectation,
drawn by a hash of the key from all labelled rows and put in order by another,
so that the landmarks, its first rows, are a draw as well; scoring reads every text
whole, in blocks, as products of a presence matrix with the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table, unused

BUCKETS = 1 << 15
PER_LANGUAGE, LANDMARKS, RIDGE = 400, 24, 1e-2
#: Rows, and characters, that are turned into a presence matrix at once.
ROWS, BLOCK = 128, 1 << 19
UNDETERMINED = "und"
#: The pipeline drops a document whose confidence is lower than this. It is where the cut stands on that scale:
#: all but REJECTED of labelled rows, held out in FOLDS folds, are above it, and chance is by LIFT of what is left to 1 below it.
FLOOR = 0.2
REJECTED, FOLDS, LIFT = 0.002, 4, 0.1


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 for all that is no letter, else 1 to 254; letters beyond the first plane share 255."""
    plane = np.array([1 + i % 254 if chr(i).isalpha() else 0 for i in range(1 << 16)], np.uint8)
    return plane


def _codes(text: str) -> np.ndarray:
    """Classes of the characters of a lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    beyond = points >= 1 << 16
    if not beyond.any():
        return _classes()[points]
    codes = _classes()[np.where(beyond, 0, points)]
    codes[beyond] = [255 if chr(p).isalpha() else 0 for p in points[beyond]]
    return codes


def _mark(found: np.ndarray, base: np.ndarray | int, c: np.ndarray, n: int) -> None:
    """Mark the n-grams that begin at the first n classes of c (two more follow) in the flat presence matrix; base: where the row of each begins."""
    c = c.astype(np.int64)
    pair, low = c[:n] * 256 + c[1 : n + 1], lambda x: (x * 0x9E3779B1 >> 17) & (BUCKETS - 1)
    found[base + c[:n]] = 1
    found[base + low(pair + 256)] = 1
    found[base + low(pair * 256 + c[2 : n + 2] + (1 << 17))] = 1


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashed n-gram presence, and whether each text has a letter; long texts go through in blocks."""
    found = np.zeros(len(texts) * BUCKETS, np.uint8)
    letters = np.zeros(len(texts), bool)
    queue: list[tuple[int, np.ndarray]] = []
    held = 0

    def drain():
        nonlocal held
        if queue:
            # two separators stand before each text and one behind it; beyond that, as before the next text, there are only separators
            pads = [np.concatenate(([0, 0], c, [0])).astype(np.uint8) for _, c in queue]
            base = np.repeat(np.array([i for i, _ in queue], np.int64) * BUCKETS, [len(p) for p in pads])
            _mark(found, base, np.concatenate([*pads, [0, 0]]), len(base))
            queue.clear()
            held = 0

    for i, text in enumerate(texts):
        if len(text) <= BLOCK:
            c = _codes(text)
            letters[i] = c.any()
            queue.append((i, c))
            held += len(c)
            if held >= BLOCK:
                drain()
        else:
            for start in range(0, len(text), BLOCK):
                c, ahead = _codes(text[start : start + BLOCK]), _codes(text[start + BLOCK : start + BLOCK + 2])[:2]
                letters[i] |= c.any()
                before, behind = [0, 0] if start == 0 else [], [0] if start + BLOCK >= len(text) else []
                _mark(found, i * BUCKETS, np.concatenate([before, c, behind, ahead, [0, 0]]), len(before) + len(c) + len(behind))
    drain()
    return found.reshape(len(texts), BUCKETS), letters


def _blocks(column: pa.Array, rows: int = ROWS, chars: int = 4 * BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    start, held, block = 0, 0, []
    for i, value in enumerate(column):
        block.append(value.as_py())
        held += len(block[-1] or "")
        if len(block) >= rows or held >= chars or i + 1 == len(column):
            yield start, block
            start, held, block = i + 1, 0, []


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in _blocks(batch.column(1)):
            bits = np.packbits(presence([t or "" for t in texts])[0], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array([x.tobytes() for x in bits], pa.binary())], ["label", "bits"])


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray  # landmarks x columns, each row divided by the root of its size
    weights: np.ndarray  # landmarks + 1 x languages, whitening included
    cut: float  # evidence that all but REJECTED of held-out rows have

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.judged(texts)[:2]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, whether each text has a letter, and the share of its n-grams that any landmark has."""
        found, letters = presence(texts)
        sizes = np.maximum(found.sum(1, dtype=np.int64), 1)
        known = found[:, self.columns].astype(np.float32)
        kernel = (known @ self.landmarks.T) / np.sqrt(sizes)[:, None]
        return np.hstack([kernel, np.ones((len(texts), 1))]) @ self.weights, letters, known.sum(1) / sizes

    def confidence(self, values: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Evidence (best score times known share) on a scale where chance is 0, the cut is FLOOR and certainty is 1.

        The scores of a text sum to 1, so the best alone is at least 1/languages
        for any text, and always 1 where there is one language.
        """
        return np.interp(np.clip(values.max(1), 0, 1) * known, [min(1 / len(self.languages), self.cut / 2), self.cut, 1], [0, FLOOR, 1])


def _ridge(kernel: np.ndarray, first: np.ndarray, y: np.ndarray, train: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks (indexes into first) and weights, learned from the rows in train; kernel is that of all rows with the landmarks, rows first."""
    marks = np.flatnonzero(train[first])
    values, vectors = np.linalg.eigh(kernel[np.ix_(first[marks], marks)])
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z, y = np.hstack([kernel[np.ix_(train, marks)] @ whiten, np.ones((train.sum(), 1))]), y[train]
    # each language weighs the same, however many of its rows were drawn
    share = y @ (1 / np.maximum(y.sum(0), 1)) * len(y) / y.shape[1]
    held = ridge * len(y) * np.eye(z.shape[1]) / z.shape[1]
    held[-1, -1] = 0
    beta = np.linalg.solve(z.T @ (z * share[:, None]) + held + 1e-9 * np.eye(z.shape[1]), z.T @ (y * share[:, None]))
    return marks, np.vstack([whiten @ beta[:-1], beta[-1:]])


def _cut(x: np.ndarray, kernel: np.ndarray, first: np.ndarray, y: np.ndarray, ridge: float) -> float:
    """The evidence that all but REJECTED of the sampled rows have where they are held out; each is, in one of FOLDS fits."""
    fold, evidence = np.arange(len(x)) % FOLDS, []
    for f in range(FOLDS):
        train, test = fold != f, np.flatnonzero(fold == f)
        if not train[first].any() or not len(test):
            continue
        marks, weights = _ridge(kernel, first, y, train, ridge)
        columns = (x[first[marks]] > 0).any(0)
        values = np.hstack([kernel[np.ix_(test, marks)], np.ones((len(test), 1))]) @ weights
        known = np.array([(columns & (x[i] > 0)).sum() / max(1, (x[i] > 0).sum()) for i in test])
        right = values.argmax(1) == y[test].argmax(1)
        evidence.append((np.clip(values.max(1), 0, 1) * known)[right])
    chance = 1 / y.shape[1]
    least = chance + LIFT * (1 - chance) if y.shape[1] > 1 else LIFT
    found = np.concatenate(evidence) if evidence else np.empty(0)
    return float(min(max(np.quantile(found, REJECTED), least) if len(found) else least, 0.99))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on about per_language rows of each language; rows without a label are left out. None without labelled rows."""
    rows = docs.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, per_language / n)])
    sample = rows.where(F.col("text").isNotNull() & (draw < rate[F.col("label")])).orderBy("label", F.xxhash64(F.lit("order"), "key"), "key").select("label", "text")
    found = sample.mapInArrow(_sampled, "label string, bits binary").collect()
    if not found:
        return None
    names = [r["label"] for r in found]
    x = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in found]), axis=1)
    length = np.sqrt(np.maximum(x.sum(1, dtype=np.int64), 1)).astype(np.float32)[:, None]
    languages = sorted(set(names))
    y = np.array([[float(n == lang) for lang in languages] for n in names])
    first = np.concatenate([np.flatnonzero(y[:, j])[:landmarks] for j in range(len(languages))])
    marks = x[first] / length[first]
    columns = np.flatnonzero(marks.any(0))
    # in blocks, so that the driver never holds the whole sample as floats
    kernel = np.vstack([(x[k : k + ROWS].astype(np.float32) / length[k : k + ROWS]) @ marks.T for k in range(0, len(x), ROWS)]).astype(np.float64)
    weights = _ridge(kernel, first, y, np.ones(len(x), bool), ridge)[1]
    cut = _cut(x, kernel, first, y, ridge)
    return Model(languages, columns, np.ascontiguousarray(marks[:, columns]), weights, cut)


def _score(model: Model | None, calibrated: bool, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _blocks(batch.column(0)):
                best, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if model is not None:
                    values, letters, known = model.judged([t or "" for t in texts])
                    top = values.argmax(1)
                    best = [model.languages[j] if ok else UNDETERMINED for j, ok in zip(top, letters, strict=True)]
                    score = np.where(letters, model.confidence(values, known) if calibrated else np.clip(values.max(1), 0, 1), 0.0)
                kept = [batch.column(i).slice(start, len(texts)) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], *names])

    return run


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, calibrated: bool = True, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep (all but the text, if None), with the language and its score (0 to 1) under the names given.

    A text that is null, empty or without a letter gets 'und' and 0, and so does
    every text if there is no model. If calibrated, the score is the confidence
    that compares with FLOOR; otherwise the best language's own. Columns of those names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names and (keep is not None or c != text)]
    rows = docs.select(F.col(text).alias(unused("text", docs.select(*keep))), *[F.col(c) for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_score(model, calibrated, names), f"{fields}{', ' if fields else ''}`{names[0]}` string, `{names[1]}` double")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"], calibrated=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents whose language is clear; learned from those labelled rows that are not held out."""
    model = fit(docs.where(~held_out()))
    names = unused("lang_pred", docs), unused("score", docs)
    return predict(docs, model, keep=docs.columns, names=names).where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= FLOOR)).select(docs.columns)


QUERIES = {"op10_langid": op10_langid}
