"""Quality classifier: cumulative-link (ordinal) regression on graded ratings.

A text is the set of its words and of their beginnings, hashed to BUCKETS, and a few binned shares
(odd word endings, capitals, repeated words, word length). All grades share one
vector of weights; ordered thresholds turn the score s into the chance of more
than grade k, 1 / (1 + exp(threshold_k - s)), which gives the expected grade
and the tail probability of the top grade for selection.

Fitting uses a bounded sample (SAMPLE labelled rows in expectation, drawn by a
hash of the key); every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import hinted, kept, table, unused

BUCKETS, SAMPLE = 1 << 18, 12_000
#: Rows of the sample that must have a feature, and standard errors by which their mean grade must differ from all rows', for it to get a weight.
SEEN, STANDS_OUT = 5, 4.0
#: Steps, pace and penalty of the fit.
STEPS, PACE, PENALTY = 400, 0.1, 1e-4
CACHE = 1 << 20
SHARES = 4
#: Letters of a word's beginnings that are features too, so that other forms of a known word count.
PREFIXES = (4, 5)
_EDGES = np.array([0.02, 0.1, 0.25, 0.5, 0.75])


class _Buckets(dict):
    """Buckets of each word and of its first letters, without what is not a letter or digit at its ends, in lower case; none if nothing is left."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        core = word.lower()
        start, end = 0, len(core)
        while start < end and not core[start].isalnum():
            start += 1
        while end > start and not core[end - 1].isalnum():
            end -= 1
        core = core[start:end]
        named = [core, *(f"{core[:n]}-" for n in PREFIXES if len(core) > n)] if core else []
        self[word] = value = tuple(zlib.crc32(x.encode()) % BUCKETS for x in named)
        return value


_BUCKETS = _Buckets()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features: buckets of words and their beginnings, then a bin of each share; of an empty text only its shares."""
    words = (text or "").split()
    different = set(words)
    found = set(chain.from_iterable(map(_BUCKETS.__getitem__, different)))
    n, d = max(len(words), 1), max(len(different), 1)
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)'\"" for w in different) / d
    loud = sum(w.isupper() and len(w) > 1 for w in different) / d
    again = 1 - len(different) / n if n >= 20 else 0.0
    bare = sum(not w[0].isalnum() for w in different) / d
    bins = np.searchsorted(_EDGES, [odd, loud, again, bare], side="right")
    return np.array(sorted(found) + [BUCKETS + i * (len(_EDGES) + 1) + int(b) for i, b in enumerate(bins)], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Ordinal:
    """Weights of all features (absent ones 0), ordered thresholds, and the grades in order, one more than thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    levels: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Chance of more than each grade but the top one."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        """Mean grade: the lowest one and, for each further one, its step times the chance of it or more."""
        return self.levels[0] + tails @ np.diff(self.levels)


def loss_and_gradient(theta: np.ndarray, owner: np.ndarray, at: np.ndarray, ranks: np.ndarray, width: int, penalty: float) -> tuple[float, np.ndarray]:
    """Mean negative log chance of the rows' ranks, with the penalty, and its gradient.

    theta: width weights, the first threshold, and the logarithms of the gaps
    between thresholds, so that they stay in order. Row owner[i] has feature at[i].
    """
    w, free = theta[:width], theta[width:]
    n, top = len(ranks), len(free)
    cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    score = np.bincount(owner, w[at], minlength=n)
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    high, low = _sigmoid(edges[ranks + 1] - score), _sigmoid(edges[ranks] - score)
    high[ranks == top], low[ranks == 0] = 1.0, 0.0
    chance = np.maximum(high - low, 1e-12)
    dh, dl = high * (1 - high) / chance, low * (1 - low) / chance
    grad_w = np.bincount(at, ((dh - dl) / n)[owner], minlength=width) + penalty * w
    grad_cut = np.array([(-dh[ranks == k].sum() + dl[ranks == k + 1].sum()) / n for k in range(top)])
    behind = np.cumsum(grad_cut[::-1])[::-1]
    return float(-np.log(chance).mean() + penalty * (w @ w) / 2), np.concatenate([grad_w, behind[:1], behind[1:] * np.exp(free[1:])])


def fit(rows: list[np.ndarray], grades: np.ndarray, seen: int = SEEN, stands_out: float = STANDS_OUT, steps: int = STEPS, pace: float = PACE, penalty: float = PENALTY) -> Ordinal:
    """Fit by full-batch gradient steps with momentum and per-weight pace; rows are feature arrays, grades whole numbers of any range, gaps included."""
    levels, ranks = np.unique(grades, return_inverse=True)
    top = len(levels) - 1
    flat = np.concatenate(rows)
    width = BUCKETS + SHARES * (len(_EDGES) + 1)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # words by the thousand are in a few rows each; a weight for each would learn the sample by heart
    count = np.bincount(flat, minlength=width)
    mean = np.bincount(flat, ranks[owner].astype(float), minlength=width) / np.maximum(count, 1)
    error = max(ranks.std(), 1e-9) / np.sqrt(np.maximum(count, 1))
    used = np.flatnonzero((count >= seen) & ((np.abs(mean - ranks.mean()) >= stands_out * error) | (np.arange(width) >= BUCKETS)))
    column = np.full(width, -1)
    column[used] = np.arange(len(used))
    at = column[flat]
    owner, at = owner[at >= 0], at[at >= 0]
    shares = np.clip([(ranks > k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    first = np.log((1 - shares) / shares)
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))]) if top else np.empty(0)
    theta = np.concatenate([np.zeros(len(used)), free])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1) if top else ():
        grad = loss_and_gradient(theta, owner, at, ranks, len(used), penalty)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(width)
    weights[used] = theta[: len(used)]
    free = theta[len(used) :]
    return Ordinal(weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), levels.astype(float))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()).astype(np.int32).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["key", "grade", "features"])


def train(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Ordinal | None:
    """Fit on about so many rated documents; ratings: key, grade (whole numbers, of which any may be missing). None if none is rated.

    Null keys and grades are left out; a key that is rated more than once has its
    least grade.
    """
    rated = ratings.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(grade).cast("int").alias("grade"))
    total = rated.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = hinted(kept(rated.where(draw < sample / total)), 2 * sample)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(drawn, "key").select("key", "grade", "text")
    kind = rows.schema["key"].dataType.simpleString()
    found = sorted(rows.mapInArrow(_featured, f"key {kind}, grade int, features binary").collect(), key=lambda r: (r["key"], r["grade"]))
    if not found:
        return None
    return fit([np.frombuffer(r["features"], np.int32) for r in found], np.array([r["grade"] for r in found]))


def _scored(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.weights[features(t.as_py())].sum() for t in batch.column(0)])
            tails = model.tails(scores)
            kept = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.expected(tails)), pa.array(tails[:, -1] if tails.shape[1] else np.ones(len(scores)))], [*batch.schema.names[1:], "expected_grade", "top_chance"])

    return run


def rate(docs: DataFrame, model: Ordinal | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but the text, if None), with expected_grade and top_chance, of every row.

    Null texts count as empty. Without a model both are null. Columns of those
    names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("expected_grade", "top_chance") and (keep is not None or c != text)]
    body = unused("text", docs.select(*keep))
    rows = docs.select(F.col(text).alias(body), *[F.col(c) for c in keep])
    if model is None:
        return rows.drop(body).withColumns({c: F.lit(None).cast("double") for c in ("expected_grade", "top_chance")})
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(_scored(model), f"{fields}expected_grade double, top_chance double")


#: A document is selected if its chance of the top grade is so high.
SELECT = 0.5


def op3_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: one point for quality and one for not being toxic; without ratings every document is selected."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    found = rate(docs, train(docs, ratings), keep=["doc_id"])
    return found.select("doc_id", "expected_grade", "top_chance", F.coalesce(F.col("top_chance") >= SELECT, F.lit(True)).alias("keep"))


QUERIES = {"op3_ordinal": op3_ordinal}
