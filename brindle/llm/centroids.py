"""Centroid clustering by sort-means: exact k-means over integer vectors that compares few centroids.

Before each round the distances between centroids are taken, and for each centroid
the others are put in order of them. A vector is compared with the centroid that it
had last, then with the others in that one's order; the scan ends at the first whose
distance from the last one is strictly beyond twice the vector's own, for by the
triangle inequality neither that one nor any behind it can be nearer, or as near.

Vectors stay where Spark has dealt them: a round is one pass that writes each vector
with its new assignment, and one aggregation whose tasks sum their own vectors first.
Only the centroids (k rows) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.llm.common import discard, table, written

#: Centroids, rounds, components of a vector, and what a component is multiplied with before it is rounded down.
K, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
#: Components beyond this size count as this: four times the squared distance of vectors of up to 1024 components then fits 64 bits.
LARGEST = 1 << 24


def order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all of them, itself first, by squared distance from it (equal ones by number), and these distances."""
    far = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(far, -1)
    near = np.argsort(far, axis=1, kind="stable")
    far = np.maximum(np.take_along_axis(far, near, 1), 0)
    return near, far


def assign(vectors: np.ndarray, last: np.ndarray, centroids: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), squared distance to it, and how many centroids each vector was compared with."""
    cluster, distance, compared = last.copy(), np.zeros(len(vectors), np.int64), np.ones(len(vectors), np.int32)
    for c in np.unique(last):
        rows = np.flatnonzero(last == c)
        own = ((vectors[rows] - centroids[c]) ** 2).sum(1)
        best, chosen = own.copy(), np.full(len(rows), c, last.dtype)
        # farthest first, so that the vectors that go on are a prefix
        by = np.argsort(-own, kind="stable")
        reach = 4 * own[by]
        for other, apart in zip(near[c, 1:], far[c, 1:], strict=True):
            on = by[: np.searchsorted(-reach, -apart, side="right")]
            if not len(on):
                break
            found = ((vectors[rows[on]] - centroids[other]) ** 2).sum(1)
            better = (found < best[on]) | ((found == best[on]) & (other < chosen[on]))
            best[on[better]], chosen[on[better]] = found[better], other
            compared[rows[on]] += 1
        cluster[rows], distance[rows] = chosen, best
    return cluster, distance, compared


def _assigned(rows: DataFrame, centroids: list[list[int]], name: str, with_vector: bool) -> DataFrame:
    """rows (key, v, cluster) with the next assignment, its distance and the number of comparisons, written."""
    kept = [f for f in rows.schema.fields if f.name == "key" or with_vector and f.name == "v"]
    kinds = T.StructType([*kept, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("n_compared", T.IntegerType())])
    columns = to_arrow_schema(kinds)
    places = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = order(places)
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                found = assign(vectors, batch.column("cluster").to_numpy(zero_copy_only=False), places, near, far)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).cast(columns.field(f.name).type) for f in kept], *map(pa.array, found)], schema=columns)

    return written(rows.mapInArrow(run, kinds), name)


def clean_vectors(rows: DataFrame, key: str, vector: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Rows (key, v): integers floor(scale * x) of the vectors of exactly width components, all of them finite."""
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.lit(float(scale)) * c), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where((F.size(vector) == width) & F.coalesce(finite, F.lit(False))).select(F.col(key).alias("key"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose keys hash lowest with the seed, in that order; a null key counts as no text, equal keys go by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def means(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The rounded-down mean of each cluster of rows (v, cluster); an empty cluster's centroid stays."""
    width = len(centroids[0])
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(width)]).alias("total")).collect()
    found = {r.cluster: [t // r.n for t in r.total] for r in sums}
    return [found.get(c, old) for c, old in enumerate(centroids)]


def sort_means(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """Rows (key, cluster, distance, n_compared) of every vector that is kept, and the final centroids.

    A vector that is null, of another width, or with a null or non-finite component
    is left out. Keys may be null or repeated: each row is a vector. Components
    beyond LARGEST count as LARGEST. Fewer vectors than k make fewer centroids, no
    vectors none and no rows. n_compared tells of the last assignment.
    """
    rows = clean_vectors(docs, key, vector, width, scale)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        nothing = rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("n_compared"))
        return nothing.where(F.lit(False)), []
    last = rows.withColumn("cluster", F.lit(0))
    old: list[DataFrame] = []
    for n in range(rounds):
        last = _assigned(last, centroids, f"round-{n}", True)
        discard(*old)
        old = [last]
        centroids = means(last, centroids)
    found = _assigned(last, centroids, "clusters", False)
    discard(*old)
    return found.withColumnRenamed("key", key), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = sort_means(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if not centroids:
        return found.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"), "n_compared")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    each = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    numbers = range(len(centroids))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        each([sums.get(c, 0) for c in numbers], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        each([digest(centroids[c]) for c in numbers], "string").alias("centroid_sha256"),
        "n_compared",
    )


QUERIES = {"op13_sort_means": op13_sort_means}


def _sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> str:
    apart = lambda a, b: f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(greatest(least(floor({scale} * x), {LARGEST}), {-LARGEST}) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS u FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept) QUALIFY c < {k})",
        "a0 AS (SELECT row, 0 AS cluster FROM kept)",
    ]
    for n in range(1, rounds + 2):
        parts.append(f"a{n} AS MATERIALIZED (SELECT row, arg_min(c, [d, c]) AS cluster, min(d) AS distance FROM (SELECT row, CAST(c AS BIGINT) AS c, {apart('v', 'u')} AS d FROM kept, c{n - 1}) GROUP BY row)")
        if n <= rounds:
            mean = f"SELECT cluster AS c, array_agg(m ORDER BY i) AS u FROM (SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT cluster, i, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({width})) AS i FROM kept JOIN a{n} USING (row)) GROUP BY cluster, i)) GROUP BY cluster"
            parts.append(f"m{n} AS ({mean}), c{n} AS MATERIALIZED (SELECT o.c, coalesce(m.u, o.u) AS u FROM c{n - 1} o LEFT JOIN m{n} m ON m.c = o.c)")
    last = rounds + 1
    return f"""
WITH {', '.join(parts)},
apart AS (SELECT x.c AS a, y.c AS b, {apart('x.u', 'y.u')} AS d FROM c{rounds} x, c{rounds} y),
seen AS (SELECT row, count(*) AS n FROM (SELECT k.row, p.cluster, 4 * {apart('k.v', 'u')} AS reach FROM kept k JOIN a{rounds} p USING (row) JOIN c{rounds} o ON o.c = p.cluster) r JOIN apart ON a = cluster WHERE d <= reach OR a = b GROUP BY row)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(u, ',')) AS centroid_sha256, CAST(n AS INTEGER) AS n_compared
FROM kept JOIN a{last} USING (row) JOIN c{rounds} o ON o.c = cluster JOIN seen USING (row)
"""


ORACLE = {"op13_sort_means": _sql()}
