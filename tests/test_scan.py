"""Running sums, sessions and moving counts: with one key that holds a third of the rows, and every key cut into ranges."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    keys = ["hot"] * 400 + [f"k{rng.randrange(40)}" for _ in range(780)] + [None] * 20
    data = [(k, i, rng.randrange(3000), rng.choice([None, 1, 2, -3])) for i, k in enumerate(keys)]
    return data, spark.createDataFrame(data, "k string, i int, at bigint, n int").repartition(7).withColumn("part", F.lit("x"))


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_running_sums(rows, at_once):
    data, df = rows
    found = {r.i: (r.total, r.rank, r.part) for r in scan.running(df, "k", ["at", "i"], {"total": F.col("n"), "rank": F.lit(1)}, at_once).collect()}
    total, rank = {}, {}
    for k, i, _, n in sorted(data, key=lambda r: (r[2], r[1])):
        total[k], rank[k] = total.get(k, 0) + (n or 0), rank.get(k, 0) + 1
        assert found[i] == (total[k], rank[k], "x")
    assert len(found) == len(data)


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_sessions_and_counts(rows, at_once):
    data, df = rows
    found = {r.i: r.session for r in scan.sessions(df, "k", ["at", "i"], "at", F.lit(20), at_once).collect()}
    last, session = {}, {}
    for k, i, at, _ in sorted(data, key=lambda r: (r[2], r[1])):
        if k not in last or at - last[k] > 20:
            session[k] = session.get(k, 0) + 1
        last[k] = at
        assert found[i] == session[k]
    hits = {r.i: r.hits for r in scan.counts_within(df, "k", "i", "at", 50, at_once).collect()}
    assert hits == {i: sum(x[0] == k and at - 50 <= x[2] <= at for x in data) for k, i, at, _ in data}


def test_a_large_key_is_dealt_over_ranges(spark, rows):
    _, df = rows
    ranges = scan._ranged(df, "k", ["at", "i"], "p")
    sizes = [r["count"] for r in ranges.groupBy("p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 5 * sorted(sizes)[len(sizes) // 2]
    assert ranges.where("k = 'hot'").select("p").distinct().count() > 1


def test_empty(spark):
    none = spark.createDataFrame([], "k string, i int, at bigint, n int")
    for at_once in (-1, 0, 5):
        assert scan.running(none, "k", ["i"], {"t": F.col("n")}, at_once).collect() == []
        assert scan.sessions(none, "k", ["i"], "at", F.lit(1), at_once).collect() == []
        assert scan.counts_within(none, "k", "i", "at", 5, at_once).collect() == []
