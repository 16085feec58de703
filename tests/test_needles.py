"""Needles of one or two words, very many of them, and terms marked longest first."""

import random

from pyspark.sql import functions as F

from brindle.functions.text import highlighted
from brindle.operators import keyed


def test_many_short_needles(spark):
    rng = random.Random(7)
    letters = "abcdeé. "
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 400)))) for i in range(60)] + [(100, None), (101, ""), (102, "a\tb  c\n"), (103, "x" * 3000 + " end")]
    needles = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))) for i in range(20_000)] + [(20_001, ""), (20_002, None), (20_003, " "), (20_004, "\n"), (20_005, "x" * 500), (20_006, "b  c"), (20_007, " end")]
    d, n = spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(needles, "i int, n string")
    found = {(r.doc, r.needle) for r in keyed.anchored_contains(d, n, "d", "t", "i", "n").collect()}
    assert found == {(i, j) for i, t in texts for j, x in needles if t is not None and x and x in t}


def test_highlighting(spark):
    cases = [("Network networking NET", ["net", "network", "Net"], "<mark>Network</mark> <mark>network</mark>ing <mark>NET</mark>"), ("a+b (c)", ["a+b", "(c)"], "<mark>a+b</mark> <mark>(c)</mark>"), ("text", [], "text"), ("text", [None, ""], "text"), (None, ["a"], None), ("$1 \\ x", ["\\", "$1"], "<mark>$1</mark> <mark>\\</mark> x")]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(cases)], "i int, t string, x array<string>").select("i", highlighted(F.col("t"), F.col("x")).alias("h"))
    assert {r.i: r.h for r in rows.collect()} == {i: want for i, (_, _, want) in enumerate(cases)}
