"""Searches over cells find what searches over all rows find, and skip most cells where vectors lie in groups; many questions shuffle the corpus once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import pivots, vector


def frames(spark, spread, n=3000, asked=40, width=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, width))
    rows = [(i, i % 7, [float(x) for x in centres[i % 30] + spread * rng.normal(size=width)]) for i in range(n)]
    odd = [(n, 1, None), (n + 1, 1, [0.0] * width), (n + 2, 1, [1.0, 2.0]), (n + 3, 2, rows[0][2]), (n + 4, 2, rows[0][2])]
    questions = [(i, [float(x) for x in centres[i % 30] + spread * rng.normal(size=width)]) for i in range(asked)] + [(asked, rows[0][2]), (asked + 1, None), (asked + 2, [0.0] * width)]
    return spark.createDataFrame(rows + odd, "id bigint, paper_id int, embedding array<double>"), spark.createDataFrame(questions, "question_id bigint, embedding array<double>")


def ids(found):
    return sorted((r.question_id, r.d_rank, r.id, r.paper_id, r.distance) for r in found.collect())


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.25), (1.0, 1.0)])
def test_cells_against_all_rows(spark, spread, most):
    corpus, asked = frames(spark, spread)
    cells = pivots.file_under_pivots(corpus)
    assert cells.rows.count() == 3002
    for keep, gate in ((5, None), (60, 0.75), (5000, None)):
        assert ids(pivots.nearest_pruned(cells, asked, keep, gate)) == ids(vector.nearest(corpus, asked, keep, gate=gate))
    share = pivots.visited(cells, asked, 5).agg(F.sum("n")).first()[0] / (41 * 3002)
    print("share of compared pairs", spread, share)
    assert share <= most


def test_empty_cells(spark):
    corpus, asked = frames(spark, 0.1, n=1)
    none = pivots.file_under_pivots(corpus.where("id < 0"))
    assert pivots.nearest_pruned(none, asked, 3).collect() == []



def test_many_questions_shuffle_the_corpus_once(spark, monkeypatch):
    corpus, asked = frames(spark, 0.5, n=900, asked=300)
    wanted = ids(vector.nearest(corpus, asked, 4))
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector, "QUESTIONS_AT_ONCE", 16)
    monkeypatch.setattr(vector, "ROWS_AT_ONCE", 64)
    found = vector.nearest(corpus, asked, 4)
    assert ids(found) == wanted
    text = vector._dealt(corpus, asked, None)._jdf.queryExecution().optimizedPlan().toString()
    # questions alone are copied, once for each part; the side with the packs is only dealt
    assert text.count("Generate explode") == 1 and text.index("MapInArrow") < text.index("Generate explode")
    assert ids(vector.nearest(corpus, asked, 2, by_group=True)) == ids(vector.nearest(corpus.repartition(5), asked, 2, by_group=True))
