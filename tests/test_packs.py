"""Searches in packs of postings: the same best rows as ranking every pair, and few rows that leave a task."""

import random

import pytest

from brindle.operators import lexical, packs, postings, websearch

WORDS = ["corn", "corns", "running", "runs", "blue", "the", "of", "night", "nights", "tree"]


def rows(df):
    return sorted((r.question_id, r.s_rank, r.id, r.tf) for r in df.collect())


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(5)
    texts = [(i, i % 3, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for i in range(200)] + [(900, 1, None), (901, None, "corn blue corn")]
    chunks = spark.createDataFrame(texts, "id long, paper_id int, text string")
    return chunks, postings.build(chunks)


@pytest.mark.parametrize("joined", [500_000, 0])
def test_best_is_what_ranking_every_pair_gives(spark, searched, monkeypatch, joined):
    chunks, index = searched
    for name, value in (("PACK_ROWS", 150), ("QUESTIONS_AT_ONCE", 3), ("BLOCKS_AT_ONCE", 2), ("ASKED_AT_ONCE", joined)):
        monkeypatch.setattr(packs, name, value)
    terms = spark.createDataFrame([(q, t) for q in range(10) for t in (WORDS[q], WORDS[(q * 3 + 1) % 10])] + [(10, "absent"), (11, "corn"), (11, "absent"), (12, None)], "question_id long, term string")
    for mode in ("all", "any"):
        wanted = rows(lexical.ranked(lexical.matches(chunks, terms, mode), 7))
        assert wanted and rows(lexical.best(index, terms, 7, mode)) == wanted
        if not joined:
            return
    scope = spark.createDataFrame([(q, p) for q in range(8) for p in ([0], [1, 2])[q % 2]], "question_id long, paper_id long")
    inside = lexical.matches(chunks, terms).join(scope, ["question_id", "paper_id"], "left_semi")
    assert rows(lexical.best(index, terms, 7, scope=scope)) == rows(lexical.ranked(inside, 7))
    typed = ["corn", '"blue night"', "corn or blue tree", "tree -blue", 'corn -"night tree"', '"corn of night" or running', "the of", "-corn", "absent", "running running", '"corn corn"', "corn-blue", None]
    asked = spark.createDataFrame(list(enumerate(typed)), "question_id long, text string")
    for stems in (False, True):
        wanted = rows(lexical.ranked(websearch.search(index, asked, stems), 7))
        assert wanted and rows(websearch.best(index, asked, 7, stems)) == wanted


def test_few_rows_leave_a_task(spark, searched, monkeypatch):
    monkeypatch.setattr(packs, "PACK_ROWS", 10)
    monkeypatch.setattr(packs, "TASKS_A_CORE", 1)
    asked = spark.createDataFrame([(0, "corn")], "question_id long, term string").selectExpr("question_id", "0 as part", "false as no", "term as atom", "0 as place", "term", "term as unit")
    found = packs.best(searched[1], asked, 2)
    assert lexical.matches(searched[1], asked).count() > 60
    assert 2 <= found.count() <= 2 * spark.sparkContext.defaultParallelism


def test_best_covers_are_those_of_every_pair(spark, searched, monkeypatch):
    chunks, index = searched
    monkeypatch.setattr(packs, "PACK_ROWS", 150)
    terms = spark.createDataFrame([(q, t) for q in range(10) for t in {WORDS[q], WORDS[(q * 3 + 1) % 10], WORDS[(q * 7 + 2) % 10]}] + [(10, "absent"), (11, "corn"), (11, "absent"), (12, "blue"), (13, None), (14, "corn"), (14, None)], "question_id long, term string")
    scored = lambda df: sorted((r.question_id, r.s_rank, r.id, r.score) for r in df.collect())
    wanted = scored(lexical.ranked(lexical.cover_density(chunks, terms), 7, "score"))
    assert wanted and scored(lexical.best_covers(index, terms, 7)) == wanted
    # a null term is held by no chunk
    assert {q for q, *_ in rows(lexical.best(index, terms, 7))} == {q for q, *_ in rows(lexical.ranked(lexical.matches(chunks, terms), 7))}


def test_covers_leave_few_rows(spark, searched, monkeypatch):
    monkeypatch.setattr(packs, "PACK_ROWS", 10)
    monkeypatch.setattr(packs, "TASKS_A_CORE", 1)
    kept = []
    monkeypatch.setattr(lexical, "ranked", lambda found, pool, score: kept.append(found.count()) or found)
    lexical.best_covers(searched[1], spark.createDataFrame([(0, "corn")], "question_id long, term string"), 2)
    assert 2 <= kept[0] <= 2 * spark.sparkContext.defaultParallelism


def test_questions_are_read_once(spark, searched):
    """Steps of a search share one reading of what is asked, which is made of texts as a rule."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    asked = spark.createDataFrame([(0, '"blue night" or corn'), (1, "trees -blue")], "question_id long, text string").coalesce(1).mapInPandas(counted, "question_id long, text string")
    assert websearch.best(searched[1], asked, 3, stems=True).count() > 0
    assert read.value <= 4


def test_nearest_of_a_group_keeps_to_its_bound(monkeypatch):
    """A group of many packs passes on ever less, and its nearest are those of all its rows."""
    import numpy as np
    import pyarrow as pa

    from brindle.functions import vector

    monkeypatch.setattr(vector, "STEP", 2)
    rng = np.random.default_rng(3)
    asked = pa.array([{"question_id": q, "embedding": list(rng.normal(size=4)), "gate": None, "scope": None if q else [1, 2]} for q in range(5)])
    units = rng.normal(size=(1000, 4))
    units /= np.sqrt((units * units).sum(1, keepdims=True))
    ids, groups = np.arange(1000), np.repeat([1, 2, 3, 4, 5, 9], [450, 300, 3, 2, 5, 240])
    packs_ = [pa.RecordBatch.from_arrays([pa.array([4], pa.int32()), *(pa.array([x[k : k + 100].tobytes()], pa.binary()) for x in (ids, groups, units)), pa.array([0]), pa.array([asked.to_pylist()])], ["width", "ids", "groups", "units", "block", "asked"]) for k in range(0, 1000, 100)]
    out = [b for b in vector._search(7, True, False, None)(iter(packs_))]
    rows_ = [np.concatenate([b.column(c).to_numpy() for b in out]) for c in range(4)]
    kept = vector._cut(rows_, 7, True)
    block = vector._Block(asked, None)
    found = np.concatenate([block.distances(at, ids, groups, units, False) for at in block.steps()])
    q, r = np.nonzero(~np.isnan(found))
    wanted = vector._cut([block.ids[q], ids[r], groups[r], found[q, r]], 7, True)
    assert all((a == b).all() for a, b in zip(kept, wanted, strict=True))
    # 14 parts of groups in the packs, 7 rows of each for 5 questions, if nothing were remembered
    whole = sum(min(7, n) for k in range(0, 1000, 100) for n in np.unique(groups[k : k + 100], return_counts=True)[1])
    assert len(rows_[0]) < 0.7 * 5 * whole


def test_a_task_passes_on_one_list_of_each_question(spark, monkeypatch):
    """However many packs it meets, and what it passes on is not sorted where it is found."""
    import numpy as np
    import pyarrow as pa

    from brindle.functions import vector

    monkeypatch.setattr(vector, "STEP", 2)
    rng = np.random.default_rng(4)
    asked = [[{"question_id": 10 * b + q, "embedding": list(rng.normal(size=4)), "gate": None, "scope": None} for q in range(5)] for b in range(3)]
    units = rng.normal(size=(1000, 4))
    units /= np.sqrt((units * units).sum(1, keepdims=True))
    ids, groups = np.arange(1000), np.arange(1000) % 3
    dealt = [(k, b) for k in range(0, 1000, 50) for b in range(3)]
    pairs = [pa.RecordBatch.from_arrays([pa.array([4], pa.int32()), *(pa.array([x[k : k + 50].tobytes()], pa.binary()) for x in (ids, groups, units)), pa.array([b]), pa.array([asked[b]])], ["width", "ids", "groups", "units", "block", "asked"]) for k, b in dealt]
    for at_once, lists in ((3, 1), (2, None)):
        monkeypatch.setattr(vector, "BLOCKS_AT_ONCE", at_once)
        out = list(vector._search(7, False, False, None)(iter(pairs)))
        rows_ = [np.concatenate([x.column(c).to_numpy() for x in out]) for c in range(4)]
        assert lists is None or len(rows_[0]) == 15 * 7 * lists
        kept = vector._cut(rows_, 7, False)
        for b in range(3):
            block = vector._Block(pa.array(asked[b]), None)
            found = np.concatenate([block.distances(at, ids, groups, units, False) for at in block.steps()])
            q, r = np.nonzero(~np.isnan(found))
            wanted = vector._cut([block.ids[q], ids[r], groups[r], found[q, r]], 7, False)
            mine = np.isin(kept[0], block.ids)
            assert all((x[mine] == y).all() for x, y in zip(kept, wanted, strict=True))
    corpus = spark.createDataFrame([(i, i % 3, u.tolist()) for i, u in enumerate(units[:40])], "id long, paper_id int, embedding array<double>")
    lines = vector.nearest(corpus, corpus.selectExpr("id as question_id", "embedding"), 3)._jdf.queryExecution().executedPlan().toString().splitlines()
    search = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    assert "Sort" in "".join(lines[:search]) and "Exchange hashpartitioning(question_id" in lines[search - 1]
