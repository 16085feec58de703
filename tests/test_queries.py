"""Every registered query against its SQL, and those without SQL against a plain version."""

import pytest

from brindle import registry
from brindle.functions.folding import fold
from brindle.operators.lexical import cover_score
from brindle.streaming.state import step
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert not differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


def test_columns_of_queries_without_sql(spark):
    for name in sorted(QUERIES.keys() - ORACLES.keys()):
        assert QUERIES[name](spark, SF).columns


def test_cover_density(spark):
    import re

    from brindle.bindings import chunks, question_terms

    terms = {}
    for r in question_terms(spark, SF).collect():
        terms.setdefault(r.question_id, set()).add(r.term)
    texts = {r.id: [t for t in re.split("[^a-z0-9]+", r.text.lower()) if t] for r in chunks(spark, SF).collect()}
    found = {(r.question_id, r.id): r.score for r in QUERIES["sparse_cover_density"](spark, SF).collect()}
    wanted = {}
    for q, asked in terms.items():
        for i, words in texts.items():
            if asked <= set(words):
                places = [(j, w) for j, w in enumerate(words) if w in asked]
                covers = set()
                for a in range(len(places)):
                    for b in range(a, len(places)):
                        inside = {w for _, w in places[a : b + 1]}
                        if inside == asked and {w for _, w in places[a + 1 : b + 1]} != asked and {w for _, w in places[a:b]} != asked:
                            covers.add((a, b))
                wanted[q, i] = round(sum(1 / (1 + places[b][0] - places[a][0] - (b - a)) for a, b in covers), 9)
    assert found and found == {k: v for k, v in wanted.items() if k in found}
    assert all(len([k for k in wanted if k[0] == q]) <= 100 for q in terms) is False or set(found) == set(wanted)
    assert cover_score([], 1) == 0


def test_rate_admission(spark):
    hits = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        hits.setdefault(r.user_id, []).append(r.event_id)
    found = {r.event_id: r for r in QUERIES["rate_admission"](spark, SF).collect()}
    for user, ids in hits.items():
        kept = [[], []]
        for e in sorted(ids, key=lambda e: (found[e].at, e)):
            assert found[e].admitted == step(kept, found[e].at, [(3, 6 * 3600), (4, 86_400)])


def test_fold_tokens(spark):
    from collections import Counter

    wanted = Counter(w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in fold(r.text).split())
    assert {r.word: r.n for r in QUERIES["fold_tokens"](spark, SF).collect()} == dict(wanted)


def test_planned_writes(spark):
    from brindle.operators.planning import free_name

    rows = sorted(QUERIES["planned_writes"](spark, SF).collect(), key=lambda r: (r.document, r.page_id % 40 != 0, r.page_id))
    taken = {}
    for r in rows:
        names = taken.setdefault(r.document, set())
        assert r.planned == (r.path if r.page_id % 40 == 0 else free_name(r.path, names))
        names.add(r.planned.lower())


def test_registered_twice_is_refused():
    with pytest.raises(ValueError):
        registry.register("hybrid_fuse")(lambda spark, sf: None)
