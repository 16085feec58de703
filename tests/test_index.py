"""Stems, the stored index, and searches over it: the same rows as over texts, from the asked tokens' folders alone."""

import re

import pytest
from pyspark.sql import functions as F

from brindle import registry
from brindle.bindings import chunks, question_terms
from brindle.functions.stemming import stemmed
from brindle.operators import lexical, postings, websearch
from brindle.plans.indexes import text_index
from brindle.plans.retrieval import typed_questions

SF = "/root/testdata/sf0.001"
#: Words and their stems as the rules' own vocabulary has them.
STEMS = (
    "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consistency:consist consistently:consist consolation:consol "
    "consolatory:consolatori consoles:consol consolidated:consolid consolingly:consol consonant:conson consorting:consort conspicuously:conspicu "
    "conspiracy:conspiraci conspirators:conspir constables:constabl constance:constanc constancy:constanc constant:constant knackeries:knackeri "
    "knavish:knavish kneaded:knead kneeling:kneel knightly:knight knitted:knit knives:knive knocker:knocker happy:happi say:say cry:cri by:by flies:fli "
    "dies:die ties:tie gas:gas this:this gaps:gap kiwis:kiwi hopping:hop hoping:hope luxuriated:luxuri falling:fall agreed:agre feed:feed disabled:disabl "
    "relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope "
    "formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:format electrical:electr goodness:good revival:reviv "
    "allowance:allow inference:infer airliner:airlin adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust "
    "dependent:depend adoption:adopt communism:communism activate:activ effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas "
    "controll:control roll:roll generate:generat generous:generous communication:communic arsenal:arsenal skis:ski skies:sky dying:die news:news "
    "inning:inning innings:inning proceed:proceed exceeds:exceed succeeding:succeed earrings:earring sky:sky singly:singl only:onli youth:youth "
    "boyish:boyish yes:yes geology:geolog apologies:apolog biology:biolog running:run ran:ran networks:network protocols:protocol queries:queri "
    "stemming:stem indexes:index analyses:analys universities:univers organization:organ studies:studi is:is a:a "
)


def test_stems(spark):
    pairs = [x.split(":") for x in STEMS.split()]
    rows = stemmed(spark.createDataFrame([*pairs, ["", ""], [None, None], ["größe", "größe"], ["2024", "2024"]], "term string, want string")).collect()
    assert [(r.term, r.stem) for r in rows if r.stem != r.want] == []


def ids(rows):
    return sorted(map(tuple, rows.collect()))


def test_searches_over_the_index_are_those_over_texts(spark):
    corpus, index = chunks(spark, SF), text_index(spark, SF)
    terms = question_terms(spark, SF)
    for mode in ("all", "any"):
        assert ids(lexical.matches(index, terms, mode).select("question_id", "id", "tf")) == ids(lexical.matches(corpus, terms, mode).select("question_id", "id", "tf"))
    assert ids(lexical.cover_density(index, terms)) == ids(lexical.cover_density(corpus, terms))
    typed = typed_questions(spark, SF)
    assert ids(websearch.search(index, typed)) == ids(websearch.search(corpus, typed))


def test_index_rows(spark):
    docs = [(1, 9, "The cat, the CAT and a dog"), (2, 9, ""), (3, None, None), (4, 8, "cat"), (None, 8, "cat")]
    index = postings.build(spark.createDataFrame(docs, "id bigint, paper_id bigint, text string"))
    rows = {(r.term, r.id): (r.paper_id, r.tf, list(r.places)) for r in index.postings.collect()}
    assert rows["cat", 1] == (9, 2, [1, 3]) and rows["cat", 4] == (8, 1, [0]) and len(rows) == 6
    assert {r.term: (r.chunks, r.stem) for r in index.vocabulary.collect()}["cat"] == (2, "cat")
    empty = postings.build(spark.createDataFrame([], "id bigint, paper_id bigint, text string"))
    assert postings.lookup(empty, spark.createDataFrame([("cat",)], "term string")).count() == 0


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_a_search_reads_the_asked_folders_alone(spark):
    index = text_index(spark, SF)
    word = index.postings.select("term").first().term
    found = lexical.matches(index, spark.createDataFrame([(1, word)], "question_id bigint, term string"))
    text = plan(found)
    assert re.search(r"PartitionFilters: \[.*bucket", text) and "documents" not in text
    assert "documents.parquet" not in plan(registry.queries()["sparse_and_topk"](spark, SF))


def test_the_index_is_built_once(spark):
    assert text_index(spark, SF) is text_index(spark, SF)


def plain_search(texts, questions, stem):
    """(question, id): finds, text by text and word by word."""
    words = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    told = {i: [stem[w] for w in words(t)] for i, t in texts.items()}
    out = {}
    for q, text in questions.items():
        parts = [[]]
        for piece in re.findall(websearch.PIECE, text or ""):
            if piece.lower() == "or":
                parts.append([])
            at = [(k, stem[w]) for k, w in enumerate(words(piece)) if w not in websearch.STOP_WORDS]
            if at:
                atom = tuple((k - at[0][0], w) for k, w in at)
                parts[-1].append((piece.startswith("-"), atom))
        for i, ws in told.items():
            best = 0
            for part in parts:
                count = lambda atom: sum(all(0 <= s + k < len(ws) and ws[s + k] == w for k, w in atom) for s in range(len(ws)))  # noqa: E731, B023
                wanted, refused = {a for no, a in part if not no}, {a for no, a in part if no}
                if wanted and all(map(count, wanted)) and not any(map(count, refused)):
                    best = max(best, sum(map(count, wanted)))
            if best:
                out[q, i] = best
    return out


def test_typed_questions_by_stems(spark):
    docs = {1: "Networks of sensors, connected by a protocol", 2: "the network connects", 3: "a connecting sensor network", 4: "nothing here", 5: "The connection of protocols"}
    asked = {1: "connected network", 2: '"sensor networks"', 3: "protocols -sensors", 4: "connecting or nothing", 5: "the of", 6: "connects connected", 7: None, 8: '"connection of protocol"', 9: "zebra", 10: "network -zebras"}
    index = postings.build(spark.createDataFrame([(i, i, t) for i, t in docs.items()], "id bigint, paper_id bigint, text string"))
    found = websearch.search(index, spark.createDataFrame(list(asked.items()), "question_id bigint, text string"), stems=True)
    rows = {(r.question_id, r.id): r.tf for r in found.collect()}
    stem = {r.term: r.stem for r in stemmed(spark.createDataFrame([(w,) for t in [*docs.values(), *filter(None, asked.values())] for w in re.split("[^a-z0-9]+", t.lower()) if w], "term string")).collect()}
    assert rows == plain_search(docs, asked, stem)
    assert {k for k in rows if k[0] == 1} == {(1, 1), (1, 2), (1, 3)} and (8, 5) in rows and not any(q in (5, 7, 9) for q, _ in rows)
    with pytest.raises(ValueError):
        websearch.search(spark.createDataFrame([], "id bigint, paper_id bigint, text string"), spark.createDataFrame([], "question_id bigint, text string"), stems=True)


def test_stemmed_queries_against_a_plain_search(spark):
    texts = {r.id: r.text for r in chunks(spark, SF).collect()}
    asked = {r.question_id: r.text for r in typed_questions(spark, SF).collect()}
    vocabulary = {w for t in [*texts.values(), *asked.values()] for w in re.split("[^a-z0-9]+", (t or "").lower()) if w}
    stem = {r.term: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in vocabulary], "term string")).collect()}
    wanted = plain_search(texts, asked, stem)
    rows = registry.queries()["websearch_stems_topk"](spark, SF).collect()
    assert {(r.question_id, r.id): r.tf for r in rows} == {k: wanted[k] for k in wanted if sum(x[0] == k[0] and (-wanted[x], x[1]) < (-wanted[k], k[1]) for x in wanted) < 100}
    fused = registry.queries()["hybrid_typed"](spark, SF).collect()
    ranks = {(r.question_id, r.id): r.s_rank for r in rows}
    assert fused and all(r.s_rank == ranks.get((r.question_id, r.chunk_id)) for r in fused)
    counts = {r.stem: r.tokens for r in registry.queries()["vocabulary_stems"](spark, SF).collect()}
    assert sum(counts.values()) == text_index(spark, SF).postings.select("term").distinct().count()
    assert text_index(spark, SF).vocabulary.where(F.col("stem").isNull()).count() == 0
