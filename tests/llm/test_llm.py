import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brindle import llm
from brindle.llm import bpe, chat, decontaminate, fingerprint, langid, lines, neardup, pii, quality, reputation
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
ALL = llm.queries()


def rows(frame, key):
    return sorted(frame.collect(), key=lambda r: (r[key] is None, r[key]))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
@pytest.mark.parametrize("where", ["sf", "odd", "empty"])
def test_sql(spark, name, where, odd, empty_dir):
    folder = {"sf": SF, "odd": odd.dir, "empty": empty_dir}[where]
    assert not differences(ALL[name](spark, folder), connect(folder), llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, name, empty_dir):
    assert ALL[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(n for n in ALL if n[2] not in "146"))
def test_every_row_has_a_result(spark, name, odd):
    found = ALL[name](spark, odd.dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(odd.docs.doc_id)


def brute_components(texts: dict, words: int, percent: int):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def held_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    wanted = brute_components({r.doc_id: r.text for r in docs}, 4, 80)
    for r in ALL["op5_superminhash"](spark, folder).collect():
        assert (r.n_shingles, r.component_id) == wanted[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_odd_texts(spark, odd):
    held_against_brute_force(spark, odd.dir)


def test_near_duplicates(spark):
    held_against_brute_force(spark, SF)


def test_near_duplicates_in_a_crowd(spark):
    """A hot group of edited copies, among them pairs that only each other link."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"e{i}-{rng.randrange(99)}"
        made.append((i, " ".join(w)))
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    wanted = brute_components(dict(made), 4, 80)
    for r in neardup.near_duplicates(docs, words=4).collect():
        assert (r.n_shingles, r.component_id) == wanted[r.doc_id]


def test_superminhash_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    x, y = neardup.superminhash([neardup._mix(a), neardup._mix(b)], 512)
    assert abs((x == y).mean() - 800 / 1200) < 0.06
    assert np.isinf(neardup.superminhash([a[:0]], 8)).all()


def test_rules_and_urls(spark, odd):
    found = {r.page_id: r for r in ALL["op6_host_reputation"](spark, odd.dir).collect()}
    assert len(found) == len(odd.urls)
    for i, url in enumerate(odd.urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (found[i].host, found[i].path) == (host, path)
        fits = [r for r in reputation.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(str(r)), default=None)
        assert found[i].rule == (str(best) if best else None)
        assert found[i].verdict == best.verdict if best else found[i].verdict in ("allow", "block")


def test_rules_say_what_the_contract_says(spark):
    stated = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {str(r): r.verdict for r in reputation.RULES} == stated and len(reputation.RULES) == len(stated)
    urls = {"http://a.com/en/1": "block", "http://x.example.com/en/70": "allow", "https://b.net/de/8": "allow", "https://example.net/de/7": "allow", "https://Example.NET/de/80": "block", "http://c.org/es/": "block"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = reputation.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()
    assert {list(urls)[r.page_id]: r.verdict for r in judged} == urls


def test_reputation_shrinks_to_parents(spark):
    pages = [(i, f"http://{'bad' if i < 60 else 'good'}.example.com/{i}") for i in range(120)] + [(200, "http://new.example.com/"), (201, "http://other.org/")]
    outcomes = [(i, i < 60 and i % 10 != 0) for i in range(120)]
    found = reputation.reputations(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(outcomes, "page_id bigint, bad boolean"))
    by = {r.host: r for r in found.collect()}
    assert by["bad.example.com"].low > reputation.LIMIT > by["good.example.com"].low
    assert by["good.example.com"].mean < by["new.example.com"].mean < by["bad.example.com"].mean


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: luhn(re.sub(r"\D", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
]


def luhn(d: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return 16 <= len(d) <= 19 and total % 10 == 0


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0])]


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_base_spans(spark, odd, where):
    folder = odd.dir if where == "odd" else "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in ALL["op7_weak_supervision"](spark, folder).collect():
        base = brute_spans(texts[r.doc_id])
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest(), (r.doc_id, named, r.spans)
        assert [r[f"n_{k}"] for k, _, _ in BASE] == [sum(x[0] == k for x in base) for k, _, _ in BASE]
        assert r.spans.startswith(named)


def test_hostile_spans(spark):
    """Texts made of the patterns' own characters, drawn at random."""
    rng = random.Random(3)
    made = [(i, "".join(rng.choice("01259 -.+()@aé_") for _ in range(rng.randrange(0, 60)))) for i in range(1500)]
    made += [(2000, "1" * 5000), (2001, "1.1." * 2000), (2002, "a" * 5000 + "@"), (2003, "+1" + " 1" * 3000)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    texts = dict(made)
    for r in pii.detect(docs).collect():
        assert [(x.kind, x.start, x.end) for x in r.base] == brute_spans(texts[r.doc_id]), texts[r.doc_id]


def test_expectation_maximisation_weighs_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda good: (1 if true else 2) if rng.random() < good else (2 if true else 1)  # noqa: B023, E731
        p = (vote(0.95), vote(0.9), vote(0.55))
        counts[p] = counts.get(p, 0) + 1.0
    post, rates = pii.expectation_maximisation(counts)
    assert post[(1, 1, 2)] > 0.9 and post[(2, 2, 1)] < 0.1
    assert rates[0][1][0] > 0.85 > 0.65 > rates[2][1][0]


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_fingerprints(spark, odd, where):
    folder = odd.dir if where == "odd" else SF
    docs = sorted({(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}, reverse=True)
    texts = dict(docs)
    order = [d for d, _ in docs]
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    repeated = {8, 4, 7, 3} if where == "odd" else set()  # of equal keys and their neighbours, see below
    prints = {}
    for r in ALL["op8_piecewise"](spark, folder).collect():
        assert r.n_chars == len(texts[r.doc_id])
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint == fingerprint.fingerprint(texts[r.doc_id])
        if r.doc_id in repeated:
            continue
        t, n = texts[r.doc_id], texts[after[r.doc_id]]
        half = len(t) // 2
        mixed = t[: len(t) - half] + n[:half]
        assert r.edited_sha256 == hashlib.sha256(mixed.encode()).hexdigest()
        assert r.edited_fingerprint == fingerprint.fingerprint(mixed)
        assert 0 <= r.near_edited <= 1 and r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(n))


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 70))) for _ in range(2))
        assert fingerprint.distance(a, b) == plain(a, b)


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_encoding(spark, odd, where):
    folder = odd.dir if where == "odd" else SF
    encoder = bpe._codec(bpe.vocabulary_path())[0]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in ALL["op9_bpe"](spark, folder).collect():
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_small_chunks_change_nothing(spark):
    """Chunks of a few characters, so that borders fall everywhere."""
    rng = random.Random(4)
    made = [(i, "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "é", "9", "!!", "\U0001f600", "xyzzyxyzzy"]) for _ in range(200))) for i in range(60)] + [(None, "null key " * 9), (7, "again " * 30)]
    encoder = bpe._codec(bpe.vocabulary_path())[0]
    found = bpe.encode(spark.createDataFrame(made, "doc_id bigint, text string"), chunk=25, overlap=8).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=key) == sorted(((k, encoder.encode_ordinary(t)) for k, t in made), key=key)


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = ALL["op10_langid"](spark, folder).collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1] or ""))
    held = [r for r in found if r.held_out and r.lang_pred != "und" and len(truth[r.doc_id][1].split()) >= 5]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.95


def test_presence_does_not_depend_on_blocks(monkeypatch):
    texts = ["abc déf " * 50, "", "x", "Zürich 99 " * 30]
    whole = langid.presence(texts)[0]
    monkeypatch.setattr(langid, "BLOCK", 16)
    assert (langid.presence(texts)[0] == whole).all()


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(900):
        g = int(rng.integers(0, 3))
        rows.append(np.unique(np.concatenate([rng.integers(0, 40, 5) + 100 * g, rng.integers(1000, 1040, 5)])))
        grades.append(g)
    model = quality.fit(rows, np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    expected = np.array([model.tails(np.array([model.weights[r].sum()])).sum() for r in rows])
    assert [expected[np.array(grades) == g].mean() for g in range(3)] == sorted(expected[np.array(grades) == g].mean() for g in range(3))
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def test_quality_separates_toxic_from_clean(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id: r.keep for r in ALL["op3_ordinal"](spark, folder).collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    toxic = [d for d, r in labels.items() if r.toxic == 1]
    assert sum(kept[d] for d in clean) / len(clean) > 0.9
    assert sum(kept[d] for d in toxic) / max(1, len(toxic)) < 0.3


def test_chat_roles(spark):
    found = ALL["op4_role_hmm"](spark, "/root/testdata/sf0.01").collect()
    truth = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect():
        truth.setdefault(r.conv_id, []).append(r.role)
    assert sum(r.roles.split(",") == truth[r.conv_id] for r in found) / len(found) > 0.95


def test_chat_of_odd_turns(spark, odd):
    found = ALL["op4_role_hmm"](spark, odd.dir).collect()
    assert sum(r.n_turns for r in found) == 7  # a repeated row counts once
    model = chat.Model([], [])
    assert model.parse(None) == model.parse(" \n ") == []
    assert [r for r, _ in model.parse("User: hi\n\nAssistant: hello\nthere\n\nUser: bye")] == ["user", "assistant", "user"]
    assert chat.render([("user", "hi")]) == "<|user|>\nhi\n<|end|>\n"


def test_decontamination_tolerates_substitutions(spark, odd):
    words = odd.passage.split()
    for i in range(3, len(words), 7):
        words[i] = "CHANGED"
    docs = spark.createDataFrame([(1, "before " * 20 + " ".join(words) + " after" * 20), (2, "nothing of it at all " * 20), (3, None)], "doc_id bigint, text string")
    items = spark.read.parquet(f"{odd.dir}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()] == [(1, 0)]


def test_decontamination_finds_short_items_and_all_that_share_a_passage(spark):
    rows = ["Why so? Because THE  answer, is forty-two.", "he said 這是一個沒有空格的句子。 then left", "answer is", "x " + " ".join(f"t{i}" for i in range(16)) + " y", None, ""]
    items = ["the answer is", "這是一個沒有空格的句子", "forty", "", None, " ".join(f"t{i}" for i in range(16)), " ".join(f"t{i}" for i in range(16)), "is the answer", " ".join(f"q{i}" for i in range(9))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_hits, r.agreement) for r in found) == [(0, 0, 1, 1.0), (0, 2, 1, 1.0), (1, 1, 1, 1.0), (3, 5, 14, 1.0), (3, 6, 14, 1.0)]


def test_boilerplate_lines(spark, odd):
    docs = spark.read.parquet(f"{odd.dir}/documents.parquet")
    found = {r.doc_id: r for r in lines.drop_boilerplate(docs).collect()}
    assert found[101].text.startswith("own 1") and found[101].n_dropped == 1
    assert found[0].text is None and found[1].text == "" and found[0].n_lines == 0
