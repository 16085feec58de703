"""Secret scans, block-max search and sort-means: against SQL, plain versions and planted cases, and over odd tables."""

import hashlib
import random
import re
import string
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brindle.llm import blockmax, centroids, secrets
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [blockmax, centroids])
def test_sql(spark, module):
    (name, query), = module.QUERIES.items()
    assert not differences(query(spark, SF), connect(SF), module.ORACLE[name])


# --- op11

ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def spelled(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def check_base(rows, texts):
    for r in rows:
        found = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(spelled(found).encode()).hexdigest(), r.doc_id
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in found) for k in ("assign", "access", "hex"))
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("random")] == [x for x in spelled(found).split(",") if x]
        assert len(spans) == len(found) + r.n_random


def test_base_spans(spark):
    rows = secrets.op11_randomness(spark, SF).collect()
    check_base(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


ODD_SECRETS = [
    None, "", "token=abc", "token:\"token :abcdef", "Token = \"ab.c=d/e\" PASSWD:  'x'", "secret==abcdef api_key:-zzzzzz APIKEY=1234567", "ſecret=abcdef toKen=abcdef", "AKIAAKIA" + "A" * 12 + " AKIA" + "B" * 15 + " xAKIA" + "C" * 16,
    "f" * 23 + "g" + "0" * 24 + "F", "ü" * 5 + " token=abcdef\n" + "a1" * 40_000 + " end", "token" + " " * 5000 + "=" + " " * 5000 + "abcdef", "password='secret:token=" + "x" * 8 + "'",
]


def test_odd_secrets(spark, odd):
    docs = spark.createDataFrame(list(enumerate(ODD_SECRETS)), "doc_id int, text string").withColumn("base", F.lit(1)).withColumn("maybe", F.lit("x"))
    for rows, texts in ((docs, dict(enumerate(ODD_SECRETS))),):
        found = secrets.detect(rows).collect()
        assert len(found) == len(texts)
        for r in found:
            assert [(x.start, x.rank, x.kind, x.end) for x in r.base] == base(texts[r.doc_id] or ""), r.doc_id
    assert len(secrets.op11_randomness(spark, odd.dir).collect()) == len(odd.docs)


def test_empty_tables(spark, empty_dir):
    assert secrets.op11_randomness(spark, empty_dir).collect() == [] and blockmax.op12_block_max(spark, empty_dir).collect() == []


def random_token(rng, kind):
    n = rng.choice([20, 24, 28, 32, 40, 64])
    if kind == "uuid":
        h = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    alphabet = {"hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_"}[kind]
    return "".join(rng.choice(alphabet) for _ in range(n)) + ("==" if kind == "base64" else "")


NAMES = ("getUserNameFromSessionContext", "src/main/java/org/apache/spark", "version2_release_candidate", "state-of-the-art-2024-model", "2024-01-31T12:00:00", "4785380592391139", "internationalization", "THE_LARGEST_NUMBER_OF_ALL")


def test_planted_secrets_recall_and_precision(spark):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text and " " in r.text][:400]
    planted, docs = {}, []
    for i, text in enumerate(texts):
        at = text.find(" ", len(text) // 2)
        more = random_token(rng, ("hex", "base32", "alnum", "base64", "base64url", "uuid")[i // 3 % 6]) if i % 3 == 0 and at > 0 else rng.choice(NAMES)
        if i % 3 == 0 and at > 0 and not base(more):
            planted[i] = more
        docs.append((i, f"{text[:at]} {more} {text[at + 1 :]}"))
    hits, false = set(), []
    for r in secrets.detect(spark.createDataFrame(docs, "doc_id int, text string")).collect():
        for x in r.added:
            span = docs[r.doc_id][1][x.start : x.end]
            if planted.get(r.doc_id) == span:
                hits.add(r.doc_id)
            else:
                false.append(span)
    assert len(planted) > 80 and len(hits) >= 0.9 * len(planted) and len(false) <= 0.05 * len(hits), (len(hits), len(planted), false)


def test_battery_against_numpy(spark):
    rng = random.Random(1)
    tokens = [random_token(rng, k).rstrip("=") for k in ("hex", "base32", "alnum", "base64", "base64url", "uuid") for _ in range(4)] + ["a" * 20, "ab", "nichtschgelichber", "DEADbeef" * 4, "A-", "0" * 16]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.encoding(F.col("t")).alias("e"), secrets.battery(F.col("t")).alias("b")).collect()
    tail = lambda z: 0.5 * __import__("math").erfc(z / 2**0.5)
    for r in rows:
        alphabet = secrets.ALPHABETS[r.e]
        plain = r.t.lower().replace("-", "") if r.e == "hex" else r.t
        s, k, n = np.array([alphabet.index(c) for c in plain], float), len(alphabet), len(plain)
        value = (k / n * sum(c * c for c in Counter(plain).values()) - n - (k - 1)) / ((n - 1) / n) ** 0.5 + k - 1
        v = 2 / (9 * (k - 1))
        p_chi = tail((np.cbrt(max(value / (k - 1), 0)) - (1 - v)) / v**0.5)
        high = s * 2 >= k
        n1 = int(high.sum())
        mean = 2 * n1 * (n - n1) / n + 1
        wide = (mean - 1) * (mean - 2) / (n - 1)
        turns = 1 + int((high[1:] != high[:-1]).sum())
        p_runs = 2.0 ** (1 - n) if n1 in (0, n) else min(2 * tail(abs(turns - mean) / wide**0.5), 1) if wide > 0 else 1
        off = s - s.mean()
        p_serial = min(2 * tail(abs((off[1:] @ off[:-1]) / (off @ off) + 1 / n) * n**0.5), 1) if off @ off > 0 else 2.0 ** (1 - n)
        assert np.allclose([r.b.p_chi, r.b.p_runs, r.b.p_serial], [p_chi, p_runs, p_serial], atol=2e-7), r.t
        assert r.b.symbols == n


def test_false_discovery_cuts():
    words = {(0, step): n for step, n in ((150, 30), (160, 60), (170, 30))}
    assert secrets.cuts(words, {}) == [0] * len(secrets.CLASSES)
    few = secrets.cuts(words, {(0, 85): 40, (0, 158): 40})
    assert few[0] == 86 and secrets.cuts(words, {(0, 85): 40}, level=1.0)[0] == 0
    assert secrets.cuts(words, {(0, 85): 1, (0, 158): 400}, rate=1e-60)[0] == 0
    assert secrets.word_models({})[0] == pytest.approx((secrets.USUAL, secrets.SPREAD))


# --- op12


def ranked(docs, items, top=20):
    """Each item's best documents by the stated formula, one after another."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x for _, _, x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = {}
    for i, (item, text) in enumerate(items):
        asked = words(text)
        scores = []
        for d, c, size in counted:
            m = 75 + (25 * size * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in asked if c[w])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out[i, item] = [(d, -s) for s, _, _, d in sorted(scores, key=lambda x: x[:3])[:top]]
    return out


def test_search_against_brute_force(spark, odd, monkeypatch):
    """Small shards and blocks, many queries in many blocks, ties, null and repeated keys, scripts beyond ASCII."""
    monkeypatch.setattr(blockmax, "QUERIES_AT_ONCE", 2)
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "gamma9", "ÄÖ", "naïve", "日本", "x", "delta", "rare", "common"]
    docs = [(rng.choice([None, rng.randrange(60), rng.randrange(60)]), " ".join(rng.choice(vocabulary + ["common"] * 10) for _ in range(rng.randrange(1, 30)))) for _ in range(150)]
    docs += [(500 + i, "same text alpha rare") for i in range(60)] + [(None, None), (7, ""), (8, " .,!\n"), (9, "huge " * 30_000 + "alpha")]
    items = [(1, "alpha beta"), (1, "ALPHA, alpha; rare"), (2, None), (3, ""), (4, "nowhere"), (5, "ÄÖ äö 日本"), (None, "common x huge"), (6, "same text"), (7, "delta" * 2)]
    d = spark.createDataFrame(docs, "doc_id int, text string").withColumn("shard", F.lit(1)).repartition(3)
    n, total = blockmax.totals(d)
    for size, joined in ((2, blockmax.BROADCAST_BYTES), (40, 0)):
        monkeypatch.setattr(blockmax, "BROADCAST_BYTES", joined)
        shards = blockmax.index(d, n, total)
        wanted = ranked(docs, items)
        rows = blockmax.search(shards, spark.createDataFrame(items, "item_id int, text string").withColumn("part", F.lit(0)), n, total, first=size).collect()
        found = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            found.setdefault((r.item_id,), []).append((r.key, r.score))
        flat = {}
        for (_, item), best in wanted.items():
            flat.setdefault((item,), []).extend(best)
        assert {k: Counter(v) for k, v in found.items()} == {k: Counter(v) for k, v in flat.items() if v}
    assert [r["rank"] for r in rows if r.item_id == 6] == list(range(1, 21)) or sorted(r["rank"] for r in rows if r.item_id == 6) == list(range(1, 21))


def test_blocks_are_pruned_and_whole(monkeypatch):
    """A shard's search scores few blocks once it has its best, and finds what scoring all would find."""
    rng = random.Random(3)
    monkeypatch.setattr(blockmax, "SHARD_POSTINGS", 10**9)
    shard = blockmax._Shard()
    for i in range(2000):
        shard.add(i, Counter({f"w{rng.randrange(3000)}".encode(): rng.randrange(1, 4) for _ in range(40)} | ({b"needle": 1 + i % 5} if i % 400 == 0 else {})))
    row = shard.row(2000, 160_000)
    s = {a: blockmax.unpacked(row[a]) for a in blockmax._ARRAYS} | {"vocabulary": np.frombuffer(row["vocabulary"], np.int64)}
    kind = pa.struct([("item", pa.int64()), ("least", pa.int64()), ("parts", pa.list_(pa.struct([("term", pa.int64()), ("weight", pa.int64())])))])
    parts = [{"term": blockmax.term_hash(t), "weight": w} for t, w in ((b"needle", 9000), (b"w1", 50), (b"w2", 50))]
    best = {}
    for top in (3, 2000):
        (_, docs, scores), = blockmax._Queries(pa.array([{"item": 0, "least": 1, "parts": parts}], kind), top).search(s, np.arange(2000), 2000, 160_000)
        best[top] = list(zip(docs.tolist(), scores.tolist(), strict=True))
    assert best[3] == best[2000][:3] and len(best[2000]) > 3


def test_repeated_terms_of_words():
    text = "Ab aB, ÄB ÄB-äb 1_2\x7f" + "z" * 10
    assert blockmax.word_counts(text) == Counter({b"ab": 2, "Äb".encode(): 2, "äb".encode(): 1, b"1": 1, b"2": 1, b"z" * 10: 1})
    assert blockmax.word_counts("a " * (blockmax.PIECE + 7))[b"a"] == blockmax.PIECE + 7
    for numbers in ([], [0], [255], [256, 1], [2**40]):
        assert blockmax.unpacked(blockmax.packed(np.array(numbers, np.int64))).tolist() == numbers


# --- op13


def lloyd(rows, k, rounds, scale):
    """Every vector against every centroid."""
    kept = [(key, [floor(scale * x) for x in v]) for key, v in rows]
    places = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(places))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(places)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                places[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((key, *near(v)[::-1]) for key, v in kept), places


def test_sort_means_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.2) for _ in range(4)]) for i in range(120)] + [(200 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)] + [(5, [0.5] * 4)]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cluster", F.lit(99)).repartition(3)
    for k, rounds in ((6, 3), (1, 1), (500, 2)):
        found, places = centroids.sort_means(df, k=k, rounds=rounds, width=4)
        wanted, at = lloyd(rows, k, rounds, 64)
        assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == wanted and places == at
    found, _ = centroids.sort_means(df, k=6, width=4)
    assert found.agg(F.avg("n_compared")).first()[0] < 4
    nothing, none = centroids.sort_means(df.where("vec_id > 899"), width=4)
    assert nothing.collect() == [] and none == [] and nothing.columns == ["vec_id", "cluster", "distance", "n_compared"]
    extreme = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id int, embedding array<double>")
    assert max(r.distance for r in centroids.sort_means(extreme, k=1, rounds=0, width=2)[0].collect()) == 2 * centroids.LARGEST**2


def test_sort_means_of_an_empty_table(spark, tmp_path):
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int64())}), tmp_path / "embeddings.parquet")
    frame = centroids.op13_sort_means(spark, str(tmp_path))
    assert frame.collect() == [] and frame.columns == centroids.op13_sort_means(spark, SF).columns
