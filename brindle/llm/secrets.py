"""Secret scans: stated patterns, and a battery of randomness tests over whatever else may be a key, in column expressions only.

Candidates are tokens of LEAST characters or more. The encoding of each is inferred
from its characters (hex, base32, letters and digits, base64, a UUID), and its symbols
are held against a uniform alphabet: chi-squared of their counts, runs above and below
the middle of the alphabet, and the correlation of neighbours. Fisher's method makes
one number of the three, small for random tokens.

Words are long tokens too. Tokens spelled like words are never reported; they are the
controls: how the number falls on them is measured for each class of length (short
tokens tell less, so a class also learns from all shorter ones), and a candidate's
chance to be a word follows from it. Within each class the Benjamini-Hochberg rule
keeps the share of false discoveries below RATE, and the battery itself must not
reject that the token is random.

Texts are read once and never shuffled; of the tokens, hashes are, so that equal ones
count once. A table of classes by steps of the number, whose size the data cannot
change, is all that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table, written
from brindle.llm.pii import spans

#: Stated patterns. Loops give nothing back that could still match; hex and access runs that are too short never match elsewhere in the same run, so their length is part of the pattern.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\x22']?+\x20*+[:=]\x20*+[\x22']?+[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\x22']?+\x20*+[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Characters of an assigned value at least, and of a candidate.
VALUE, LEAST = 6, 16
_IN = r"\p{L}\p{N}+/_-"
#: Whole tokens; what follows an equals sign or a quote counts, a letter beyond ASCII on either side makes it part of a word.
CANDIDATE = rf"(?<![{_IN}])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}+(?![={_IN}])"
#: Spelled like words: letters of one case, or capitalised, perhaps several in a row; and numbers, which are no secrets by themselves.
WORDLIKE = r"^(?:[A-Z]?[a-z]*|[A-Z]+)(?:[-/_+]+(?:[A-Z]?[a-z]*|[A-Z]+))*$"
NUMBER = r"^[0-9+/_-]+$"
#: Alphabets, each in the order in which its symbols count.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "alnum": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_"}
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Lengths at which a new class begins.
CLASSES = (16, 18, 20, 24, 28, 32, 40, 48, 64, 128)
#: Share of false discoveries; level at which the battery rejects randomness; steps of the number, and how fine they are.
RATE, LEVEL, STEPS, STEP = 0.01, 0.01, 400, 0.02
#: What a class without any word starts from: mean and spread of the number on words, and how many words that counts for.
USUAL, SPREAD, WEIGHT = 3.2, 0.45, 8.0


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal number exceeds z, by a polynomial that is right to 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _two_sided(z: Column) -> Column:
    return F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0))


def encoding(token: Column) -> Column:
    """Name of the narrowest alphabet that has all symbols of a token; null where none has."""
    return (
        F.when(token.rlike(UUID) | token.rlike("^(?:[0-9a-f]+|[0-9A-F]+|[0-9a-fA-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[A-Za-z0-9]+$"), "alnum")
        .when(token.rlike("^[A-Za-z0-9+/]+$"), "base64")
        .when(token.rlike("^[A-Za-z0-9_-]+$"), "base64url")
    )


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _with(x: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[x[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def battery(token: Column) -> Column:
    """Struct (symbols, p_chi, p_runs, p_serial, fisher) of a token without padding; the p of its tests, were it random.

    fisher is -2 times the sum of the logarithms of the three. A token in no
    alphabet, or with fewer than two symbols, is null.
    """
    named = _let(token, lambda t: F.struct(t.alias("token"), encoding(t).alias("name")))
    alphabet = lambda name: F.coalesce(*[F.when(name == k, F.lit(a)) for k, a in ALPHABETS.items()])
    plain = lambda x: F.when(x["name"] == "hex", F.replace(F.lower(x["token"]), F.lit("-"), F.lit(""))).otherwise(x["token"])
    spelled = _let(named, lambda x: F.struct(plain(x).alias("plain"), alphabet(x["name"]).alias("alphabet")))
    # places in the alphabet, from 0
    placed = _let(spelled, lambda x: F.struct(F.transform(F.filter(F.split(x["plain"], ""), lambda c: c != ""), lambda c: F.position(c, x["alphabet"]) - 1).alias("s"), F.length(x["alphabet"]).alias("k")))
    return _let(placed, lambda x: F.when((F.size(x["s"]) >= 2) & x["k"].isNotNull(), _tests(x)))


def _tests(x: Column) -> Column:
    """The struct of battery() for places s in an alphabet of k symbols; each step names the sums of the one before."""
    # sum of squared counts: in sorted order, the i-th of equal symbols adds 2 i - 1
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def count(a: Column, v: Column) -> Column:
        run = F.when(a["last"] == v, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(v.alias("last"), run.alias("run"), (a["total"] + 2 * run - 1).alias("total"))

    squares = F.aggregate(F.array_sort(x["s"]), start, count, lambda a: a["total"]).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    pairs = lambda a, f: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), f)
    n = F.size(x["s"]).cast("double")
    high = F.transform(x["s"], lambda v: F.when(v * 2 >= x["k"], 1.0).otherwise(0.0))
    sums = F.struct(x["k"].cast("double").alias("k"), n.alias("n"), squares.alias("squares"), high.alias("high"), _let(total(x["s"]) / n, lambda m: F.transform(x["s"], lambda v: v - m)).alias("off"))
    lags = _let(sums, lambda y: _with(y, ("k", "n", "squares"), n1=total(y["high"]), turns=1 + total(pairs(y["high"], lambda a, b: F.abs(a - b))), power=total(F.transform(y["off"], lambda v: v * v)), lag=total(pairs(y["off"], lambda a, b: a * b))))
    # the statistic's own spread for n symbols, as a chi-squared value; then the cube root for its long right tail
    value = lambda y: (y["k"] / y["n"] * y["squares"] - y["n"] - (y["k"] - 1)) / F.sqrt((y["n"] - 1) / y["n"]) + y["k"] - 1
    spread = lambda y: 2 / (9 * (y["k"] - 1))
    z_chi = lambda y: (F.cbrt(F.greatest(value(y) / (y["k"] - 1), F.lit(0.0))) - (1 - spread(y))) / F.sqrt(spread(y))
    expected = _let(lags, lambda y: _with(y, ("n", "n1", "turns", "power", "lag"), z_chi=z_chi(y), mean=2 * y["n1"] * (y["n"] - y["n1"]) / y["n"] + 1))
    wide = lambda y: (y["mean"] - 1) * (y["mean"] - 2) / (y["n"] - 1)
    scores = _let(expected, lambda y: _with(y, ("n", "n1", "z_chi", "power"), z_runs=F.when(wide(y) > 0, (y["turns"] - y["mean"]) / F.sqrt(wide(y))).otherwise(0.0), z_serial=F.when(y["power"] > 0, (y["lag"] / y["power"] + 1 / y["n"]) * F.sqrt(y["n"])).otherwise(0.0)))
    # all symbols in one half of the alphabet, or all equal: the chance of that itself
    alone = lambda y: F.pow(F.lit(2.0), 1 - y["n"])
    one_half = lambda y: (y["n1"] == 0) | (y["n1"] == y["n"])
    chances = _let(scores, lambda y: F.struct(y["n"].cast("int").alias("symbols"), _upper_tail(y["z_chi"]).alias("p_chi"), F.when(one_half(y), alone(y)).otherwise(_two_sided(y["z_runs"])).alias("p_runs"), F.when(y["power"] > 0, _two_sided(y["z_serial"])).otherwise(alone(y)).alias("p_serial")))
    log = lambda p: F.log(F.greatest(p, F.lit(1e-300)))
    return _let(chances, lambda y: _with(y, ("symbols", "p_chi", "p_runs", "p_serial"), fisher=-2 * (log(y["p_chi"]) + log(y["p_runs"]) + log(y["p_serial"]))))


def length_class(length: Column) -> Column:
    return sum(((length >= c).cast("int") for c in CLASSES[1:]), F.lit(0))


def random_tail(fisher: float) -> float:
    """Chance that three tests of a random token give such a number or a larger one."""
    half = fisher / 2
    return math.exp(-half) * (1 + half + half * half / 2)


def word_models(words: dict[tuple[int, int], int]) -> list[tuple[float, float]]:
    """Mean and spread of the number on words for each class, from counts by (class, step); a class also learns from all shorter ones."""
    out, n, total, squares = [], WEIGHT, WEIGHT * USUAL, WEIGHT * (USUAL * USUAL + SPREAD * SPREAD)
    for c in range(len(CLASSES)):
        for (at, step), count in words.items():
            if at == c:
                x = (step + 0.5) * STEP
                n, total, squares = n + count, total + count * x, squares + count * x * x
        mean = total / n
        out.append((mean, math.sqrt(max(squares / n - mean * mean, 1e-4))))
    return out


def cuts(words: dict[tuple[int, int], int], maybe: dict[tuple[int, int], int], rate: float = RATE, level: float = LEVEL) -> list[int]:
    """For each class of length the steps below which candidates are discoveries: Benjamini-Hochberg over their chances to be words.

    A step's chance is taken at its upper end, and a step is left out whose lower
    end the battery rejects.
    """
    out = []
    models = word_models(words)
    for c in range(len(CLASSES)):
        mine = sorted((step, n) for (at, step), n in maybe.items() if at == c)
        total, seen, cut = sum(n for _, n in mine), 0, 0
        mean, spread = models[c]
        for step, n in mine:
            seen += n
            chance = 0.5 * math.erfc((mean - (step + 1) * STEP) / spread / math.sqrt(2))
            if chance <= rate * seen / total and random_tail((step * STEP) ** 3) >= level:
                cut = step + 1
        out.append(cut)
    return out


def base_spans(text: Column, kind: str) -> Column:
    """Array of struct (start, end, span) of one stated kind; an assigned value that is too short takes its characters with it."""
    found = spans(text, BASE[kind], NEEDS[kind])
    if kind != "assign":
        return found
    value = lambda x: F.regexp_extract(x["span"], r"[:=]\x20*+[\x22']?+([A-Za-z0-9+/_.=-]++)$", 1)
    return F.filter(found, lambda x: F.length(value(x)) >= VALUE)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """Rows (key, base, added) of every row of docs: arrays of struct (start, rank, kind, end) in the order of start and kind.

    Null texts count as empty. Added spans have the kind random and never overlap
    base ones. Keys need not be unique, and a null key is kept. A random token of
    letters of one case alone is taken for a word, digits alone for a number.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind in BASE:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind))
    rows = rows.withColumn("maybe", spans(F.col("text"), CANDIDATE, rf"[A-Za-z0-9+/_-]{{{LEAST}}}"))
    tag = lambda kind, rank: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[tag(kind, i) for i, kind in enumerate(BASE)])))
    free = F.filter("maybe", lambda x: ~x["span"].rlike(NUMBER) & ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    judged = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["span"]).alias("token"), x["span"].rlike(WORDLIKE).alias("word"), battery(F.regexp_replace(x["span"], "=+$", "")).alias("t")))
    told = F.transform(
        F.filter(judged, lambda x: x["t"].isNotNull()),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), x["word"].alias("word"), length_class(x["t"]["symbols"]).alias("class"), F.least(F.floor(F.cbrt(x["t"]["fisher"]) / STEP), F.lit(STEPS)).cast("int").alias("step")),
    )
    none = F.array().cast("array<struct<start:int,end:int,token:bigint,word:boolean,class:int,step:int>>")
    found = written(rows.select("key", "base", F.when(F.size("maybe") > 0, told).otherwise(none).alias("maybe")), "secrets")
    # equal tokens are one test, however many copies of a text there are
    once = found.where(F.size("maybe") > 0).select(F.inline("maybe")).groupBy("token").agg(*[F.first(c).alias(c) for c in ("word", "class", "step")])
    counts = once.groupBy("word", "class", "step").count().collect()
    side = lambda word: {(r["class"], r["step"]): r["count"] for r in counts if r["word"] == word}
    limits = F.array(*[F.lit(c) for c in cuts(side(True), side(False), rate)])
    sure = F.filter("maybe", lambda x: ~x["word"] & (x["step"] < F.get(limits, x["class"])))
    added = F.transform(sure, lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind"), x["end"].alias("end")))
    return found.select(F.col("key").alias(key), "base", F.array_sort(added).alias("added"))


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


QUERIES = {"op11_randomness": op11_randomness}
