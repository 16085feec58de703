"""Personal data by patterns and weak supervision, in column expressions only.

Four kinds are found by pattern and check (email, ip, card, phone), and cards also
where several stand side by side, by the check digit alone. Beyond them,
tokens with digits are candidates for secrets and identifiers: a regex, a
gazetteer of cue words, the characters around, the mix of characters and the
check digit of card-like numbers each vote for, against or abstain. Expectation-maximisation over the counts of vote
patterns (a table bounded by 3 to the number of labelers) estimates how reliable
each labeler is and how likely each pattern is personal. These posteriors are
soft labels for the final span classifier, a naive Bayes model over hashed
features of a span and what stands around it, which decides alone, so it also
judges spans on which all labelers abstain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import hinted, kept, table, written

#: Patterns as stated for each kind, rewritten so that no text makes them slow: they start only where the stated pattern would (at the end of a match, or behind a character that cannot belong to it), and loops give nothing back that could not be used.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Runs of digits that are too long for one card, and groups of digits that a card has at most.
LONG_RUN, MOST_GROUPS = r"[0-9](?:[\x20-]?[0-9]){19}", 8
_TOKEN = r"A-Za-z0-9+/_-"
#: Tokens of eight characters or more with a digit, and groups of digits as in telephone numbers.
CANDIDATE = rf"(?:\([0-9]{{3}}\)\x20?|(?<![0-9.])[0-9]{{3}}[\x20.])[0-9]{{3}}[\x20.-][0-9]{{4}}(?![0-9])|(?<![{_TOKEN}])(?=[A-Za-z+/_-]*+[0-9])[{_TOKEN}]{{8,}}+"
#: Gazetteer: words before a span that speak for and against it.
FOR = ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "pin", "ssn", "passport", "account", "iban", "tel", "phone", "fax", "mobile", "licence", "license", "customer", "patient", "member", "card", "user", "login")
AGAINST = ("page", "pages", "version", "chapter", "figure", "table", "section", "volume", "vol", "issue", "year", "isbn", "doi", "release", "model", "part")
#: Kinds of added spans: with letters and without.
ADDED = ("secret", "id")
#: Labelers in the order of their votes: for, against, abstain are 1, 2, 0.
LABELERS = ("pattern", "gazetteer", "context", "mixture", "checksum")
ROUNDS, SMOOTH, BUCKETS, LEAST = 40, 1.0, 4096, 0.5
#: Characters to the left of a span that labelers and features see.
LEFT = 32
#: Documents with added spans that are broadcast at most.
ROWS_AT_ONCE = 200_000


def _starts(lengths: Column, step: int = 512) -> Column:
    """Sums of all elements before each one, in blocks, so that long arrays are not copied for each element."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int"))
    part = lambda k: F.slice(lengths, k * step + 1, step)
    more = lambda found, x: F.array_append(found, F.element_at(found, -1) + x)
    heads = F.aggregate(blocks, F.array(F.lit(0)), lambda found, k: more(found, F.aggregate(part(k), F.lit(0), lambda s, x: s + x)))
    zipped = F.arrays_zip(blocks.alias("k"), F.slice(heads, 1, F.size(blocks)).alias("head"))
    each = F.transform(zipped, lambda b: F.aggregate(part(b["k"]), F.array(b["head"]), more))
    return F.flatten(F.transform(each, lambda x: F.slice(x, 1, F.size(x) - 1)))


def spans(text: Column, pattern: str, needs: str) -> Column:
    """Array of struct (start, end, span) of the leftmost non-overlapping matches; code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda x, y: F.char_length(x) + F.char_length(y))
    placed = F.zip_with(F.zip_with(_starts(lengths), lengths, lambda s, n: s + n), found, lambda end, x: F.struct((end - F.char_length(x)).alias("start"), end.alias("end"), x.alias("span")))
    none = F.array().cast("array<struct<start:int,end:int,span:string>>")
    return F.when(text.rlike(needs), F.when(F.size(found) > 0, placed).otherwise(none)).otherwise(none)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(span: Column) -> Column:
    digits = F.reverse(F.split(_digits(span), ""))
    doubled = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1))
    return F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), doubled), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        # up to three digits behind any zeros in front, so no part is too long to be a number
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(span, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.right(part(p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return _luhn(span)
    if kind == "phone":
        return F.length(_digits(span)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans(text, BASE[kind], NEEDS[kind]), lambda x: _valid(kind, x["span"]))


def cards_in_runs(text: Column) -> Column:
    """Array of struct (start, end, span): card numbers in runs of digits that are too long for one card, as where several stand side by side.

    A run is made of groups with one blank or hyphen between them. A card is some
    whole groups of 16 to 19 digits whose check digit is right; the leftmost come
    first (of those that begin at one place the shortest), and no two share a digit.
    """
    none = F.array().cast("array<struct<start:int,end:int,span:string>>")

    def found(groups: Column) -> Column:
        def windows(at: Column) -> Column:
            part = lambda n: F.slice(groups, at, n)
            each = F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_GROUPS), F.size(groups) - at + 1)), lambda n: F.struct(F.get(part(n), F.lit(0))["start"].alias("start"), F.get(part(n), n - 1)["end"].alias("end"), F.array_join(F.transform(part(n), lambda g: g["span"]), "").alias("digits")))
            long = F.filter(each, lambda w: F.length(w["digits"]).between(16, 19) & (w["end"] - w["start"] <= 2 * F.length(w["digits"]) - 1))
            whole = F.transform(long, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.substr(text, w["start"] + 1, w["end"] - w["start"]).alias("span")))
            return F.slice(F.filter(whole, lambda w: w["span"].rlike(r"^[0-9](?:[\x20-]?[0-9])*\z") & _luhn(w["span"])), 1, 1)

        free = lambda kept, w: F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) <= w["start"]
        return F.aggregate(F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), windows)), none, lambda kept, w: F.when(free(kept, w), F.array_append(kept, w)).otherwise(kept))

    groups = spans(text, "[0-9]++", "[0-9]")
    return F.when(text.rlike(LONG_RUN), F.get(F.transform(F.array(groups), found), F.lit(0))).otherwise(none)


def _checked(span: Column) -> Column:
    """Whether a number as long as a card's has the right check digit; null for anything else."""
    return F.when(span.rlike("^[0-9]{13,19}$"), _luhn(span))


def _votes(span: Column, left: Column, right: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate; left: what stands before it, right: the character behind it."""
    cue = lambda words: left.rlike(rf"(?i)(?:^|[^a-z])(?:{'|'.join(words)})s?[\x20\x22':=#.]*$")
    vote = lambda yes, no: F.when(yes, 1).when(no, 2).otherwise(0)
    share = F.length(_digits(span)) / F.length(span)
    letters = F.length(F.regexp_replace(span, "[^A-Za-z]", ""))
    return {
        "pattern": vote(span.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Za-z0-9+/_-]{24,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}[)\x20.]+[0-9]{3}[\x20.-][0-9]{4})$"), span.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[a-z]+[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$")),
        "gazetteer": vote(cue(FOR), cue(AGAINST)),
        "context": vote(left.rlike(r"[=:#][\x20]?[\x22']?$|[\x22']$"), left.rlike(r"[$€£/.]$") | right.isin("%", "/", "°")),
        "checksum": vote(_checked(span), ~_checked(span)),
        "mixture": vote((letters > 0) & share.between(0.2, 0.95) & (F.length(span) >= 12), ((letters > 0) & (share < 0.15)) | ((letters == 0) & (F.length(span) < 9))),
    }


def _features(span: Column, left: Column, right: Column) -> Column:
    """Hashed features: shape and length, each with the check digit, both neighbours, the word before."""
    checked = F.coalesce(F.concat(F.lit(":"), _checked(span).cast("string")), F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(span, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    named = F.array(
        F.concat(F.lit("shape:"), F.left(F.regexp_replace(shape, "(?:9a|a9|9A|A9){2,}9?", "M"), F.lit(12)), checked),
        F.concat(F.lit("length:"), F.least(F.length(span), F.lit(40)).cast("string"), checked),
        F.concat(F.lit("left:"), F.right(F.regexp_replace(F.regexp_replace(left, r"[0-9]", "9"), r"\p{L}", "a"), F.lit(2))),
        F.concat(F.lit("right:"), F.regexp_replace(F.coalesce(right, F.lit("")), r"\p{L}", "a")),
        F.concat(F.lit("word:"), F.lower(F.regexp_extract(left, r"(\p{L}+)[^\p{L}]*$", 1))),
    )
    return F.transform(named, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)))


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = ROUNDS, smooth: float = SMOOTH) -> tuple[dict[tuple[int, ...], float], list[dict[int, tuple[float, float]]]]:
    """Posterior of each vote pattern, and for each labeler how likely each of its votes is if personal and if not.

    Starts from the majority of votes; labelers are taken to be independent given the truth.
    """
    if not counts:
        return {}, []
    width = len(next(iter(counts)))
    start = lambda p: (0.5 + sum(v == 1 for v in p)) / (1 + sum(v > 0 for v in p))
    post = {p: start(p) for p in counts}
    rates: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        good = sum(n * post[p] for p, n in counts.items())
        bad = sum(n * (1 - post[p]) for p, n in counts.items())
        rates = []
        for j in range(width):
            a, b = {v: smooth for v in (0, 1, 2)}, {v: smooth for v in (0, 1, 2)}
            # a vote for is given a head start where it is true, so that the two classes cannot change places
            a[1], b[2] = a[1] + smooth, b[2] + smooth
            for p, n in counts.items():
                a[p[j]] += n * post[p]
                b[p[j]] += n * (1 - post[p])
            rates.append({v: (a[v] / sum(a.values()), b[v] / sum(b.values())) for v in (0, 1, 2)})
        prior = math.log((good + smooth) / (bad + smooth))
        odds = {p: prior + sum(math.log(rates[j][v][0] / rates[j][v][1]) for j, v in enumerate(p)) for p in counts}
        post = {p: 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for p, x in odds.items()}
    return post, rates


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Rows (key, base, added), arrays of struct (kind, start, end), for every row of docs.

    Null texts count as empty. Added spans have the kind secret (with letters) or
    id, and never overlap base ones. Cards that stand side by side are ids whatever
    the classifier says: their check digits speak for them. Keys need not be unique; a null key is kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"))
    for kind in BASE:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind))
    rows = rows.withColumn("maybe", spans(F.col("text"), CANDIDATE, r"[0-9]"))
    tag = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    tagged = [tag(kind) for kind in BASE]
    rows = rows.withColumn("base", F.concat(*tagged))
    meets = lambda x, others: F.exists(others, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    rows = rows.withColumn("cards", F.transform(F.filter(cards_in_runs(F.col("text")), lambda x: ~meets(x, "base")), lambda x: F.struct(F.lit("id").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    free = F.filter("maybe", lambda x: ~meets(x, "base") & ~meets(x, "cards"))
    around = F.transform(
        free,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["span"].alias("span"),
            F.substr("text", F.greatest(x["start"] - LEFT + 1, F.lit(1)), F.least(x["start"], F.lit(LEFT))).alias("left"),
            F.substr("text", x["end"] + 1, F.lit(1)).alias("right"),
        ),
    )
    # one pass over the texts; from here on only spans are read
    found = written(rows.select(F.monotonically_increasing_id().alias("row"), "key", "base", "cards", F.when(F.size("maybe") > 0, around).otherwise(F.array().cast("array<struct<start:int,end:int,span:string,left:string,right:string>>")).alias("maybe")), "spans")
    each = found.where(F.size("maybe") > 0).select("row", F.inline("maybe"))
    votes = _votes(F.col("span"), F.col("left"), F.col("right"))
    voted = each.select("row", "start", "end", "span", "left", "right", *[votes[name].alias(name) for name in LABELERS])
    counts = {tuple(r[name] for name in LABELERS): float(r["count"]) for r in voted.groupBy(*LABELERS).count().collect()}
    post, _ = expectation_maximisation(counts)
    soft = F.create_map(*[F.lit(x) for p, v in sorted(post.items()) for x in ("".join(map(str, p)), v)])[F.concat(*[F.col(name).cast("string") for name in LABELERS])] if post else F.lit(None).cast("double")
    labelled = voted.select("row", "start", "end", "span", soft.alias("soft"), _features(F.col("span"), F.col("left"), F.col("right")).alias("features"))
    sums = labelled.select("soft", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("soft").alias("a"), F.sum(1 - F.col("soft")).alias("b")).collect()
    good, bad = sum(n * post[p] for p, n in counts.items()), sum(n * (1 - post[p]) for p, n in counts.items())
    weigh = {r["feature"]: math.log((r["a"] + SMOOTH) / (good + 2 * SMOOTH)) - math.log((r["b"] + SMOOTH) / (bad + 2 * SMOOTH)) for r in sums}
    if weigh:
        # one literal array, read by place
        weights = F.array(*[F.lit(weigh.get(k, 0.0)) for k in range(BUCKETS)])
        score = F.aggregate("features", F.lit(math.log((good + SMOOTH) / (bad + SMOOTH))), lambda s, f: s + F.get(weights, f.cast("int")))
        sure = 1 / (1 + F.exp(-score)) >= least
    else:
        sure = F.lit(False)
    kind = F.when(F.col("span").rlike("[A-Za-z]"), "secret").otherwise("id")
    added = labelled.where(sure).select("row", F.struct(kind.alias("kind"), "start", "end").alias("one")).groupBy("row").agg(F.array_sort(F.collect_list("one")).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.join(hinted(kept(added), ROWS_AT_ONCE), "row", "left").select(F.col("key").alias(key), "base", F.array_sort(F.concat("cards", F.coalesce("added", none))).alias("added"))


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    # kinds in the order of BASE, then the added ones; within a kind by start
    return found.select(
        "doc_id",
        *[count("base", kind) for kind in BASE],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.concat("base", F.array_sort("added"))).alias("spans"),
        *[count("added", kind) for kind in ADDED],
        (F.size("base") + F.size("added")).cast("long").alias("n_all"),
    )


QUERIES = {"op7_weak_supervision": op7_weak_supervision}
