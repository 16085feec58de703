"""Which papers a question names: by a run of the title, by an attributed author, by a year; ambiguity resolves nothing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.config import CONFIG
from brindle.functions.folding import fold, folded
from brindle.operators import keyed

#: Words that a name after "by" may have.
NAME_WORDS = 3
YEAR = r"\b((?:19|20)\d{2})\b"


def _words(question: str) -> list[tuple[str, bool]]:
    """Words that begin with a letter, and whether only blanks stand between each and the one before; apostrophes and hyphens are part of them."""
    out, behind = [], -1
    for m in re.finditer(r"[\w'\u2019-]+", question):
        start = next((i for i, c in enumerate(m[0]) if c.isalpha()), len(m[0]))
        # a word cannot begin behind a digit or underscore that it would be one with
        if start < len(m[0]) and (start == 0 or not (m[0][start - 1].isalnum() or m[0][start - 1] == "_")):
            out.append((m[0][start:], start == 0 and behind >= 0 and not question[behind : m.start()].strip()))
        behind = m.end()
    return out


def _capitals(words: list[str]) -> str:
    stop = next((i for i, word in enumerate(words) if not word[0].isupper()), len(words))
    return " ".join(words[:stop])


def _owner(word: str) -> str:
    """The word before the last possessive ending in it; empty if it has none."""
    for at in range(len(word) - 2, 0, -1):
        if word[at] in "'\u2019" and word[at + 1] == "s" and not (word[at + 2 : at + 3].isalnum() or word[at + 2 : at + 3] == "_"):
            return word[:at]
    return ""


def attributed(question: str | None) -> list[str]:
    """Capitalised names that a question attributes something to: authored by, by, et al., possessive, in order of the constructions."""
    words = _words(question or "")
    found: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}
    for i, (word, _) in enumerate(words):
        joined = [next_ for next_, beside in words[i + 1 : i + 1 + NAME_WORDS]]
        run = next((k for k, (_, beside) in enumerate(words[i + 1 : i + 1 + NAME_WORDS]) if not beside), len(joined))
        if word == "by":
            name = _capitals(joined[:run])
            found[1].append(name)
            if i and words[i - 1][0] == "authored" and words[i][1]:
                found[0].append(name)
        if run >= 2 and joined[:2] == ["et", "al"]:
            found[2].append(_capitals([word]))
        if owner := _owner(word):
            found[3].append(_capitals([owner]))
    return [name for names in found.values() for name in names if name]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))])))
def attributions(questions: pd.Series) -> pd.Series:
    return questions.map(lambda q: [(n, fold(n).split()) for n in attributed(q)])


def title_spans(asked: DataFrame, titled: DataFrame, least: int = 4) -> DataFrame:
    """Rows (question_id, paper_id, span, n): the longest run of a title's words (least or more, or all of a shorter title) that a question holds.

    Runs of so many words are joined by hash; hits that follow each other in
    both texts are one run. asked: question_id, words; titled: paper_id, words.
    """
    width = F.least(F.lit(least), F.size("words"))
    some = titled.where(F.size("words") > 0).withColumn("width", width)
    titles = keyed.word_runs(some.select("paper_id", "words", "width"), "words", F.col("width"), least, "i")
    widths = F.explode(F.sequence(F.lit(1), F.lit(least))).alias("width")
    questions = keyed.word_runs(asked.select("question_id", "words", widths), "words", F.col("width"), least, "j")
    hits = titles.join(questions, ["gram", "width"]).select("question_id", "paper_id", "width", "i", (F.col("j") - F.col("i")).alias("shift")).distinct()
    run = F.col("i") - F.row_number().over(Window.partitionBy("question_id", "paper_id", "shift").orderBy("i"))
    runs = hits.withColumn("run", run).groupBy("question_id", "paper_id", "width", "shift", "run").agg(F.min("i").alias("first"), F.count("*").alias("hits"))
    best = runs.withColumn("n", F.col("hits") + F.col("width") - 1).groupBy("question_id", "paper_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"))).alias("top"))
    return best.join(titled, "paper_id").select("question_id", "paper_id", F.array_join(F.slice("words", (1 - F.col("top.f")).cast("int"), F.col("top.n").cast("int")), " ").alias("span"), "top.n")


def author_hits(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows (question_id, paper_id, name): the longest beginning of a name whose words one paper's authors have; the first name of a paper counts.

    Words are joined by equality and counted, so no question meets every paper.
    """
    names = questions.select("question_id", F.posexplode(attributions("text")).alias("at", "n")).select("question_id", "at", "n.name", "n.tokens").where(F.size("tokens") > 0)
    prefixes = names.select("question_id", "at", "name", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("length"))
    wanted = prefixes.withColumn("set", F.array_distinct(F.slice("tokens", F.lit(1), F.col("length")))).select("question_id", "at", "name", "length", F.size("set").alias("need"), F.explode("set").alias("token"))
    owned = papers.select("paper_id", F.explode("authors").alias("author")).select("paper_id", F.explode(F.split(folded("author"), " ")).alias("token")).where("token <> ''").distinct()
    full = wanted.join(owned, "token").groupBy("question_id", "at", "name", "length", "need", "paper_id").agg(F.count("*").alias("have")).where("have = need")
    longest = full.withColumn("best", F.max("length").over(Window.partitionBy("question_id", "at"))).where("length = best")
    return longest.groupBy("question_id", "paper_id").agg(F.min_by("name", "at").alias("name"))


def resolve(questions: DataFrame, papers: DataFrame, most: int = CONFIG.max_resolved_papers) -> DataFrame:
    """Rows (question_id, paper_ids, evidence) for every question (question_id, text); both empty if nothing is named for sure.

    papers: paper_id, title, authors, year. Title runs come first, with one
    author's paper beside them; then one author's single paper, narrowed by a
    year; then a year that one paper alone has and no title mentions. More papers
    than most resolve nothing, and neither does a library of one.
    """
    tokens = lambda c: F.filter(F.split(folded(c), " "), lambda x: x != "")
    spans = title_spans(questions.select("question_id", tokens("text").alias("words")), papers.select("paper_id", tokens("title").alias("words")))
    spans = spans.withColumn("shared", F.count("*").over(Window.partitionBy("question_id", "span")) > 1)
    sure = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    by_span = spans.groupBy("question_id").agg(sure("paper_id", F.col("span").alias("why")).alias("spans"), F.max("shared").alias("shared"))
    years = questions.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(YEAR), F.lit(1)))).alias("y"))
    of_year = years.join(papers.select("paper_id", F.col("year").cast("string").alias("y")), "y").select("question_id", "paper_id", "y")
    contested = years.join(papers.select(F.explode(F.regexp_extract_all("title", F.lit(YEAR), F.lit(1))).alias("y")).distinct(), "y").select("question_id").distinct().withColumn("contested", F.lit(True))
    by_year = of_year.groupBy("question_id").agg(sure("paper_id", F.col("y").alias("why")).alias("years"))
    hits = author_hits(questions, papers).join(of_year.select("question_id", "paper_id", F.lit(True).alias("in_year")).distinct(), ["question_id", "paper_id"], "left")
    by_author = hits.groupBy("question_id").agg(sure("paper_id", F.col("name").alias("why")).alias("authors"), sure("paper_id", F.col("name").alias("why"), "in_year").alias("dated"))
    rows = questions.select("question_id").join(by_span, "question_id", "left").join(by_author, "question_id", "left").join(by_year, "question_id", "left").join(contested, "question_id", "left")
    none = F.array().cast("array<struct<paper_id:bigint,why:string>>")
    one = lambda c: F.transform(c, lambda x: F.struct(x["paper_id"].cast("bigint").alias("paper_id"), x["why"].alias("why")))
    named = F.coalesce(one("spans"), none)
    beside = F.when(F.size("authors") == 1, F.filter(one("authors"), lambda a: ~F.exists("spans", lambda s: s["paper_id"] == a["paper_id"]))).otherwise(none)
    narrowed = F.when(F.size("years") > 0, one(F.filter("dated", lambda x: x["in_year"]))).otherwise(one("authors"))
    found = (
        F.when(F.size("spans") > 0, F.when(F.col("shared"), none).otherwise(F.concat(named, beside)))
        .when(F.size("authors") > 0, F.when(F.size(narrowed) == 1, narrowed).otherwise(none))
        .when((F.size("years") == 1) & F.col("contested").isNull(), one("years"))
        .otherwise(none)
    )
    library = papers.limit(2).agg((F.count("*") > 1).alias("many"))
    capped = rows.crossJoin(F.broadcast(library)).select("question_id", F.when(F.col("many") & F.size(found).between(1, most), found).otherwise(none).alias("f"))
    return capped.select("question_id", F.col("f.paper_id").alias("paper_ids"), F.col("f.why").alias("evidence"))
