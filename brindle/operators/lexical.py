"""Lexical arm: terms of questions matched with the tokens of chunks, scored by frequency or by cover density."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import tokens
from brindle.operators import packs
from brindle.operators.postings import TERMS_AT_ONCE, Index, lookup
from brindle.store import hinted


def _counted(corpus: DataFrame | Index, asked: DataFrame) -> DataFrame:
    """Rows of asked with id, paper_id and tf of each chunk that has the term: looked up in an index, or counted in texts."""
    if isinstance(corpus, Index):
        return lookup(corpus, asked).drop("places")
    each = corpus.select("id", "paper_id", F.explode(tokens(F.col("text"))).alias("term"))
    return each.join(hinted(asked, TERMS_AT_ONCE), "term").groupBy(*asked.columns, "id", "paper_id").agg(F.count("*").alias("tf"))


def placed(corpus: DataFrame | Index, asked: DataFrame) -> DataFrame:
    """Rows of asked with id, paper_id and at for each place of the term in a chunk."""
    if isinstance(corpus, Index):
        return lookup(corpus, asked).drop("tf").withColumn("at", F.explode("places")).drop("places")
    each = corpus.select("id", "paper_id", F.posexplode(tokens(F.col("text"))).alias("at", "term"))
    return each.join(hinted(asked, TERMS_AT_ONCE), "term")


def matches(chunks: DataFrame | Index, terms: DataFrame, mode: str = "all", without: DataFrame | None = None) -> DataFrame:
    """Rows (question_id, id, paper_id, tf): chunks that hold all (or any) of a question's terms, and none of those it excludes.

    chunks: id, paper_id, text, or their index; terms and without: question_id,
    term. A question without terms finds nothing. Without an index, only tokens
    that some question asks for leave the scan, and they are counted before they
    are shuffled.
    """
    if mode not in ("all", "any"):
        raise ValueError("mode is all or any")
    asked = terms.select("question_id", "term").distinct().withColumn("asked", F.count("*").over(Window.partitionBy("question_id")))
    wanted = asked.withColumn("no", F.lit(False))
    if without is not None:
        wanted = wanted.unionByName(without.select("question_id", "term", F.lit(0).cast("long").alias("asked"), F.lit(True).alias("no")).distinct())
    found = _counted(chunks, wanted).groupBy("question_id", "id", "paper_id").agg(F.sum(F.when(~F.col("no"), F.col("tf")).otherwise(0)).alias("tf"), F.sum((~F.col("no")).cast("long")).alias("n"), F.max("no").alias("refused"), F.max("asked").alias("asked"))
    enough = F.col("n") == F.col("asked") if mode == "all" else F.col("n") > 0
    return found.where(~F.col("refused") & enough).select("question_id", "id", "paper_id", "tf")


def _single(terms: DataFrame) -> DataFrame:
    """What packs.best() takes, of single words. A null term is one that no chunk has."""
    term = F.coalesce("term", F.lit(""))
    return terms.select("question_id", F.lit(0).alias("part"), F.lit(False).alias("no"), term.alias("atom"), F.lit(0).alias("place"), term.alias("term"), term.alias("unit")).distinct()


def best(corpus: DataFrame | Index, terms: DataFrame, pool: int, mode: str = "all", scope: DataFrame | None = None) -> DataFrame:
    """The pool best of matches(), with s_rank; scope (question_id, paper_id) names the papers that a question may find.

    With an index, pairs of question and chunk stay in the tasks (see packs).
    """
    if mode not in ("all", "any"):
        raise ValueError("mode is all or any")
    if not isinstance(corpus, Index):
        found = matches(corpus, terms, mode)
        return ranked(found if scope is None else found.join(hinted(scope, TERMS_AT_ONCE), ["question_id", "paper_id"], "left_semi"), pool)
    found = packs.best(corpus, _single(terms), pool, packs.by_sum if mode == "all" else packs.by_any, scope, placed=False)
    return ranked(found.select("question_id", "id", "paper_id", F.col("score").cast("long").alias("tf")), pool)


def ranked(found: DataFrame, pool: int, score: str = "tf") -> DataFrame:
    """The best of each question, with s_rank; ties by id."""
    order = Window.partitionBy("question_id").orderBy(F.desc(score), "id")
    return found.withColumn("s_rank", F.row_number().over(order).cast("long")).where(F.col("s_rank") <= pool)


def cover_score(places: list[tuple[int, str]], n_terms: int) -> float:
    """Sum over all minimal runs that hold every term of 1 / (1 + words in it that are none of the terms' places)."""
    total, last, left = 0.0, {}, -1
    for at, (place, term) in enumerate(places):
        last[term] = at
        if len(last) == n_terms:
            first = min(last.values())
            # a run is minimal if it begins later than the one before
            if first > left:
                left = first
                total += 1.0 / (1 + place - places[first][0] - (at - first))
    return total


@F.pandas_udf(T.DoubleType())
def _covers(places: pd.Series, found: pd.Series, asked: pd.Series) -> pd.Series:
    return pd.Series([cover_score(list(zip(p, t, strict=True)), n) for p, t, n in zip(places, found, asked, strict=True)])


def cover_density(chunks: DataFrame | Index, terms: DataFrame) -> DataFrame:
    """Rows (question_id, id, paper_id, score) of chunks with all terms of a question, scored by how close they stand.

    Only the places of terms are gathered, for one question and chunk at a time.
    """
    asked = terms.select("question_id", "term").distinct().withColumn("asked", F.count("*").over(Window.partitionBy("question_id")))
    hits = placed(chunks, asked).groupBy("question_id", "id", "paper_id", "asked").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), "term"))).alias("hits"), F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == F.col("asked")).select("question_id", "id", "paper_id", _covers("hits.place", "hits.term", "asked").alias("score"))


def best_covers(index: Index, terms: DataFrame, pool: int) -> DataFrame:
    """The pool best of cover_density(), with s_rank: pairs of question and chunk and their places stay in the tasks (see packs)."""
    return ranked(packs.best(index, _single(terms), pool, packs.by_cover), pool, "score")
