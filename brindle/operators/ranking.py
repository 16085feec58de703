"""Ranked lists as rows with a position: fusion, cuts, guarantees, floors. Every window is partitioned by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import CONFIG, EngineConfig
from brindle.functions.vector import nearest
from brindle.operators import lexical, websearch

#: Stands for the rank of an arm that has missed a row.
MISSED = 2**62


def fuse(dense: DataFrame, sparse: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """Weighted reciprocal-rank fusion of dense (…, distance, d_rank) and sparse (…, s_rank): a row of either arm is admitted.

    Adds score and pos (from 1); ties by dense rank, then sparse rank, then id.
    The arms are bounded lists, so they are put under each other and grouped
    instead of joined.
    """
    keys = ["question_id", "id", "paper_id"]
    both = dense.select(*keys, "distance", "d_rank", F.lit(None).cast("long").alias("s_rank")).unionByName(sparse.select(*keys, F.lit(None).cast("double").alias("distance"), F.lit(None).cast("long").alias("d_rank"), "s_rank"))
    rows = both.groupBy(*keys).agg(F.min("distance").alias("distance"), F.min("d_rank").alias("d_rank"), F.min("s_rank").alias("s_rank"))
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(config.hybrid_rrf_k) + F.col(c)), F.lit(0.0))
    scored = rows.withColumn("score", part(config.hybrid_dense_weight, "d_rank") + part(config.hybrid_sparse_weight, "s_rank"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.coalesce("d_rank", F.lit(MISSED)), F.coalesce("s_rank", F.lit(MISSED)), "id")
    return scored.withColumn("pos", F.row_number().over(order).cast("long"))


def within_delta(rows: DataFrame, delta: float = CONFIG.intra_paper_delta) -> DataFrame:
    """The prefix of each question's list up to the first distance beyond its first one plus delta; later rows do not come back."""
    order = Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    limit = rows.withColumn("__first", F.first("distance").over(order))
    return limit.withColumn("__out", F.max(F.col("distance") > F.col("__first") + F.lit(delta)).over(order)).where(~F.col("__out")).drop("__first", "__out")


def within_window(rows: DataFrame, window: int = CONFIG.intra_paper_rank_window) -> DataFrame:
    """The first so many of each question; none if window is not positive."""
    return rows.where(F.col("pos") <= max(0, window))


def guaranteed(ranked: DataFrame, extras: DataFrame) -> DataFrame:
    """ranked, and behind it those of extras (with d_rank within their paper) that it lacks, paper by paper in turn."""
    head = ranked.select("question_id", "id", "paper_id", "distance", F.lit(0).alias("block"), F.col("pos").alias("a"))
    tail = extras.select("question_id", "id", "paper_id", "distance", F.lit(1).alias("block"), F.col("d_rank").alias("a"))
    # a row of both is taken where it comes first; grouping reads each side once, an anti join would compute ranked twice
    once = head.unionByName(tail).groupBy("question_id", "id").agg(F.min(F.struct("block", "a", "distance", "paper_id")).alias("at")).select("question_id", "id", "at.*")
    order = Window.partitionBy("question_id").orderBy("block", "a", F.when(F.col("block") == 1, F.col("distance")), "id")
    return once.withColumn("pos", F.row_number().over(order).cast("long")).select("question_id", "id", "paper_id", "distance", "pos")


def floor(ordered: DataFrame, scope: DataFrame, least: int = CONFIG.mention_per_paper_floor, budget: int = CONFIG.max_context_chunks) -> DataFrame:
    """At most budget rows of each question, among them the first rows (least) of each paper in scope (question_id, paper_id, scope_pos).

    Pinned rows come first, in turn by paper; the rest fills up in order. Papers
    named twice count once, at their first place. Adds n (from 1).
    """
    once = scope.groupBy("question_id", "paper_id").agg(F.min("scope_pos").alias("scope_pos"))
    rows = ordered.join(once, ["question_id", "paper_id"], "left")
    own = Window.partitionBy("question_id", "paper_id").orderBy("pos")
    rows = rows.withColumn("__r", F.row_number().over(own)).withColumn("pinned", F.col("scope_pos").isNotNull() & (F.col("__r") <= least))
    order = Window.partitionBy("question_id").orderBy(F.desc("pinned"), F.when(F.col("pinned"), F.col("__r")), F.when(F.col("pinned"), F.col("scope_pos")), "pos")
    return rows.withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= budget).drop("__r", "scope_pos")


def widened(pinned: DataFrame, fill: DataFrame, budget: int = CONFIG.max_context_chunks) -> DataFrame:
    """pinned (n), then the rows of fill (pos) that are not pinned, up to the budget of each question; renumbered."""
    both = pinned.select("question_id", "id", "paper_id", F.lit(0).alias("block"), F.col("n").alias("a")).unionByName(fill.select("question_id", "id", "paper_id", F.lit(1).alias("block"), F.col("pos").alias("a")))
    once = both.groupBy("question_id", "id").agg(F.min(F.struct("block", "a", "paper_id")).alias("at")).select("question_id", "id", "at.*")
    order = Window.partitionBy("question_id").orderBy("block", "a")
    return once.withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= budget).select("question_id", "id", "paper_id", "n", (F.col("block") == 1).alias("fill"))


def ranked_within(near: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """The nearest of each question (question_id, gate) among rows found for each of its papers, ranked anew."""
    rows = near.join(asked.select("question_id", "gate"), "question_id").where(F.col("distance") < F.col("gate")).drop("gate", "d_rank")
    order = Window.partitionBy("question_id").orderBy("distance", "id")
    return rows.withColumn("d_rank", F.row_number().over(order).cast("long")).where(F.col("d_rank") <= keep)


def retrieve(chunks: DataFrame, questions: DataFrame, terms: DataFrame | None = None, scope: DataFrame | None = None, pool: int | None = None, guarantee: int = 0, near: DataFrame | None = None, texts: DataFrame | lexical.Index | None = None, typed: DataFrame | None = None, config: EngineConfig = CONFIG) -> DataFrame:
    """Rows (question_id, pos, id, paper_id, distance[, d_rank, s_rank, score]) for a batch of questions, in the order of the cuts: gate, pools, fusion, budget, cut within one paper, guarantee.

    chunks: id, paper_id, embedding and, for the lexical arm, text, unless texts
    brings chunks with texts or their index. Without terms and typed questions
    (question_id, text; see websearch, by stems where there is an index) only the
    dense arm is used. A question whose scope is exactly one paper has
    the wider gate and a cut of its own, and no guarantee. near may bring the
    nearest rows of each question and paper in scope (d_rank within the paper, no
    gate, as many as any pool): then nothing is searched again.
    """
    pool = pool or config.max_context_chunks
    asked = questions
    if scope is not None:
        scope = scope.select("question_id", "paper_id").distinct()
        sizes = scope.groupBy("question_id").agg(F.count("*").alias("papers"))
        asked = questions.drop("gate").join(sizes, "question_id", "left").withColumn("single", F.coalesce(F.col("papers") == 1, F.lit(False)))
        asked = asked.withColumn("gate", F.when(F.col("single"), config.intra_paper_ceiling).otherwise(config.similarity_threshold))
    else:
        asked = questions.withColumn("single", F.lit(False)).withColumn("gate", F.lit(config.similarity_threshold))
    single = asked.select("question_id", "single")
    by_words = terms is not None or typed is not None
    keep = max(config.hybrid_dense_pool, pool) if by_words else pool
    dense = nearest(chunks, asked, keep, scope=scope) if near is None else ranked_within(near, asked, keep)
    if not by_words:
        ranked = dense.withColumnRenamed("d_rank", "pos").where(F.col("pos") <= pool).join(single, "question_id")
        cut = within_delta(ranked.where("single"), config.intra_paper_delta)
        ranked = ranked.where("not single").unionByName(cut).drop("single")
    else:
        corpus = chunks if texts is None else texts
        pool_of = config.hybrid_sparse_pool
        sparse = lexical.best(corpus, terms, pool_of, scope=scope) if typed is None else websearch.best(corpus, typed, pool_of, isinstance(corpus, lexical.Index), scope)
        fused = fuse(dense, sparse, config).where(F.col("pos") <= pool)
        ranked = fused.join(single, "question_id").where(~F.col("single") | (F.col("pos") <= config.intra_paper_rank_window)).drop("single")
    if guarantee > 0 and scope is not None:
        many = asked.where("not single")
        if near is None:
            return guaranteed(ranked, nearest(chunks, many, guarantee, scope=scope, by_group=True))
        own = near.join(many.select("question_id", "gate"), "question_id").where(F.col("distance") < F.col("gate"))
        return guaranteed(ranked, own.where(F.col("d_rank") <= guarantee))
    return ranked
