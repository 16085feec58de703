"""Scores of ranked lists. Lists are rows (case, rank, distance, sat); a case without rows still counts, so cases come along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cutoffs of a sweep.
THRESHOLDS = [round(0.30 + 0.05 * i, 2) for i in range(13)]


def first_hits(cases: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Rows (question_id, rank, distance) of each case's first satisfying row within k; both null if there is none."""
    hit = lists.where(F.col("sat") & (F.col("rank") <= k)).groupBy("question_id").agg(F.min(F.struct("rank", "distance")).alias("hit"))
    return cases.select("question_id").join(hit, "question_id", "left").select("question_id", "hit.rank", "hit.distance")


def refuse_empty(cases: DataFrame, what: str) -> None:
    if cases.isEmpty():
        raise ValueError(f"no {what} to score")


def recall_and_mrr(hits: DataFrame, ks: list[int]) -> DataFrame:
    """Rows (k, recall, mrr) over all cases; a miss counts 0. Null without cases."""
    at = hits.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank")
    found = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    return at.groupBy("k").agg(F.avg(found.cast("double")).alias("recall"), F.avg(F.when(found, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"))


def sweep(hits: DataFrame, negatives: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Rows (threshold, recall, false_accept). hits: distance of each positive's first hit; negatives: best distance of each, null if it has found nothing.

    A gate and the top k both keep a prefix of the same order, so one search
    serves every threshold.
    """
    cut = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    below = lambda: F.avg(F.coalesce(F.col("distance") < F.col("threshold"), F.lit(False)).cast("double"))
    positive = hits.select(cut, "distance").groupBy("threshold").agg(below().alias("recall"))
    negative = negatives.select(cut, "distance").groupBy("threshold").agg(below().alias("false_accept"))
    return positive.join(negative, "threshold")


def separation(hits: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row (lo, lo_case, hi, hi_case, blocked, separable): lo and hi are null if a positive has no hit, hi without negatives."""
    low = hits.agg(F.max(F.struct("distance", (-F.col("question_id")).alias("c"))).alias("lo"), F.count_if(F.col("distance").isNull()).alias("blocked"), F.count("*").alias("n"))
    high = negatives.where("distance is not null").agg(F.min(F.struct("distance", "question_id")).alias("hi"))
    open_ = (F.col("blocked") == 0) & (F.col("n") > 0)
    both = low.crossJoin(high)
    lo, hi = F.when(open_, F.col("lo.distance")), F.when(open_, F.col("hi.distance"))
    return both.select(lo.alias("lo"), F.when(open_, -F.col("lo.c")).alias("lo_case"), hi.alias("hi"), F.when(open_, F.col("hi.question_id")).alias("hi_case"), "blocked", F.coalesce(lo < hi, F.lit(False)).alias("separable"))


def leave_one_out(hits: DataFrame) -> DataFrame:
    """Rows (question_id, lo): the largest first-hit distance of all other cases, from the two largest of all; null if another case has none or there is none."""
    two = hits.orderBy(F.desc_nulls_first("distance"), "question_id").limit(2).agg(F.sort_array(F.collect_list(F.struct(F.col("distance").isNull().alias("none"), F.coalesce("distance", F.lit(0.0)).alias("d"), (-F.col("question_id")).alias("c"))), asc=False).alias("top"))
    other = F.when(-F.col("top")[0]["c"] == F.col("question_id"), F.get("top", F.lit(1))).otherwise(F.col("top")[0])
    return hits.select("question_id").crossJoin(F.broadcast(two)).select("question_id", other.alias("o")).select("question_id", F.when(~F.col("o.none"), F.col("o.d")).alias("lo"))


def recommended(lo: Column, hi: Column, decimals: int = 4) -> Column:
    """The middle of the interval above lo up to hi, rounded half to even; null where the interval is empty or rounding leaves it."""
    middle = F.bround((lo + hi) / 2, decimals)
    return F.when((middle > lo) & (middle <= hi), middle)


def flip_risk(positives: int, negatives: int) -> tuple[float, float, float]:
    """Chances that one more case of either kind would break the interval, and that any of both would."""
    if positives < 1 or negatives < 1:
        raise ValueError("one case of each kind at least")
    p, n = 1 / (positives + 1), 1 / (negatives + 1)
    return p, n, 1 - (1 - p) * (1 - n)


def outcomes(kept: DataFrame, scope: DataFrame, answers: DataFrame, *by: str) -> DataFrame:
    """Rows (by, question_id, kept_total, scope_size, represented, answer_chunks, second_chunks, minority, survived).

    kept: question_id, id, paper_id; scope: question_id, paper_id; answers:
    question_id, paper_id and answer_id (null if the case has none); all with the
    columns in by, such as the policy.
    """
    case = [*by, "question_id"]
    per = kept.groupBy(*case, "paper_id").agg(F.count("*").alias("n"))
    named = scope.select(*case, "paper_id").distinct().join(per, [*case, "paper_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sides = named.groupBy(*case).agg(F.count("*").alias("scope_size"), F.count_if(F.col("n") > 0).alias("represented"), F.min("n").alias("minority"))
    joined = answers.select(*case, F.col("paper_id").alias("answer_paper"), "answer_id").join(kept, case, "left")
    totals = joined.groupBy(*case, "answer_id").agg(F.count("id").alias("kept_total"), F.count_if(F.col("paper_id") == F.col("answer_paper")).alias("answer_chunks"), F.max(F.col("id") == F.col("answer_id")).alias("hit"))
    totals = totals.withColumn("survived", F.when(F.col("answer_id").isNotNull(), F.coalesce("hit", F.lit(False)))).drop("hit", "answer_id")
    return totals.join(sides, case).withColumn("second_chunks", F.col("kept_total") - F.col("answer_chunks"))


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """Rates over outcomes; null, not 0, where nothing was measured."""
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(
        F.try_divide(F.sum("represented"), F.sum("scope_size")).alias("representation"),
        share(F.col("represented") == F.col("scope_size")).alias("both_represented"),
        share(F.col("represented") < F.col("scope_size")).alias("shut_out"),
        share(F.col("answer_chunks") == 0).alias("answer_zero"),
        share(F.col("survived")).alias("survival"),
        F.avg("kept_total").alias("mean_kept"),
        F.max("kept_total").alias("worst_kept"),
        F.avg(F.when(F.col("kept_total") > 0, F.col("second_chunks") / F.col("kept_total"))).alias("second_share"),
        F.avg(F.when(F.col("kept_total") > 0, F.col("minority") / F.col("kept_total"))).alias("minority_share"),
    )


def regressions(base: DataFrame, candidate: DataFrame, *keys: str) -> DataFrame:
    """Keys of cases that survived in base and no longer do in candidate; nulls on either side do not count."""
    then = base.select(*keys, F.col("survived").alias("then"))
    return candidate.select(*keys, "survived").join(then, list(keys)).where(F.col("then") & ~F.col("survived")).select(*keys)


def verdict(truth, got):
    """correct, wrong, missed or hallucinated, of a value and what was found; null is absent."""
    return F.when(truth.isNull(), F.when(got.isNull(), "correct").otherwise("hallucinated")).when(got.isNull(), "missed").when(truth == got, "correct").otherwise("wrong")


def name_sets(cases: DataFrame, names: DataFrame, case: str) -> DataFrame:
    """Rows (case, verdict) of lists compared as sets. names: case, side ('truth' or 'got'), name as compared; null and empty names do not count."""
    side = lambda which: F.array_sort(F.collect_set(F.when((F.col("side") == which) & (F.col("name") != ""), F.col("name"))))
    sets = cases.join(names.groupBy(case).agg(side("truth").alias("truth"), side("got").alias("got")), case, "left")
    stated = lambda c: F.when(F.size(c) > 0, F.col(c))
    return sets.select(case, verdict(stated("truth"), stated("got")).alias("verdict"))


def resolution_passes(expected: Column, resolved: Column) -> Column:
    """Whether each expected part of a title takes a resolved title of its own, the first that holds it in any case, and none is left over."""
    none = F.array().cast("array<string>")
    start = F.struct(F.coalesce(resolved, none).alias("left"), F.lit(True).alias("ok"))

    def take(state: Column, part: Column) -> Column:
        left = state["left"]
        at = F.array_position(F.transform(left, lambda t: F.contains(F.lower(t), F.lower(part))), True).cast("int")
        rest = F.when(at > 0, F.concat(F.slice(left, 1, F.greatest(at - 1, F.lit(0))), F.slice(left, at + 1, F.size(left)))).otherwise(left)
        return F.struct(rest.alias("left"), (state["ok"] & (at > 0)).alias("ok"))

    end = F.aggregate(F.coalesce(expected, none), start, take)
    return end["ok"] & (F.size(end["left"]) == 0)


def sides(kept: DataFrame, scope: DataFrame, best: DataFrame) -> DataFrame:
    """One row for each arm, question and named paper: how many of its chunks were kept, the rank of the first of them, and how near the paper is at all.

    kept: arm, question_id, id, paper_id, n. scope: arm, question_id, paper_id,
    scope_pos (0 is the paper that answers). best: question_id, paper_id, best.
    """
    counts = kept.groupBy("arm", "question_id", "paper_id").agg(F.count("*").alias("kept"), F.min("n").alias("first"))
    rows = scope.join(counts, ["arm", "question_id", "paper_id"], "left").join(best, ["question_id", "paper_id"], "left")
    return rows.select("arm", "question_id", "paper_id", F.when(F.col("scope_pos") == 0, "answer").otherwise("other").alias("side"), F.coalesce("kept", F.lit(0)).alias("kept"), "first", "best")


def slices(rows: DataFrame, low: float, high: float, by: tuple[str, ...] = ("arm", "side")) -> DataFrame:
    """Rates of sides() for every slice: each value of each column in by alone, all of them together, and everything. A column that a slice does not look at is null.

    All slices come from one pass over the rows. Rates of an empty slice are null.
    """
    sets = [list(by), *[[c] for c in by], []]
    view = rows.withColumns({"in_band": F.when((F.col("best") >= low) & (F.col("best") < high), 1).otherwise(0), "there": F.when(F.col("kept") > 0, 1.0).otherwise(0.0)})
    return view.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(
        F.count("*").alias("n"), F.avg("there").alias("represented"), F.count_if(F.col("kept") == 0).alias("shut_out"), F.avg("kept").alias("mean_kept"), F.max("kept").alias("worst_kept"), F.avg("first").alias("mean_first"), F.sum("in_band").cast("long").alias("in_band"), F.max("best").alias("worst_best")
    )


def kept_maps(rows: DataFrame) -> DataFrame:
    """Rows (arm, question_id, kept, by_paper, answer_first, other_first) of sides(): what a case has kept of each named paper, as a map in the order of papers."""
    pair = F.array_sort(F.collect_list(F.struct("paper_id", "kept")))
    first = lambda side: F.min(F.when(F.col("side") == side, F.col("first")))
    return rows.groupBy("arm", "question_id").agg(F.sum("kept").alias("kept"), F.map_from_entries(pair).alias("by_paper"), first("answer").alias("answer_first"), first("other").alias("other_first"))
