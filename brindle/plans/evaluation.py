"""Queries that score retrieval: relevant is what has the question's label, off-topic questions are negated vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.bindings import DISTANCES_SQL, NEGATIVES_SQL, QUESTIONS_SQL, chunks, distance_sql, questions, table, vectors
from brindle.config import CONFIG as C
from brindle.functions.vector import counts_below, nearest
from brindle.operators import evaluation as ev
from brindle.operators import ranking
from brindle.plans import retrieval as R
from brindle.plans.indexes import asked_terms, text_index
from brindle.registry import register
from brindle.store import written

K = C.max_context_chunks
KS = [5, 10, K]
POSITIVES_SQL = f"""{QUESTIONS_SQL}, lists AS (SELECT q.question_id, e.vec_id AS id, e.label = q.own AS sat, {distance_sql('CAST(e.embedding AS DOUBLE[])', 'q.qv')} AS distance FROM questions q JOIN embeddings e ON e.vec_id <> q.question_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank FROM lists QUALIFY rank <= {K}),
hits AS (SELECT q.question_id, min(r.rank) AS rank, min(r.distance) AS distance FROM questions q LEFT JOIN ranked r ON r.question_id = q.question_id AND r.sat GROUP BY q.question_id)"""
OFF_TOPIC_SQL = f"{NEGATIVES_SQL}, bests AS (SELECT n.question_id, min({distance_sql('CAST(e.embedding AS DOUBLE[])', 'n.qv')}) AS distance FROM negatives n CROSS JOIN embeddings e GROUP BY n.question_id)"
CUTS_SQL = f"cuts AS (SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in ev.THRESHOLDS)}]) AS threshold)"
SWEEP_SQL = f"""WITH {POSITIVES_SQL}, {OFF_TOPIC_SQL}, {CUTS_SQL},
swept AS (SELECT threshold, (SELECT avg(CASE WHEN h.distance < c.threshold THEN 1.0 ELSE 0.0 END) FROM hits h) AS recall, (SELECT avg(CASE WHEN b.distance < c.threshold THEN 1.0 ELSE 0.0 END) FROM bests b) AS false_accept FROM cuts c)"""


def positives(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cases, and their lists (question_id, id, rank, distance, sat)."""
    asked = questions(spark, sf)
    found = nearest(vectors(spark, sf), asked, K, skip_self=True)
    lists = found.join(asked.select("question_id", F.col("paper_id").alias("own")), "question_id")
    return asked, lists.select("question_id", "id", F.col("d_rank").alias("rank"), "distance", (F.col("paper_id") == F.col("own")).alias("sat"))


def hits(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    asked, lists = positives(spark, sf)
    ev.refuse_empty(asked, "positives")
    return ev.first_hits(asked, lists, k)


def off_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Best distance of each off-topic question; one that finds nothing stays, with null."""
    asked = questions(spark, sf, rest=10, sign=-1)
    best = nearest(vectors(spark, sf), asked, 1).select("question_id", "distance")
    return asked.select("question_id").join(best, "question_id", "left")


@register("recall_at_k", f"WITH {POSITIVES_SQL}, ks AS (SELECT unnest({KS}) AS k) SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 9) AS recall FROM hits CROSS JOIN ks GROUP BY k")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return ev.recall_and_mrr(hits(spark, sf), KS).select("k", F.round("recall", 9).alias("recall"))


@register("mrr", f"WITH {POSITIVES_SQL}, ks AS (SELECT unnest({KS}) AS k) SELECT k, round(avg(CASE WHEN rank <= k THEN CAST(1 AS DOUBLE) / rank ELSE 0 END), 9) AS mrr FROM hits CROSS JOIN ks GROUP BY k")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    return ev.recall_and_mrr(hits(spark, sf), KS).select("k", F.round("mrr", 9).alias("mrr"))


@register("first_satisfying", f"WITH {POSITIVES_SQL} SELECT question_id, rank, round(distance, 6) AS distance FROM hits")
def first_satisfying(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).select("question_id", "rank", F.round("distance", 6).alias("distance"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    rows = ranking.retrieve(chunks(spark, sf), asked, asked_terms(spark, sf), texts=text_index(spark, sf)).join(asked.select("question_id", F.col("paper_id").alias("own")), "question_id")
    return rows.where((F.col("paper_id") == F.col("own")) & (F.col("id") != F.col("question_id"))).groupBy("question_id").agg(F.min_by(F.struct("d_rank", "s_rank"), "pos").alias("first"))


@register(
    "rescued",
    f"{R.HYBRID_SQL}, firsts AS (SELECT o.question_id, arg_min([o.d_rank, o.s_rank], o.pos) AS f FROM ordered o JOIN questions q ON q.question_id = o.question_id WHERE o.paper_id = q.own AND o.id <> o.question_id AND o.pos <= {K} GROUP BY o.question_id), dense_ids AS (SELECT p.question_id, p.id, p.paper_id = p.own AS sat, row_number() OVER (PARTITION BY p.question_id ORDER BY p.distance, p.id) AS r FROM pairs p WHERE p.id <> p.question_id QUALIFY r <= {K}) SELECT (SELECT count(*) FROM firsts WHERE f[1] IS NULL AND f[2] IS NOT NULL) AS rescued, (SELECT count(*) FROM questions q WHERE NOT EXISTS (SELECT 1 FROM dense_ids d WHERE d.question_id = q.question_id AND d.sat)) AS eligible",
)
def rescued(spark: SparkSession, sf: str) -> DataFrame:
    """Cases whose first satisfying row came from the lexical arm alone, beside those that the dense arm misses."""
    only = _fused(spark, sf).agg(F.count_if(F.col("first.d_rank").isNull() & F.col("first.s_rank").isNotNull()).alias("rescued"))
    asked = questions(spark, sf)
    dense = nearest(chunks(spark, sf), asked, K, skip_self=True).join(asked.select("question_id", F.col("paper_id").alias("own")), "question_id").where("paper_id = own")
    return only.crossJoin(asked.join(dense, "question_id", "left_anti").agg(F.count("*").alias("eligible")))


@register("rescue_eligible", f"WITH {POSITIVES_SQL} SELECT question_id FROM hits WHERE rank IS NULL OR rank > {KS[0]}")
def rescue_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Cases that the dense arm misses within its first rows: those that another arm could rescue."""
    asked, lists = positives(spark, sf)
    return asked.select("question_id").join(lists.where(F.col("sat") & (F.col("rank") <= KS[0])).select("question_id"), "question_id", "left_anti")


@register("noise_floor", f"WITH {OFF_TOPIC_SQL} SELECT round(min(distance), 6) AS noise_floor, count(distance) AS measured FROM bests")
def noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    return off_topic(spark, sf).agg(F.round(F.min("distance"), 6).alias("noise_floor"), F.count("distance").alias("measured"))


@register("threshold_sweep", f"{SWEEP_SQL} SELECT threshold, round(recall, 9) AS recall, round(false_accept, 9) AS false_accept FROM swept")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    negatives = off_topic(spark, sf)
    ev.refuse_empty(negatives, "negatives")
    return ev.sweep(hits(spark, sf), negatives).select("threshold", F.round("recall", 9).alias("recall"), F.round("false_accept", 9).alias("false_accept"))


@register("separating_threshold", f"{SWEEP_SQL} SELECT min(CASE WHEN recall = 1 AND false_accept = 0 THEN threshold END) AS threshold, max(CASE WHEN false_accept = 0 THEN recall END) AS best_clean_recall FROM swept")
def separating_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.sweep(hits(spark, sf), off_topic(spark, sf))
    return rows.agg(F.min(F.when((F.col("recall") == 1) & (F.col("false_accept") == 0), F.col("threshold"))).alias("threshold"), F.max(F.when(F.col("false_accept") == 0, F.col("recall"))).alias("best_clean_recall"))


@register(
    "separation_bounds",
    f"WITH {POSITIVES_SQL}, {OFF_TOPIC_SQL}, low AS (SELECT max(distance) AS lo, arg_max(question_id, distance) AS lo_case, count(*) FILTER (WHERE distance IS NULL) AS blocked FROM (SELECT * FROM hits ORDER BY question_id)), high AS (SELECT min(distance) AS hi, arg_min(question_id, distance) AS hi_case FROM (SELECT * FROM bests ORDER BY question_id)) SELECT CASE WHEN blocked = 0 THEN round(lo, 6) END AS lo, CASE WHEN blocked = 0 THEN lo_case END AS lo_case, CASE WHEN blocked = 0 THEN round(hi, 6) END AS hi, CASE WHEN blocked = 0 THEN hi_case END AS hi_case, blocked, coalesce(blocked = 0 AND lo < hi, false) AS separable FROM low CROSS JOIN high",
)
def separation_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return ev.separation(hits(spark, sf), off_topic(spark, sf)).withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@register("leave_one_out_lo", f"WITH {POSITIVES_SQL} SELECT h.question_id, CASE WHEN count(o.question_id) > 0 AND count(*) FILTER (WHERE o.distance IS NULL) = 0 THEN round(max(o.distance), 6) END AS lo FROM hits h LEFT JOIN hits o ON o.question_id <> h.question_id GROUP BY h.question_id")
def leave_one_out_lo(spark: SparkSession, sf: str) -> DataFrame:
    return ev.leave_one_out(hits(spark, sf)).select("question_id", F.round("lo", 6).alias("lo"))


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest chunks of each question in each of its two papers, as many as any policy looks at: one search for all policies."""
    asked = questions(spark, sf)
    keep = max(C.hybrid_dense_pool, C.max_context_chunks + 2 * C.mention_per_paper_floor) + 1
    return written(nearest(chunks(spark, sf), asked, keep, scope=R.scope_of_two(asked), by_group=True), "scoped")


def arm(spark: SparkSession, sf: str, name: str, near: DataFrame) -> DataFrame:
    """What a policy keeps of a question's two named papers: production (hybrid), flat at either gate, or paper by paper admitted at either gate. near: scoped()."""
    asked = questions(spark, sf)
    scope = R.scope_of_two(asked)
    if name == "production":
        return ranking.floor(R.candidates(spark, sf, near)[0], scope)
    if name.startswith("flat"):
        found = ranking.ranked_within(near, asked.withColumn("gate", F.lit(float(name[5:]))), C.max_context_chunks + 2 * C.mention_per_paper_floor)
        return ranking.floor(found.withColumnRenamed("d_rank", "pos"), scope)
    admit = float(name[6:])
    own = near.where((F.col("distance") < C.intra_paper_ceiling) & (F.col("d_rank") <= C.max_context_chunks))
    best = F.min("distance").over(R.Window.partitionBy("question_id", "paper_id"))
    admitted = own.withColumn("best", best).where(F.col("best") < admit)
    # each paper's list is cut against its own first row, then the lists are merged in turn
    cut = admitted.where((F.col("distance") <= F.col("best") + F.lit(C.intra_paper_delta))).join(scope, ["question_id", "paper_id"])
    order = R.Window.partitionBy("question_id").orderBy("d_rank", "scope_pos")
    return ranking.floor(cut.withColumn("pos", F.row_number().over(order)).select("question_id", "id", "paper_id", "distance", "pos"), scope)


ARMS = ["production", f"flat:{C.similarity_threshold}", f"flat:{C.intra_paper_ceiling}", f"admit:{C.similarity_threshold}", f"admit:{C.intra_paper_ceiling}"]


def arm_outcomes(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """Rows (arm, ...) of ev.outcomes(). The answer of a question is the chunk of its own paper nearest to it, itself excluded."""
    near = scoped(spark, sf)
    asked = questions(spark, sf).select("question_id", F.col("paper_id").cast("long").alias("paper_id"))
    own = near.join(asked, ["question_id", "paper_id"]).where(F.col("id") != F.col("question_id")).groupBy("question_id").agg(F.min(F.struct("distance", "id"))["id"].alias("answer_id"))
    answers = asked.join(own, "question_id", "left")
    kept = None
    for name in names:
        found = arm(spark, sf, name, near).select(F.lit(name).alias("arm"), "question_id", "id", "paper_id")
        kept = found if kept is None else kept.unionByName(found)
    arms = F.explode(F.array(*map(F.lit, names))).alias("arm")
    return ev.outcomes(kept, R.scope_of_two(asked).select(arms, "question_id", "paper_id"), answers.select(arms, "question_id", "paper_id", "answer_id"), "arm")


def _flat_sql(name: str, gate: float) -> str:
    return f"""{name}_c AS (SELECT question_id, id, paper_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS pos FROM pairs p WHERE distance < {gate} AND {R.IN_SCOPE} QUALIFY pos <= {C.max_context_chunks + 2 * C.mention_per_paper_floor}),
{R.floor_sql(str(C.max_context_chunks), f'{name}_c', name)}"""


def _admit_sql(name: str, admit: float) -> str:
    return f"""{name}_o AS (SELECT question_id, id, paper_id, distance, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY distance, id) AS r, min(distance) OVER (PARTITION BY question_id, paper_id) AS best FROM pairs p WHERE distance < {C.intra_paper_ceiling} AND {R.IN_SCOPE} QUALIFY r <= {C.max_context_chunks}),
{name}_c AS (SELECT o.question_id, o.id, o.paper_id, o.distance, row_number() OVER (PARTITION BY o.question_id ORDER BY o.r, s.scope_pos) AS pos FROM {name}_o o JOIN scope s ON s.question_id = o.question_id AND s.paper_id = o.paper_id WHERE o.best < {admit} AND o.distance <= o.best + CAST({C.intra_paper_delta} AS DOUBLE)),
{R.floor_sql(str(C.max_context_chunks), f'{name}_c', name)}"""


ARMS_SQL = f"""{R.CANDIDATES_SQL}, {R.floor_sql(str(C.max_context_chunks), 'candidates', 'arm0')}, {_flat_sql('arm1', C.similarity_threshold)}, {_flat_sql('arm2', C.intra_paper_ceiling)}, {_admit_sql('arm3', C.similarity_threshold)}, {_admit_sql('arm4', C.intra_paper_ceiling)},
answers AS (SELECT q.question_id, q.own, (SELECT arg_min(p.id, struct_pack(d := p.distance, i := p.id)) FROM pairs p WHERE p.question_id = q.question_id AND p.paper_id = q.own AND p.id <> q.question_id) AS answer_id FROM questions q),
kept AS ({' UNION ALL '.join(f"SELECT '{a}' AS arm, question_id, id, paper_id FROM arm{i}" for i, a in enumerate(ARMS))}),
arms AS (SELECT unnest({ARMS}) AS arm),
totals AS (SELECT a.arm, w.question_id, count(k.id) AS kept_total, count(*) FILTER (WHERE k.paper_id = w.own) AS answer_chunks, CASE WHEN w.answer_id IS NOT NULL THEN coalesce(bool_or(k.id = w.answer_id), false) END AS survived
  FROM arms a CROSS JOIN answers w LEFT JOIN kept k ON k.arm = a.arm AND k.question_id = w.question_id GROUP BY a.arm, w.question_id, w.answer_id),
named AS (SELECT a.arm, s.question_id, s.paper_id, count(k.id) AS n FROM arms a CROSS JOIN scope s LEFT JOIN kept k ON k.arm = a.arm AND k.question_id = s.question_id AND k.paper_id = s.paper_id GROUP BY a.arm, s.question_id, s.paper_id),
sides AS (SELECT arm, question_id, count(*) AS scope_size, count(*) FILTER (WHERE n > 0) AS represented, min(n) AS minority FROM named GROUP BY arm, question_id),
outcome AS (SELECT t.*, s.scope_size, s.represented, s.minority FROM totals t JOIN sides s ON s.arm = t.arm AND s.question_id = t.question_id)"""
RATES = ("representation", "both_represented", "shut_out", "answer_zero", "survival", "mean_kept", "second_share", "minority_share")


@register(
    "representation_rates",
    f"""{ARMS_SQL} SELECT arm, round(sum(represented) / CAST(sum(scope_size) AS DOUBLE), 9) AS representation, round(avg(CASE WHEN represented = scope_size THEN 1.0 ELSE 0.0 END), 9) AS both_represented, round(avg(CASE WHEN represented < scope_size THEN 1.0 ELSE 0.0 END), 9) AS shut_out,
round(avg(CASE WHEN answer_chunks = 0 THEN 1.0 ELSE 0.0 END), 9) AS answer_zero, round(avg(CASE WHEN survived THEN 1.0 WHEN NOT survived THEN 0.0 END), 9) AS survival, round(avg(kept_total), 9) AS mean_kept, max(kept_total) AS worst_kept,
round(avg(CASE WHEN kept_total > 0 THEN (kept_total - answer_chunks) / CAST(kept_total AS DOUBLE) END), 9) AS second_share, round(avg(CASE WHEN kept_total > 0 THEN minority / CAST(kept_total AS DOUBLE) END), 9) AS minority_share FROM outcome GROUP BY arm""",
)
def representation_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Five policies over the same questions."""
    return ev.rates(arm_outcomes(spark, sf, ARMS), "arm").withColumns({c: F.round(c, 9) for c in RATES})


@register("arm_outcome_rows", f"{ARMS_SQL} SELECT arm, question_id, kept_total, answer_chunks, represented, survived FROM outcome WHERE arm = 'production'")
def arm_outcome_rows(spark: SparkSession, sf: str) -> DataFrame:
    return arm_outcomes(spark, sf, ["production"]).select("arm", "question_id", "kept_total", "answer_chunks", "represented", "survived")


SIDE_ARMS = [ARMS[0], ARMS[2]]
SIDES_SQL = f"""{ARMS_SQL}, placed AS ({' UNION ALL '.join(f"SELECT '{a}' AS arm, question_id, id, paper_id, n FROM arm{ARMS.index(a)}" for a in SIDE_ARMS)}),
bests AS (SELECT question_id, paper_id, min(distance) AS best FROM pairs GROUP BY question_id, paper_id),
side_rows AS (SELECT a.arm, s.question_id, s.paper_id, CASE WHEN s.scope_pos = 0 THEN 'answer' ELSE 'other' END AS side, count(k.id) AS kept, min(k.n) AS first, any_value(b.best) AS best
  FROM (SELECT unnest({SIDE_ARMS}) AS arm) a CROSS JOIN scope s LEFT JOIN placed k ON k.arm = a.arm AND k.question_id = s.question_id AND k.paper_id = s.paper_id LEFT JOIN bests b ON b.question_id = s.question_id AND b.paper_id = s.paper_id GROUP BY a.arm, s.question_id, s.paper_id, s.scope_pos)"""


def side_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of ev.sides() for two policies."""
    near = scoped(spark, sf)
    kept = None
    for name in SIDE_ARMS:
        found = arm(spark, sf, name, near).select(F.lit(name).alias("arm"), "question_id", "id", "paper_id", "n")
        kept = found if kept is None else kept.unionByName(found)
    scope = R.scope_of_two(questions(spark, sf)).select(F.explode(F.array(*map(F.lit, SIDE_ARMS))).alias("arm"), "question_id", "paper_id", "scope_pos")
    return ev.sides(kept, scope, near.groupBy("question_id", "paper_id").agg(F.min("distance").alias("best")))


@register(
    "slice_report",
    f"{SIDES_SQL} SELECT arm, side, count(*) AS n, round(avg(CASE WHEN kept > 0 THEN 1.0 ELSE 0.0 END), 9) AS represented, count(*) FILTER (WHERE kept = 0) AS shut_out, round(avg(kept), 9) AS mean_kept, max(kept) AS worst_kept, round(avg(first), 9) AS mean_first, count(*) FILTER (WHERE best >= {C.similarity_threshold} AND best < {C.intra_paper_ceiling}) AS in_band, round(max(best), 6) AS worst_best FROM side_rows GROUP BY GROUPING SETS ((arm, side), (arm), (side), ())",
)
def slice_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of two policies by policy, by side of the question and over all, with how many papers are so far off that the gates differ about them."""
    found = ev.slices(side_rows(spark, sf), C.similarity_threshold, C.intra_paper_ceiling)
    return found.withColumns({c: F.round(c, 9) for c in ("represented", "mean_kept", "mean_first")}).withColumn("worst_best", F.round("worst_best", 6))


@register("kept_by_paper", f"{SIDES_SQL} SELECT arm, question_id, CAST(sum(kept) AS BIGINT) AS kept, string_agg(paper_id || ':' || kept, ' ' ORDER BY paper_id) AS by_paper, min(CASE WHEN side = 'answer' THEN first END) AS answer_first, min(CASE WHEN side = 'other' THEN first END) AS other_first FROM side_rows GROUP BY arm, question_id")
def kept_by_paper(spark: SparkSession, sf: str) -> DataFrame:
    """What each question has kept of its papers, and the rank of each side's first chunk."""
    spelled = F.array_join(F.transform(F.map_entries("by_paper"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), " ")
    return ev.kept_maps(side_rows(spark, sf)).withColumn("by_paper", spelled)


@register("survival_regressions", f"{ARMS_SQL} SELECT b.question_id FROM outcome b JOIN outcome c ON c.question_id = b.question_id WHERE b.arm = '{ARMS[2]}' AND c.arm = '{ARMS[1]}' AND b.survived AND NOT c.survived")
def survival_regressions(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(arm_outcomes(spark, sf, [ARMS[2], ARMS[1]]), "outcomes")
    return ev.regressions(rows.where(F.col("arm") == ARMS[2]), rows.where(F.col("arm") == ARMS[1]), "question_id")


@register(
    "separation_point",
    f"WITH {POSITIVES_SQL}, {OFF_TOPIC_SQL}, b AS (SELECT (SELECT max(distance) FROM hits) AS lo, (SELECT min(distance) FROM bests) AS hi, (SELECT count(*) FROM hits) AS p, (SELECT count(*) FROM bests) AS n, (SELECT count(*) FROM bests WHERE distance < {C.similarity_threshold}) AS below) SELECT p AS positives, n AS negatives, round(CAST(1 AS DOUBLE) / (p + 1), 9) AS p_positive, round(CAST(1 AS DOUBLE) / (n + 1), 9) AS p_negative, round(CAST(below AS DOUBLE) / n, 9) AS acceptance, CASE WHEN round_even((lo + hi) / 2, 4) > lo AND round_even((lo + hi) / 2, 4) <= hi THEN round_even((lo + hi) / 2, 4) END AS recommended FROM b",
)
def separation_point(spark: SparkSession, sf: str) -> DataFrame:
    """How many cases stand behind the bounds, the chances that one more would break them, the share of off-topic questions that pass the gate, and the gate that would part both kinds."""
    p = hits(spark, sf).agg(F.count("*").alias("positives"), F.max("distance").alias("lo"))
    n = off_topic(spark, sf).agg(F.count("*").alias("negatives"), F.min("distance").alias("hi"), F.count_if(F.col("distance") < C.similarity_threshold).alias("below"))
    return p.crossJoin(n).select("positives", "negatives", F.round(1 / (F.col("positives") + 1), 9).alias("p_positive"), F.round(1 / (F.col("negatives") + 1), 9).alias("p_negative"), F.round(F.try_divide("below", "negatives"), 9).alias("acceptance"), ev.recommended(F.col("lo"), F.col("hi")).alias("recommended"))


@register(
    "metadata_verdicts",
    "WITH t AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.lang END AS truth, CASE WHEN l.toxic = 0 THEN (CASE WHEN d.n_chars > 1000 THEN d.lang ELSE 'en' END) END AS got FROM documents d JOIN labels l ON l.doc_id = d.doc_id), v AS (SELECT CASE WHEN truth IS NULL THEN (CASE WHEN got IS NULL THEN 'correct' ELSE 'hallucinated' END) WHEN got IS NULL THEN 'missed' WHEN truth = got THEN 'correct' ELSE 'wrong' END AS verdict FROM t) SELECT verdict, count(*) AS n FROM v GROUP BY verdict",
)
def metadata_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A stated field against what a guess from the text's length has found."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    truth, got = F.when(F.col("quality") == 1, F.col("lang")), F.when(F.col("toxic") == 0, F.when(F.col("n_chars") > 1000, F.col("lang")).otherwise("en"))
    return rows.select(ev.verdict(truth, got).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


#: A chunk answers a question of its own paper if both ids leave the same remainder, itself excluded.
ANSWER_EVERY = 7
TARGETED_SQL = f"""WITH {R.VECTORS_SQL}, off AS (SELECT question_id, own, qv, 'off_topic' AS kind FROM (SELECT vec_id AS question_id, label AS own, list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) AS qv FROM embeddings WHERE vec_id % 20 = 10)),
cases AS (SELECT question_id, own, qv, 'content' AS kind FROM questions UNION ALL SELECT * FROM off),
near AS MATERIALIZED (SELECT c.question_id, c.own, c.kind, k.id, k.paper_id, {distance_sql('k.v', 'c.qv')} AS distance FROM cases c CROSS JOIN chunks k WHERE k.id <> c.question_id),
scope AS (SELECT question_id, CASE WHEN any_value(kind) = 'content' THEN any_value(own) ELSE arg_min(paper_id, struct_pack(d := distance, i := id)) END AS paper_id FROM near GROUP BY question_id),
inside AS (SELECT n.*, n.kind = 'content' AND n.id % {ANSWER_EVERY} = n.question_id % {ANSWER_EVERY} AS sat, row_number() OVER (PARTITION BY n.question_id ORDER BY n.distance, n.id) AS pos, min(n.distance) OVER (PARTITION BY n.question_id) AS best FROM near n JOIN scope s ON s.question_id = n.question_id AND s.paper_id = n.paper_id),
judged AS (SELECT *, pos <= {K} AND distance < {C.intra_paper_ceiling} AND distance <= best + CAST({C.intra_paper_delta} AS DOUBLE) AS stays FROM inside)"""


def targeted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (question_id, kind, paper_chunks, kept, survived): each question held to one paper, its own or, off topic, the nearest."""
    corpus = vectors(spark, sf)
    own = questions(spark, sf).withColumn("kind", F.lit("content"))
    far = questions(spark, sf, rest=10, sign=-1).withColumn("kind", F.lit("off_topic"))
    first = nearest(corpus, far, 1, skip_self=True).select("question_id", "paper_id")
    asked = own.unionByName(far)
    scope = written(own.select("question_id", F.col("paper_id").cast("long").alias("paper_id")).unionByName(first), "scope")
    found = nearest(corpus, asked.select("question_id", "embedding"), K, gate=C.intra_paper_ceiling, scope=scope, skip_self=True)
    best = found.groupBy("question_id").agg(F.min("distance").alias("best"))
    stays = found.join(best, "question_id").where(F.col("distance") <= F.col("best") + C.intra_paper_delta)
    kept = stays.groupBy("question_id").agg(F.count("*").alias("kept"), F.max(F.col("id") % ANSWER_EVERY == F.col("question_id") % ANSWER_EVERY).alias("hit"))
    # every chunk of the paper is counted at a distance of more than any two vectors have
    sizes = counts_below(corpus, asked.select("question_id", "embedding"), [3.0], scope=scope, skip_self=True).select("question_id", F.col("n").alias("paper_chunks"))
    rows = asked.select("question_id", "kind").join(sizes, "question_id", "left").join(kept, "question_id", "left")
    survived = F.when(F.col("kind") == "content", F.coalesce("hit", F.lit(False)))
    return rows.select("question_id", "kind", F.coalesce("paper_chunks", F.lit(0)).cast("long").alias("paper_chunks"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), survived.alias("survived"))


@register("targeted_rows", f"{TARGETED_SQL} SELECT question_id, any_value(kind) AS kind, count(*) AS paper_chunks, count(*) FILTER (WHERE stays) AS kept, CASE WHEN any_value(kind) = 'content' THEN coalesce(bool_or(sat AND stays), false) END AS survived FROM judged GROUP BY question_id")
def targeted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return targeted(spark, sf)


@register(
    "targeted_report",
    f"{TARGETED_SQL}, r AS (SELECT question_id, any_value(kind) AS kind, count(*) FILTER (WHERE stays) AS kept, bool_or(sat AND stays) AS hit FROM judged GROUP BY question_id) SELECT round(avg(CASE WHEN kind = 'content' THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END), 9) AS survival, round(avg(CASE WHEN kind = 'content' THEN kept END), 9) AS mean_kept, max(CASE WHEN kind = 'off_topic' THEN kept END) AS worst_off_topic FROM r",
)
def targeted_report(spark: SparkSession, sf: str) -> DataFrame:
    """Survival and kept chunks of questions held to their paper, and the most that an off-topic one keeps."""
    content, off = F.col("kind") == "content", F.col("kind") == "off_topic"
    return targeted(spark, sf).agg(F.round(F.avg(F.col("survived").cast("double")), 9).alias("survival"), F.round(F.avg(F.when(content, F.col("kept"))), 9).alias("mean_kept"), F.max(F.when(off, F.col("kept"))).alias("worst_off_topic"))
