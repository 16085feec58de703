"""Queries of hybrid retrieval. The query set is every twentieth vector, against all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.bindings import CHUNKS_SQL, DISTANCES_SQL, PAPERS_SQL, TERMS_SQL, VECTORS_SQL, chunks, papers, questions, table, vectors
from brindle.config import CONFIG as C
from brindle.functions.pivots import nearest_pruned
from brindle.functions.vector import counts_below, nearest
from brindle.operators import lexical, ranking, websearch
from brindle.plans.indexes import asked_terms, text_index, vector_cells
from brindle.registry import register
from brindle.store import in_order

PAPERS_IN_ALL = 10


def scope_of_two(asked: DataFrame) -> DataFrame:
    """A question names its own paper and the one after it."""
    named = F.array(F.struct(F.lit(0).alias("scope_pos"), F.col("paper_id").cast("long").alias("paper_id")), F.struct(F.lit(1).alias("scope_pos"), ((F.col("paper_id") + 1) % PAPERS_IN_ALL).cast("long").alias("paper_id")))
    return asked.select("question_id", F.inline(named))


def scope_of_one(asked: DataFrame) -> DataFrame:
    return asked.select("question_id", F.col("paper_id").cast("long").alias("paper_id"))


TWO_SQL = f"scope AS (SELECT question_id, 0 AS scope_pos, own AS paper_id FROM questions UNION ALL SELECT question_id, 1, (own + 1) % {PAPERS_IN_ALL} FROM questions)"


def dense_sql(gate: float = C.similarity_threshold, keep: int = C.hybrid_dense_pool, name: str = "dense", where: str = "true") -> str:
    return f"{name} AS (SELECT question_id, own, id, paper_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS d_rank FROM pairs p WHERE distance < {gate} AND {where} QUALIFY d_rank <= {keep})"


def hits_sql(need: str = "n = asked") -> str:
    return f"""{TERMS_SQL}, tokens AS MATERIALIZED (SELECT id, paper_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM chunks),
hits AS (SELECT t.question_id, k.id, k.paper_id, count(*) AS tf, count(DISTINCT t.term) AS n FROM tokens k JOIN terms t ON t.term = k.term GROUP BY t.question_id, k.id, k.paper_id),
asked AS (SELECT question_id, count(*) AS asked FROM terms GROUP BY question_id),
matched AS (SELECT h.question_id, h.id, h.paper_id, h.tf FROM hits h JOIN asked a ON a.question_id = h.question_id WHERE {need})"""


def sparse_sql(where: str = "true") -> str:
    return f"sparse AS (SELECT question_id, id, paper_id, tf, row_number() OVER (PARTITION BY question_id ORDER BY tf DESC, id) AS s_rank FROM matched p WHERE {where} QUALIFY s_rank <= {C.hybrid_sparse_pool})"


FUSED_SQL = f"""fused AS (SELECT coalesce(d.question_id, s.question_id) AS question_id, coalesce(d.id, s.id) AS id, coalesce(d.paper_id, s.paper_id) AS paper_id, d.distance, d.d_rank, s.s_rank,
  coalesce(CAST({C.hybrid_dense_weight} AS DOUBLE) / ({C.hybrid_rrf_k} + d.d_rank), 0) + coalesce(CAST({C.hybrid_sparse_weight} AS DOUBLE) / ({C.hybrid_rrf_k} + s.s_rank), 0) AS score
  FROM dense d FULL OUTER JOIN sparse s ON s.id = d.id AND s.question_id = d.question_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coalesce(d_rank, {2**62}), coalesce(s_rank, {2**62}), id) AS pos FROM fused)"""
IN_SCOPE = "EXISTS (SELECT 1 FROM scope s WHERE s.question_id = p.question_id AND s.paper_id = p.paper_id)"
HYBRID_SQL = f"WITH {DISTANCES_SQL}, {hits_sql()}, {dense_sql()}, {sparse_sql()}, {FUSED_SQL}"
#: Hybrid candidates of two named papers, with their guaranteed chunks behind.
CANDIDATES_SQL = f"""WITH {DISTANCES_SQL}, {TWO_SQL}, {hits_sql()}, {dense_sql(where=IN_SCOPE)}, {sparse_sql(IN_SCOPE)}, {FUSED_SQL},
ranked AS (SELECT question_id, id, paper_id, distance, pos FROM ordered WHERE pos <= {C.max_context_chunks}),
own AS (SELECT question_id, id, paper_id, distance, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY distance, id) AS r FROM pairs p WHERE distance < {C.similarity_threshold} AND {IN_SCOPE} QUALIFY r <= {C.mention_per_paper_floor}),
both_parts AS (SELECT question_id, id, paper_id, distance, 0 AS block, pos AS a, CAST(NULL AS DOUBLE) AS b FROM ranked UNION ALL
  SELECT question_id, id, paper_id, distance, 1, r, distance FROM own o WHERE NOT EXISTS (SELECT 1 FROM ranked k WHERE k.question_id = o.question_id AND k.id = o.id)),
candidates AS (SELECT question_id, id, paper_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY block, a, b, id) AS pos FROM both_parts)"""


def floor_sql(budget: str, source: str = "candidates", name: str = "floored") -> str:
    return f"""{name}_r AS (SELECT c.*, s.scope_pos, row_number() OVER (PARTITION BY c.question_id, c.paper_id ORDER BY c.pos) AS r FROM {source} c LEFT JOIN scope s ON s.question_id = c.question_id AND s.paper_id = c.paper_id),
{name}_p AS (SELECT *, scope_pos IS NOT NULL AND r <= {C.mention_per_paper_floor} AS pinned FROM {name}_r),
{name} AS (SELECT question_id, id, paper_id, distance, pinned, row_number() OVER (PARTITION BY question_id ORDER BY pinned DESC, CASE WHEN pinned THEN r END, CASE WHEN pinned THEN scope_pos END, pos) AS n FROM {name}_p QUALIFY n <= {budget})"""


@register("dense_topk", f"WITH {VECTORS_SQL}, {dense_sql()} SELECT question_id, id, paper_id, round(distance, 6) AS distance, d_rank FROM dense")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = nearest(vectors(spark, sf), questions(spark, sf), C.hybrid_dense_pool, gate=C.similarity_threshold)
    return found.select("question_id", "id", F.col("paper_id").cast("int"), F.round("distance", 6).alias("distance"), "d_rank")


@register("dense_topk_pruned", f"WITH {VECTORS_SQL}, {dense_sql(keep=C.max_context_chunks)} SELECT question_id, id, paper_id, round(distance, 6) AS distance, d_rank FROM dense")
def dense_topk_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over cells: those that cannot hold a result are not read."""
    found = nearest_pruned(vector_cells(spark, sf), questions(spark, sf), C.max_context_chunks, gate=C.similarity_threshold)
    return found.select("question_id", "id", F.col("paper_id").cast("int"), F.round("distance", 6).alias("distance"), "d_rank")


@register("dense_gate_count", f"WITH {VECTORS_SQL}, gates AS (SELECT unnest([CAST({C.similarity_threshold} AS DOUBLE), CAST({C.intra_paper_ceiling} AS DOUBLE)]) AS gate) SELECT question_id, gate, count(*) FILTER (WHERE distance < gate) AS n FROM pairs CROSS JOIN gates GROUP BY question_id, gate")
def dense_gate_count(spark: SparkSession, sf: str) -> DataFrame:
    return counts_below(vectors(spark, sf), questions(spark, sf), [C.similarity_threshold, C.intra_paper_ceiling])


@register("dense_guarantee_per_group", f"WITH {VECTORS_SQL}, g AS (SELECT question_id, id, paper_id, distance, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY distance, id) AS p_rank FROM pairs WHERE distance < {C.similarity_threshold} QUALIFY p_rank <= {C.mention_per_paper_floor}) SELECT question_id, id, paper_id, round(distance, 6) AS distance, p_rank FROM g")
def dense_guarantee_per_group(spark: SparkSession, sf: str) -> DataFrame:
    found = nearest(vectors(spark, sf), questions(spark, sf), C.mention_per_paper_floor, gate=C.similarity_threshold, by_group=True)
    return found.select("question_id", "id", F.col("paper_id").cast("int"), F.round("distance", 6).alias("distance"), F.col("d_rank").alias("p_rank"))


@register("sparse_and_topk", f"WITH {CHUNKS_SQL}, questions AS (SELECT vec_id AS question_id FROM embeddings WHERE vec_id % 20 = 0), {hits_sql()}, {sparse_sql()} SELECT question_id, id, tf, s_rank FROM sparse")
def sparse_and_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.best(text_index(spark, sf), asked_terms(spark, sf), C.hybrid_sparse_pool).select("question_id", "id", "tf", "s_rank")


@register("sparse_or_topk", f"WITH {CHUNKS_SQL}, questions AS (SELECT vec_id AS question_id FROM embeddings WHERE vec_id % 20 = 0), {hits_sql('n > 0')}, {sparse_sql()} SELECT question_id, id, tf, s_rank FROM sparse")
def sparse_or_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.best(text_index(spark, sf), asked_terms(spark, sf), C.hybrid_sparse_pool, mode="any").select("question_id", "id", "tf", "s_rank")


#: What people type, by the question's number: words, a phrase, alternatives, a refused word, a refused phrase, stop words alone.
TYPED = (
    "w[1] || ' ' || w[2]",
    "'\"' || w[2] || ' ' || w[3] || '\"'",
    "w[1] || ' or ' || w[2] || ' ' || w[3] || ' OR \"' || w[3] || ' the ' || w[4]",
    "w[1] || ' -' || w[2]",
    "w[2] || ' -\"' || w[3] || ' ' || w[4] || '\" ' || w[5] || '-' || w[6]",
    "'the of \"to a\" or -and'",
)


def typed_questions(spark: SparkSession, sf: str) -> DataFrame:
    """question_id, text: each stated question typed in one of the ways of TYPED, from the title of the document with its id."""
    titles = papers(spark, sf).select(F.col("paper_id").alias("question_id"), F.split(F.replace("title", F.lit('"'), F.lit("")), " ").alias("w"))
    asked = questions(spark, sf).select("question_id").join(titles, "question_id")
    word = lambda sql: "".join(f"get(w, {int(x[0]) - 1}){x[1:]}" if i else x for i, x in enumerate(sql.replace("w[", "\0").replace("]", "").split("\0")))
    ways = F.array(*[F.expr(word(sql)) for sql in TYPED])
    return asked.select("question_id", F.get(ways, (F.floor(F.col("question_id") / 20) % len(TYPED)).cast("int")).alias("text"))


TYPED_SQL = f"""{PAPERS_SQL}, typed AS (SELECT question_id, CASE CAST(question_id // 20 AS INTEGER) % {len(TYPED)} {' '.join(f'WHEN {i} THEN {sql}' for i, sql in enumerate(TYPED))} END AS text FROM (SELECT q.question_id, string_split(replace(p.title, '"', ''), ' ') AS w FROM questions q JOIN papers p ON p.paper_id = q.question_id)),
pieces AS MATERIALIZED (SELECT question_id, unnest(l) AS piece, unnest(range(len(l))) AS seq FROM (SELECT question_id, regexp_extract_all(text, '{websearch.PIECE}') AS l FROM typed)),
parted AS (SELECT *, count(*) FILTER (WHERE lower(piece) = 'or') OVER (PARTITION BY question_id ORDER BY seq) AS part, list_filter(regexp_split_to_array(lower(piece), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM pieces),
said AS MATERIALIZED (SELECT question_id, part, seq, piece LIKE '-%' AS no, unnest(ts) AS term, unnest(range(len(ts))) AS place FROM parted),
words AS (SELECT * FROM said WHERE term NOT IN ({', '.join(f"'{x}'" for x in websearch.STOP_WORDS)})),
placed AS (SELECT *, count(*) OVER (PARTITION BY question_id, seq) AS n, place - min(place) OVER (PARTITION BY question_id, seq) AS off FROM words),
firsts AS (SELECT question_id, min(seq) AS seq FROM (SELECT question_id, part, seq, no, string_agg(term || ' ' || off, ' ' ORDER BY off) AS atom FROM placed GROUP BY ALL) GROUP BY question_id, part, no, atom),
need AS MATERIALIZED (SELECT question_id, part, seq, no, n, off, hash(term) AS h FROM placed p WHERE EXISTS (SELECT 1 FROM firsts f WHERE f.question_id = p.question_id AND f.seq = p.seq)),
toks AS MATERIALIZED (SELECT id, paper_id, hash(term) AS h, place FROM (SELECT id, paper_id, unnest(ts) AS term, unnest(range(len(ts))) AS place FROM (SELECT id, paper_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM chunks))),
met AS MATERIALIZED (SELECT n.question_id, n.part, n.seq, n.no, n.n, t.id, t.paper_id, t.place - n.off AS start FROM toks t JOIN need n ON n.h = t.h),
runs AS (SELECT question_id, part, seq, no, id, paper_id, start FROM met GROUP BY ALL HAVING count(*) = any_value(n)),
atoms AS (SELECT question_id, part, seq, no, id, paper_id, count(*) AS tf FROM runs GROUP BY ALL),
wanted AS (SELECT question_id, part, count(DISTINCT seq) FILTER (WHERE NOT no) AS asked FROM need GROUP BY ALL),
parts AS (SELECT a.question_id, a.part, a.id, a.paper_id, sum(a.tf) AS tf FROM atoms a JOIN wanted w ON w.question_id = a.question_id AND w.part = a.part GROUP BY ALL HAVING NOT bool_or(a.no) AND count(*) = any_value(w.asked)),
matched AS (SELECT question_id, id, paper_id, CAST(max(tf) AS BIGINT) AS tf FROM parts GROUP BY ALL)"""


@register("websearch_topk", f"WITH {CHUNKS_SQL}, questions AS (SELECT vec_id AS question_id FROM embeddings WHERE vec_id % 20 = 0), {TYPED_SQL}, {sparse_sql()} SELECT question_id, id, tf, s_rank FROM sparse")
def websearch_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Typed questions with phrases, alternatives and refusals."""
    found = websearch.best(text_index(spark, sf), typed_questions(spark, sf), C.hybrid_sparse_pool)
    return found.select("question_id", "id", "tf", "s_rank")


@register("websearch_stems_topk")
def websearch_stems_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Typed questions by English stems: a word finds all tokens with its stem. Held against a plain search in the tests."""
    found = websearch.best(text_index(spark, sf), typed_questions(spark, sf), C.hybrid_sparse_pool, stems=True)
    return found.select("question_id", "id", "tf", "s_rank")


@register("hybrid_typed")
def hybrid_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search whose lexical arm takes questions as they are typed, by stems. Held against a plain search in the tests."""
    found = ranking.retrieve(chunks(spark, sf), questions(spark, sf), texts=text_index(spark, sf), typed=typed_questions(spark, sf))
    return _shown(found, "d_rank", "s_rank", F.round("score", 9).alias("score"))


@register("vocabulary_stems")
def vocabulary_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stems of the corpus: how many tokens share each, and in how many chunks its most frequent token stands."""
    return text_index(spark, sf).vocabulary.groupBy("stem").agg(F.count("*").alias("tokens"), F.max("chunks").alias("most"))


@register("sparse_cover_density")
def sparse_cover_density(spark: SparkSession, sf: str) -> DataFrame:
    """Held against a brute-force count of covers in the tests."""
    return lexical.best_covers(text_index(spark, sf), asked_terms(spark, sf), C.hybrid_sparse_pool).select("question_id", "id", F.round("score", 9).alias("score"), "s_rank")


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    dense = nearest(chunks(spark, sf), questions(spark, sf), C.hybrid_dense_pool, gate=C.similarity_threshold)
    return ranking.fuse(dense, lexical.best(text_index(spark, sf), asked_terms(spark, sf), C.hybrid_sparse_pool))


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("question_id", F.col("pos").alias("n"), F.col("id").alias("chunk_id"), F.col("paper_id").cast("int"), *columns)


@register("hybrid_fuse", f"{HYBRID_SQL} SELECT question_id, pos AS n, id AS chunk_id, paper_id, d_rank, s_rank, round(score, 9) AS score FROM ordered WHERE pos <= {C.max_context_chunks}")
def hybrid_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_arms(spark, sf).where(F.col("pos") <= C.max_context_chunks), "d_rank", "s_rank", F.round("score", 9).alias("score"))


@register("hybrid_full_outer_arms", f"{HYBRID_SQL} SELECT question_id, id, d_rank, s_rank, round(distance, 6) AS distance FROM fused")
def hybrid_full_outer_arms(spark: SparkSession, sf: str) -> DataFrame:
    return _arms(spark, sf).select("question_id", "id", "d_rank", "s_rank", F.round("distance", 6).alias("distance"))


@register("hybrid_global_budget", f"{HYBRID_SQL}, papers_kept AS (SELECT question_id, paper_id, count(*) AS kept FROM ordered WHERE pos <= {C.max_context_chunks} GROUP BY question_id, paper_id) SELECT question_id, CAST(sum(kept) AS BIGINT) AS kept, count(*) AS papers, max(kept) AS most FROM papers_kept GROUP BY question_id")
def hybrid_global_budget(spark: SparkSession, sf: str) -> DataFrame:
    kept = ranking.retrieve(chunks(spark, sf), questions(spark, sf), asked_terms(spark, sf), texts=text_index(spark, sf)).groupBy("question_id", "paper_id").agg(F.count("*").alias("kept"))
    return kept.groupBy("question_id").agg(F.sum("kept").alias("kept"), F.count("*").alias("papers"), F.max("kept").alias("most"))


ONE_SQL = "scope AS (SELECT question_id, own AS paper_id FROM questions)"


@register("hybrid_single_paper_window", f"WITH {DISTANCES_SQL}, {ONE_SQL}, {hits_sql()}, {dense_sql(C.intra_paper_ceiling, where=IN_SCOPE)}, {sparse_sql(IN_SCOPE)}, {FUSED_SQL} SELECT question_id, pos AS n, id AS chunk_id, paper_id, round(score, 9) AS score FROM ordered WHERE pos <= {min(C.max_context_chunks, C.intra_paper_rank_window)}")
def hybrid_single_paper_window(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    return _shown(ranking.retrieve(chunks(spark, sf), asked, asked_terms(spark, sf), scope_of_one(asked), texts=text_index(spark, sf)), F.round("score", 9).alias("score"))


@register(
    "dense_single_paper_delta",
    f"WITH {VECTORS_SQL}, {ONE_SQL}, {dense_sql(C.intra_paper_ceiling, C.max_context_chunks, where=IN_SCOPE)}, firsts AS (SELECT question_id, min(distance) AS best FROM dense GROUP BY question_id) SELECT d.question_id, d.d_rank AS n, d.id AS chunk_id, d.paper_id, round(d.distance, 6) AS distance FROM dense d JOIN firsts f ON f.question_id = d.question_id WHERE d.distance <= f.best + CAST({C.intra_paper_delta} AS DOUBLE)",
)
def dense_single_paper_delta(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    return _shown(ranking.retrieve(vectors(spark, sf), asked, scope=scope_of_one(asked)), F.round("distance", 6).alias("distance"))


def candidates(spark: SparkSession, sf: str, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    asked = questions(spark, sf)
    scope = scope_of_two(asked)
    return ranking.retrieve(chunks(spark, sf), asked, asked_terms(spark, sf), scope, guarantee=C.mention_per_paper_floor, near=near, texts=text_index(spark, sf)), scope


@register("guaranteed_tail_union", f"{CANDIDATES_SQL} SELECT question_id, pos AS n, id AS chunk_id, paper_id FROM candidates")
def guaranteed_tail_union(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(candidates(spark, sf)[0])


@register("mention_floor_round_robin", f"{CANDIDATES_SQL}, {floor_sql(str(C.max_context_chunks))} SELECT question_id, n, id AS chunk_id, paper_id, pinned FROM floored")
def mention_floor_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    found, scope = candidates(spark, sf)
    return ranking.floor(found, scope).select("question_id", "n", F.col("id").alias("chunk_id"), F.col("paper_id").cast("int"), "pinned")


WIDENED_SQL = f"""{CANDIDATES_SQL}, {floor_sql(str(min(2 * C.mention_per_paper_floor, C.max_context_chunks)))},
everywhere AS (SELECT question_id, id, paper_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS d_rank FROM pairs WHERE distance < {C.similarity_threshold} QUALIFY d_rank <= {C.hybrid_dense_pool}),
anywhere AS (SELECT question_id, id, paper_id, row_number() OVER (PARTITION BY question_id ORDER BY tf DESC, id) AS s_rank FROM matched QUALIFY s_rank <= {C.hybrid_sparse_pool}),
filling AS (SELECT coalesce(d.question_id, s.question_id) AS question_id, coalesce(d.id, s.id) AS id, coalesce(d.paper_id, s.paper_id) AS paper_id, d.d_rank, s.s_rank,
  coalesce(CAST({C.hybrid_dense_weight} AS DOUBLE) / ({C.hybrid_rrf_k} + d.d_rank), 0) + coalesce(CAST({C.hybrid_sparse_weight} AS DOUBLE) / ({C.hybrid_rrf_k} + s.s_rank), 0) AS score
  FROM everywhere d FULL OUTER JOIN anywhere s ON s.id = d.id AND s.question_id = d.question_id),
filled AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coalesce(d_rank, {2**62}), coalesce(s_rank, {2**62}), id) AS pos FROM filling),
parts AS (SELECT question_id, id, paper_id, 0 AS block, n AS a FROM floored UNION ALL
  SELECT question_id, id, paper_id, 1, pos FROM filled f WHERE pos <= {C.max_context_chunks + 2 * C.mention_per_paper_floor} AND NOT EXISTS (SELECT 1 FROM floored k WHERE k.question_id = f.question_id AND k.id = f.id)),
shown AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY block, a) AS n FROM parts QUALIFY n <= {C.max_context_chunks})"""


@register("mention_widened_fill", f"{WIDENED_SQL} SELECT h.question_id, h.n, h.id AS chunk_id, h.paper_id, h.block = 1 AS fill, NOT EXISTS (SELECT 1 FROM scope s WHERE s.question_id = h.question_id AND s.paper_id = h.paper_id) AS outside FROM shown h")
def mention_widened_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A turn is widened where a row from outside the scope has landed; the pool for filling has room for all pinned rows."""
    found, scope = candidates(spark, sf)
    pinned = ranking.floor(found, scope, budget=min(2 * C.mention_per_paper_floor, C.max_context_chunks))
    fill = ranking.retrieve(chunks(spark, sf), questions(spark, sf), asked_terms(spark, sf), pool=C.max_context_chunks + 2 * C.mention_per_paper_floor, texts=text_index(spark, sf))
    rows = ranking.widened(pinned, fill).join(scope.select("question_id", "paper_id", F.lit(False).alias("out")), ["question_id", "paper_id"], "left")
    return rows.select("question_id", "n", F.col("id").alias("chunk_id"), F.col("paper_id").cast("int"), "fill", F.coalesce("out", F.lit(True)).alias("outside"))


@register("empty_mentions", f"{CANDIDATES_SQL} SELECT s.question_id, s.paper_id FROM scope s WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.question_id = s.question_id AND c.paper_id = s.paper_id)")
def empty_mentions(spark: SparkSession, sf: str) -> DataFrame:
    found, scope = candidates(spark, sf)
    return scope.join(found, ["question_id", "paper_id"], "left_anti").select("question_id", F.col("paper_id").cast("int"))


MESSAGES_SQL = "messages AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS message_id, conv_id, turn, role, text FROM conversations)"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages numbered from 0 over all conversations."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return in_order(rows, ["conv_id", "turn", "role", "text"], "message_id")


@register(
    "history_topk",
    f"WITH {MESSAGES_SQL}, near AS (SELECT q.vec_id AS question_id, m.conv_id, m.message_id, m.role, round(greatest(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0), 9) AS distance FROM messages m JOIN embeddings e ON e.vec_id = m.message_id CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q) SELECT question_id, conv_id, message_id, role, round(distance, 6) AS distance, row_number() OVER (PARTITION BY question_id, conv_id ORDER BY distance, message_id) AS n FROM near WHERE distance < {C.similarity_threshold} QUALIFY n <= {C.history_top_k}",
)
def history_topk(spark: SparkSession, sf: str) -> DataFrame:
    """For every question and conversation, the messages nearest to the question."""
    told = messages(spark, sf).select(F.col("message_id").alias("id"), F.col("conv_id").alias("paper_id"), "role")
    rows = told.join(vectors(spark, sf).select("id", "embedding"), "id")
    near = nearest(rows, questions(spark, sf), C.history_top_k, gate=C.similarity_threshold, by_group=True)
    shown = near.join(told.select("id", "role"), "id")
    return shown.select("question_id", F.col("paper_id").alias("conv_id"), F.col("id").alias("message_id"), "role", F.round("distance", 6).alias("distance"), F.col("d_rank").alias("n"))


@register("renumbered_context", f"{HYBRID_SQL}, {PAPERS_SQL.replace('papers AS', 'titled AS')} SELECT o.question_id, o.pos AS n, o.id AS chunk_id, coalesce(t.title, '') AS title, left(c.text, {C.snippet_chars}) AS snippet FROM ordered o JOIN chunks c ON c.id = o.id LEFT JOIN titled t ON t.paper_id = o.id WHERE o.pos <= {C.max_context_chunks}")
def renumbered_context(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked rows with title and snippet: the text is fetched for the rows that are shown only."""
    rows = _arms(spark, sf).where(F.col("pos") <= C.max_context_chunks).select("question_id", F.col("pos").alias("n"), F.col("id").alias("chunk_id"))
    shown = papers(spark, sf).select(F.col("paper_id").alias("chunk_id"), "title", F.left("body", F.lit(C.snippet_chars)).alias("snippet"))
    return rows.join(shown, "chunk_id").select("question_id", "n", "chunk_id", F.coalesce("title", F.lit("")).alias("title"), "snippet")


@register("group_best_distance", f"WITH {VECTORS_SQL} SELECT question_id, paper_id, round(min(distance), 6) AS best, row_number() OVER (PARTITION BY question_id ORDER BY min(distance), paper_id) AS pos FROM pairs GROUP BY question_id, paper_id")
def group_best_distance(spark: SparkSession, sf: str) -> DataFrame:
    best = nearest(vectors(spark, sf), questions(spark, sf), 1, by_group=True)
    order = Window.partitionBy("question_id").orderBy("distance", "paper_id")
    return best.select("question_id", F.col("paper_id").cast("int"), F.round("distance", 6).alias("best"), F.row_number().over(order).cast("long").alias("pos"))


@register("group_band_counts", f"WITH {VECTORS_SQL}, best AS (SELECT question_id, paper_id, min(distance) AS d FROM pairs GROUP BY question_id, paper_id) SELECT question_id, count(*) FILTER (WHERE d >= {C.similarity_threshold} AND d < {C.intra_paper_ceiling}) AS in_band, count(*) FILTER (WHERE d < {C.similarity_threshold}) AS admitted FROM best GROUP BY question_id")
def group_band_counts(spark: SparkSession, sf: str) -> DataFrame:
    best = nearest(vectors(spark, sf), questions(spark, sf), 1, by_group=True)
    d = F.col("distance")
    return best.groupBy("question_id").agg(F.count_if((d >= C.similarity_threshold) & (d < C.intra_paper_ceiling)).alias("in_band"), F.count_if(d < C.similarity_threshold).alias("admitted"))


@register(
    "nearest_other_pair",
    f"WITH {VECTORS_SQL}, best AS (SELECT question_id, own, paper_id, min(distance) AS d FROM pairs WHERE paper_id <> own GROUP BY question_id, own, paper_id), a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, paper_id) AS r, row_number() OVER (PARTITION BY question_id ORDER BY md5(concat('7:', question_id, ':', paper_id)), paper_id) AS s FROM best) SELECT question_id, own, max(paper_id) FILTER (WHERE r = 1) AS nearest_other, max(paper_id) FILTER (WHERE s = 1) AS seeded_other FROM a GROUP BY question_id, own",
)
def nearest_other_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Partner papers of a question: the nearest other one, and one drawn by a hash of seed, question and paper."""
    best = nearest(vectors(spark, sf), questions(spark, sf), 1, by_group=True).join(questions(spark, sf).select("question_id", F.col("paper_id").alias("own")), "question_id").where("paper_id <> own")
    drawn = F.md5(F.concat_ws(":", F.lit("7"), "question_id", "paper_id").cast("binary"))
    return best.groupBy("question_id", "own").agg(F.min(F.struct("distance", "paper_id"))["paper_id"].cast("int").alias("nearest_other"), F.min(F.struct(drawn.alias("h"), "paper_id"))["paper_id"].cast("int").alias("seeded_other"))


@register("round_robin_merge", f"WITH {VECTORS_SQL}, lists AS (SELECT question_id, id, paper_id, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY distance, id) AS r FROM pairs WHERE distance < {C.intra_paper_ceiling} QUALIFY r <= {C.mention_per_paper_floor}) SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY r, paper_id) AS n FROM lists")
def round_robin_merge(spark: SparkSession, sf: str) -> DataFrame:
    lists = nearest(vectors(spark, sf), questions(spark, sf), C.mention_per_paper_floor, gate=C.intra_paper_ceiling, by_group=True)
    order = Window.partitionBy("question_id").orderBy("d_rank", "paper_id")
    return lists.select("question_id", "id", F.row_number().over(order).cast("long").alias("n"))


@register("nearest_paper_scope", f"WITH {VECTORS_SQL}, first AS (SELECT question_id, paper_id FROM pairs QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY distance, id) = 1) SELECT p.question_id, p.id, p.paper_id, row_number() OVER (PARTITION BY p.question_id ORDER BY p.distance, p.id) AS n FROM pairs p JOIN first f ON f.question_id = p.question_id AND f.paper_id = p.paper_id WHERE p.distance < {C.intra_paper_ceiling} QUALIFY n <= {C.intra_paper_rank_window}")
def nearest_paper_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows of the paper that owns the nearest row of all."""
    asked = questions(spark, sf)
    owner = nearest(vectors(spark, sf), asked, 1).select("question_id", "paper_id")
    found = nearest(vectors(spark, sf), asked, C.intra_paper_rank_window, gate=C.intra_paper_ceiling, scope=owner)
    return found.select("question_id", "id", F.col("paper_id").cast("int"), F.col("d_rank").alias("n"))


TITLE_NEEDLE = "The A"


@register(
    "title_scope",
    f"WITH {DISTANCES_SQL}, {PAPERS_SQL}, scoped AS (SELECT p.question_id, p.id, p.distance FROM pairs p JOIN papers t ON t.paper_id = p.id WHERE contains(lower(t.title), lower('{TITLE_NEEDLE}')) AND p.distance < {C.intra_paper_ceiling}) SELECT question_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS n FROM scoped QUALIFY n <= {C.max_context_chunks}",
)
def title_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Only chunks of documents whose title holds the needle, case aside, nearest first: the scope is cut before anything is searched."""
    named = papers(spark, sf).where(F.contains(F.lower("title"), F.lit(TITLE_NEEDLE.lower()))).select(F.col("paper_id").alias("id"))
    rows = vectors(spark, sf).join(named, "id", "left_semi")
    found = nearest(rows, questions(spark, sf), C.max_context_chunks, gate=C.intra_paper_ceiling)
    return found.select("question_id", "id", F.round("distance", 6).alias("distance"), F.col("d_rank").alias("n"))


@register("space_topk", f"WITH {VECTORS_SQL} SELECT question_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS n FROM pairs WHERE id % 2 = question_id % 4 // 2 QUALIFY n <= {C.history_top_k}")
def space_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of two models (even and odd ids) are never compared with each other: a question is asked in the space of its own model."""
    models = vectors(spark, sf).select("id", (F.col("id") % 2).alias("paper_id"), "embedding")
    asked = questions(spark, sf)
    found = nearest(models, asked, C.history_top_k, scope=asked.select("question_id", F.floor(F.col("question_id") % 4 / 2).alias("paper_id")))
    return found.select("question_id", "id", F.round("distance", 6).alias("distance"), F.col("d_rank").alias("n"))
