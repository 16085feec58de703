"""The engine's tables as views of the test tables, in Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.store import hinted

#: Words of a document that serve as its title.
TITLE_WORDS = 12
#: Rows (id, paper_id) of chunks that are broadcast at most, so that texts are not shuffled.
IDS_AT_ONCE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """Runs of anything but white space, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("project_id"), F.array_join(F.slice(words(F.col("text")), 1, TITLE_WORDS), " ").alias("title"), F.col("text").alias("body"), "lang")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, paper_id, embedding of every chunk: for searches that need no text, so nothing is joined."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("paper_id"), "embedding")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, paper_id, embedding, project_id and text of the chunks that have a text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"), "text")
    return vectors(spark, sf_dir).join(docs, "id")


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, paper_id and text of the same chunks: what is joined with the texts is a few bytes a row."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(hinted(vectors(spark, sf_dir).select("id", "paper_id"), IDS_AT_ONCE), "id").select("id", "paper_id", "text")


def questions(spark: SparkSession, sf_dir: str, rest: int = 0, sign: int = 1) -> DataFrame:
    """question_id, paper_id, embedding: the stated query set is every twentieth vector; negated ones serve as off-topic questions."""
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == rest)
    turned = F.col("embedding") if sign > 0 else F.transform("embedding", lambda x: -x)
    return asked.select(F.col("vec_id").alias("question_id"), F.col("label").alias("paper_id"), turned.alias("embedding"))


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, term: the first two tokens of four letters or more of the title of the document with the question's id."""
    titles = papers(spark, sf_dir).where(F.col("paper_id") % 20 == 0).select(F.col("paper_id").alias("question_id"), "title")
    asked = questions(spark, sf_dir).select("question_id").join(titles, "question_id")
    tokens = F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda x: F.length(x) >= 4)
    return asked.select("question_id", F.explode(F.slice(tokens, 1, 2)).alias("term")).distinct()


WORDS_SQL = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"
PAPERS_SQL = f"papers AS (SELECT doc_id AS paper_id, source AS project_id, array_to_string({WORDS_SQL.format('text')}[1:{TITLE_WORDS}], ' ') AS title, text AS body, lang FROM documents)"
CHUNKS_SQL = "chunks AS (SELECT e.vec_id AS id, e.label AS paper_id, d.source AS project_id, d.text, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"
QUESTIONS_SQL = "questions AS (SELECT vec_id AS question_id, label AS own, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0)"
NEGATIVES_SQL = "negatives AS (SELECT vec_id AS question_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) AS qv FROM embeddings WHERE vec_id % 20 = 10)"
TERMS_SQL = f"{PAPERS_SQL}, terms AS MATERIALIZED (SELECT DISTINCT q.question_id, unnest(list_filter(regexp_split_to_array(lower(p.title), '[^a-z0-9]+'), lambda x: len(x) >= 4)[1:2]) AS term FROM questions q JOIN papers p ON p.paper_id = q.question_id)"


def distance_sql(a: str, b: str) -> str:
    return f"round(greatest(list_cosine_distance({a}, {b}), 0), 9)"


#: Every pair of question and chunk; a fresh vector search would keep the nearest only. Without texts all vectors are chunks.
DISTANCES_SQL = f"{CHUNKS_SQL}, {QUESTIONS_SQL}, pairs AS (SELECT question_id, own, id, paper_id, {distance_sql('v', 'qv')} AS distance FROM questions CROSS JOIN chunks)"
VECTORS_SQL = f"chunks AS (SELECT vec_id AS id, label AS paper_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {QUESTIONS_SQL}, pairs AS (SELECT question_id, own, id, paper_id, {distance_sql('v', 'qv')} AS distance FROM questions CROSS JOIN chunks)"
