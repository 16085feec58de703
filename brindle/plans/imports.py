"""Queries of imports: what archives of pages would write into trees, and which requests to write it are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.bindings import table
from brindle.operators import imports as I
from brindle.registry import register

ARCHIVES, DOCUMENTS, MOVED = 50, 10, 3

INPUTS_SQL = f"""
p AS (SELECT page_id, split_part(url, '/', 3) AS host, CAST(coalesce(length(html), 0) AS BIGINT) AS n_bytes FROM pages),
entries AS (SELECT archive, path, min(seq) AS seq, arg_min(n_bytes, seq) AS n_bytes FROM (SELECT page_id % {ARCHIVES} AS archive, page_id AS seq, CASE WHEN page_id < {ARCHIVES} THEN '{I.MANIFEST}' WHEN page_id % 3 = 0 THEN upper(host) || '/index.tex' ELSE host || '/index.tex' END AS path, n_bytes FROM p) GROUP BY archive, path),
targets AS (SELECT DISTINCT archive, CASE WHEN archive % 5 <> 0 THEN archive % {DOCUMENTS} END AS document FROM entries),
tree AS (SELECT DISTINCT page_id % {DOCUMENTS} AS document, host || '/index.tex' AS path FROM p WHERE page_id % 4 = 1),
landing AS (SELECT e.archive, t.document, e.seq, e.path, e.n_bytes, r.path AS there, row_number() OVER w AS r, first_value(e.path) OVER w AS first
  FROM entries e JOIN targets t USING (archive) LEFT JOIN tree r ON r.document = t.document AND lower(r.path) = lower(e.path) WHERE e.path <> '{I.MANIFEST}' WINDOW w AS (PARTITION BY e.archive, lower(e.path) ORDER BY e.seq)),
numbered AS (SELECT *, r - CASE WHEN there IS NULL THEN 1 ELSE 0 END AS n FROM landing),
plan AS (SELECT archive, document, CASE WHEN document IS NOT NULL THEN document * 3 + 1 END AS base_revision, seq, path, n_bytes, CASE WHEN n > 0 THEN coalesce(there, first) END AS existing, CASE WHEN n > 0 THEN regexp_replace(path, '\\.tex$', '') || ' (' || n || ').tex' END AS suggestion FROM numbered)"""


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """entries, targets, tree and revisions: pages as files of archives, and some of their hosts as trees."""
    n = F.col("page_id")
    rows = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.coalesce(F.char_length("html"), F.lit(0)).cast("long").alias("n_bytes"))
    leaf = lambda host: F.concat(host, F.lit("/index.tex"))
    path = F.when(n < ARCHIVES, I.MANIFEST).when(n % 3 == 0, leaf(F.upper("host"))).otherwise(leaf(F.col("host")))
    entries = rows.groupBy((n % ARCHIVES).alias("archive"), path.alias("path")).agg(F.min("page_id").alias("seq"), F.min_by("n_bytes", "page_id").alias("n_bytes"))
    targets = entries.select("archive").distinct().withColumn("document", F.when(F.col("archive") % 5 != 0, F.col("archive") % DOCUMENTS))
    tree = rows.where(n % 4 == 1).groupBy((n % DOCUMENTS).alias("document"), leaf(F.col("host")).alias("path")).agg(F.lit(1).cast("long").alias("n_bytes"))
    revisions = targets.where("document is not null").select("document", (F.col("document") * 3 + 1).alias("revision")).distinct()
    return entries, targets, tree, revisions


@register("import_plan", f"WITH {INPUTS_SQL} SELECT * FROM plan")
def import_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What each archive would write, where it collides, and the free name that it is offered; nothing is written."""
    entries, targets, tree, revisions = _inputs(spark, sf)
    return I.import_plan(entries, targets, tree, revisions)


@register(
    "import_commit",
    f"""WITH {INPUTS_SQL},
commits AS (SELECT archive, CASE WHEN archive % 9 = 4 THEN coalesce(document, 0) + 1 ELSE document END AS document, document AS planned_for FROM targets WHERE archive IN (SELECT archive FROM plan) UNION ALL SELECT 999, NULL, NULL FROM (SELECT 1 FROM pages LIMIT 1)),
counts AS (SELECT archive, count(*) AS n_files, count(suggestion) AS collisions FROM plan GROUP BY archive),
own AS (SELECT c.archive, c.document, n_files, CASE WHEN c.archive = 999 THEN 'unknown' WHEN c.archive % 9 = 4 THEN 'other target' WHEN c.document = {MOVED} THEN 'stale' WHEN c.archive % 11 = 5 THEN 'not in the archive' WHEN c.archive % 13 = 6 THEN 'bad path' WHEN c.archive % 17 = 7 THEN 'reserved' WHEN c.archive % 8 = 1 AND collisions > 0 THEN 'collision' END AS own FROM commits c LEFT JOIN counts USING (archive)),
judged AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN document IS NULL OR row_number() OVER (PARTITION BY document ORDER BY own IS NOT NULL, archive) = 1 THEN 'ok' ELSE 'stale' END AS verdict FROM own),
now AS (SELECT *, CASE WHEN document IN (SELECT document FROM targets) THEN document * 3 + 1 + CASE WHEN document = {MOVED} THEN 1 ELSE 0 END END AS revision FROM judged)
SELECT archive, document, verdict, CASE WHEN verdict = 'ok' THEN n_files ELSE 0 END AS n_files, CASE WHEN verdict = 'ok' THEN coalesce(revision, 0) + 1 ELSE revision END AS revision FROM now""",
)
def import_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to write the plans: most take the names that they were offered, some name another document, decide about files that are not there, or come too late."""
    entries, targets, tree, revisions = _inputs(spark, sf)
    plan = I.import_plan(entries, targets, tree, revisions)
    a = F.col("archive")
    asked = plan.select("archive", "document").distinct().select("archive", F.when(a % 9 == 4, F.coalesce("document", F.lit(0)) + 1).otherwise(F.col("document")).alias("document"))
    stray = entries.limit(1).select(F.lit(999).cast("long").alias("archive"), F.lit(None).cast("long").alias("document"))
    commits = asked.unionByName(stray).withColumn("seq", a)
    first = plan.groupBy("archive").agg(F.min("path").alias("path"))
    decide = lambda rows, path, new: rows.select("archive", path.alias("path"), new.alias("new_path"))
    decisions = decide(plan.where(F.col("suggestion").isNotNull() & (a % 8 != 1)), F.col("path"), F.col("suggestion"))
    for wrong in (decide(first.where(a % 11 == 5), F.lit("nowhere.tex"), F.lit("x.tex")), decide(first.where(a % 13 == 6), F.col("path"), F.lit("../x")), decide(first.where(a % 17 == 7), F.col("path"), F.lit(I.MANIFEST))):
        decisions = decisions.unionByName(wrong)
    now = revisions.withColumn("revision", F.col("revision") + F.when(F.col("document") == MOVED, 1).otherwise(0))
    return I.import_commit(plan, commits, decisions, tree, now)[0]
