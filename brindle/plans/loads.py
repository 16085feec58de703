"""Queries of bulk loads and of SyncTeX lookups; lines and boxes are made from the texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.bindings import table
from brindle.operators import synctex
from brindle.registry import register
from brindle.sources import bulk


@register(
    "bulk_load",
    """WITH d AS (SELECT doc_id, n_chars, source, coalesce(lang, '') AS lang FROM documents),
lines AS (SELECT doc_id AS seq, doc_id, CASE WHEN n_chars % 7 = 3 THEN 'malformed' WHEN source IS NULL THEN 'missing url' WHEN lang = '' THEN 'missing lang' END AS reason, 'u' || doc_id AS url FROM d
  UNION ALL SELECT doc_id + 1000000000, doc_id, CASE WHEN source IS NULL THEN 'missing url' WHEN lang = '' THEN 'missing lang' END, 'u' || doc_id FROM d WHERE n_chars % 5 = 1),
ledger AS (SELECT DISTINCT 'u' || doc_id AS url FROM labels WHERE quality = 1),
firsts AS (SELECT url, min(seq) AS first FROM lines WHERE reason IS NULL GROUP BY url)
SELECT l.seq, CASE WHEN l.reason IS NOT NULL THEN 'broken' WHEN g.url IS NOT NULL THEN 'loaded' WHEN l.seq = f.first THEN 'new' ELSE 'repeated' END AS status, l.reason, CASE WHEN l.reason IS NULL THEN l.url END AS url
FROM lines l LEFT JOIN firsts f ON f.url = l.url AND l.reason IS NULL LEFT JOIN ledger g ON g.url = l.url AND l.reason IS NULL""",
)
def bulk_load(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON lines, some cut off, without a field, or once more; what has a good label is loaded already."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang", "text")
    record = F.to_json(F.struct(F.when(F.col("source").isNotNull(), F.concat(F.lit("u"), "doc_id")).alias("url"), "lang", F.left("text", F.lit(200)).alias("abstract")))
    cut = F.when(F.col("n_chars") % 7 == 3, F.left(record, F.char_length(record) - 1)).otherwise(record)
    lines = d.select(F.col("doc_id").alias("seq"), cut.alias("value")).unionByName(d.where(F.col("n_chars") % 5 == 1).select((F.col("doc_id") + 1_000_000_000).alias("seq"), record.alias("value")))
    ledger = table(spark, sf, "labels").where("quality = 1").select(F.concat(F.lit("u"), "doc_id").alias("url"))
    found = bulk.classified(lines, "url string, lang string, abstract string", "url", ("lang",), ledger)
    return found.select("seq", "status", "reason", F.when(F.col("reason").isNull(), F.col("record.url")).alias("url"))


ROWS = 30
BOXES_SQL = f"""WITH texts AS (SELECT doc_id, n_chars, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, n_chars, len(ls) AS n, unnest(ls) AS l, unnest(range(len(ls))) AS k FROM texts),
boxes AS (SELECT doc_id AS run, k + 1 AS seq, 'main.tex' AS file, k + 1 AS line, k // {ROWS} + 1 AS page, CAST(72 AS DOUBLE) AS x, CAST(72 + 12 * (k % {ROWS}) AS DOUBLE) AS y, CAST(least(len(l) * 5, 450) AS DOUBLE) AS width, CAST(10 + len(l) % 6 AS DOUBLE) AS height FROM lines
  UNION ALL SELECT doc_id, 1000000 + k // {ROWS}, 'page.tex', k // {ROWS} + 1, k // {ROWS} + 1, 60, 60, 480, 400 FROM lines WHERE k % {ROWS} = 0)"""


def _boxes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Runs (doc_id, n_chars, number of lines) and the boxes of their lines, with one around each page."""
    texts = table(spark, sf, "documents").where("text is not null").select("doc_id", "n_chars", F.split("text", "\n", -1).alias("ls"))
    lines = texts.select(F.col("doc_id").alias("run"), F.posexplode("ls").alias("at", "l"))
    page = F.floor(F.col("at") / ROWS) + 1
    d = lambda c: c.cast("double")
    own = lines.select("run", (F.col("at") + 1).cast("long").alias("seq"), F.lit("main.tex").alias("file"), (F.col("at") + 1).cast("long").alias("line"), page.alias("page"), F.lit(72.0).alias("x"), d(72 + 12 * (F.col("at") % ROWS)).alias("y"), d(F.least(F.char_length("l") * 5, F.lit(450))).alias("width"), d(10 + F.char_length("l") % 6).alias("height"))
    around = lines.where(F.col("at") % ROWS == 0).select("run", (page + 999_999).alias("seq"), F.lit("page.tex").alias("file"), page.alias("line"), page.alias("page"), F.lit(60.0).alias("x"), F.lit(60.0).alias("y"), F.lit(480.0).alias("width"), F.lit(400.0).alias("height"))
    return texts.select("doc_id", "n_chars", F.size("ls").alias("n")), own.unionByName(around)


@register("synctex_forward", f"{BOXES_SQL}, asks AS (SELECT doc_id, any_value(1 + n_chars % (n + 2)) AS line FROM lines GROUP BY doc_id) SELECT a.doc_id, a.line, b.page, b.x, b.y, b.width, b.height FROM asks a LEFT JOIN boxes b ON b.run = a.doc_id AND b.file = 'main.tex' AND b.line = a.line")
def synctex_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Where a line of each document, or one beyond its end, is on a page."""
    runs, boxes = _boxes(spark, sf)
    asks = runs.select(F.col("doc_id").alias("run"), F.lit("main.tex").alias("file"), (1 + F.col("n_chars") % (F.col("n") + 2)).cast("long").alias("line"))
    return synctex.forward(boxes, asks).select(F.col("run").alias("doc_id"), "line", "page", "x", "y", "width", "height")


@register(
    "synctex_reverse",
    f"""{BOXES_SQL}, points AS (SELECT doc_id, any_value(1 + n_chars % ((n - 1) // {ROWS} + 1)) AS page, any_value(CAST(50 + n_chars % 500 AS DOUBLE)) AS x, any_value(CAST(50 + n_chars * 7 % 430 AS DOUBLE)) AS y FROM lines GROUP BY doc_id),
inside AS (SELECT p.doc_id, b.file, b.line FROM points p JOIN boxes b ON b.run = p.doc_id AND b.page = p.page WHERE p.x BETWEEN b.x AND b.x + b.width AND p.y BETWEEN b.y AND b.y + b.height QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY b.width * b.height, b.seq) = 1)
SELECT p.doc_id, p.page, p.x, p.y, i.file, i.line FROM points p LEFT JOIN inside i ON i.doc_id = p.doc_id""",
)
def synctex_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """Which line made what stands at a point of each document: the smallest box around it."""
    runs, boxes = _boxes(spark, sf)
    n = F.col("n_chars")
    points = runs.select(F.col("doc_id").alias("point"), F.col("doc_id").alias("run"), (1 + n % (F.floor((F.col("n") - 1) / ROWS) + 1)).cast("long").alias("page"), (50 + n % 500).cast("double").alias("x"), (50 + n * 7 % 430).cast("double").alias("y"))
    return synctex.reverse(boxes, points).select(F.col("run").alias("doc_id"), "page", "x", "y", "file", "line")
