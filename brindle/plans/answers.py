"""Queries over answers and names: folding, citations, resolution, file plans. Answers are the assistants' messages with markers added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.bindings import papers, table
from brindle.functions.citations import cited
from brindle.functions.folding import folded, metadata_keyed, recomposed
from brindle.operators.planning import plan_writes
from brindle.operators.resolve import resolve
from brindle.registry import register

MARKS = "'. See [3, 1] and [2], [9]. `x[1]` [3]'"
#: Catalog positions of an answer; position n is of paper n modulo 2.
POSITIONS = 5


def answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.concat("text", F.expr(MARKS)).alias("text"))


@register("fold_tokens")
def fold_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Folded words of all texts with their counts; held against a plain loop in the tests."""
    words = table(spark, sf, "documents").select(F.explode(F.split(folded("text"), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@register("name_keys")
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Names as shown and as compared: every customer's, with an accent put beside a letter."""
    name = F.concat(F.col("c_name"), F.lit(" G¨uven Evs¸en"))
    return table(spark, sf, "customer").select("c_custkey", recomposed(name).alias("shown"), metadata_keyed(name).alias("key"))


@register("citation_map", f"WITH a AS (SELECT conv_id, turn, concat(text, '. See [3], [1] and [2], [9].') AS text FROM conversations WHERE role = 'assistant'), m AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS n, unnest(range(1, len(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) + 1)) AS pos FROM a), f AS (SELECT conv_id, turn, CAST(n AS INTEGER) AS n, min(pos) AS pos FROM m WHERE CAST(n AS INTEGER) BETWEEN 1 AND {POSITIONS} GROUP BY conv_id, turn, CAST(n AS INTEGER)) SELECT conv_id, turn, n AS old, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS new FROM f")
def citation_map(spark: SparkSession, sf: str) -> DataFrame:
    """New numbers by first appearance, as columns: for answers without code."""
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(". See [3], [1] and [2], [9].")).alias("text"))
    marks = rows.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("pos", "n")).withColumn("old", F.col("n").cast("int"))
    first = marks.where(F.col("old").between(1, POSITIONS)).groupBy("conv_id", "turn", "old").agg(F.min("pos").alias("pos"))
    return first.select("conv_id", "turn", "old", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")).cast("long").alias("new"))


@register("citation_pipeline")
def citation_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with their markers expanded, stripped and renumbered; the rules themselves are tested on small texts."""
    owners = F.array(*[F.lit(str(n % 2)) for n in range(1, POSITIONS + 1)])
    titles = F.create_map(F.lit("0"), F.lit("a title of five words"), F.lit("1"), F.lit("quite another title of six words"))
    rows = answers(spark, sf).withColumn("c", cited("text", F.lit(POSITIONS), owners, titles))
    return rows.select("conv_id", "turn", F.col("c.text").alias("text"), F.array_join(F.col("c.stripped").cast("array<string>"), ",").alias("stripped"), F.array_join(F.col("c.old").cast("array<string>"), ",").alias("old"))


@register("scope_resolution")
def scope_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that the benchmark's passages name, with an author and a year made up for each paper; the cascade is tested on small tables."""
    library = papers(spark, sf).select("paper_id", "title", F.array(F.concat(F.lit("Ada Name"), F.col("paper_id").cast("string"))).alias("authors"), (1900 + F.col("paper_id") % 150).cast("int").alias("year"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("What does the paper by Name7 say: "), "text").alias("text"))
    found = resolve(asked, library)
    return found.select("question_id", F.array_join(F.col("paper_ids").cast("array<string>"), ",").alias("papers"), F.array_join("evidence", "|").alias("evidence"))


@register("planned_writes")
def planned_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all pages within their host, some taken already; held against a plain loop in the tests."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "Main").otherwise("main"), (F.col("page_id") % 3).cast("string"), F.lit(".tex"))
    rows = table(spark, sf, "pages").select(F.substring_index(host, ".", -2).alias("document"), "page_id", name.alias("path"), (F.col("page_id") % 40 == 0).alias("existing"))
    return plan_writes(rows, "document", "page_id", "path", "existing")
