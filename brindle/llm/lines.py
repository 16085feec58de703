"""Line dedup by site-relative frequency: lines that stand on too large a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import neardup
from brindle.llm.common import discard, kept, matched, salted, small, table, unused, written

#: A line goes if it is on more than RATIO of its host's pages, and on PAGES of them at least.
RATIO, PAGES = 0.05, 5
#: Hosts whose lists of lines are broadcast at most; a host has fewer lines than its mean lines a page divided by RATIO.
HOSTS_AT_ONCE = 100_000
#: Bands of near copies of a host, of so many places each; buckets that are broadcast at most; and what a page counts for.
BANDS, BAND_ROWS, COPIES_AT_ONCE, WHOLE = 16, 4, 1_000_000, 10**9


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES, weight: str | None = None) -> DataFrame:
    """Rows (host, line_hash) of the lines to drop.

    Rows of a host with equal texts are one page, so what only copies of a page
    share is no boilerplate. If weight names a column, each row is a page that
    counts for as many WHOLE-ths as it says.

    A line counts once for a page; blank lines never count. Rows with a null host
    belong to no site. Counts are summed before the shuffle, so a host or a line
    with a third of all rows costs no more than any other.
    """
    lines = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != ""))
    if weight is not None:
        rows = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"), F.col(weight).cast("decimal(38,0)").alias("weight"))
        placed = rows.select("host", "weight", F.explode(lines).alias("line"))
        counted = placed.groupBy("host", F.xxhash64("line").alias("line_hash")).agg(F.sum("weight").alias("n"))
        totals = rows.groupBy("host").agg(F.sum("weight").alias("total"))
        often = counted.where(F.col("n") >= pages * WHOLE)
        return salted(often, totals, "host", "line_hash").where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "line_hash")
    rows = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"), F.xxhash64(text).alias("page"))
    placed = rows.select("host", "page", F.explode(lines).alias("line")).select("host", "page", F.xxhash64("line").alias("line_hash")).distinct()
    counted = placed.groupBy("host", "line_hash").agg(F.count("*").alias("n"))
    totals = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    often = counted.where(F.col("n") >= pages)
    return salted(often, totals, "host", "line_hash").where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "line_hash")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES, found: DataFrame | None = None, counts: tuple[str, str] | None = ("n_lines", "n_dropped"), at_once: int = HOSTS_AT_ONCE) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and with the counts of lines and of dropped ones under the names in counts.

    Every row stays: a null text stays null (0 lines), an empty one empty, one
    that is all boilerplate becomes empty; rows with a null host stay as they are.
    Columns named as the counts are replaced; without counts none is added. The
    lines are those of boilerplate(), or the rows of found. Beyond at_once hosts
    with such lines, each host's rows are dealt over several tasks.
    """
    found = kept(boilerplate(docs, host, text, ratio, pages) if found is None else found)
    drops = found.groupBy("host").agg(F.collect_set("line_hash").alias("drop"))
    # all columns of docs in one, so that none can have the name of one of ours
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(host).alias("host"), F.col(text).alias("text"))
    if small(drops, at_once):
        rows = rows.join(F.broadcast(drops), "host", "left")
    else:
        rows = salted(rows, drops, "host", "text", "left", salts=64)
    lines = F.split("text", "\n", -1)
    stay = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), F.xxhash64(x)))
    rows = rows.select("doc", "text", lines.alias("lines"), F.when(F.col("drop").isNull(), lines).otherwise(stay).alias("stay"))
    count = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    more = [] if counts is None else [count("lines").alias(counts[0]), (count("lines") - count("stay")).alias(counts[1])]
    same = [c for c in docs.columns if counts is None or c not in counts]
    return rows.select(*[F.array_join("stay", "\n").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in same], *more)


def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("clean_sha256"))


def weighed(rows: DataFrame, key: str, host: str = "source", text: str = "text", bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows (key, weight) for rows of a unique key whose host has copies or near copies of them: WHOLE over about as many as there are.

    Texts are sketched in bands; rows of a host with an equal band are a bucket,
    and a row's weight is WHOLE over the size of its largest. A group of near
    copies so counts for little more than one page, whatever its size: of copies
    with a similarity of 0.8 a bucket has four in ten, and all but 0.02 % are in
    one; of texts with a similarity of 0.3 an eighth is in any. Rows without a
    bucket of two are left out.
    """
    hashed = rows.where(F.col(host).isNotNull()).select(F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(host).alias("host")).alias("id"), neardup.word_hashes(F.col(text)).alias("words"))
    sketch = written(hashed.mapInArrow(neardup._sketch(neardup.WORDS, bands, band_rows), "id struct<id:bigint,host:bigint>, n_shingles bigint, print binary, keys array<bigint>").where("n_shingles > 0").select("id.*", "keys"), "line-bands")
    placed = sketch.select("id", "host", F.explode("keys").alias("band")).select("id", F.xxhash64("host", "band").alias("band"))
    sizes = kept(placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    largest = matched(placed, sizes, "band", "id", COPIES_AT_ONCE).groupBy("id").agg(F.max("n").alias("n"))
    found = written(largest.select(F.col("id").alias(key), F.floor(F.lit(WHOLE) / F.col("n")).alias("weight")), "line-weights")
    discard(sketch, sizes)
    return found


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document, without its site's boilerplate lines; n_chars follows the text.

    Equal texts and near copies count for about one page (see weighed()), so what
    only they share is no boilerplate and is left for the next stage.
    """
    row, weight = unused("row", docs), unused("weight", docs)
    rows, _ = neardup.numbered(docs, "doc_id", row)
    copies = weighed(rows, row).withColumnRenamed("weight", weight)
    pages = rows.select(row, "source", "text").join(copies, row, "left").withColumn(weight, F.coalesce(weight, F.lit(WHOLE)))
    cleaned = drop_boilerplate(docs, found=boilerplate(pages, weight=weight), counts=None)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


QUERIES = {"op2_site_lines": op2_site_lines}
ORACLE = {
    "op2_site_lines": f"""
WITH texts AS (SELECT DISTINCT source, text FROM documents WHERE source IS NOT NULL),
pages AS (SELECT source, count(*) AS total FROM texts GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM texts),
bad AS (
  SELECT l.source, l.line FROM lines l JOIN pages p ON p.source = l.source
  WHERE trim(l.line) <> '' GROUP BY l.source, l.line, p.total
  HAVING count(*) >= {PAGES} AND count(*) > CAST({RATIO} AS DOUBLE) * p.total),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
split AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines, coalesce(l.bad, []) AS bad FROM documents d LEFT JOIN lists l ON l.source = d.source),
done AS (SELECT *, list_filter(lines, lambda x: NOT list_contains(bad, x)) AS stay FROM split)
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(stay), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(stay, chr(10))) AS clean_sha256 FROM done
"""
}
