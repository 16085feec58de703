"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens under the ones of a fixed mask; its zeros are
ignored, so a hit survives substituted words there. Seeds of documents are
joined with those of the benchmark, and around each hit the aligned tokens are
compared one by one: the overlap counts if enough of them agree.

Items with fewer tokens than the mask have no seed; they are looked up exactly,
as runs of their own number of tokens.

Everything is column expressions: one pass over the documents (two if there are
such short items), no Python and, while the benchmark's seeds are few (counted),
no shuffle before the hits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import hinted, kept, small, table

#: Masks of one length; a run with every fifth or sixth word replaced still has hits.
MASKS = ("1101101011", "1110010111")
#: Tokens on each side of the mask that are compared too, and the share of the compared tokens that must agree.
MARGIN, AGREE = 3, 0.75
#: Tokens of an item at least for which the pipeline drops a document; shorter ones stand in texts that have nothing to do with the benchmark.
LEAST_ITEM = 5
#: Stands for a missing token of an item, so that it agrees with nothing.
NO_TOKEN = -0x6E6F6E65
#: Seeds that are broadcast at most with what stands around them (about 250 bytes each), seeds alone (8 bytes), and ids.
SEEDS_AT_ONCE, BARE_AT_ONCE, IDS_AT_ONCE = 200_000, 4_000_000, 1_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text in lower case; none for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, hashes: str, masks: tuple[str, ...], margin: int) -> DataFrame:
    """The columns of rows but hashes, once for each place and mask: with the seed and the tokens w0, w1, ... around it.

    The tokens (null beyond either end of the text) are read from the array by
    generated code, and for documents only once their seed has been hit.
    """
    span = len(masks[0])
    last = F.size(hashes) - span
    placed = rows.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    token = lambda i: F.get(F.col(hashes), F.col("at") + i)
    each = [F.xxhash64(F.lit(m), *[token(i) for i, bit in enumerate(mask) if bit == "1"]) for m, mask in enumerate(masks)]
    seeded = placed.select("*", F.explode(F.array(*each)).alias("seed"))
    return seeded.select(*[c for c in rows.columns if c != hashes], "seed", *[token(i).alias(f"w{i + margin}") for i in range(-margin, span + margin)])


def short_overlaps(docs: DataFrame, items: DataFrame, below: int) -> DataFrame:
    """Rows (key, item, n, agreement) for items of 1 to below - 1 tokens, from rows (key, our) and (item, their) of token hashes.

    n counts the places where all tokens of the item stand in a row; there is one
    pass over the places, with a run for each length that an item has.
    """
    few = kept(items.where((F.size("their") > 0) & (F.size("their") < below)).distinct())
    lengths = sorted(r[0] for r in few.select(F.size("their")).distinct().collect())
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"key {docs.schema['key'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, n bigint, agreement double")
    words = [f"w{i}" for i in range(lengths[-1])]
    run = lambda n: F.xxhash64(F.lit(n), *words[:n])
    told = few.select("item", F.size("their").alias("length"), *[F.get("their", F.lit(i)).alias(w) for i, w in enumerate(words)])
    told = told.select("item", "length", F.coalesce(*[F.when(F.col("length") == n, run(n)) for n in lengths]).alias("run"), *[F.col(w).alias(f"b{w}") for w in words])
    theirs = hinted(kept(told), SEEDS_AT_ONCE)
    placed = docs.select("key", "our", F.explode(F.when(F.size("our") > 0, F.sequence(F.lit(0), F.size("our") - 1))).alias("at"))
    placed = placed.select("key", *[F.get("our", F.col("at") + i).alias(w) for i, w in enumerate(words)])
    # a run that the text's end cuts off has a missing token, which no item has
    ours = placed.select("key", *words, F.explode(F.array(*[run(n) for n in lengths])).alias("run"))
    agrees = [(F.col("length") <= i) | F.col(w).eqNullSafe(F.col(f"b{w}")) for i, w in enumerate(words)]
    same = ours.join(theirs, "run").where(reduce(and_, agrees))
    return same.groupBy("key", "item").agg(F.count("*").alias("n"), F.lit(1.0).alias("agreement"))


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, margin: int = MARGIN, agree: float = AGREE, at_once: int = SEEDS_AT_ONCE) -> DataFrame:
    """Rows (key, item, n_hits, agreement): documents that share a passage with an item.

    n_hits counts the confirmed seed hits and agreement is the best share of
    agreeing tokens around one; where items share the passage, each has them. Of
    items with fewer tokens than a mask every exact place counts, a single word
    as well. Texts without tokens never match; rows with equal keys are taken
    together. Beyond at_once seeds of the benchmark, places are first held
    against the seeds alone.
    """
    if len({len(m) for m in masks}) != 1:
        raise ValueError("masks must have one length")
    window = [f"w{i}" for i in range(len(masks[0]) + 2 * margin)]
    docs = docs.select(F.col(key).alias("key"), token_hashes(F.col(text)).alias("our"))
    items = items.select(F.col(item).alias("item"), token_hashes(F.col(item_text)).alias("their"))
    held = seeds(items, "their", masks, margin).distinct()
    # a passage that many items share is compared once; passage is null for all others
    theirs = held.groupBy("seed", *window).agg(F.min("item").alias("item"), F.when(F.count("*") > 1, F.xxhash64("seed", *window)).alias("passage"))
    sharing = held.select("item", F.xxhash64("seed", *window).alias("passage"))
    # what can be told from the item alone is told here: the loop over all places is compiled only while its code is small
    compared = sum((F.col(w).isNotNull().cast("int") for w in window), F.lit(0))
    theirs = theirs.select("seed", "item", "passage", compared.cast("double").alias("compared"), *[F.coalesce(w, F.lit(NO_TOKEN)).alias(f"b{w}") for w in window])
    theirs = kept(theirs)
    shared = theirs.where(F.col("passage").isNotNull()).select("passage").distinct()
    sharing = kept(sharing.join(shared, "passage"))
    ours = seeds(docs, "our", masks, margin)
    if small(theirs, at_once):
        theirs = F.broadcast(theirs)
    else:
        # only places whose seed some item has are shuffled
        ours = ours.join(hinted(kept(theirs.select("seed").distinct()), BARE_AT_ONCE), "seed", "left_semi")
    same = sum((F.col(w).eqNullSafe(F.col(f"b{w}")).cast("int") for w in window), F.lit(0))
    judged = ours.join(theirs, "seed").select("key", "item", "passage", (same / F.col("compared")).alias("share")).where(F.col("share") >= agree)
    found = judged.groupBy("key", "item", "passage").agg(F.count("*").alias("n"), F.max("share").alias("agreement"))
    if not sharing.isEmpty():
        # the passage's representative gives way to all items that hold it, itself among them
        found = kept(found)
        each = found.where(F.col("passage").isNotNull()).drop("item").join(hinted(sharing, SEEDS_AT_ONCE), "passage")
        found = found.where(F.col("passage").isNull()).unionByName(each)
    found = found.drop("passage").unionByName(short_overlaps(docs, items, len(masks[0])))
    return found.groupBy(F.col("key").alias(key), F.col("item").alias(item)).agg(F.sum("n").alias("n_hits"), F.max("agreement").alias("agreement"))


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least_item: int = LEAST_ITEM) -> DataFrame:
    """Pipeline: documents without a benchmark passage; items of fewer than least_item tokens drop none."""
    items = table(spark, sf_dir, "benchmark").where(F.size(token_hashes(F.col("text"))) >= least_item)
    leaks = kept(overlaps(docs, items).select("doc_id").distinct())
    return docs.join(hinted(leaks, IDS_AT_ONCE), "doc_id", "left_anti").select(docs.columns)


QUERIES = {"op1_spaced_seeds": op1_spaced_seeds}


def _sql(masks: tuple[str, ...] = MASKS, margin: int = MARGIN, agree: float = AGREE) -> str:
    span = len(masks[0])

    def seeded(table: str, key: str) -> str:
        token = lambda i: f"CASE WHEN pos + {i} >= 0 THEN w[pos + {i + 1}] END"
        window = ", ".join(token(i) for i in range(-margin, span + margin))
        each = [f"SELECT {key}, [{', '.join([repr(str(m)), *[token(i) for i, bit in enumerate(mask) if bit == '1']])}] AS seed, [{window}] AS win FROM {table}_at" for m, mask in enumerate(masks)]
        return f"""{table}_w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL),
{table}_at AS (SELECT {key}, w, unnest(range(0, len(w) - {span - 1})) AS pos FROM {table}_w),
{table}_seeds AS ({' UNION ALL '.join(each)})"""

    return f"""
WITH {seeded('documents', 'doc_id')},
{seeded('benchmark', 'item_id')},
theirs AS (SELECT DISTINCT seed, win, item_id FROM benchmark_seeds),
judged AS (
  SELECT o.doc_id, t.item_id,
    CAST(list_sum(list_transform(range(1, {span + 2 * margin + 1}), lambda i: CASE WHEN o.win[i] = t.win[i] THEN 1 ELSE 0 END)) AS DOUBLE)
    / CAST(len(list_filter(t.win, lambda x: x IS NOT NULL)) AS DOUBLE) AS share
  FROM documents_seeds o JOIN theirs t ON t.seed = o.seed),
short AS (SELECT DISTINCT item_id, w FROM benchmark_w WHERE len(w) BETWEEN 1 AND {span - 1}),
runs AS (
  SELECT d.doc_id, s.item_id, len(list_filter(range(0, greatest(len(d.w) - len(s.w), -1) + 1), lambda i: d.w[i + 1 : i + len(s.w)] = s.w)) AS n
  FROM documents_w d JOIN short s ON list_has_all(d.w, s.w)),
found AS (
  SELECT doc_id, item_id, count(*) AS n, max(share) AS agreement FROM judged WHERE share >= {agree} GROUP BY doc_id, item_id
  UNION ALL SELECT doc_id, item_id, sum(n), 1.0 FROM runs WHERE n > 0 GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(sum(n) AS BIGINT) AS n_hits, max(agreement) AS agreement FROM found GROUP BY doc_id, item_id
"""


ORACLE = {"op1_spaced_seeds": _sql()}
