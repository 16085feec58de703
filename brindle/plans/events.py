"""Stateful event handling as batch queries; streaming/ has the same rules over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.bindings import table
from brindle.config import CONFIG as C
from brindle.functions import text as X
from brindle.operators import scan
from brindle.registry import register
from brindle.streaming.state import admitted

LAST, GAP_MINUTES, DEBOUNCE_MINUTES = 5, 30, 60
HITS, WINDOW_SECONDS, DAY_HITS, GRACE_SECONDS = 3, 6 * 3600, 4, 12 * 3600


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@register("events_last_n", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, greatest(count(*) OVER (PARTITION BY user_id) - {LAST}, 0) AS dropped FROM events QUALIFY r <= {LAST}")
def events_last_n(spark: SparkSession, sf: str) -> DataFrame:
    """What a bounded queue that drops its oldest holds, and how many it has dropped."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    latest = rows.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")).where(F.col("r") <= LAST)
    sizes = rows.groupBy("user_id").agg(F.greatest(F.count("*") - LAST, F.lit(0)).alias("dropped"))
    return latest.join(sizes, "user_id").select("user_id", "event_id", "r", "dropped")


@register("rate_window_counts", f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_SECONDS * 1_000_000} PRECEDING AND CURRENT ROW) AS hits FROM events")
def rate_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return scan.counts_within(table(spark, sf, "events").select("event_id", "user_id", micros.alias("at")), "user_id", "event_id", "at", WINDOW_SECONDS * 1_000_000)


@register("rate_admission")
def rate_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Which hits a limiter with two windows lets through: a denied hit counts only in the windows before the one that denied it. Held against a plain loop in the tests."""
    rows = table(spark, sf, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return admitted(rows, "user_id", "event_id", "at", [(HITS, WINDOW_SECONDS), (DAY_HITS, 86_400)])


@register("daily_cap_admission", f"SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= {C.daily_run_cap} AS admitted FROM events")
def daily_cap_admission(spark: SparkSession, sf: str) -> DataFrame:
    """The first runs of each day: the best of each day are found before the shuffle, the rest is told apart by comparing with the last of them."""
    rows = table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))).where(F.col("r") <= C.daily_run_cap)
    last = first.groupBy("day").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return rows.join(last, "day").select("event_id", "day", (F.struct("ts", "event_id") <= F.col("last")).alias("admitted"))


@register("daily_counts", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) > {C.daily_run_cap} AS over, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) AS resets FROM events GROUP BY CAST(ts AS DATE)")
def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rows.select("day", "n", (F.col("n") > C.daily_run_cap).alias("over"), F.date_add("day", 1).cast("timestamp_ntz").alias("resets"))


@register("sessionize_gap", f"WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {GAP_MINUTES} MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n, min(ts) AS begins, max(ts) AS ends FROM s GROUP BY user_id, s")
def sessionize_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    numbered = scan.sessions(rows, "user_id", ["ts", "event_id"], "ts", F.expr(f"INTERVAL {GAP_MINUTES} MINUTES"))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


@register("debounce_latest", f"SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR next - ts > INTERVAL {DEBOUNCE_MINUTES} MINUTE")
def debounce_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Of edits that follow each other quickly only the last is saved."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", F.lead("ts").over(by_user()).alias("next"))
    return rows.where(F.col("next").isNull() | (F.col("next") - F.col("ts") > F.expr(f"INTERVAL {DEBOUNCE_MINUTES} MINUTES"))).select("user_id", "event_id")


@register("grace_expiries", f"SELECT user_id, event_id, epoch_us(ts) + {GRACE_SECONDS * 1_000_000} AS settles FROM (SELECT user_id, event_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE event_type = 'purchase' AND (next IS NULL OR epoch_us(next) - epoch_us(ts) > {GRACE_SECONDS * 1_000_000})")
def grace_expiries(spark: SparkSession, sf: str) -> DataFrame:
    """When what a user has left is closed: a grace after the last event, unless another one comes in time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("user_id", "event_id", micros.alias("at"), "event_type")
    later = rows.withColumn("minus", -F.col("at")).withColumn("back", -F.col("event_id"))
    after = scan.previous(later, "user_id", ["minus", "back"], "at", "next")
    calm = F.col("next").isNull() | (F.col("next") - F.col("at") > GRACE_SECONDS * 1_000_000)
    return after.where((F.col("event_type") == "purchase") & calm).select("user_id", "event_id", (F.col("at") + GRACE_SECONDS * 1_000_000).alias("settles"))


@register("orphan_sweep", "SELECT CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def orphan_sweep(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus").isin("O", "P"), "failed").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register("step_latest_output", "SELECT user_id, event_type, arg_max(value, event_id) AS output, count(*) AS updates FROM events GROUP BY user_id, event_type")
def step_latest_output(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("output"), F.count("*").alias("updates"))


@register("retry_outcomes", f"WITH a AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events QUALIFY attempt <= {C.max_attempts}), g AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN attempt END) AS won, max(attempt) AS tried, max(value) AS best FROM a GROUP BY user_id) SELECT user_id, coalesce(won, tried) AS attempts, won IS NOT NULL AS validated, CASE WHEN won IS NULL THEN best END AS degraded_best FROM g")
def retry_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """At most three attempts a key: the first valid one ends it, else the best is kept as degraded."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    tries = table(spark, sf, "events").withColumn("attempt", F.row_number().over(order).cast("long")).where(F.col("attempt") <= C.max_attempts)
    done = tries.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("attempt"))).alias("won"), F.max("attempt").alias("tried"), F.max("value").alias("best"))
    return done.select("user_id", F.coalesce("won", "tried").alias("attempts"), F.col("won").isNotNull().alias("validated"), F.when(F.col("won").isNull(), F.col("best")).alias("degraded_best"))


@register("revision_staleness", "SELECT l_orderkey, count(*) AS revision, max(l_linenumber) FILTER (WHERE l_returnflag <> 'N') AS compiled, count(*) IS DISTINCT FROM max(l_linenumber) FILTER (WHERE l_returnflag <> 'N') AS stale FROM lineitem GROUP BY l_orderkey")
def revision_staleness(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("revision"), F.max(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))).alias("compiled"))
    return rows.withColumn("stale", ~F.col("revision").eqNullSafe(F.col("compiled").cast("long")))


@register("relative_time", "WITH d AS (SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2001-08-02 12:00:00') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS d FROM orders) SELECT o_orderkey, CASE WHEN d = 0 THEN 'Today' WHEN d < 30 THEN (CASE WHEN d = 1 THEN '1 day ago' ELSE concat(d, ' days ago') END) WHEN d // 30 < 12 THEN (CASE WHEN d // 30 = 1 THEN '1 month ago' ELSE concat(d // 30, ' months ago') END) ELSE (CASE WHEN d // 30 // 12 = 1 THEN '1 year ago' ELSE concat(d // 30 // 12, ' years ago') END) END AS label FROM d")
def relative_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", X.relative_time(F.col("o_orderdate"), F.lit("2001-08-02 12:00:00")).alias("label"))


@register("iso_day", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def iso_day(spark: SparkSession, sf: str) -> DataFrame:
    """The day of what can be read as a time; anything else stays as it is."""
    raw = F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd"), raw).alias("day"))


@register("retry_after", "SELECT event_id, CAST(86400 - (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS BIGINT) AS seconds FROM events")
def retry_after(spark: SparkSession, sf: str) -> DataFrame:
    """Whole seconds until the next midnight, when a daily cap is open again."""
    return table(spark, sf, "events").select("event_id", (86_400 - (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))).cast("long").alias("seconds"))
