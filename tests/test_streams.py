"""Streams read to their end give what the batch queries give."""

import pytest
from pyspark.sql import functions as F

from brindle import registry
from brindle.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture
def run(spark, tmp_path):
    def go(build, mode, name, files=1):
        events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
        events.repartitionByRange(files, "event_id").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    return go


def test_admission(spark, run):
    limits = [(3, 6 * 3600), (4, 86_400)]
    timed = lambda s: s.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    found = run(lambda s: state.admitted_stream(timed(s), limits), "append", "admission")
    assert {r.event_id: r.admitted for r in found} == {r.event_id: r.admitted for r in registry.queries()["rate_admission"](spark, SF).collect()}


def test_bounded_log(spark, run):
    found = run(lambda s: state.bounded_log_stream(s.select("user_id", "event_id"), 5), "update", "log")
    wanted = {(r.user_id, r.event_id, r.dropped) for r in registry.queries()["events_last_n"](spark, SF).collect()}
    assert {(r.user_id, r.event_id, r.dropped) for r in found} == wanted


def test_daily_counts(spark, run):
    found = {r.day: r.n for r in run(lambda s: state.daily_counts_stream(s), "complete", "days")}
    assert found == {r.day: r.n for r in registry.queries()["daily_counts"](spark, SF).collect()}


def test_sessions(spark, run):
    found = run(lambda s: state.sessions_stream(s), "complete", "sessions")
    wanted = registry.queries()["sessionize_gap"](spark, SF).collect()
    assert sum(r.n for r in found) == sum(r.n for r in wanted) and abs(len(found) - len(wanted)) <= 2


@pytest.fixture
def timed(spark, tmp_path):
    """Run settled_stream over events that come out of order and twice, in files of their own, with one event behind all to let the last timers run out."""

    def go(wait, ends, late):
        events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", ends.alias("ends"))
        end = events.agg(F.max("ts") + F.expr("INTERVAL 900 DAYS")).first()[0]
        mixed = events.withColumn("file", F.pmod(F.xxhash64("event_id"), F.lit(4)))
        again = mixed.where("event_id % 9 = 0").withColumn("file", (F.col("file") + 1) % 4)
        for i in range(4):
            mixed.unionByName(again).where(F.col("file") == i).drop("file").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        last = spark.createDataFrame([(-1, -1, end, False)], events.schema)
        last.coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        query = state.settled_stream(stream, wait, late).writeStream.outputMode("append").format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        return spark.table("settled").collect()

    return go


def test_timers_of_a_grace(spark, timed):
    from brindle.plans.events import GRACE_SECONDS

    found = timed(GRACE_SECONDS, F.col("event_type") == "purchase", "800 days")
    wanted = {(r.user_id, r.event_id, r.settles) for r in registry.queries()["grace_expiries"](spark, SF).collect()}
    assert {(r.user_id, r.event_id, r.settles) for r in found} == wanted and len(found) == len(wanted) > 10


def test_timers_of_a_debounce(spark, timed):
    from brindle.plans.events import DEBOUNCE_MINUTES

    found = timed(60 * DEBOUNCE_MINUTES, F.lit(True), "800 days")
    assert {(r.user_id, r.event_id) for r in found} == {(r.user_id, r.event_id) for r in registry.queries()["debounce_latest"](spark, SF).collect()}
