"""Rules that need state from row to row: over a batch by key, and over streams with the state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.config import CONFIG

Limits = list[tuple[int, int]]


def step(kept: list[list[int]], at: int, limits: Limits) -> bool:
    """One hit against several moving windows, tried in order; kept: times that each window holds, changed in place.

    A window holds at most its limit of times, so state is bounded however many hits a key has.
    """
    for times, (most, seconds) in zip(kept, limits, strict=True):
        while times and times[0] <= at - seconds:
            times.pop(0)
        if len(times) >= most:
            return False
        times.append(at)
    return True


def admitted(rows: DataFrame, key: str, seq: str, at: str, limits: Limits) -> DataFrame:
    """Rows (key, seq, at, admitted): each key's hits in order of time.

    Keys are dealt over tasks and sorted there, and one pass holds only the
    windows of the key at hand, so a key with very many hits is never gathered.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), []
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[at], strict=True):
                if k != now:
                    now, kept = k, [[] for _ in limits]
                out.append(step(kept, int(t), limits))
            yield batch.assign(admitted=out)

    dealt = rows.select(key, seq, at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at, seq)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {seq} {kinds[seq]}, {at} {kinds[at]}, admitted boolean")


def admitted_stream(rows: DataFrame, limits: Limits) -> DataFrame:
    """The same over a stream of (user_id bigint, event_id bigint, at bigint); hits of a micro-batch are taken in order of time."""

    def run(user: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [list(map(int, x)) for x in state.get[0]] if state.exists else [[] for _ in limits]
        for frame in frames:
            frame = frame.sort_values(["at", "event_id"])
            yield frame.assign(admitted=[step(kept, int(t), limits) for t in frame["at"]])
        state.update((kept,))

    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, at bigint, admitted boolean", "kept array<array<bigint>>", "append", GroupStateTimeout.NoTimeout)


def bounded_log_stream(rows: DataFrame, most: int = CONFIG.event_queue) -> DataFrame:
    """The newest rows of each user after every micro-batch, with how many were dropped; oldest go first. rows: user_id, event_id (bigint)."""

    def run(user: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = (list(state.get[0]), int(state.get[1])) if state.exists else ([], 0)
        for frame in frames:
            held.extend(int(x) for x in frame["event_id"])
            held.sort()
            dropped += max(0, len(held) - most)
            held = held[-most:]
        state.update((held, dropped))
        yield pd.DataFrame({"user_id": [user[0]] * len(held), "event_id": held, "dropped": [dropped] * len(held)})

    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, dropped bigint", "held array<bigint>, dropped bigint", "update", GroupStateTimeout.NoTimeout)


def sessions_stream(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of (user_id, ts) that end after a gap without events; ts without a time zone is taken as UTC."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def daily_counts_stream(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def settled_stream(rows: DataFrame, wait_seconds: int = CONFIG.grace_seconds, late: str = "1 hour") -> DataFrame:
    """Rows (user_id, event_id, at, settles) of the events that end something and are followed by none of their user within the wait: timers over event time.

    rows: user_id, event_id (bigint), ts, ends. An event that ends (the last one left,
    a text was edited) starts a timer; any later event of the user within the wait
    cancels it (someone came back, the text was edited again). It has run out once
    no event can come in time any more, by the watermark. at and settles are
    microseconds. Events may come late (up to late), out of order and repeated; what
    waits for its timer is all that is kept of a user.
    """
    wait = wait_seconds * 1_000_000
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    timed = timed.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("ends", F.lit(False)).alias("ends"))

    def run(user: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(int(a), int(e)): bool(x) for a, e, x in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            for frame in frames:
                held |= {(int(a), int(e)): bool(x) for a, e, x in zip(frame["at"], frame["event_id"], frame["ends"], strict=True)}
        passed = state.getCurrentWatermarkMs() * 1000
        order = sorted(held)
        out = []
        for i, (at, event) in enumerate(order):
            calm = i + 1 == len(order) or order[i + 1][0] > at + wait
            if held[at, event] and calm and at + wait <= passed:
                out.append((user[0], event, at, at + wait))
        # what no event can reach any more is done with
        left = [k for k in order if k[0] + wait > passed]
        if left:
            state.update(([a for a, _ in left], [e for _, e in left], [held[k] for k in left]))
            state.setTimeoutTimestamp(-(-(left[0][0] + wait) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "at", "settles"])

    return timed.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, at bigint, settles bigint", "at array<bigint>, event array<bigint>, ends array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
