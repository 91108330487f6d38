"""Sliding-window rate limit: a call is accepted if fewer than N *accepted* calls lie in the last P seconds.

Rejected calls leave no trace, so a range window over all calls would be wrong.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark import rules


def accept(times, recent: deque, calls: int, period_us: int) -> list[bool]:
    """Decide calls in time order (microseconds); ``recent`` holds accepted times and is updated."""
    out = []
    for now in times:
        while recent and now - recent[0] >= period_us:
            recent.popleft()
        ok = len(recent) < calls
        if ok:
            recent.append(now)
        out.append(ok)
    return out


def rate_limit(log: DataFrame, preset: str | tuple[int, int] = "strict", user: str = "user_id", ts: str = "ts",
               tie: str = "event_id") -> DataFrame:
    """Batch form: add ``accepted``.

    A stretch of calls is independent of everything before a quiet time of one period. Stretches are
    found on one row per (user, period), so a busy user is first reduced and then split at each quiet
    time. A stretch is read in time order as a stream of batches and only its last N accepted times
    are held, so memory does not grow with it.
    """
    calls, period = rules.RATE_LIMITS[preset] if isinstance(preset, str) else preset
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(micros / F.lit(period * 1_000_000))
    rows = log.withColumns({"_us": micros, "_slot": slot})
    w = Window.partitionBy(user).orderBy("_slot")
    slots = rows.select(user, "_slot").distinct()
    # an empty slot in between is a whole quiet period
    slots = slots.withColumn("_new", F.coalesce(F.col("_slot") - F.lag("_slot").over(w) > 1, F.lit(False)).cast("int"))
    slots = slots.withColumn("_run", F.sum("_new").over(w)).drop("_new")
    keyed = rows.join(slots, [user, "_slot"]).drop("_slot")
    ordered = keyed.repartition(F.col(user), F.col("_run")).sortWithinPartitions(user, "_run", "_us", tie)
    keep = log.columns
    schema = T.StructType(log.schema.fields + [T.StructField("accepted", T.BooleanType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for pdf in batches:
            flags = []
            for u, run, now in zip(pdf[user], pdf["_run"], pdf["_us"]):
                if (u, run) != current:
                    current, recent = (u, run), deque()
                flags += accept([now], recent, calls, period * 1_000_000)
            yield pdf[keep].assign(accepted=flags)

    return ordered.mapInPandas(scan, schema)


def rate_limit_stream(stream: DataFrame, preset: str | tuple[int, int] = "strict", user: str = "user_id",
                      ts: str = "ts", tie: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Streaming form: (user, tie, ts, accepted). State is the last N accepted times of a user.

    A user's state is dropped once the watermark is a period past the last accepted call.
    """
    calls, period = rules.RATE_LIMITS[preset] if isinstance(preset, str) else preset
    rows = stream.select(user, tie, F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    schema = T.StructType(rows.schema.fields + [T.StructField("accepted", T.BooleanType())])

    def decide(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        parts = list(frames)  # one micro-batch of one user
        pdf = pd.concat(parts).sort_values(["ts", tie], kind="stable")
        micros = (pdf["ts"].astype("int64") // _per_micro(pdf["ts"])).tolist()
        flags = accept(micros, recent, calls, period * 1_000_000)
        state.update((list(recent),))
        if recent:
            state.setTimeoutTimestamp(max(recent[-1] // 1000 + period * 1000, state.getCurrentWatermarkMs() + 1))
        yield pdf[[user, tie, "ts"]].assign(accepted=flags)

    return rows.groupBy(user).applyInPandasWithState(
        decide, schema, "accepted array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def _per_micro(s: pd.Series) -> int:
    return 1000 if "[ns" in str(s.dtype) else 1
