"""The life of pipeline jobs: nine states, illegal moves reported, jobs without news failed when their time is up.

The same report comes from a table by windows and from a stream by keyed state with event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The states of a job, in order; a job may fail from any but the last two.
STATES = ("pending", "building_graph", "identifying_targets", "generating_candidates", "screening", "scoring", "reporting", "complete", "failed")
FINAL = ("complete", "failed")


def _legal(before: str | None, after: str) -> bool:
    if before is None:
        return after == STATES[0]
    if before in FINAL or after not in STATES:
        return False
    return after == "failed" or STATES.index(after) == STATES.index(before) + 1


def transitions(events: DataFrame, patience: int) -> DataFrame:
    """job_id, at, before, after, finding (ok, illegal, stale) for each event, and for each job that fell silent.

    events: job_id, at, seq, state. Events of a job are taken by at, then seq. An illegal move is told and taken all the same. A job
    in no final state that has no event for more than `patience` seconds fails at that moment, if the table's last event is as late.
    """
    w = Window.partitionBy("job_id").orderBy("at", "seq")
    seconds = lambda c: F.unix_micros(c) / 1e6
    late = events.agg(F.max("at").alias("_end"))
    held = events.select("job_id", "at", "seq", "state").withColumns({"_was": F.lag("state").over(w), "_then": F.lag("at").over(w), "_next": F.lead("at").over(w)}).join(F.broadcast(late))  # one row
    silent = lambda a, b: seconds(b) - seconds(a) > patience
    before = F.when(~F.col("_was").isin(*FINAL) & silent("_then", "at"), "failed").otherwise(F.col("_was"))
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("before")), F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    legal = F.when(F.col("before").isNull(), F.col("state") == STATES[0]).otherwise(~F.col("before").isin(*FINAL) & (place[1] > 0) & ((F.col("state") == "failed") | (place[1] == place[0] + 1)))
    moves = held.withColumn("before", before).select("job_id", "at", "before", F.col("state").alias("after"), F.when(legal, "ok").otherwise("illegal").alias("finding"))
    gone = held.where(~F.col("state").isin(*FINAL)).where(silent("at", F.coalesce("_next", F.col("_end"))))
    stale = gone.select("job_id", F.timestamp_micros(F.unix_micros("at") + patience * 1_000_000).alias("at"), F.col("state").alias("before"), F.lit("failed").alias("after"), F.lit("stale").alias("finding"))
    return moves.unionByName(stale)


def transitions_stream(events: DataFrame, patience: int, late: str = "0 seconds") -> DataFrame:
    """The same rows from a stream, each job's state in keyed state with a timer at its last event and patience.

    Events of a job may be in any order within a micro-batch; later batches bring later ones. A silent job is told when the
    watermark passes its time.
    """

    wait = patience * 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list = []
        now, last = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            out.append((key[0], last + wait, now, "failed", "stale"))
            state.update(("failed", last))
        else:
            rows = pd.concat(list(parts)).sort_values(["us", "seq"])
            for us, new in zip(rows["us"].tolist(), rows["state"], strict=True):
                if now is not None and now not in FINAL and us - last > wait:
                    out.append((key[0], last + wait, now, "failed", "stale"))
                    now = "failed"
                out.append((key[0], us, now, new, "ok" if _legal(now, new) else "illegal"))
                now, last = new, us
            state.update((now, last))
            if now not in FINAL:
                # Timers count milliseconds and must lie ahead of the watermark; a wait is over the moment after its end.
                state.setTimeoutTimestamp(max((last + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "us", "before", "after", "finding"])

    keyed = events.select("job_id", "at", F.unix_micros("at").alias("us"), "seq", "state").withWatermark("at", late).groupBy("job_id")
    told = keyed.applyInPandasWithState(step, "job_id long, us long, before string, after string, finding string", "state string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("job_id", F.timestamp_micros("us").alias("at"), "before", "after", "finding")
