"""The job lifecycle as a fold over each job's ordered events.

State is one small struct, so the fold is an `aggregate` over a job's events in
the JVM; the streaming form in `rosterlake.streaming` uses the same rules.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("queued", "running", "succeeded", "failed", "cancel_requested", "cancelled", "interrupted", "needs_attention")
ACTIVE = ("queued", "running", "cancel_requested")
TERMINAL = ("succeeded", "failed", "cancelled", "needs_attention")
#: (event, states that it applies in, next state); the first rule that fits applies, else the event is refused.
RULES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("begin", ("", "succeeded", "failed", "cancelled", "interrupted", "needs_attention"), "running"),
    ("complete", ("running",), "succeeded"),
    ("complete", ("cancel_requested",), "cancelled"),
    ("fail", ("running", "cancel_requested"), "failed"),
    ("cancel", ("running",), "cancel_requested"),
    ("cancel", ("queued", "interrupted"), "cancelled"),
)
#: Events that leave a state as it is without being refused.
IDLE: tuple[tuple[str, tuple[str, ...]], ...] = (("progress", ("running", "cancel_requested")), ("complete", ("succeeded",)), ("fail", ("failed",)), ("cancel", ("cancel_requested", *TERMINAL)))


def next_state(state: str, event: str) -> tuple[str, bool]:
    """(state after the event, whether it was accepted)."""
    for name, states, to in RULES:
        if event == name and state in states:
            return to, True
    return state, any(event == name and state in states for name, states in IDLE)


def _next(state: Column, event: Column) -> tuple[Column, Column]:
    to, accepted = state, F.lit(False)
    for name, states in IDLE:
        accepted = accepted | ((event == name) & state.isin(*states))
    for name, states, new in reversed(RULES):
        fits = (event == name) & state.isin(*states)
        to, accepted = F.when(fits, F.lit(new)).otherwise(to), accepted | fits
    return to, accepted


def fold(events: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """(key, state, attempts, refused, n_events) of each job after its events in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(event).alias("event"))))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        to, accepted = _next(acc["state"], e["event"])
        began = accepted & (e["event"] == "begin")
        return F.struct(to.alias("state"), (acc["attempts"] + began.cast("int")).alias("attempts"), (acc["refused"] + (~accepted).cast("int")).alias("refused"))

    folded = events.groupBy(key).agg(F.aggregate(ordered, start, step).alias("x"), F.count("*").alias("n_events"))
    return folded.select(key, "x.state", "x.attempts", "x.refused", "n_events")


def recover(jobs: DataFrame, most: int = 3) -> DataFrame:
    """After a restart: active safe jobs are interrupted, at most `most` times, then failed; unsafe ones need attention."""
    safe = F.col("safety").isin("safe_idempotent_read", "local_idempotent")
    active = F.col("state").isin(*ACTIVE)
    state = F.when(active & safe & (F.col("recoveries") < most), "interrupted").when(active & safe, "failed").when(active, "needs_attention").otherwise(F.col("state"))
    return jobs.withColumns({"state": state, "recoveries": F.when(active & safe, F.col("recoveries") + 1).otherwise(F.col("recoveries"))})


def summary(jobs: DataFrame) -> DataFrame:
    """(state, n) of every state, zeros included."""
    names = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return names.join(jobs.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def prune(jobs: DataFrame, most: int) -> DataFrame:
    """The oldest finished jobs go until `most` are left; unfinished ones always stay."""
    excess = max(0, jobs.count() - most)
    oldest = jobs.filter(F.col("state").isin("succeeded", "failed", "cancelled")).orderBy("updated_at", "id").limit(excess).select("id")
    return jobs.join(oldest, "id", "left_anti")


def job_id(kind: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", kind, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


# Executors need not have this package: its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
