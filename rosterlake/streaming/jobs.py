"""Streams: the job lifecycle with kept state, rates in event-time windows, idempotent keyed sinks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import next_state
from ..operators.store import latest_wins


def job_states(events: DataFrame) -> DataFrame:
    """events (job, at, event) to (job, state, attempts, refused) after each batch; state is three fields for each job."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, attempts, refused = state.get if state.exists else ("", 0, 0)
        rows = pd.concat(list(frames))
        for event in rows.sort_values("at")["event"]:
            name, accepted = next_state(name, event)
            attempts += accepted and event == "begin"
            refused += not accepted
        state.update((name, int(attempts), int(refused)))
        yield pd.DataFrame({"job": [key[0]], "state": [name], "attempts": [int(attempts)], "refused": [int(refused)]})

    return events.groupBy("job").applyInPandasWithState(advance, "job long, state string, attempts long, refused long", "name string, attempts long, refused long", "update", GroupStateTimeout.NoTimeout)


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, event_type, n) by event time; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def keyed_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key; a batch replayed after a failure changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        old = read()
        changes = batch if old is None else old.unionByName(batch)
        write(latest_wins(changes.dropDuplicates(), key, order).drop("revision"))

    return apply


# Executors need not have this package: its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
