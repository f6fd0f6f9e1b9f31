"""Job states, gestures and undo stacks as Structured Streaming queries.

Events are rows (event_id, user_id, ts, event_type, value). The same functions read a stream or
a table where they need no state of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Event types of the stand-in table and the job states they stand for.
STATES = {"view": "Pending", "click": "Running", "purchase": "Done", "signup": "Failed"}
ALLOWED = {None: {"Pending"}, "Pending": {"Running"}, "Running": {"Done", "Failed"}, "Failed": {"Running"}, "Done": set()}
UNDO_LIMIT = 50


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """One row for each user and open gesture: events closer than the gap are one step."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, steps = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event in rows["event_type"]:
        wanted = STATES.get(event)
        if wanted in ALLOWED[status]:
            status, steps = wanted, steps + 1
    state.update((status, steps))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "steps": [steps]})


def machine(events: DataFrame) -> DataFrame:
    """user_id, status, steps after each micro-batch; events that the state doesn't allow change nothing."""
    return events.groupBy("user_id").applyInPandasWithState(_advance, "user_id long, status string, steps long", "status string, steps long", "update", GroupStateTimeout.NoTimeout)


def _stacks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    undo, redo = (list(x) for x in state.get) if state.exists else ([], [])
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event, value in zip(rows["event_type"], rows["value"], strict=True):
        if event == "click" and undo:
            redo.append(undo.pop())
        elif event == "signup" and redo:
            undo.append(redo.pop())
        elif event not in ("click", "signup"):
            undo, redo = [*undo, float(value)][-UNDO_LIMIT:], []
    state.update((undo, redo))
    yield pd.DataFrame({"user_id": [key[0]], "undo": [len(undo)], "redo": [len(redo)]})


def undo_stacks(events: DataFrame) -> DataFrame:
    """user_id, undo, redo: sizes of bounded stacks; an edit clears what could be redone."""
    return events.groupBy("user_id").applyInPandasWithState(_stacks, "user_id long, undo long, redo long", "undo array<double>, redo array<double>", "update", GroupStateTimeout.NoTimeout)


def claim(batch: DataFrame) -> DataFrame:
    """The oldest pending row of each kind in a micro-batch: a single writer needs no row locks."""
    return batch.groupBy("event_type").agg(F.min_by(F.struct("event_id", "user_id"), F.struct("ts", "event_id")).alias("x")).select("event_type", "x.*")
