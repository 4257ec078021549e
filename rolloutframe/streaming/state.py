"""Tool state of rollouts as streams: what each call sees at its time.

The batch twin is :func:`rolloutframe.operators.rollouts.variables_at`. Both
agree where the turns of a rollout arrive in order; turns of one micro-batch may
stand in any order. A rollout ends at its first error or its first row without a
tool, and its state goes then, but for the mark that it is over; with ``idle``,
the state of a rollout that has been silent for so long goes as well.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _is_name(text: str | None) -> bool:
    return bool(text) and (text[0].isalpha() or text[0] == "_") and all(c.isalnum() or c == "_" for c in text)


class Variables(StatefulProcessor):
    """A map of each rollout's variables, and whether the rollout is over."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "name string", "value double")
        self.over = handle.getValueState("over", "over boolean")

    def _silence(self, now: int) -> None:
        """One timer a rollout, moved on by each batch."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """One key's rows of one micro-batch."""
        if self.over.exists():
            return
        found = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            tool = None if pd.isna(row.tool) else row.tool
            if tool is None or tool == "error":
                self.over.update((True,))
                self.values.clear()
                break
            name = None if pd.isna(row.name) else row.name
            if tool == "define_variable" and _is_name(name):
                self.values.updateValue((name,), (None if pd.isna(row.value) else float(row.value),))
            elif tool == "get_variable":
                known = _is_name(name) and self.values.containsKey((name,))
                error = f"Invalid variable name: '{name or ''}'" if not _is_name(name) else None if known else f"Variable '{name}' not defined"
                found.append((key[0], row.seq, name, self.values.getValue((name,))[0] if known else None, error))
        if self.idle is not None:
            self._silence(timerValues.getCurrentProcessingTimeInMs())
        if found:
            yield pd.DataFrame(found, columns=["rollout_id", "seq", "name", "value", "error"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.values.clear()
        self.over.clear()
        yield from ()


def variables_at(log: DataFrame, idle: int | None = None) -> DataFrame:
    """(rollout_id, seq, name, value, error) of every ``get_variable`` call of a stream (rollout_id, seq, tool, name, value).

    ``idle``: after so many milliseconds without a turn a rollout's state goes;
    such a stream looks at its clock for ever and ends only when it is stopped.
    The state store must be ``PROVIDER``.
    """
    # the driver's own worker for state schemas has no added files, so the processor travels whole
    register_pickle_by_value(sys.modules[__name__])
    kinds = dict(log.dtypes)
    rows = log.select("rollout_id", "seq", "tool", "name", log["value"].cast("double").alias("value"))
    return rows.groupBy("rollout_id").transformWithStateInPandas(
        Variables(idle), f"rollout_id {kinds['rollout_id']}, seq {kinds['seq']}, name string, value double, error string",
        outputMode="Update", timeMode="None" if idle is None else "ProcessingTime",
    )
