"""Rows that come late, told and kept instead of dropped.

Spark's watermark drops what is behind it and says only how many rows that were. Here each key has its own: the newest time that
earlier micro-batches have brought, less `delay`. A row behind it goes on with the time that it missed the watermark by, so
that a sink can write results and late rows beside each other, in one version."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightstream.streaming.processors import use_rocksdb

LATE_BY = "late_by"


class Punctual(StatefulProcessor):
    """State of a key is the newest time it has seen. Rows of one micro-batch don't make each other late."""

    def __init__(self, delay: float) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "time double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.newest.get()
        newest = state[0] if state is not None else None
        bound = None if newest is None else newest - self.delay
        for df in rows:
            t = df.iloc[:, -1].astype("float64")
            by = pd.Series([None] * len(df), df.index, dtype="float64") if bound is None else (bound - t).where(t < bound)
            if t.notna().any():
                newest = max(t.max(), newest if newest is not None else t.max())
            yield df.iloc[:, :-1].assign(**{LATE_BY: by})
        if newest is not None:
            self.newest.update((float(newest),))

    def close(self) -> None:
        pass


def with_lateness(stream: DataFrame, keys: list[str], time: str, delay: float) -> DataFrame:
    """The rows of stream and late_by: null, or the seconds by which `time` (seconds, or a timestamp) is behind the key's watermark.
    A row without a time is never late."""
    use_rocksdb(stream.sparkSession)
    rows = stream.select("*", F.col(time).cast("double").alias("_time"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return rows.groupBy(*keys).transformWithStateInPandas(Punctual(delay), f"{kinds}, {LATE_BY} double", "Append", "None")


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in time, without late_by; late ones, with it) of rows of with_lateness."""
    late = F.col(LATE_BY).isNotNull()
    return rows.where(~late).drop(LATE_BY), rows.where(late)
