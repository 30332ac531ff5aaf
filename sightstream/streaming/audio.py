"""Packets of sound in a stream, as chunks that overlap (A1-A5): a buffer of frames for each source, in keyed state.

A packet's frames go to the end of its source's buffer; as soon as a chunk is whole it is given out, and the buffer moves on
by a chunk less the overlap. What is left waits for the next micro-batch: state is less than a chunk and a packet long,
however long the source is. Packets may be split over micro-batches in any way; chunks, errors and what waits in the
end are those of operators.audio over all of them. A packet whose number is below one that was taken before is late: the
frames after it are given out or placed already, so it gets an error."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightstream.operators.audio import CHUNK_SECONDS, OVERLAP_SECONDS
from sightstream.streaming.processors import use_rocksdb

#: What a row of buffered() is: a whole chunk; a packet that was refused; how much waits, once a micro-batch and source.
CHUNK, ERROR, WAITING = "chunk", "error", "waiting"

ROW = "kind string, seq long, start_frame long, samples array<float>, sample_rate double, channels int, packet_id long, error string, frames long, duration double"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


class FrameBuffer(StatefulProcessor):
    """State of a source: its format (that of its first packet), the place of the buffer's first frame, the next chunk's number
    and the last packet's; the buffered frames, a part for each packet since the last chunk was given out."""

    def __init__(self, seconds: float, overlap: float) -> None:
        if not 0 <= overlap < seconds:
            raise ValueError("0 <= overlap < seconds is needed")
        self.seconds, self.overlap = seconds, overlap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "sample_rate double, channels int, start long, seq long, last long")
        self.parts = handle.getListState("parts", "samples binary")

    def _refused(self, r: Any, rate: float, channels: int, last: int | None) -> str | None:
        if r.channels <= 0 or r.sample_rate <= 0:
            return "bad format"
        if len(r.samples) % r.channels:
            return "bad layout"
        if (r.sample_rate, r.channels) != (rate, channels):
            return "format changed"
        return "late packet" if last is not None and r.packet_id < last else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows)).sort_values("packet_id", kind="stable")
        df = df[[x is not None and len(x) > 0 for x in df["samples"]]]
        if not len(df):
            return
        state = self.place.get()
        if state is not None:
            rate, channels, start, seq, last = tuple(state)
        else:
            rate, channels, start, seq, last = float(df["sample_rate"].iloc[0]), int(df["channels"].iloc[0]), 0, 0, None
        out, fresh = [], []
        for r in df.itertuples(index=False):
            if error := self._refused(r, rate, channels, last):
                out.append((key[0], ERROR, None, None, None, r.sample_rate, r.channels, r.packet_id, error, None, None))
            else:
                fresh.append(np.asarray(r.samples, np.float32))
                last = int(r.packet_id)
        if fresh:
            size = max(1, half_up(self.seconds * rate))
            hop = max(1, size - half_up(self.overlap * rate))
            held = [np.frombuffer(p[0], np.float32) for p in self.parts.get()]
            n = sum(map(len, held + fresh)) // channels
            drained = (n - size) // hop + 1 if n >= size else 0
            if drained:
                buffer = np.concatenate(held + fresh)
                for k in range(drained):
                    at = k * hop
                    out.append((key[0], CHUNK, seq + k, start + at, buffer[at * channels : (at + size) * channels], rate, channels, None, None, None, None))
                self.parts.put([(buffer[drained * hop * channels :].tobytes(),)])
                start, seq, n = start + drained * hop, seq + drained, n - drained * hop
            else:
                self.parts.appendList([(x.tobytes(),) for x in fresh])
            out.append((key[0], WAITING, None, start, None, rate, channels, None, None, n, n / rate))
        self.place.update((rate, channels, start, seq, last))
        table = pd.DataFrame(out, columns=["source", *NAMES])
        yield table.astype({c: "Int64" for c in ("seq", "start_frame", "packet_id", "frames")})

    def close(self) -> None:
        pass


def buffered(packets: DataFrame, seconds: float = CHUNK_SECONDS, overlap: float = OVERLAP_SECONDS) -> DataFrame:
    """packets: a stream of packet_id, source, samples, sample_rate, channels -> source and ROW."""
    use_rocksdb(packets.sparkSession)
    kind = packets.schema["source"].dataType.simpleString()
    rows = packets.select("source", F.col("packet_id").cast("long").alias("packet_id"), F.col("samples").cast("array<float>").alias("samples"), F.col("sample_rate").cast("double").alias("sample_rate"), F.col("channels").cast("int").alias("channels"))
    return rows.groupBy("source").transformWithStateInPandas(FrameBuffer(seconds, overlap), f"source {kind}, {ROW}", "Append", "None")


def chunks(rows: DataFrame) -> DataFrame:
    """A2-A4: the chunks among rows of buffered(), with the columns of operators.audio.chunks."""
    return rows.where(F.col("kind") == CHUNK).select("source", "seq", "start_frame", "sample_rate", "channels", "samples")


def errors(rows: DataFrame) -> DataFrame:
    """A1: packets that were refused."""
    return rows.where(F.col("kind") == ERROR).select("source", "packet_id", "sample_rate", "channels", "error")


def available(rows: DataFrame) -> DataFrame:
    """A5: source, frames and duration that wait, as of the last micro-batch of each source in rows."""
    last = rows.where(F.col("kind") == WAITING).groupBy("source").agg(F.max_by(F.struct("frames", "duration"), "start_frame").alias("w"), F.max("start_frame"))
    return last.select("source", "w.frames", "w.duration")
