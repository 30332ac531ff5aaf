"""Samples of several displays in a stream (S6, W15, W16): frames as they come, in any order within `wait` seconds of each other.

State of a session is the cache of frames of each display (operators.framecache), kept no longer than its documents, and the
samples that lack a display. A sample is given out when its last display has come, or by a timer of event time once the
watermark is `wait` seconds past its first frame: then without those that never came, and marked so. A frame that comes later
still is given out by itself, as late. The recogniser hears only of frames that a cache lacks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightstream.operators.framecache import FrameCache, Recogniser
from sightstream.operators.memory import CACHE_SECONDS, CACHE_SIZE
from sightstream.streaming.processors import use_rocksdb

FRAME = "display_id long, seq long, t long, frame_hash string, text string, text_hash string, layout_hash string"
SAMPLE = "seq long, t long, displays long, reused long, recognised long, text string, status string"
NAMES = [c.split()[0] for c in SAMPLE.split(", ")]
COMPLETE, INCOMPLETE, LATE = "complete", "incomplete", "late"


class Samples(StatefulProcessor):
    def __init__(self, expected: int, wait: int, max_age: int, limit: int, recognise: Recogniser | None) -> None:
        self.expected, self.wait, self.max_age, self.limit, self.recognise = expected, wait, max_age, limit, recognise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.caches = handle.getMapState("caches", "display_id long", "cache binary")
        self.open = handle.getMapState("open", "seq long", "sample binary")
        self.closed = handle.getMapState("closed", "seq long", "at long")

    def _row(self, key: Any, seq: int, parts: dict, status: str) -> tuple:
        texts = [f"Display {i}\n{text}" for i, (_, text, _) in sorted(parts.items()) if text]
        reused = sum(r for _, _, r in parts.values())
        return (key[0], seq, min(t for t, _, _ in parts.values()), len(parts), reused, len(parts) - reused, "\n\n".join(texts), status)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        caches: dict[int, FrameCache] = {}
        out = []
        df = pd.concat(list(rows))
        for row in df.astype(object).where(df.notna(), None).sort_values(["t", "seq", "display_id"], kind="stable").to_dict("records"):
            display, seq = int(row["display_id"]), int(row["seq"])
            if display not in caches:
                held = self.caches.getValue((display,))
                caches[display] = pickle.loads(held[0]) if held is not None else FrameCache(self.max_age, self.limit)  # noqa: S301  own state
            document, reused = caches[display].serve(row, self.recognise)
            part = (int(row["t"]), document.text, reused)
            if self.closed.containsKey((seq,)):
                out.append(self._row(key, seq, {display: part}, LATE))
                continue
            held = self.open.getValue((seq,))
            parts = pickle.loads(held[0]) if held is not None else {}  # noqa: S301
            if held is None:
                self.handle.registerTimer((part[0] + self.wait) * 1000)
            parts[display] = part
            if len(parts) >= self.expected:
                out.append(self._row(key, seq, parts, COMPLETE))
                self._close(seq, parts)
            else:
                self.open.updateValue((seq,), (pickle.dumps(parts),))
        for display, cache in caches.items():
            self.caches.updateValue((display,), (pickle.dumps(cache),))
        if out:
            yield pd.DataFrame(out, columns=["session_id", *NAMES])

    def _close(self, seq: int, parts: dict) -> None:
        if self.open.containsKey((seq,)):
            self.open.removeKey((seq,))
        self.closed.updateValue((seq,), (min(t for t, _, _ in parts.values()),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.wait
        out = []
        for seq, held in [(k[0], v[0]) for k, v in self.open.iterator()]:
            parts = pickle.loads(held)  # noqa: S301
            if min(t for t, _, _ in parts.values()) <= due:
                out.append(self._row(key, seq, parts, INCOMPLETE))
                self._close(seq, parts)
        for seq in [k[0] for k, v in self.closed.iterator() if v[0] < due - max(self.max_age, self.wait)]:
            self.closed.removeKey((seq,))
        for display, held in [(k[0], v[0]) for k, v in self.caches.iterator()]:
            cache = pickle.loads(held)  # noqa: S301
            cache.expire(due)
            if not cache.documents and cache.current is None:
                self.caches.removeKey((display,))
        if out:
            yield pd.DataFrame(out, columns=["session_id", *NAMES])

    def close(self) -> None:
        pass


def samples(frames: DataFrame, expected: int, wait: int = 5, max_age: int = CACHE_SECONDS, limit: int = CACHE_SIZE, recognise: Recogniser | None = None) -> DataFrame:
    """frames: a stream of session_id and FRAME (text and the hashes may be null where recognise gives them) with a watermark on
    `at`, the timestamp of t. expected: displays of a sample. -> session_id and SAMPLE."""
    use_rocksdb(frames.sparkSession)
    kind = frames.schema["session_id"].dataType.simpleString()
    rows = frames.select("session_id", *(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FRAME.split(", ")), "at")
    return rows.groupBy("session_id").transformWithStateInPandas(Samples(expected, wait, max_age, limit, recognise), f"session_id {kind}, {SAMPLE}", "Append", "EventTime")
