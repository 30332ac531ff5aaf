"""Streaming versions of the operators that keep state; for a finite input they give what the batch versions give.

Rows of a micro-batch are put in order by (t, seq) within a session, and micro-batches follow each other: the engine
has no event-time reordering, late rows are taken as they come. State is kept by RocksDB for each session, so that a
session is bounded by its own memory only: encounters of the open window, the last document, the end of the running text."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightstream.operators.transcript import GATE_SECONDS, MAX_OVERLAP, RECENT_CHUNKS, RECENT_SECONDS, addition, ending
from sightstream.operators.windows import MAX_SIGHTINGS
from sightstream.sources import asr

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = ["t", "seq", "x", "y", "w", "h"]
ENCOUNTER = (
    "session_id long, window_no int, started_at long, ended_at long, display_id long, text_hash string, text string, first_seen long, last_seen long, seen_count long, "
    "sightings array<struct<t: long, seq: long, x: double, y: double, w: double, h: double>>, roles array<struct<role: string, n: long>>"
)
ENCOUNTER_NAMES = ["session_id", "window_no", "started_at", "ended_at", "display_id", "text_hash", "text", "first_seen", "last_seen", "seen_count", "sightings", "roles"]
SNAPSHOT = "session_id long, display_id long, seq long, t long, text_hash string, layout_hash string"
STATE = "session_id long, seq long, added string, chunks int, characters long, language string"
PAIR = "session_id long, new_chunk_id string, old_chunk_id string"

#: Commands that a row of a stream of samples can hold: a session begins anew, with windows from 1 on; memory is emptied and
#: the window begins at this time.
START, CLEAR = "start", "clear"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def normalized(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values([c for c in ("t", "seq") if c], kind="stable")


class SealedWindows(StatefulProcessor):
    """Encounters of a session's open window with their last sightings and roles, given out when a sample
    seals it. A sample's role and place, and a row's command, are optional columns."""

    def __init__(self, length: int, ttl: int, limit: int) -> None:
        self.length, self.ttl, self.limit = max(1, length), ttl, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "anchor long, number int")
        self.memory = handle.getMapState("memory", "key string", "display_id long, text_hash string, text string, first_seen long, last_seen long, seen_count long, more string")

    def _prune(self, held: dict[tuple, list], now: int) -> None:
        for k in [k for k, v in held.items() if v[4] < now - self.ttl]:
            del held[k]

    def _evict(self, held: dict[str, list], sample: tuple[int, int] | None = None) -> None:
        """Lets go what is beyond the limit, unless the last sample (t, seq) isn't over: seen least recently first, of one
        sample's texts the last by display and hash."""
        if len(held) <= self.limit:
            return
        newest = heapq.nlargest(self.limit, held, key=lambda k: (*held[k][6]["sightings"][-1][:2], -held[k][0], [-ord(c) for c in held[k][1]]))
        if sample is None or tuple(held[newest[0]][6]["sightings"][-1][:2]) != sample:
            for k in held.keys() - set(newest):
                del held[k]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: [*v[:6], json.loads(v[6])] for k, v in self.memory.iterator()}
        state = self.window.get()
        anchor, number = (state[0], state[1]) if state is not None else (None, 0)
        out = []
        for r in ordered(rows).itertuples(index=False):
            t = int(r.t)
            command = getattr(r, "command", None)
            if command in (START, CLEAR):
                held, anchor, number = {}, t if command == CLEAR else None, number if command == CLEAR else 0
                continue
            anchor = t if anchor is None else anchor
            text = (r.text or "").strip()
            norm = normalized(text)
            self._prune(held, t)
            if len(norm) > 1:
                self._evict(held, (t, int(r.seq)))
                digest = hashlib.sha256(norm.encode()).hexdigest()
                k = f"{r.display_id}|{digest}"
                if k in held:
                    held[k][4], held[k][5] = t, held[k][5] + 1
                else:
                    held[k] = [int(r.display_id), digest, text, t, t, 1, {"sightings": [], "roles": {}}]
                more, role = held[k][6], getattr(r, "role", None) or "unknown"
                more["sightings"] = [*more["sightings"], [t, int(r.seq), *(float(getattr(r, c, 0.0)) for c in "xywh")]][-MAX_SIGHTINGS:]
                more["roles"][role] = more["roles"].get(role, 0) + 1
            if t - anchor >= self.length:
                number += 1
                self._evict(held)
                out += [(key[0], number, anchor, t, *v[:6], [dict(zip(PLACE, s, strict=True)) for s in v[6]["sightings"]], [{"role": x, "n": n} for x, n in v[6]["roles"].items()]) for v in held.values()]
                held, anchor = {}, t
        if anchor is not None:
            self.window.update((anchor, number))
        else:
            self.window.clear()
        self.memory.clear()
        for k, v in held.items():
            self.memory.updateValue((k,), (*v[:6], json.dumps(v[6])))
        if out:
            yield pd.DataFrame(out, columns=ENCOUNTER_NAMES)

    def close(self) -> None:
        pass


class ChangedSnapshots(StatefulProcessor):
    """Snapshots of a display whose text or layout differs from the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "text_hash string, layout_hash string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get()
        last = tuple(state) if state is not None else None
        keep = []
        df = ordered(rows)
        for text, layout in zip(df.text_hash, df.layout_hash, strict=True):
            keep.append((text, layout) != last)
            last = (text, layout)
        self.last.update(last)
        yield df[keep][[c.split()[0] for c in SNAPSHOT.split(", ")]]

    def close(self) -> None:
        pass


def append_deduplicated(text: str, more: str, limit: int = MAX_OVERLAP) -> str:
    """A22 over plain strings."""
    return text + addition(ending(text, limit), more, limit)


class RunningTranscript(StatefulProcessor):
    """What each micro-batch adds to a session's text. State is the end of the text, however long it is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "tail string, chunks int, characters long, language string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get()
        tail, chunks, characters, language = tuple(state) if state is not None else ("", 0, 0, None)
        seq, added = None, []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if getattr(r, "command", None) in (START, CLEAR):
                tail, chunks, characters, language, seq, added = "", 0, 0, None, int(r.seq), []
                continue
            more = (r.text or "").strip()
            if more:
                part = addition(tail, more)
                tail, characters = ending(tail + part), characters + len(part)
                added.append(part)
                chunks, language, seq = chunks + 1, r.language or language, int(r.seq)
        if seq is not None:
            self.state.update((tail, chunks, characters, language))
            yield pd.DataFrame([(key[0], seq, "".join(added), chunks, characters, language)], columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


class ComparedChunks(StatefulProcessor):
    """Pairs of a chunk that comes with chunks of the other source in that source's window: the newest
    RECENT_CHUNKS, of those that end in the last RECENT_SECONDS as of its last chunk. Chunks are taken as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "source string", "held string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        windows = {k[0]: json.loads(v[0]) for k, v in self.windows.iterator()}
        found = []
        df = pd.concat(list(rows))
        df = df.assign(_end=df.start_time + df.duration).sort_values(["_end", "seq", "source", "chunk_id"], kind="stable")
        for r in df.itertuples(index=False):
            if getattr(r, "command", None) in (START, CLEAR):
                windows = {}
                continue
            start, duration = float(r.start_time), float(r.duration)
            own = [*windows.get(r.source, []), [r.chunk_id, start, duration]]
            windows[r.source] = [x for x in own if x[1] + x[2] >= start + duration - RECENT_SECONDS][-RECENT_CHUNKS:]
            for source, held in windows.items():
                for name, begin, long in held if source != r.source else ():
                    if duration + long > max(start + duration, begin + long) - min(start, begin) or abs(start - begin) < GATE_SECONDS:
                        found.append((key[0], r.chunk_id, name))
        for source, held in windows.items():
            self.windows.updateValue((source,), (json.dumps(held),))
        if not windows:
            self.windows.clear()
        if found:
            yield pd.DataFrame(found, columns=["session_id", "new_chunk_id", "old_chunk_id"])

    def close(self) -> None:
        pass


def sealed_windows(samples: DataFrame, length: int = 60, ttl: int = 60, limit: int = 1500) -> DataFrame:
    """samples: a stream of session_id, seq, t (seconds), display_id, text, and if need be role, x, y, w, h, command. What comes
    out has the columns of windows.encounters: windows.segments and windows.analysis take its micro-batches (W12-W14)."""
    use_rocksdb(samples.sparkSession)
    return samples.groupBy("session_id").transformWithStateInPandas(SealedWindows(length, ttl, limit), ENCOUNTER, "Append", "None")


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    use_rocksdb(snapshots.sparkSession)
    return snapshots.groupBy("session_id", "display_id").transformWithStateInPandas(ChangedSnapshots(), SNAPSHOT, "Append", "None")


def running_transcript(chunks: DataFrame) -> DataFrame:
    """chunks: a stream of session_id, seq, text, language, and if need be command. Each micro-batch gives what it added to a
    session's text and the session's state after it."""
    use_rocksdb(chunks.sparkSession)
    return chunks.groupBy("session_id").transformWithStateInPandas(RunningTranscript(), STATE, "Update", "None")


def compared_chunks(chunks: DataFrame) -> DataFrame:
    """chunks: a stream of session_id, source, seq, chunk_id, start_time, duration, and if need be command."""
    use_rocksdb(chunks.sparkSession)
    return chunks.groupBy("session_id").transformWithStateInPandas(ComparedChunks(), PAIR, "Append", "None")


def unseen(snapshots: DataFrame, time: str | None = None, within: str | None = None) -> DataFrame:
    """W18 on a stream: the first snapshot of each text and layout. Without a bound state grows with all that was ever seen,
    as in a store that is never pruned; within (of the column `time`) forgets what is older than that."""
    use_rocksdb(snapshots.sparkSession)
    if time and within:
        return snapshots.withWatermark(time, within).dropDuplicatesWithinWatermark(["text_hash", "layout_hash"])
    return snapshots.dropDuplicates(["text_hash", "layout_hash"])


def every(seconds: float) -> dict[str, str]:
    """The trigger of a sampler; intervals under a second become one."""
    return {"processingTime": f"{max(1, int(seconds))} seconds"}


def sampled(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def to_folder(stream: DataFrame, path: str, checkpoint: str, analyzer: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append", trigger: dict[str, Any] | None = None):  # noqa: ANN201
    """Each micro-batch, through the analyzer if given, into a folder of its own under path, so that a batch that runs
    again replaces what it wrote. trigger: every() or, by default, all that is there and no more. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        (analyzer(batch) if analyzer else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def transcribed(chunks: DataFrame, recognise: Callable[[list[float], float], str]) -> DataFrame:
    """Chunks (samples, sample_rate and others) with recognised (asr.parse of what the recogniser gives for each) and
    error. A chunk that the recogniser fails on, or gives no JSON for, gets an error and the others go on."""
    at, rate = chunks.columns.index("samples"), chunks.columns.index("sample_rate")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            found, errors = [], []
            for samples, hertz in zip(b.column(at).to_pylist(), b.column(rate).to_pylist(), strict=True):
                try:
                    found.append(recognise(samples, hertz))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a recogniser raises is that chunk's error
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "_json", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    rows = chunks.mapInArrow(run, f"{kinds}, _json string, error string").withColumn("recognised", asr.parse("_json"))
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("recognised").isNull(), F.lit("no transcription")))).drop("_json")


def live(chunks: DataFrame, recognise: Callable[[list[float], float], str], path: str, checkpoint: str, hook: Callable[[DataFrame], None] | None = None):  # noqa: ANN201
    """A stream of chunks through the recogniser into path/chunks, those with an error into path/errors; hook gets each
    micro-batch of good ones. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        at = f"{path}/judged/batch={number}"
        transcribed(batch, recognise).write.mode("overwrite").parquet(at)
        judged = batch.sparkSession.read.parquet(at)
        good = judged.where("error is null").drop("error")
        good.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        judged.where("error is not null").drop("recognised").write.mode("overwrite").parquet(f"{path}/errors/batch={number}")
        if hook:
            hook(good)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retention(stream: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """Counts of samples in time windows, for late rows within delay; later ones are dropped by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "session_id").count()
