"""Utterances that two sources share, scored as their chunks come.

State of a session is the window of each source: its newest chunks with the words, and if need be the samples, that a score
needs, how many chunks the source has had, and which pairs and chunks of the windows were found before. What leaves a window
can't be in another pair, so it is forgotten; state is 20 chunks a source, however long the session is. Chunks that come in
the order of their ends, in any split into micro-batches, give what operators.transcript.duplicates and first_annotation do."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightstream.operators.transcript import DUPLICATE, GATE_SECONDS, RECENT_CHUNKS, RECENT_SECONDS, with_words
from sightstream.streaming.processors import CLEAR, START, use_rocksdb

FOUND = "primary_id string, duplicate_id string, confidence double, signals array<string>, time double, seq long, rank long, first boolean"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


class Chunk(NamedTuple):
    """What is held of a chunk."""

    chunk_id: str
    source: str
    start: float
    duration: float
    seq: int
    rank: int
    language: str | None
    n_words: int
    spoken: str
    words: frozenset
    samples: np.ndarray | None
    rate: float | None

    @property
    def end(self) -> float:
        return self.start + self.duration


def same_utterance(a: Chunk, b: Chunk) -> bool:
    """A16"""
    if not a.spoken or not b.spoken:
        return False
    short, long = sorted((a.spoken, b.spoken), key=len)
    smaller = min(len(a.words), len(b.words))
    return a.spoken == b.spoken or (len(short) >= 24 and short in long) or (smaller >= 4 and len(a.words & b.words) / smaller >= 0.82)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """A15, summed in the order of the samples."""
    n = min(len(a), len(b))
    x, y = a[:n].astype(np.float64), b[:n].astype(np.float64)
    total = lambda v: float(np.cumsum(v)[-1]) if n else 0.0
    energy = (total(x * x) * total(y * y)) ** 0.5
    return abs(total(x * y)) / energy if energy > 0 else 0.0


def near(new: Chunk, old: Chunk) -> bool:
    """They overlap, or begin at nearly one time."""
    return new.duration + old.duration > max(new.end, old.end) - min(new.start, old.start) or abs(new.start - old.start) < GATE_SECONDS


def score(new: Chunk, old: Chunk, pcm: bool) -> tuple[float, list[str]]:
    """A19"""
    ratio = new.duration / old.duration if old.duration > 0 else 0.0
    tests = [
        ("time_overlap", 0.10, abs(new.start - old.start) < 0.3),
        ("duration_match", 0.05, 0.85 < ratio < 1.15),
        ("language_match", 0.05, new.language is not None and new.language == old.language),
        ("text_jaccard", 0.45, same_utterance(new, old)),
    ]
    if pcm:
        heard = new.samples is not None and old.samples is not None and len(new.samples) and len(old.samples) and new.rate is not None and new.rate == old.rate
        tests.append(("pcm_correlation", 0.35, bool(heard) and correlation(new.samples, old.samples) >= 0.50))
    total = 0.0
    for _, points, true in tests:
        total += points if true else 0.0
    filler = new.n_words < 3 or old.n_words < 3
    return min(1.0, total * 0.3 if filler else total), [name for name, _, true in tests if true] + ["filler_penalty"] * filler


class ScoredPairs(StatefulProcessor):
    def __init__(self, first: str, second: str, pcm: bool) -> None:
        self.sources, self.pcm = (first, second), pcm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "source string", "held binary")
        self.found = handle.getValueState("found", "pairs binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        windows: dict[str, tuple[int, list[Chunk]]] = {k[0]: pickle.loads(v[0]) for k, v in self.windows.iterator()}  # noqa: S301  own state
        held = self.found.get()
        pairs, annotated = pickle.loads(held[0]) if held is not None else (set(), set())  # noqa: S301
        df = pd.concat(list(rows))
        df = df.assign(_end=df.start_time + df.duration).sort_values(["_end", "seq", "source", "chunk_id"], kind="stable")
        out = []
        for r in df.itertuples(index=False):
            if getattr(r, "command", None) in (START, CLEAR):
                windows, pairs, annotated = {}, set(), set()
                continue
            if r.source not in self.sources or pd.isna(r.start_time) or pd.isna(r.duration):
                continue
            many, own = windows.get(r.source, (0, []))
            samples = getattr(r, "samples", None)
            new = Chunk(r.chunk_id, r.source, float(r.start_time), float(r.duration), int(r.seq), many + 1, r.language, int(r.n_words), r.spoken, frozenset(r.distinct_words), None if samples is None else np.asarray(samples, np.float32), getattr(r, "sample_rate", None))
            windows[r.source] = many + 1, [x for x in [*own, new] if x.end >= new.end - RECENT_SECONDS][-RECENT_CHUNKS:]
            other = self.sources[r.source == self.sources[0]]
            for old in windows.get(other, (0, []))[1]:
                if not near(new, old):
                    continue
                confidence, signals = score(new, old, self.pcm)
                if confidence < DUPLICATE:
                    continue
                primary, duplicate = sorted((new, old), key=lambda c: (c.start, c.source != self.sources[0], c.chunk_id))
                pair = (primary.chunk_id, duplicate.chunk_id)
                if pair not in pairs:
                    out.append((key[0], *pair, confidence, signals, new.end, new.seq, old.rank, duplicate.chunk_id not in annotated))
                    pairs.add(pair)
                    annotated.add(duplicate.chunk_id)
        there = {c.chunk_id for _, w in windows.values() for c in w}
        self.windows.clear()
        for source, window in windows.items():
            self.windows.updateValue((source,), (pickle.dumps(window),))
        self.found.update((pickle.dumps(({p for p in pairs if there.issuperset(p)}, annotated & there)),))
        if out:
            yield pd.DataFrame(out, columns=["session_id", *NAMES])

    def close(self) -> None:
        pass


def scored_pairs(chunks: DataFrame, first: str = "computer", second: str = "microphone", pcm: bool = False) -> DataFrame:
    """Chunks: a stream of session_id, source, seq, chunk_id, start_time, duration, language, text, with pcm samples and
    sample_rate, and if need be command. -> session_id and FOUND: each duplicate as it is found, once; time, seq and rank tell
    when, as operators.transcript.duplicates has it in `at`; first: whether it is the duplicate's first."""
    use_rocksdb(chunks.sparkSession)
    kind = chunks.schema["session_id"].dataType.simpleString()
    named = {"session_id", "source", "seq", "chunk_id", "start_time", "duration", "language", "command", *(("samples", "sample_rate") if pcm else ())}
    rows = with_words(chunks.withColumn("text", F.coalesce("text", F.lit("")))).select(*(c for c in chunks.columns if c in named), "n_words", "spoken", "distinct_words")
    return rows.groupBy("session_id").transformWithStateInPandas(ScoredPairs(first, second, pcm), f"session_id {kind}, {FOUND}", "Append", "None")


def annotations(found: DataFrame) -> DataFrame:
    """Of rows of scored_pairs, session_id, chunk_id, duplicate_of and duplicate_confidence."""
    return found.where("first").select("session_id", F.col("duplicate_id").alias("chunk_id"), F.col("primary_id").alias("duplicate_of"), F.col("confidence").alias("duplicate_confidence"))
