"""A24 as a whole: packets of sound in; chunks, transcript, errors and how far each source has come out.

A micro-batch's packets go through the buffer of frames (streaming.audio); its chunks are made mono at one rate, trimmed to
their voiced span and recognised; what each adds to its source's text is told by the end of that text, which is a table of
the sink like the others. The tables of a micro-batch become visible together, or not at all (streaming.sink).

recognised_chunks and transcript are the same functions for a table of all packets, so that a stream gives its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightstream.functions.text import trimmed
from sightstream.operators import audio as A
from sightstream.operators.storage import numbered
from sightstream.operators.transcript import addition, ending
from sightstream.sources import asr
from sightstream.streaming import audio as S
from sightstream.streaming.processors import transcribed
from sightstream.streaming.sink import Sink

SEGMENTS = "array<struct<start_time: double, end_time: double, text: string>>"
STATE = "tail string, chunks long, characters long, language string"
PART = "seq long, no long, part string"


def schemas(source: str = "string") -> dict[str, str]:
    """Tables of a live loop whose sources have this type."""
    return {
        "chunks": f"id long, source {source}, seq long, chunk_id string, start_time double, end_time double, language string, text string, segments {SEGMENTS}",
        "transcript": f"source {source}, {PART}",
        "errors": f"source {source}, packet_id long, seq long, error string",
        "state": f"source {source}, {STATE}",
    }


def recognised_chunks(chunks: DataFrame, recognise: Callable[[list[float], float], str], rate: float = A.RATE) -> DataFrame:
    """Chunks of operators.audio.chunks -> source, seq, chunk_id, start_time, end_time, language, text,
    segments, error. A chunk without a voice isn't recognised; segments are on the source's time, the trimmed part's own
    beginning added."""
    spoken = A.voice(A.normalized(chunks.withColumn("_duration", F.size("samples") / F.col("channels") / F.col("sample_rate")).withColumn("_start", F.col("start_frame") / F.col("sample_rate")), rate))
    rows = spoken.select("source", "seq", "_start", "_duration", "error", F.coalesce(F.col("voiced.start"), F.lit(0)).alias("_from"), F.col("trimmed").alias("samples"), "sample_rate")
    # what stands before such a step is computed once a row; else it would be written into the filter, and the parsed document into each of its uses
    rows = rows.mapInArrow(lambda batches: batches, rows.schema)
    heard = transcribed(rows.where("error is null").drop("error"), recognise).select("source", "seq", "_start", "_duration", (F.col("_from") / F.col("sample_rate")).alias("_from"), "recognised.*", "error").drop("duration")
    heard = heard.mapInArrow(lambda batches: batches, heard.schema)
    moved = F.transform("segments", lambda s: F.struct((s.start_time + F.col("_from")).alias("start_time"), (s.end_time + F.col("_from")).alias("end_time"), s.text.alias("text")))
    chunk = asr.transcript_chunk(F.col("source").cast("string"), F.col("seq"), F.col("_start"), F.col("_duration"), moved)
    good = heard.withColumn("_c", chunk).select("source", "seq", "_c.chunk_id", "_c.start_time", "_c.end_time", "language", "text", F.when(F.col("error").isNull(), F.col("_c.segments")).cast(SEGMENTS).alias("segments"), "error")
    silent = rows.where("error is not null").select("source", "seq", *(F.lit(None).cast(t).alias(c) for c, t in (("chunk_id", "string"), ("start_time", "double"), ("end_time", "double"), ("language", "string"), ("text", "string"), ("segments", SEGMENTS))), "error")
    return good.union(silent)


def transcript(chunks: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what each chunk adds to its source's text; the state after them) of chunks (source, seq, text, language) that
    come after what state (source, STATE) tells. A source's chunks are taken in the order of their numbers, blank ones left
    out; both come from one table, since the one has to be read for the other."""
    kind = chunks.schema["source"].dataType.simpleString()
    new = chunks.select("source", F.lit(1).alias("_at"), F.col("seq").cast("long").alias("seq"), trimmed("text").alias("text"), F.col("language").cast("string").alias("language"), F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("characters")).where("text <> ''")
    old = state.join(new.select("source").distinct(), "source", "left_semi").select("source", F.lit(0).alias("_at"), F.lit(-1).cast("long").alias("seq"), F.col("tail").alias("text"), "language", "chunks", "characters")
    dealt = old.union(new).repartition("source").sortWithinPartitions("source", "_at", "seq", "text", "language")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sources one after another, in order: only the end of a text is held."""
        source: Any = None
        tail, no, characters, language = "", 0, 0, None

        def ended() -> tuple:
            return (source, None, None, None, tail, no, characters, language)

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.source != source:
                    if source is not None:
                        out.append(ended())
                    source, tail, no, characters, language = r.source, "", 0, 0, None
                if r[1] == 0:
                    tail, no, characters, language = r.text, int(r.chunks), int(r.characters), r.language
                    continue
                part = addition(tail, r.text)
                tail, no, characters, language = ending(tail + part), no + 1, characters + len(part), r.language or language
                out.append((source, int(r.seq), no, part, None, None, None, None))
            yield pd.DataFrame(out, columns=names).astype(numbers)
        if source is not None:
            yield pd.DataFrame([ended()], columns=names).astype(numbers)

    names = ["source", "seq", "no", "part", "tail", "chunks", "characters", "language"]
    numbers = {c: "Int64" for c in ("seq", "no", "chunks", "characters")}
    both = dealt.mapInPandas(scan, f"source {kind}, {PART}, {STATE}")
    return both, state.join(new.select("source").distinct(), "source", "left_anti")


def live_transcripts(
    packets: DataFrame, recognise: Callable[[list[float], float], str], path: str, checkpoint: str, seconds: float = A.CHUNK_SECONDS, overlap: float = A.OVERLAP_SECONDS,
    hook: Callable[[DataFrame], None] | None = None, trigger: dict[str, Any] | None = None, rate: float = A.RATE,
):  # fmt: skip  # noqa: ANN201
    """A stream of packets (packet_id, source, samples, sample_rate, channels) into the tables of schemas() under path, each
    micro-batch whole and once; hook gets the chunks that each has stored. Returns the query.

    What comes from the buffer is written first, since a micro-batch's plan may be run but once cheaply; the recogniser's
    results are written before they are parted, so that it hears a chunk once."""
    spark = packets.sparkSession
    kind = packets.schema["source"].dataType.simpleString()
    sink = Sink(spark, path, schemas(kind))

    def write(batch: DataFrame, number: int) -> None:
        if sink.has(number):
            return
        aside: list[tuple[str, str]] = []

        def kept(table: str, rows: DataFrame) -> DataFrame:
            name = sink.versions.write(table, rows)
            aside.append((table, name))
            return spark.read.schema(rows.schema).parquet(sink.versions.folder(table, name))

        rows = kept("_buffered", batch)
        heard = kept("_heard", recognised_chunks(S.chunks(rows), recognise, rate))
        good = heard.where("error is null").drop("error")
        both, others = transcript(good, sink.read("state"))
        told = kept("_told", both)
        first = sink.facts().get("next_id", 1)
        stored, count = numbered(good.withColumn("_g", F.lit(0)), ["source", "seq"], first)
        refused = S.errors(rows).select("source", "packet_id", F.lit(None).cast("long").alias("seq"), "error").union(heard.where("error is not null").select("source", F.lit(None).cast("long"), "seq", "error"))
        state = told.where("seq is null").select("source", "tail", "chunks", "characters", "language").union(others.select("source", "tail", "chunks", "characters", "language"))
        columns = [c.split()[0] for c in sink.schemas["chunks"].split(f", segments {SEGMENTS}")[0].split(", ")] + ["segments"]
        sink.publish(number, {"chunks": stored.select(*columns), "transcript": told.where("seq is not null").select("source", "seq", "no", "part"), "errors": refused}, {"state": state}, {"next_id": first + count})
        if hook:
            hook(good)
        for table, name in aside:
            sink.versions.remove(table, [name])

    return S.buffered(packets, seconds, overlap).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def text_of(sink: Sink) -> DataFrame:
    """source and text: the parts of each source's transcript in their order."""
    parts = F.array_sort(F.collect_list(F.struct("no", "part")))
    return sink.read("transcript").groupBy("source").agg(F.array_join(F.transform(parts, lambda p: p.part), "").alias("text"))


def opened(spark: SparkSession, path: str, source: str = "string") -> Sink:
    """The tables that a live loop writes."""
    return Sink(spark, path, schemas(source))
