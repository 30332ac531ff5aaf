"""Speech-recognition output and its parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightstream.functions.text import timestamp_seconds, trimmed

SCHEMA = "struct<result: struct<language: string>, transcription: array<struct<timestamps: struct<`from`: string, `to`: string>, text: string>>>"

#: A speech recogniser: chunks with samples in, the same rows with a column of JSON out.
Recogniser = Callable[[DataFrame], DataFrame]


def parse(document: Column | str) -> Column:
    """(language, text, segments of start, end, text; duration: end of the last segment). Null for what isn't JSON."""
    d = F.from_json(document, SCHEMA)
    segments = F.transform(
        d.transcription,
        lambda s: F.struct(timestamp_seconds(s.timestamps["from"]).alias("start_time"), timestamp_seconds(s.timestamps["to"]).alias("end_time"), trimmed(s.text).alias("text")),
    )
    return F.when(
        d.transcription.isNotNull(),
        F.struct(
            d.result.language.alias("language"),
            trimmed(F.array_join(F.transform(d.transcription, lambda s: s.text), "")).alias("text"),
            segments.alias("segments"),
            F.get(segments, F.size(segments) - 1)["end_time"].alias("duration"),
        ),
    )


def transcript_chunk(source: Column, seq: Column, start_time: Column, duration: Column, segments: Column) -> Column:
    """Id, span and segments of a chunk; segments are shifted to the session's time, clamped to the chunk, blanks dropped."""
    end = start_time + duration
    inside = lambda t: F.least(F.greatest(start_time + t, start_time), end)
    moved = F.transform(
        F.filter(segments, lambda s: trimmed(s.text) != ""),
        lambda s: F.struct(inside(F.coalesce(s.start_time, F.lit(0.0))).alias("start_time"), inside(F.coalesce(s.end_time, duration)).alias("end_time"), trimmed(s.text).alias("text")),
    )
    return F.struct(F.format_string("%s_%03d", source, seq).alias("chunk_id"), start_time.alias("start_time"), end.alias("end_time"), moved.alias("segments"))
