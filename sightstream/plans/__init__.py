"""The queries of the engine, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from sightstream.plans import audio, stored, text, transcript, windows

    return {**text.QUERIES, **windows.QUERIES, **audio.QUERIES, **transcript.QUERIES, **stored.QUERIES}
