"""The documents of a display by the hash of its frame, so that a frame seen before isn't recognised again.

A display's cache holds the newest `limit` documents, none older than max_age, each under the hash of its frame. A frame
that it holds is served that document; any other is recognised and stored, and is served the current document instead if its
text and layout are the same as that one's. What the cache holds so depends on its own misses, and a display is read in order
by one task, which holds `limit` documents of it, however long it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightstream.functions.text import displays_text
from sightstream.operators.memory import CACHE_SECONDS, CACHE_SIZE

#: What a recogniser gives for a frame (a row as a dict): text, text_hash, layout_hash.
Recogniser = Callable[[dict], tuple[str, str, str]]


class Document(NamedTuple):
    seq: int
    at: int
    frame_hash: str
    text_hash: str | None
    layout_hash: str | None
    text: str | None


class FrameCache:
    """The documents of one display. It can be pickled."""

    def __init__(self, max_age: int = CACHE_SECONDS, limit: int = CACHE_SIZE) -> None:
        self.max_age, self.limit = max_age, max(1, limit)
        self.documents: list[Document] = []  # the newest first
        self.current: Document | None = None

    def expire(self, now: int) -> None:
        """Documents strictly older than max_age go; without a max_age none does."""
        if self.max_age > 0:
            self.documents = [d for d in self.documents if d.at >= now - self.max_age]
            if self.current is not None and self.current.at < now - self.max_age:
                self.current = None

    def get(self, frame_hash: str, now: int) -> Document | None:
        self.expire(now)
        return next((d for d in self.documents if d.frame_hash == frame_hash), None)

    def store(self, new: Document) -> Document:
        """The document that is served for a new one."""
        self.expire(new.at)
        now = self.current
        if now is not None and (now.text_hash, now.layout_hash) == (new.text_hash, new.layout_hash):
            return now
        self.current = new
        self.documents = [new, *self.documents][: self.limit]
        return new

    def serve(self, frame: dict, recognise: Recogniser | None = None) -> tuple[Document, bool]:
        """The document of a frame, and whether it was there. A frame without a hash is recognised each time."""
        seq, at, h = int(frame["seq"]), int(frame["t"]), frame["frame_hash"]
        if h is not None and (held := self.get(h, at)) is not None:
            return held, True
        text, text_hash, layout_hash = recognise(frame) if recognise else (frame["text"], frame["text_hash"], frame["layout_hash"])
        return self.store(Document(seq, at, h, text_hash, layout_hash, text)), False


def served(frames: DataFrame, max_age: int = CACHE_SECONDS, limit: int = CACHE_SIZE, recognise: Recogniser | None = None) -> DataFrame:
    """frames: session_id, display_id, seq, t (seconds), frame_hash; and text, text_hash, layout_hash, what a recogniser gives, or
    recognise, which is called for the frames that the cache lacks only. -> the first five, text, text_hash and layout_hash of
    the document that each frame is served, document_seq (the sample that it was made for) and reused."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("session_id", "display_id", "seq", "t")) + ", frame_hash string, text string, text_hash string, layout_hash string, document_seq long, reused boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: Any = None
        cache = FrameCache(max_age, limit)
        for b in batches:
            out = []
            for row in b.astype(object).where(b.notna(), None).to_dict("records"):
                if (own := (row["session_id"], row["display_id"])) != key:
                    key, cache = own, FrameCache(max_age, limit)
                d, reused = cache.serve(row, recognise)
                out.append((*own, row["seq"], row["t"], row["frame_hash"], d.text, d.text_hash, d.layout_hash, d.seq, reused))
            yield pd.DataFrame(out, columns=names)

    return frames.repartition("session_id", "display_id").sortWithinPartitions("session_id", "display_id", "t", "seq").mapInPandas(scan, schema)


def assembled(rows: DataFrame, expected: Column | None = None) -> DataFrame:
    """A row for each sample of rows of served(): when its first display was captured, how many displays it has, how many of
    them were reused and how many recognised, and their texts. expected: how many it should have; complete tells whether it has."""
    part = F.struct((F.col("display_id") - 1).alias("index"), "text")
    out = rows.groupBy("session_id", "seq").agg(F.min("t").alias("t"), F.count("*").alias("displays"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("recognised"), displays_text(F.collect_list(part)).alias("text"))
    return out if expected is None else out.withColumn("complete", F.col("displays") >= expected)
