"""Captured packets as a source that Spark reads by name: spark.read and spark.readStream.format("captured_packets").

A folder gets a WAV file for each packet, named <number>-<source>.wav; numbers go up as packets are captured, over all sources,
and a file has its name once it is whole. A table is all of them. A stream's offset is the last number it has read. As a
capture device's buffer does, a stream holds at most `buffer` packets for a reader that is late: of more, the oldest are
dropped, and the first packet after them says how many (column dropped). Which ones follows from the offsets alone, so that a
micro-batch that runs again drops the same.

Options: path; buffer (512; 0: nothing is dropped); files (64), packets that one task reads."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "captured_packets"
SCHEMA = "packet_id long, source string, samples array<float>, sample_rate double, channels int, dropped long"

#: Packets that wait for a reader; packets that one task reads.
BUFFER, FILES = 512, 64

_FILE = re.compile(r"(\d+)-(.+)\.wav")


class Packet(NamedTuple):
    number: int
    source: str
    path: str


class Packets(InputPartition):
    """Some packets, and how many were dropped before the first of them."""

    def __init__(self, packets: list[Packet], dropped: int = 0) -> None:
        self.packets, self.dropped = packets, dropped


def listed(path: str, after: int = -1, until: int | None = None) -> list[Packet]:
    """The packets of a folder in the order of their numbers, those after one number and up to another."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    found = []
    for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if (m := _FILE.fullmatch(f.base_name)) and after < (number := int(m[1])) and (until is None or number <= until):
            found.append(Packet(number, m[2], f.path))
    return sorted(found)


def kept(packets: list[Packet], buffer: int) -> tuple[list[Packet], int]:
    """(the newest `buffer` packets, how many older ones are dropped)."""
    gone = max(0, len(packets) - buffer) if buffer > 0 else 0
    return packets[gone:], gone


def rows_of(folder: str, part: Packets) -> Iterator[tuple]:
    """Rows of SCHEMA. A file that is no WAV file of 16-bit samples gives a packet without samples."""
    import io
    import wave

    import numpy as np
    from pyarrow import fs

    store = fs.FileSystem.from_uri(folder)[0] if ":" in folder else fs.LocalFileSystem()
    dropped = part.dropped
    for p in part.packets:
        try:
            with store.open_input_file(p.path) as f, wave.open(io.BytesIO(f.read())) as w:
                if w.getsampwidth() != 2:
                    raise wave.Error("not 16 bit")
                samples = (np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32767.0).astype(np.float32).tolist()
                rate, channels = float(w.getframerate()), w.getnchannels()
        except (wave.Error, EOFError):
            samples, rate, channels = [], 0.0, 0
        yield p.number, p.source, samples, rate, channels, dropped
        dropped = 0


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.buffer, self.files = int(options.get("buffer", BUFFER)), max(1, int(options.get("files", FILES)))

    def parts(self, packets: list[Packet], dropped: int = 0) -> list[Packets]:
        return [Packets(packets[i : i + self.files], 0 if i else dropped) for i in range(0, len(packets), self.files)]


class Reader(_Options, DataSourceReader):
    def partitions(self) -> list[Packets]:
        return self.parts(listed(self.path)) or [Packets([])]

    def read(self, partition: Packets) -> Iterator[tuple]:
        return rows_of(self.path, partition)


class StreamReader(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, Any]:  # noqa: N802
        return {"number": -1}

    def latestOffset(self, *_: Any) -> dict[str, Any]:  # noqa: N802
        found = listed(self.path)
        return {"number": found[-1].number if found else -1}

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[Packets]:
        return self.parts(*kept(listed(self.path, start["number"], end["number"]), self.buffer))

    def read(self, partition: Packets) -> Iterator[tuple]:
        return rows_of(self.path, partition)

    def commit(self, end: dict[str, Any]) -> None:
        """Files stay: they are the captures' archive."""


class CapturedPackets(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: Any) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


class Captured:
    """A provider (sources.providers) of the packets in a folder."""

    def __init__(self, path: str, buffer: int = BUFFER, files: int = FILES) -> None:
        self.options = {"path": path, "buffer": str(buffer), "files": str(files)}

    def table(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(CapturedPackets)
        return spark.read.format(NAME).options(**self.options).load()

    def stream(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(CapturedPackets)
        return spark.readStream.format(NAME).options(**self.options).load()
