"""Where samples and packets come from (S1-S5, S7-S9, S12): a provider gives a stream or a table of them.

Devices are outside of the engine; what they write into a folder, a queue or a table is where it begins."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightstream.functions.text import device_label, trimmed

BOXES = "session_id long, seq long, t long, display_id long, frame_hash string, obs_idx int, text string, x double, y double, w double, h double, confidence double"
PACKETS = "packet_id long, source string, samples array<float>, sample_rate double, channels int"


class Provider(Protocol):
    """What captures: all rows so far, or rows as they come."""

    def table(self, spark: SparkSession) -> DataFrame: ...

    def stream(self, spark: SparkSession) -> DataFrame: ...


class Folder:
    """A folder of Parquet or JSON files of one schema; a micro-batch takes at most `files` of them, so that a burst waits
    instead of being dropped."""

    def __init__(self, path: str, schema: str, kind: str = "parquet", files: int = 16) -> None:
        self.path, self.schema, self.kind, self.files = path, schema, kind, files

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).format(self.kind).load(self.path)

    def stream(self, spark: SparkSession) -> DataFrame:
        return spark.readStream.schema(self.schema).format(self.kind).option("maxFilesPerTrigger", self.files).load(self.path)


def main_display(frames: DataFrame) -> DataFrame:
    """Of each sample the frame of its first display; a row without a frame, with an error, for a sample that has none.
    frames: session_id, seq, display_id (null where nothing was captured), frame_hash."""
    first = frames.groupBy("session_id", "seq").agg(F.min(F.when(F.col("display_id").isNotNull(), F.struct("display_id", "frame_hash"))).alias("f"))
    return first.select("session_id", "seq", "f.display_id", "f.frame_hash", F.when(F.col("f").isNull(), F.lit("no display")).alias("error"))


def input_devices(devices: DataFrame, key: str = "host") -> DataFrame:
    """Devices that record (channels over 0) of each host with label and position: the default one first, then by label
    whatever the case, then by id. devices: key, id, name, manufacturer, channels, is_default."""
    rows = devices.where("channels > 0").withColumn("label", device_label(F.coalesce("name", F.concat(F.lit("Input "), F.col("id").cast("string"))), F.col("manufacturer")))
    w = Window.partitionBy(key).orderBy(F.desc("is_default"), F.lower("label"), "id")
    return rows.withColumn("position", F.row_number().over(w))


def recognised(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """S3: recogniser's boxes, in shares of the frame with y upward, as pixels with y downward; blank ones are left out."""
    rows = boxes.withColumn("text", trimmed("text")).where("text <> ''")
    return rows.withColumns({"y": (1 - (F.col("y") + F.col("h"))) * height, "x": F.col("x") * width, "w": F.col("w") * width, "h": F.col("h") * height})


def joined_text(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes' texts in order, by lines, trimmed."""
    ordered = F.array_sort(F.collect_list(F.struct("obs_idx", "text")))
    return boxes.groupBy(*keys).agg(trimmed(F.array_join(F.transform(ordered, lambda b: b.text), "\n")).alias("text"))
