"""Files in and out: WAV files, JSON and Markdown documents, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes a query's shuffle files once it has run.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A local master, whose only machine sees all, may
    leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/sightstream"
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, and outlives any executor. What was shuffled for it goes
    when it is written."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, sample_rate, channels, samples (floats) of 16-bit WAV files with the usual header of 44 bytes."""
    from sightstream.functions.audio import decode_pcm

    number = lambda at, n: F.conv(F.concat(*(F.hex(F.substring("content", at + i, 1)) for i in reversed(range(n)))), 16, 10).cast("long")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return rows.where(F.length("content") >= 44).select("path", number(25, 4).cast("double").alias("sample_rate"), number(23, 2).cast("int").alias("channels"), decode_pcm(F.substring("content", 45, 1 << 30), F.lit("int16")).alias("samples"))


def write_wav_files(chunks: DataFrame, path: str) -> None:
    """Chunks (name, samples, sample_rate) as WAV files in a folder. A file gets its name when it is whole, so that a
    task that runs again leaves the same files."""
    from pyarrow import fs

    from sightstream.functions.audio import quantize, wav_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{at}/_{name}.{uuid.uuid4().hex[:8]}"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, f"{at}/{name}")
            yield b.select(["name"])

    chunks.select("name", wav_bytes(quantize(F.col("samples")), F.col("sample_rate")).alias("wav")).mapInArrow(write, "name string").count()


def write_documents(docs: DataFrame, path: str) -> None:
    """One text column, a document a row."""
    docs.write.mode("overwrite").text(path)
