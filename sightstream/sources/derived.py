"""Logical inputs of the engine (observations, samples, chunks, signals) from the driver's tables.

A deployment reads these from its own tables or streams; the names and types are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_WIDTH = 1920
LINE_HEIGHT = 20

#: Time to live and window that go with the events table, in seconds: half a day and a day.
TTL = 12 * 3600
WINDOW = 24 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """doc_id, obs_idx, display_id, text, x, y, w, h, confidence: a box for each line of a document that isn't blank. dealt: documents
    are dealt out by doc_id first, so that what is grouped, ordered and joined by document isn't shuffled again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = (docs.repartition("doc_id") if dealt else docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("obs_idx", "text")).where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")
    i = F.col("obs_idx")
    four, eight = F.floor(i / 4), F.floor(i / 8)
    return lines.select(
        "doc_id",
        "obs_idx",
        (F.col("doc_id") % 2 + 1).alias("display_id"),
        "text",
        (16 * (four % 2)).cast("double").alias("x"),
        (24 * i + 60 * four + 200 * eight).cast("double").alias("y"),
        (8 * F.least(F.length("text"), F.lit(100))).cast("double").alias("w"),
        F.lit(float(LINE_HEIGHT)).alias("h"),
        (F.lit(1.0) / (1 + i)).alias("confidence"),
    )


def doubled(boxes: DataFrame) -> DataFrame:
    """The boxes, and for every third one a shifted copy of lower confidence, as a recogniser gives them at times."""
    copy = boxes.where("obs_idx % 3 = 0").withColumns({"obs_idx": F.col("obs_idx") + 100_000, "x": F.col("x") + 2, "y": F.col("y") + 2, "confidence": F.col("confidence") / 2})
    return boxes.unionByName(copy)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, t (seconds), display_id, text: what was seen when, a session for each user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 2 + 1).alias("display_id"), F.col("event_type").alias("text"))


def transcript_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, source, seq, start_time, duration, language, text: a chunk for each spoken turn."""
    c = table(spark, sf_dir, "conversations").where("role in ('assistant', 'user')")
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.when(F.col("role") == "assistant", "computer").otherwise("microphone").alias("source"),
        F.col("turn").alias("seq"),
        (4.0 * F.col("turn")).alias("start_time"),
        F.lit(5.0).alias("duration"),
        F.when(F.col("turn") % 3 == 0, F.lit("en")).alias("language"),
        "text",
    )


def packets_of(embeddings: DataFrame) -> DataFrame:
    """packet_id, source, samples, sample_rate, channels: stereo packets of 32 frames, of a table or stream of embeddings."""
    return embeddings.select(F.col("vec_id").alias("packet_id"), F.col("label").cast("long").alias("source"), F.col("embedding").alias("samples"), F.lit(200.0).alias("sample_rate"), F.lit(2).alias("channels"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of the table of embeddings."""
    return packets_of(table(spark, sf_dir, "embeddings"))
