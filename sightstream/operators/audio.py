"""Packets of sound as overlapping chunks with voiced spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.functions import audio as S

CHUNK_SECONDS, OVERLAP_SECONDS = 5.0, 1.0
RATE = 16_000.0

#: Packets of a source whose frames are summed up by one task.
PACKETS = 4096


def checked(packets: DataFrame) -> DataFrame:
    """A1: packets with an error instead of samples where the layout is wrong or the format changes within a source; empty
    packets are left out. A source's format is that of its first packet: one row a source, joined back."""
    rows = packets.where(F.size("samples") > 0)
    first = rows.groupBy("source").agg(F.min(F.struct("packet_id", "sample_rate", "channels")).alias("_first"))
    error = (
        F.when((F.col("channels") <= 0) | (F.col("sample_rate") <= 0), "bad format")
        .when(F.size("samples") % F.greatest("channels", F.lit(1)) != 0, "bad layout")
        .when((F.col("sample_rate") != F.col("_first.sample_rate")) | (F.col("channels") != F.col("_first.channels")), "format changed")
    )
    return rows.join(first, "source").select(*packets.columns, error.alias("error"))


def placed(packets: DataFrame) -> DataFrame:
    """packets with _start and _end, their frames' places in their source, and _all, the source's frames.

    Prefix sums on two levels: PACKETS packets are summed up by a task, and the sums of a source's blocks, a row each, by
    another, so that a long source is many tasks."""
    key = ["source", "_block"]
    rows = packets.withColumns({"_n": (F.size("samples") / F.col("channels")).cast("long"), "_block": F.floor(F.col("packet_id") / PACKETS)})
    blocks = rows.groupBy(*key).agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(*key, F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_base"), F.sum("_in").over(Window.partitionBy("source")).alias("_all"))
    so_far = F.sum("_n").over(Window.partitionBy(*key).orderBy("packet_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_end", so_far).join(base, key).withColumn("_end", F.col("_end") + F.col("_base")).withColumn("_start", F.col("_end") - F.col("_n")).drop("_base", "_block")


def _sizes(rate: str, seconds: float, overlap: float) -> tuple[Column, Column]:
    """A4: frames of a chunk, and from one chunk's start to the next."""
    if not 0 <= overlap < seconds:
        raise ValueError("0 <= overlap < seconds is needed")
    size = F.greatest(F.lit(1), F.round(F.lit(seconds) * F.col(rate)).cast("long"))
    return size, F.greatest(F.lit(1), size - F.round(F.lit(overlap) * F.col(rate)).cast("long"))


def _ready(frames: Column, size: Column, hop: Column) -> Column:
    """A3: how many chunks so many frames hold."""
    return F.when(frames >= size, F.floor((frames - size) / hop) + 1).otherwise(0)


def chunks(packets: DataFrame, seconds: float = CHUNK_SECONDS, overlap: float = OVERLAP_SECONDS) -> DataFrame:
    """A2-A4: source, seq (from 0), start_frame, samples, sample_rate, channels of chunks of `seconds` that overlap. A tail
    shorter than a chunk waits.

    A frame goes to each chunk that covers it: packets are numbered by a running sum of frames, and only the parts of the
    packets that a chunk needs meet in its row, so that a long source is never one array."""
    size, hop = _sizes("sample_rate", seconds, overlap)
    rows = placed(packets).withColumns({"_size": size, "_hop": hop})
    count = _ready(F.col("_all"), F.col("_size"), F.col("_hop"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_start") - F.col("_size") + 1) / F.col("_hop")))
    last = F.least(count - 1, F.floor((F.col("_end") - 1) / F.col("_hop")))
    parts = rows.withColumns({"_f": first, "_l": last}).where("_f <= _l").withColumn("seq", F.explode(F.sequence("_f", "_l")))
    begin = F.col("seq") * F.col("_hop")
    lo, hi = F.greatest(begin, F.col("_start")), F.least(begin + F.col("_size"), F.col("_end"))
    cut = F.slice("samples", ((lo - F.col("_start")) * F.col("channels") + 1).cast("int"), ((hi - lo) * F.col("channels")).cast("int"))
    parts = parts.select("source", "seq", begin.alias("start_frame"), F.col("_start"), cut.alias("part"), "sample_rate", "channels")
    return parts.groupBy("source", "seq", "start_frame", "sample_rate", "channels").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_start", "part"))), lambda p: p.part)).alias("samples"))


def available(packets: DataFrame, seconds: float = CHUNK_SECONDS, overlap: float = OVERLAP_SECONDS) -> DataFrame:
    """A5: source, frames and duration (seconds) that wait in each source's buffer once all whole chunks were taken."""
    size, hop = _sizes("sample_rate", seconds, overlap)
    sums = packets.groupBy("source", "sample_rate").agg(F.sum((F.size("samples") / F.col("channels")).cast("long")).alias("all"))
    left = F.col("all") - _ready(F.col("all"), size, hop) * hop
    return sums.select("source", left.cast("long").alias("frames"), (left / F.col("sample_rate")).alias("duration"))


def normalized(chunks: DataFrame, rate: float = RATE) -> DataFrame:
    """Mono chunks at one rate."""
    mono = S.downmix(F.col("samples"), F.col("channels"))
    return chunks.withColumn("samples", mono).withColumn("samples", S.resample(F.col("samples"), F.col("sample_rate"), F.lit(rate))).withColumns({"sample_rate": F.lit(rate), "channels": F.lit(1)})


def voice(mono: DataFrame) -> DataFrame:
    """threshold_db, max_db, mean_db, n_windows, voiced span and the samples in it; error for what isn't mono or
    holds no voice."""
    window = S.window_samples(F.col("sample_rate"))
    rows = mono.withColumn("window", window).withColumn("db", S.levels(F.col("samples"), F.col("window")))
    rows = rows.withColumns({"threshold_db": F.when(F.size("db") > 0, S.threshold(F.col("db"))), "max_db": F.array_max("db"), "mean_db": F.when(F.size("db") > 0, S.total(F.col("db")) / F.size("db")), "n_windows": F.size("db")})
    rows = rows.withColumn("voiced", S.voiced_span(F.col("db"), F.col("threshold_db"), F.col("window"), F.col("sample_rate"), F.size("samples")))
    error = F.when(F.col("channels") != 1, "not mono").when(F.size("samples") == 0, "no samples").when(F.col("voiced").isNull(), "no voice")
    trimmed = F.when(F.col("voiced").isNotNull(), F.slice("samples", F.col("voiced.start") + 1, F.col("voiced.end") - F.col("voiced.start")))
    return rows.withColumns({"error": error, "trimmed": trimmed})
