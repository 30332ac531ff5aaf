"""Queries over signals, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sightstream.functions import audio as S
from sightstream.functions import text as T
from sightstream.operators import audio as A
from sightstream.sources.derived import packets_of, signals, table
from sightstream.sources.files import new_path, write_wav_files
from sightstream.sources.files import wav_files as wav_files_of
from sightstream.streaming import audio as B
from sightstream.streaming.sink import Sink

#: Seconds of a chunk and of an overlap that go with packets of 32 frames at 200 Hz.
CHUNK, OVERLAP = 0.5, 0.1
RATE = 160.0


def mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets taken as mono signals of 64 frames."""
    return signals(spark, sf_dir).withColumn("channels", F.lit(1))


@F.pandas_udf(StructType([StructField(name, BinaryType()) for name in ("double", "float", "byte")]))
def pcm_bytes(samples: pd.Series) -> pd.DataFrame:
    kinds = {"double": "<f8", "float": "<f4", "byte": "u1"}
    return pd.DataFrame({name: [np.zeros(len(s), kind).tobytes() if name == "byte" else np.asarray(s, kind).tobytes() for s in samples] for name, kind in kinds.items()})


def digits(c):
    return F.round(c, 9)


def listed(c):
    """An array of numbers as text, to compare by."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.6f", F.round(x.cast("double"), 6) + 0.0)), ",")


def stereo_downmix(spark, sf_dir):
    return signals(spark, sf_dir).select("packet_id", F.posexplode(S.downmix(F.col("samples"), F.col("channels"))).alias("frame", "sample")).select("packet_id", "frame", digits(F.col("sample").cast("double")).alias("sample"))


def resample_linear(spark, sf_dir):
    out = S.resample(F.col("samples"), F.col("sample_rate"), F.lit(RATE))
    return mono(spark, sf_dir).select("packet_id", F.posexplode(out).alias("frame", "sample")).select("packet_id", "frame", (F.round(F.col("sample").cast("double"), 6) + 0.0).alias("sample"))


def audio_chunks(spark, sf_dir):
    """Chunks of each source's packets; their samples by number, sum and ends."""
    return told(A.chunks(A.checked(signals(spark, sf_dir)).where("error is null"), CHUNK, OVERLAP))


def told(c: DataFrame) -> DataFrame:
    total = S.total(F.transform("samples", lambda x: x.cast("double")))
    return c.select("source", "seq", "start_frame", F.size("samples").alias("n_samples"), F.round(total, 6).alias("total"), F.get("samples", F.lit(0)).cast("double").alias("first_sample"), F.element_at("samples", -1).cast("double").alias("last_sample"))


def streamed_chunks(spark, sf_dir):
    """audio_chunks of a stream: packets through each source's buffer of frames into tables that are written whole and once."""
    fields = signals(spark, sf_dir).schema
    path = new_path(spark, "streamed")
    sink = Sink(spark, f"{path}/tables", {"rows": f"source long, {B.ROW}"})
    packets = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a pattern, since a stream takes no single file
    query = B.buffered(packets_of(packets).select(*fields.names), CHUNK, OVERLAP).writeStream.foreachBatch(lambda rows, n: sink.publish(n, {"rows": rows}))
    query = query.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return told(B.chunks(sink.read("rows")))


def audio_available(spark, sf_dir):
    """What waits in each source's buffer once its chunks were taken."""
    a = A.available(A.checked(signals(spark, sf_dir)).where("error is null"), CHUNK, OVERLAP)
    return a.select("source", "frames", digits(F.col("duration")).alias("duration"))


def wav_source(spark, sf_dir):
    """Packets written as WAV files and read back."""
    path = new_path(spark, "wav")
    write_wav_files(mono(spark, sf_dir).select(S.chunk_file_name(F.col("source").cast("string"), F.col("packet_id")).alias("name"), "samples", "sample_rate"), path)
    return wav_files_of(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sample_rate", "channels", T.sha(listed("samples")).alias("samples_sha256"))


def pcm_formats(spark, sf_dir):
    """Samples stored in other formats, read as single precision: as bytes of 64-bit and 32-bit floats, and of an unknown format."""
    raw = mono(spark, sf_dir).select("packet_id", pcm_bytes("samples").alias("raw"))
    both = [raw.select("packet_id", F.lit(f).alias("format"), S.decode_pcm(F.col(f"raw.{c}"), F.lit(f)).alias("back")) for f, c in (("float64", "double"), ("float32", "float"), ("other", "byte"))]
    return both[0].union(both[1]).union(both[2]).select("packet_id", "format", T.sha(listed("back")).alias("samples_sha256"))


def normalized_chunks(spark, sf_dir):
    """Chunks as mono at another rate: how long they are, and their first sample."""
    c = A.normalized(A.chunks(signals(spark, sf_dir), CHUNK, OVERLAP), RATE)
    return c.select("source", "seq", F.size("samples").alias("n_samples"), "sample_rate", digits(F.get("samples", F.lit(0)).cast("double")).alias("first_sample"))


def packet_check(spark, sf_dir):
    s = signals(spark, sf_dir).withColumns({"channels": F.when(F.col("packet_id") % 17 == 3, 3).otherwise(F.col("channels")), "sample_rate": F.when(F.col("packet_id") % 19 == 4, 100.0).otherwise(F.col("sample_rate"))})
    return A.checked(s).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("packets"))


def rms_dbfs(spark, sf_dir):
    return mono(spark, sf_dir).select("packet_id", digits(S.level(F.col("samples"))).alias("dbfs"))


def vad_threshold(spark, sf_dir):
    v = A.voice(mono(spark, sf_dir))
    return v.select("packet_id", "n_windows", digits(F.col("threshold_db")).alias("threshold_db"), digits(F.col("max_db")).alias("max_db"), digits(F.col("mean_db")).alias("mean_db"))


def faded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that are silent but for a middle part, by a rule that both engines share."""
    s = mono(spark, sf_dir)
    start = 6 * (F.col("packet_id") % 4)
    quiet = F.transform("samples", lambda x, i: F.when((i >= start) & (i < start + 6 * (F.col("packet_id") % 6)), x).otherwise((x * 0.0001).cast("float")))
    return s.withColumn("samples", quiet).withColumn("sample_rate", F.lit(200.0))


def vad_trim_range(spark, sf_dir):
    v = A.voice(faded(spark, sf_dir))
    known = lambda c: F.coalesce(c, F.lit(-1)).cast("int")
    return v.select("packet_id", known(F.col("voiced.start")).alias("start"), known(F.col("voiced.end")).alias("end"), F.coalesce(F.size(F.coalesce("trimmed", F.array().cast("array<float>"))), F.lit(0)).alias("n_kept"), F.coalesce("error", F.lit("")).alias("error"))


def pcm_quantize(spark, sf_dir):
    return mono(spark, sf_dir).select("packet_id", F.array_join(F.transform(S.quantize(F.col("samples")), lambda v: v.cast("string")), ",").alias("pcm"))


def pcm_correlation(spark, sf_dir):
    """Each packet with the one five numbers on."""
    s = mono(spark, sf_dir).select("packet_id", "samples")
    other = s.select((F.col("packet_id") - 5).alias("packet_id"), F.col("samples").alias("other"))
    return s.join(other, "packet_id").select("packet_id", digits(S.correlation(F.col("samples"), F.col("other"))).alias("correlation"))


def wav_files(spark, sf_dir):
    """Bytes of WAV files, told by their number and hash."""
    w = S.wav_bytes(S.quantize(F.col("samples")), F.col("sample_rate"))
    return mono(spark, sf_dir).select("packet_id", S.chunk_file_name(F.col("source").cast("string"), F.col("packet_id")).alias("name"), w.alias("wav")).select("packet_id", "name", F.length("wav").alias("n_bytes"), F.sha2("wav", 256).alias("wav_sha256"))


def pcm_decode(spark, sf_dir):
    """16-bit samples through bytes and back."""
    w = mono(spark, sf_dir).withColumn("pcm", S.quantize(F.col("samples"))).withColumn("raw", F.substring(S.wav_bytes(F.col("pcm"), F.col("sample_rate")), 45, 1 << 30))
    back = S.decode_pcm(F.col("raw"), F.lit("int16"))
    return w.select("packet_id", F.posexplode(back).alias("frame", "sample")).select("packet_id", "frame", F.round(F.col("sample").cast("double"), 6).alias("sample"))


def interleave(spark, sf_dir):
    planes = F.array(F.slice("samples", 1, 32), F.slice("samples", 33, 32))
    return signals(spark, sf_dir).select("packet_id", F.posexplode(S.interleave(planes)).alias("i", "sample")).select("packet_id", "i", F.col("sample").cast("double").alias("sample"))


SIG = "sig AS (SELECT vec_id AS packet_id, CAST(label AS BIGINT) AS source, embedding AS s FROM embeddings)"
ELEMENTS = f"{SIG}, el AS (SELECT packet_id, source, unnest(s) AS v, unnest(range(len(s))) AS i FROM sig)"
_DB = lambda src, key: f"CASE WHEN count(*) > 0 THEN 20 * log10(greatest(sqrt(sum(CAST(CAST(v * v AS FLOAT) AS DOUBLE) ORDER BY i) / count(*)), 1e-10)) ELSE -200.0 END"  # noqa: E731, ARG005
_LEVELS = lambda el: f"""win AS (SELECT packet_id, i // 6 AS wi, {_DB('', '')} AS db FROM {el} WHERE i // 6 < 10 GROUP BY packet_id, i // 6), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY db) - 1 AS r, count(*) OVER (PARTITION BY packet_id) AS n FROM win
), thr AS (
  SELECT packet_id, greatest(-60.0, least(-40.0, max(CASE WHEN r = CAST(floor(0.2::DOUBLE * (n - 1)) AS BIGINT) THEN db END) + 12.0)) AS threshold_db, max(db) AS max_db, sum(db ORDER BY wi) / count(*) AS mean_db, CAST(count(*) AS INTEGER) AS n_windows FROM ranked GROUP BY packet_id
)"""  # noqa: E731
_Q = "CAST(round(CASE WHEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(v AS DOUBLE))) < 0 THEN greatest(-1.0::DOUBLE, CAST(v AS DOUBLE)) * 32768 ELSE least(1.0::DOUBLE, CAST(v AS DOUBLE)) * 32767 END) AS INTEGER)"

_LISTED = "printf('%.6f', round(CAST(v AS DOUBLE), 6) + 0.0::DOUBLE)"

QUERIES = {
    "audio_available": (audio_available, f"""WITH {SIG}, n AS (SELECT source, count(*) * 32 AS frames FROM sig GROUP BY source), c AS (SELECT source, frames - CASE WHEN frames >= 100 THEN ((frames - 100) // 80 + 1) * 80 ELSE 0 END AS frames FROM n)
SELECT source, CAST(frames AS BIGINT) AS frames, round(frames / 200.0::DOUBLE, 9) AS duration FROM c"""),
    "wav_source": (wav_source, f"""WITH {ELEMENTS}, q AS (SELECT packet_id, source, i, CAST({_Q} / 32767.0::DOUBLE AS FLOAT) AS v FROM el)
SELECT CAST(source AS VARCHAR) || '-chunk-' || printf('%04d', packet_id) || '.wav' AS name, 200.0::DOUBLE AS sample_rate, 1::INTEGER AS channels, sha256(string_agg({_LISTED}, ',' ORDER BY i)) AS samples_sha256 FROM q GROUP BY packet_id, source"""),
    "pcm_formats": (pcm_formats, f"""WITH {ELEMENTS}, f AS (SELECT packet_id, unnest(['float64', 'float32', 'other']) AS format, i, v FROM el)
SELECT packet_id, format, sha256(string_agg(CASE WHEN format = 'other' THEN '0.000000' ELSE {_LISTED} END, ',' ORDER BY i)) AS samples_sha256 FROM f GROUP BY packet_id, format"""),
    "stereo_downmix": (stereo_downmix, f"WITH {ELEMENTS} SELECT packet_id, CAST(i // 2 AS INTEGER) AS frame, round(CAST(CAST(CAST(first(v ORDER BY i) + last(v ORDER BY i) AS FLOAT) / 2 AS FLOAT) AS DOUBLE), 9) AS sample FROM el GROUP BY packet_id, i // 2"),
    "resample_linear": (resample_linear, f"""WITH {SIG}, p AS (SELECT packet_id, s, unnest(range(CAST(round(len(s) * ({RATE} / 200.0)) AS BIGINT))) AS frame FROM sig), q AS (
  SELECT packet_id, frame, s, least(CAST(floor(frame * (200.0 / {RATE})) AS BIGINT), len(s) - 1) AS lo, frame * (200.0 / {RATE}) AS pos FROM p
) SELECT packet_id, CAST(frame AS INTEGER) AS frame, round(CAST(CAST(CAST(s[lo + 1] AS DOUBLE) + (CAST(s[least(lo + 1, len(s) - 1) + 1] AS DOUBLE) - CAST(s[lo + 1] AS DOUBLE)) * (pos - lo) AS FLOAT) AS DOUBLE), 6) + 0.0::DOUBLE AS sample FROM q"""),
    "normalized_chunks": (normalized_chunks, f"""WITH {SIG}, ranked AS (SELECT source, packet_id, s, row_number() OVER (PARTITION BY source ORDER BY packet_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM sig), ch AS (
  SELECT source, unnest(range(CASE WHEN max(n) * 32 >= 100 THEN (max(n) * 32 - 100) // 80 + 1 ELSE 0 END)) AS seq FROM ranked GROUP BY source
) SELECT c.source, CAST(c.seq AS BIGINT) AS seq, 80::INTEGER AS n_samples, {RATE}::DOUBLE AS sample_rate, round(CAST(CAST(CAST(s[(c.seq * 160) % 64 + 1] + s[(c.seq * 160) % 64 + 2] AS FLOAT) / 2 AS FLOAT) AS DOUBLE), 9) AS first_sample FROM ch c JOIN ranked r ON r.source = c.source AND r.k = c.seq * 160 // 64"""),
    "audio_chunks": (audio_chunks, f"""WITH {SIG}, ranked AS (SELECT source, packet_id, s, row_number() OVER (PARTITION BY source ORDER BY packet_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM sig), flat AS (
  SELECT source, n * 32 AS frames, k * 64 + j AS pos, v FROM (SELECT source, n, k, unnest(s) AS v, unnest(range(len(s))) AS j FROM ranked)
), counts AS (SELECT source, max(frames) AS frames FROM flat GROUP BY source), ch AS (
  SELECT source, unnest(range(CASE WHEN frames >= 100 THEN (frames - 100) // 80 + 1 ELSE 0 END)) AS seq FROM counts
) SELECT c.source, CAST(c.seq AS BIGINT) AS seq, CAST(c.seq * 80 AS BIGINT) AS start_frame, CAST(count(*) AS INTEGER) AS n_samples, round(sum(CAST(v AS DOUBLE) ORDER BY pos), 6) AS total, CAST(first(v ORDER BY pos) AS DOUBLE) AS first_sample, CAST(last(v ORDER BY pos) AS DOUBLE) AS last_sample
FROM ch c JOIN flat f ON f.source = c.source AND f.pos >= c.seq * 160 AND f.pos < c.seq * 160 + 200 GROUP BY c.source, c.seq"""),
    "packet_check": (packet_check, f"""WITH {SIG}, b AS (SELECT packet_id, source, len(s) AS n, CASE WHEN packet_id % 17 = 3 THEN 3 ELSE 2 END AS ch, CASE WHEN packet_id % 19 = 4 THEN 100.0 ELSE 200.0 END AS rate FROM sig), f AS (
  SELECT *, first_value(ch) OVER (PARTITION BY source ORDER BY packet_id) AS ch0, first_value(rate) OVER (PARTITION BY source ORDER BY packet_id) AS rate0 FROM b
) SELECT CASE WHEN n % ch <> 0 THEN 'bad layout' WHEN ch <> ch0 OR rate <> rate0 THEN 'format changed' ELSE 'none' END AS error, count(*) AS packets FROM f GROUP BY 1"""),
    "rms_dbfs": (rms_dbfs, f"WITH {ELEMENTS} SELECT packet_id, round({_DB('', '')}, 9) AS dbfs FROM el GROUP BY packet_id"),
    "vad_threshold": (vad_threshold, f"WITH {ELEMENTS}, {_LEVELS('el')} SELECT packet_id, n_windows, round(threshold_db, 9) AS threshold_db, round(max_db, 9) AS max_db, round(mean_db, 9) AS mean_db FROM thr"),
    "vad_trim_range": (vad_trim_range, f"""WITH {ELEMENTS}, quiet AS (
  SELECT packet_id, i, CASE WHEN i >= 6 * (packet_id % 4) AND i < 6 * (packet_id % 4) + 6 * (packet_id % 6) THEN v ELSE CAST(CAST(v AS DOUBLE) * 0.0001 AS FLOAT) END AS v FROM el
), {_LEVELS('quiet')}, span AS (
  SELECT t.packet_id, min(CASE WHEN w.db >= t.threshold_db THEN w.wi END) * 6 AS a, (max(CASE WHEN w.db >= t.threshold_db THEN w.wi END) + 1) * 6 AS b FROM thr t JOIN win w ON w.packet_id = t.packet_id GROUP BY t.packet_id
), got AS (SELECT packet_id, CASE WHEN a IS NOT NULL AND (b - a) / 200.0 >= 0.1 THEN greatest(0, a - 40) END AS s, CASE WHEN a IS NOT NULL AND (b - a) / 200.0 >= 0.1 THEN least(64, b + 40) END AS e FROM span)
SELECT packet_id, CAST(coalesce(s, -1) AS INTEGER) AS start, CAST(coalesce(e, -1) AS INTEGER) AS "end", CAST(coalesce(e - s, 0) AS INTEGER) AS n_kept, CASE WHEN s IS NULL THEN 'no voice' ELSE '' END AS error FROM got"""),
    "pcm_quantize": (pcm_quantize, f"WITH {ELEMENTS} SELECT packet_id, string_agg(CAST({_Q} AS VARCHAR), ',' ORDER BY i) AS pcm FROM el GROUP BY packet_id"),
    "pcm_correlation": (pcm_correlation, f"""WITH {ELEMENTS}, p AS (SELECT a.packet_id, sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE) ORDER BY a.i) AS d, sum(CAST(a.v AS DOUBLE) * CAST(a.v AS DOUBLE) ORDER BY a.i) AS x, sum(CAST(b.v AS DOUBLE) * CAST(b.v AS DOUBLE) ORDER BY a.i) AS y
  FROM el a JOIN el b ON b.packet_id = a.packet_id + 5 AND b.i = a.i GROUP BY a.packet_id)
SELECT packet_id, round(CASE WHEN sqrt(x * y) > 0 THEN abs(d) / sqrt(x * y) ELSE 0.0 END, 9) AS correlation FROM p"""),
    "wav_files": (wav_files, None),
    "pcm_decode": (pcm_decode, f"WITH {ELEMENTS} SELECT packet_id, CAST(i AS INTEGER) AS frame, round(CAST(CAST({_Q} / 32767.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS sample FROM el"),
    "interleave": (interleave, f"WITH {ELEMENTS} SELECT packet_id, CAST((i % 32) * 2 + i // 32 AS INTEGER) AS i, CAST(v AS DOUBLE) AS sample FROM el"),
}

QUERIES["streamed_chunks"] = (streamed_chunks, QUERIES["audio_chunks"][1])
