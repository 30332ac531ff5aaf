"""Captured packets read by name: as a table, as a stream that drops the oldest of a burst, and through the buffer of frames."""

import io
import wave

from pyspark.sql import functions as F

from sightstream.operators import audio as A
from sightstream.sources import datasource as D
from sightstream.streaming import audio as S
from tests.test_streaming import drained


def put(folder, number, source="mic", n=20, rate=100, channels=1):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(int((number * 7 + i) % 200 - 100).to_bytes(2, "little", signed=True) for i in range(n * channels)))
    (folder / f"{number:06d}-{source}.wav").write_bytes(raw.getvalue())


def test_a_table_has_all_packets(spark, tmp_path):
    for i in range(30):
        put(tmp_path, i, "ab"[i % 2], channels=1 + i % 2)
    (tmp_path / "000030-a.wav").write_bytes(b"RIFF")
    (tmp_path / "other.txt").write_text("x")
    df = D.Captured(str(tmp_path), files=7).table(spark)
    assert df.schema.simpleString() == spark.createDataFrame([], D.SCHEMA).schema.simpleString()
    got = {r.packet_id: r for r in df.collect()}
    assert sorted(got) == list(range(31)) and df.rdd.getNumPartitions() == 5
    assert (got[3].source, got[3].channels, got[3].sample_rate, len(got[3].samples)) == ("b", 2, 100.0, 40)
    assert abs(got[1].samples[0] - (7 - 100) / 32767) < 1e-7 and (got[30].samples, got[30].channels) == ([], 0)
    assert D.Captured(str(tmp_path / "none")).table(spark).count() == 0


def test_a_burst_drops_the_oldest_and_says_so(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(10):
        put(folder, i)
    stream = D.Captured(str(folder)).stream(spark)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination(240)
        assert q.exception() is None
        return {r.packet_id: r.dropped for r in spark.read.parquet(out).collect()}

    assert run() == {i: 0 for i in range(10)}
    for i in range(10, 610):
        put(folder, i, n=2)
    got = run()
    assert sorted(got) == [*range(10), *range(98, 610)]  # 600 came, 88 were dropped
    assert got[98] == 88 and sum(got.values()) == 88
    assert run() == got
    whole = drained(D.Captured(str(folder), buffer=0).stream(spark), "append")
    assert len(whole) == 610 and not any(r.dropped for r in whole)


def test_the_stream_feeds_the_buffer_of_frames(spark, tmp_path):
    for i in range(60):
        put(tmp_path, i, "ab"[i % 2], n=7 + i % 5)
    source = D.Captured(str(tmp_path), files=9)
    got = spark.createDataFrame(drained(S.buffered(source.stream(spark), 0.5, 0.1), "append"), f"source string, {S.ROW}")
    total = lambda df: sorted((r.source, r.seq, r.start_frame, round(r.total, 6)) for r in df.select("source", "seq", "start_frame", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")).collect())
    assert total(S.chunks(got)) == total(A.chunks(source.table(spark).drop("dropped"), 0.5, 0.1)) and S.chunks(got).count() > 8
