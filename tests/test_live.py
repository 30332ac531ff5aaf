"""Packets in a stream: any split into micro-batches gives what the batch operators give; tables are written whole and once."""

import math
import random

import pytest

from sightstream.operators import audio as A
from sightstream.operators import transcript as R
from sightstream.sources.versions import Versions
from sightstream.streaming import audio as S
from sightstream.streaming import live as L
from tests.test_streaming import drained

PACKETS = "packet_id long, source string, samples array<float>, sample_rate double, channels int"
RATE = 100.0


def tone(start, n, loud=0.5):
    return [float(loud * math.sin(0.9 * i)) for i in range(start, start + n)]


def packets(r):
    """Two sources of uneven packets, one stereo; empty ones, a wrong layout, changed formats."""
    rows, at = [], 0
    for source, channels in (("a", 1), ("b", 2)):
        for _ in range(60):
            n = r.choice([0, 1, 7, 40, 130]) * channels
            loud = 0.0 if r.random() < 0.3 else 0.5
            rows.append((at, source, tone(at, n, loud), RATE, channels))
            at += 1
    rows += [(at, "b", [0.5, 0.5, 0.5], RATE, 2), (at + 1, "a", [0.5], 2 * RATE, 1), (at + 2, "a", [0.5, 0.5], RATE, 2), (at + 3, "c", [0.1], 0.0, 1), (at + 4, "a", None, RATE, 1), (at + 5, "d", [0.1] * 30, RATE, 1)]
    return rows


def streamed(spark, rows, path, r, parts):
    """Rows in order, in files of random sizes, one a micro-batch."""
    cuts = sorted(r.sample(range(1, len(rows)), parts - 1))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], PACKETS).coalesce(1).write.parquet(f"{path}/{i:03d}")
    files = sorted(p for p in path.iterdir())
    for i, folder in enumerate(files):  # one folder for the stream, files in the order of their times
        (f,) = folder.glob("*.parquet")
        f.rename(path / f"{i:03d}.parquet")
        import os

        os.utime(path / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(path))


def good(df):
    return A.checked(df).where("error is null").drop("error")


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_of_any_split(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = packets(r)
    table = spark.createDataFrame(rows, PACKETS)
    got = drained(S.buffered(streamed(spark, rows, tmp_path, r, 6), 0.5, 0.1), "append")
    frame = spark.createDataFrame(got, f"source string, {S.ROW}")
    key = lambda x: (x.source, x.seq, x.start_frame, x.sample_rate, x.channels, list(x.samples))
    want = sorted(map(key, A.chunks(good(table), 0.5, 0.1).collect()))
    assert sorted(map(key, S.chunks(frame).collect())) == want and len(want) > 40
    bad = A.checked(table).where("error is not null").select("source", "packet_id", "sample_rate", "channels", "error").collect()
    assert sorted(map(tuple, S.errors(frame).collect())) == sorted(map(tuple, bad)) and len(bad) == 4
    assert sorted(map(tuple, S.available(frame).collect())) == sorted(map(tuple, A.available(good(table), 0.5, 0.1).collect()))


def test_late_packets_are_refused(spark, tmp_path):
    rows = [(0, "a", [1.0] * 30, RATE, 1), (2, "a", [1.0] * 30, RATE, 1), (1, "a", [1.0] * 30, RATE, 1), (3, "a", [1.0] * 30, RATE, 1)]
    got = drained(S.buffered(streamed(spark, rows, tmp_path, random.Random(0), 4), 0.5, 0.1), "append")
    assert [(x.packet_id, x.error) for x in got if x.kind == S.ERROR] == [(1, "late packet")]
    assert sum(x.kind == S.CHUNK for x in got) == 2
    with pytest.raises(ValueError):
        S.buffered(spark.createDataFrame([], PACKETS), 1.0, 1.0)


def recognise(samples, rate):
    """Text by the number of samples; some chunks fail, some give no JSON, some say nothing."""
    n = len(samples)
    if n % 5 == 1:
        raise ValueError("failed")
    if n % 5 == 2:
        return "no json"
    text = "" if n % 5 == 3 else f" we said {n % 7} and {n % 3}"
    return '{"result":{"language":%s},"transcription":[{"timestamps":{"from":"00:00:00,000","to":"00:00:00,200"},"text":"%s"}]}' % ('"en"' if n % 2 else "null", text)


def told(rows):
    return sorted(str((x.source, x.seq, x.chunk_id, x.start_time, x.end_time, x.language, x.text, [tuple(s) for s in x.segments])) for x in rows)


def in_batch(spark, rows):
    heard = L.recognised_chunks(A.chunks(good(spark.createDataFrame(rows, PACKETS)), 0.5, 0.1), recognise, RATE)
    return heard.collect(), R.running_state(heard.where("error is null"), ["source"]).collect()


def test_live_loop_equals_batch_and_survives_a_kill(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    rows = packets(r)
    (tmp_path / "in").mkdir()
    stream = streamed(spark, rows, tmp_path / "in", r, 5)
    heard, texts = in_batch(spark, rows)
    start = lambda: L.live_transcripts(stream, recognise, str(tmp_path / "out"), str(tmp_path / "check"), 0.5, 0.1, rate=RATE)
    sink = L.opened(spark, str(tmp_path / "out"))
    inner, calls = Versions.write, []

    def dies(self, table, df, partition_by=None):
        """After the third micro-batch has written its chunks and before it writes its errors."""
        calls.append(table)
        if table == "transcript" and calls.count("transcript") == 3:
            raise RuntimeError("killed")
        return inner(self, table, df, partition_by)

    with monkeypatch.context() as m:
        m.setattr(Versions, "write", dies)
        q = start()
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination(240)
    assert calls[-2:] == ["chunks", "transcript"]
    seen = sink.versions.manifest()[1]
    assert seen["batch"] == 1 and {t: len(f) for t, f in seen["tables"].items()} == {"chunks": 2, "transcript": 2, "errors": 2, "state": 1}
    half = sink.read("chunks").count()
    assert half == sink.facts()["next_id"] - 1 and half < sum(x.error is None for x in heard)
    start().awaitTermination(240)
    stored = sink.read("chunks").collect()
    assert told(stored) == told(x for x in heard if x.error is None) and len(stored) > 10
    assert sorted(x.id for x in stored) == list(range(1, len(stored) + 1))
    refused = [(x.source, x.seq, x.error) for x in heard if x.error is not None]
    packet_errors = A.checked(spark.createDataFrame(rows, PACKETS)).where("error is not null").select("source", "packet_id", "error").collect()
    assert sorted(str((x.source, x.seq, x.error)) for x in sink.read("errors").where("seq is not null").collect()) == sorted(map(str, refused)) and {e for _, _, e in refused} >= {"no voice"}
    assert sorted((x.source, x.packet_id, x.error) for x in sink.read("errors").where("packet_id is not null").collect()) == sorted(map(tuple, packet_errors))
    assert {x.source: x.text for x in L.text_of(sink).collect()} == {x.source: x.text for x in texts}
    assert {(x.source, x.chunks, x.characters, x.language) for x in sink.read("state").collect()} == {(x.source, x.chunks, x.characters, x.language) for x in texts}
    before = sink.versions.manifest()
    start().awaitTermination(240)  # nothing new: nothing written
    assert sink.versions.manifest() == before
    assert not sink.publish(seen["batch"], {"errors": sink.read("errors")}) and sink.versions.manifest() == before
    sink.compact("chunks")
    assert told(sink.read("chunks").collect()) == told(stored) and len(sink.versions.manifest()[1]["tables"]["chunks"]) == 1
