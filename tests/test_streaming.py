"""For a finite input, streaming gives what the batch versions give."""

import random
import uuid

from pyspark.sql import functions as F

from sightstream.operators import memory as M
from sightstream.operators import transcript as R
from sightstream.operators import windows as W
from sightstream.plans.windows import seen, snapshots
from sightstream.sources.derived import TTL, WINDOW, transcript_chunks
from sightstream.sources.providers import Folder
from sightstream.streaming import processors as P


def replay(spark, df, path, parts, order):
    """Writes df in order as so many files and returns the stream of them."""
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return P.sampled(spark, path, df.schema, parts)


def drained(stream, mode):
    name = "q" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def test_sealed_windows(spark, sf_dir, tmp_path):
    """Encounters with their sightings and roles, and the segments made of them."""
    df = seen(spark, sf_dir).where("session_id < 6")
    stream = replay(spark, df, str(tmp_path / "in"), 3, ["t", "seq"])
    got = drained(P.sealed_windows(stream, WINDOW, TTL), "append")
    want = W.sealed_encounters(df, WINDOW, TTL)
    key = lambda r: (r.session_id, r.window_no, r.started_at, r.ended_at, r.display_id, r.text_hash, r.text, r.first_seen, r.last_seen, r.seen_count, [tuple(s) for s in r.sightings], sorted(tuple(x) for x in r.roles))
    assert sorted(map(key, got)) == sorted(map(key, want.collect())) and got
    again = spark.createDataFrame(got, P.ENCOUNTER)
    segments = lambda e: sorted(map(tuple, W.segments(e.withColumn("role", W.dominant_role(F.col("roles")))).collect()))
    assert segments(again) == segments(want)


def test_commands_begin_windows_and_texts_anew(spark, tmp_path):
    rows = [(1, 0, 0, 1, "one text", None), (1, 1, 61, 1, "two texts", None), (1, 2, 70, 1, "lost", None), (1, 3, 80, 1, "", "clear"), (1, 4, 90, 1, "three", None), (1, 5, 139, 1, "four", None), (1, 6, 140, 1, "five", None), (1, 7, 150, 1, "", "start"), (1, 8, 160, 1, "six", None), (1, 9, 220, 1, "seven", None)]
    df = spark.createDataFrame(rows, "session_id long, seq long, t long, display_id long, text string, command string")
    got = drained(P.sealed_windows(replay(spark, df, str(tmp_path / "a"), 4, ["seq"])), "append")
    want = {(1, 0, 61): {"two texts"}, (2, 80, 140): {"three", "four", "five"}, (1, 160, 220): {"six", "seven"}}
    held = {}
    for r in got:
        held.setdefault((r.window_no, r.started_at, r.ended_at), set()).add(r.text)
    assert held == want | {(1, 0, 61): held[1, 0, 61]} and "two texts" in held[1, 0, 61]
    batch = M.epochs(df, F.col("command").isNotNull())
    assert [(r.seq, r.epoch) for r in batch.orderBy("seq").collect()] == [(0, 0), (1, 0), (2, 0), (4, 1), (5, 1), (6, 1), (8, 2), (9, 2)]
    texts = drained(P.running_transcript(replay(spark, df.withColumn("language", F.lit("en")), str(tmp_path / "b"), 1, ["seq"])), "update")
    assert [(r.added, r.chunks) for r in texts] == [("six seven", 2)]


def test_compared_chunks(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(2), r.choice(["computer", "microphone"]), i, f"c{i}", 0.25 * (i // 3), r.choice([0.0, 2.0, 8.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id long, source string, seq long, chunk_id string, start_time double, duration double")
    stream = replay(spark, df.withColumn("end", F.col("start_time") + F.col("duration")), str(tmp_path / "in"), 1, ["end", "seq"])
    got = sorted((x.session_id, x.new_chunk_id, x.old_chunk_id) for x in drained(P.compared_chunks(stream), "append"))
    want = R.candidates(df.withColumns({"text": F.lit("a b c"), "language": F.lit("en")})).collect()
    assert got == sorted((x.session_id, x.new_chunk_id, x.old_chunk_id) for x in want) and got


def test_live_loop_goes_on_after_an_error(spark, tmp_path):
    rows = [(1, i, [float(i)], 16000.0) for i in range(6)]
    df = spark.createDataFrame(rows, "session_id long, seq long, samples array<double>, sample_rate double")

    def recognise(samples, rate):
        if samples[0] == 2.0:
            raise ValueError("no voice")
        return "no json" if samples[0] == 3.0 else '{"result":{"language":"en"},"transcription":[{"timestamps":{"from":"00:00:00,000","to":"00:00:01,000"},"text":" said %d"}]}' % samples[0]

    heard = []
    q = P.live(replay(spark, df, str(tmp_path / "in"), 2, ["seq"]), recognise, str(tmp_path / "out"), str(tmp_path / "check"), lambda b: heard.extend(r.seq for r in b.collect()))
    q.awaitTermination(240)
    assert q.exception() is None
    assert sorted(r.recognised.text for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()) == ["said 0", "said 1", "said 4", "said 5"]
    assert {r.seq: r.error for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()} == {2: "ValueError: no voice", 3: "no transcription"}
    assert sorted(heard) == [0, 1, 4, 5]


def test_folder_provider_sampler_and_late_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:10", "a", "l"), (1, "2024-01-01 00:05:00", "a", "l"), (1, "2024-01-01 00:00:20", "b", "l"), (1, "2024-01-01 00:09:00", "a", "l")], "session_id long, at string, text_hash string, layout_hash string").withColumn("at", F.to_timestamp("at"))
    for i, r in enumerate(df.collect()):
        spark.createDataFrame([r], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder = Folder(str(tmp_path / "in"), df.schema, files=1)
    assert folder.table(spark).count() == 4
    counts = drained(P.retention(folder.stream(spark), "at", "1 minute", "1 minute"), "update")
    assert sum({(r.window, r.session_id): r["count"] for r in counts}.values()) >= 3
    assert len(drained(P.unseen(folder.stream(spark), "at", "10 minutes"), "append")) == 2
    assert (P.every(0.2), P.every(5)) == ({"processingTime": "1 seconds"}, {"processingTime": "5 seconds"})


def test_changed_snapshots(spark, sf_dir, tmp_path):
    df = snapshots(spark, sf_dir).where("session_id < 6").drop("text")
    stream = replay(spark, df, str(tmp_path / "in"), 2, ["t", "seq"])
    got = drained(P.changed_snapshots(stream), "append")
    want = M.changed(df, ["session_id", "display_id"], ["t", "seq"]).collect()
    assert sorted(r.seq for r in got) == sorted(r.seq for r in want)


def test_running_transcript(spark, sf_dir, tmp_path):
    df = transcript_chunks(spark, sf_dir).select("session_id", "seq", "text", "language")
    stream = replay(spark, df, str(tmp_path / "in"), 2, ["seq", "session_id"])
    got = {}
    for r in sorted(drained(P.running_transcript(stream), "update"), key=lambda r: r.seq):
        got[r.session_id] = (got.get(r.session_id, ("",))[0] + r.added, r.chunks, r.characters, r.language)
    want = {r.session_id: (r.text, r.chunks, r.characters, r.language) for r in R.running_state(df, ["session_id"]).collect()}
    assert got == want


def test_folder_sink(spark, sf_dir, tmp_path):
    df = snapshots(spark, sf_dir).drop("text")
    stream = replay(spark, df, str(tmp_path / "in"), 2, ["t", "seq"])
    q = P.to_folder(P.unseen(stream), str(tmp_path / "out"), str(tmp_path / "check"), lambda b: b.withColumn("seen", F.lit(True)))
    q.awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == M.first_of_each(df, ["t", "seq"]).count()


def test_late_rows_are_told_and_kept(spark, tmp_path):
    """On a shuffled input: rows in time and late ones are all that was sent; which ones is as told by a plain watermark."""
    from sightstream.streaming.lateness import parted, with_lateness

    r = random.Random(11)
    rows = [(i % 3, i, float(max(0, i - r.choice([0, 1, 30, 80]))) if i % 17 else None) for i in range(240)]
    schema = "session_id long, seq long, t double"
    path = str(tmp_path / "in")
    for a in range(0, 240, 40):
        spark.createDataFrame(rows[a : a + 40], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = spark.createDataFrame(drained(with_lateness(stream, ["session_id"], "t", 20.0), "append"), f"{schema}, late_by double")
    newest, want = {}, {}
    for a in range(0, 240, 40):
        bound = {k: v - 20.0 for k, v in newest.items()}
        for k, i, t in rows[a : a + 40]:
            want[i] = bound[k] - t if t is not None and k in bound and t < bound[k] else None
            if t is not None:
                newest[k] = max(newest.get(k, t), t)
    assert {x.seq: x.late_by for x in got.collect()} == want
    kept, late = parted(got)
    assert kept.count() + late.count() == got.count() == len(rows) and late.count() > 20 and kept.columns == ["session_id", "seq", "t"]
