"""Pairs of chunks scored in a stream, by content and order, as in batch."""

import random

import pytest
from pyspark.sql import functions as F

from sightstream.operators import transcript as R
from sightstream.streaming import duplicates as D
from tests.test_streaming import drained, replay

SCHEMA = "session_id long, source string, seq long, chunk_id string, start_time double, duration double, language string, text string, samples array<float>, sample_rate double"
WORDS = ["the deadline is tomorrow morning", "The deadline is tomorrow morning.", "we met about the new plan for lunch today", "we met about the new plan for lunch today again", "Thanks.", "", None, "á long été of words that go on", "a long ete of words that go on"]


def chunks(r, n):
    rows = []
    for i in range(n):
        source = r.choice(["computer", "microphone", "other"] if i % 9 == 0 else ["computer", "microphone"])
        tone = [float((j * (1 + i % 3)) % 7 - 3) for j in range(r.choice([0, 20, 30]))]
        rows.append((r.randrange(2), source, i, f"c{i}", 0.5 * (i // 2), r.choice([0.0, 2.0, 2.1, 8.0]), r.choice([None, "en", "de"]), r.choice(WORDS), tone, 200.0))
    return rows


@pytest.mark.parametrize("pcm", [False, True])
def test_scored_pairs_equal_batch(spark, tmp_path, pcm):
    df = spark.createDataFrame(chunks(random.Random(5 + pcm), 300), SCHEMA)
    ordered = df.withColumn("end", F.col("start_time") + F.col("duration"))
    got = drained(D.scored_pairs(replay(spark, ordered, str(tmp_path / "in"), 1, ["end", "seq", "source", "chunk_id"]), pcm=pcm), "append")
    batch = R.duplicates(df.withColumn("text", F.coalesce("text", F.lit(""))), pcm=pcm)
    want = sorted((x.session_id, x.primary_id, x.duplicate_id, round(x.confidence, 12), list(x.signals), x["at"].time, x["at"].seq, x["at"].rank) for x in batch.collect())
    assert sorted((x.session_id, x.primary_id, x.duplicate_id, round(x.confidence, 12), list(x.signals), x.time, x.seq, x.rank) for x in got) == want and len(want) > 40
    first = R.first_annotation(df, batch).where("duplicate_of is not null").collect()
    told = D.annotations(spark.createDataFrame(got, f"session_id long, {D.FOUND}")).collect()
    assert sorted((x.session_id, x.chunk_id, x.duplicate_of, round(x.duplicate_confidence, 12)) for x in told) == sorted((x.session_id, x.chunk_id, x.duplicate_of, round(x.duplicate_confidence, 12)) for x in first)


def test_windows_go_on_from_micro_batch_to_micro_batch(spark, tmp_path):
    """One chunk a micro-batch; a command empties the windows; what was found isn't found again."""
    line = "the deadline is tomorrow morning"
    rows = [(1, "computer", 0, "a", 0.0, 5.0, "en", line, None), (1, "microphone", 1, "b", 0.1, 5.0, "en", line, None), (1, "microphone", 2, "b", 0.1, 5.0, "en", line, None), (1, "computer", 3, "c", 0.2, 5.0, "en", line, None), (1, "computer", 4, "", 0.0, 0.0, None, "", "clear"), (1, "microphone", 5, "d", 0.3, 5.0, "en", line, None), (1, "computer", 6, "e", 60.0, 5.0, "en", line, None)]
    df = spark.createDataFrame(rows, "session_id long, source string, seq long, chunk_id string, start_time double, duration double, language string, text string, command string")
    path = str(tmp_path / "in")
    for r in rows:
        spark.createDataFrame([r], df.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drained(D.scored_pairs(stream), "append")
    assert sorted((x.primary_id, x.duplicate_id, x.first) for x in got) == [("a", "b", True), ("b", "c", True)]
