"""Frames that a display's cache holds are served from it: A, B, A; expiry; the document after the last that fits; streams."""

import random

from pyspark.sql import functions as F

from sightstream.operators import framecache as C
from sightstream.streaming import samples as S
from tests.test_streaming import drained

FRAMES = "session_id long, display_id long, seq long, t long, frame_hash string, text string, text_hash string, layout_hash string"


def frame(seq, t, h, text=None, layout="l", display=1, session=1):
    text = h if text is None else text
    return (session, display, seq, t, h, text, text, layout)


def told(spark, rows, **k):
    return [(r.document_seq, r.reused) for r in C.served(spark.createDataFrame(rows, FRAMES).repartition(3), **k).orderBy("session_id", "display_id", "t", "seq").collect()]


def test_a_frame_seen_before_is_served_again(spark):
    assert told(spark, [frame(0, 0, "A"), frame(1, 1, "B"), frame(2, 2, "A"), frame(3, 3, "B")]) == [(0, False), (1, False), (0, True), (1, True)]


def test_documents_expire_strictly_after_their_age(spark):
    rows = [frame(0, 0, "A"), frame(1, 600, "A"), frame(2, 601, "A"), frame(3, 700, "B"), frame(4, 1201, "A"), frame(5, 1202, "A")]
    assert told(spark, rows) == [(0, False), (0, True), (2, False), (3, False), (2, True), (5, False)]
    assert told(spark, rows, max_age=0) == [(0, False), (0, True), (0, True), (3, False), (0, True), (0, True)]


def test_the_21st_document_takes_the_place_of_the_first(spark):
    rows = [frame(i, i, f"f{i}") for i in range(21)] + [frame(21, 21, "f1"), frame(22, 22, "f0"), frame(23, 23, "f1")]
    assert told(spark, rows)[20:] == [(20, False), (1, True), (22, False), (23, False)]


def test_equal_texts_are_the_current_document(spark):
    """Another frame of the same text and layout is recognised, served the current document, and not held by its own hash."""
    rows = [frame(0, 0, "A", "x"), frame(1, 1, "B", "x"), frame(2, 2, "B", "x"), frame(3, 3, "C", "x", "other"), frame(4, 4, "A", "x"), frame(5, 5, None, "n"), frame(6, 6, None, "n")]
    assert told(spark, rows) == [(0, False), (0, False), (0, False), (3, False), (0, True), (5, False), (5, False)]


def test_only_misses_are_recognised(spark, tmp_path):
    log = str(tmp_path)

    def recognise(row):
        with open(f"{log}/{row['seq']}", "w") as f:
            f.write("x")
        return f"text of {row['frame_hash']}", row["frame_hash"], "l"

    rows = [(1, 1, i, i, h, None, None, None) for i, h in enumerate("ABAACB")]
    got = C.served(spark.createDataFrame(rows, FRAMES), recognise=recognise).orderBy("seq").collect()
    assert [r.text for r in got] == [f"text of {h}" for h in "ABAACB"] and [r.reused for r in got] == [False, False, True, True, False, True]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0", "1", "4"]
    assert C.served(spark.createDataFrame([], FRAMES)).count() == 0


def streamed(spark, rows, path, parts):
    df = spark.createDataFrame(rows, FRAMES).withColumn("at", F.timestamp_seconds("t"))
    kept = df.collect()
    step = -(-len(kept) // parts)
    for i in range(parts):
        if part := kept[i * step : (i + 1) * step]:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("at", "2 seconds")


def test_samples_in_a_stream_equal_batch(spark, tmp_path):
    """Displays of a sample come in different micro-batches; one never comes; one comes after its sample was closed."""
    r = random.Random(3)
    rows = [frame(s, 3 * s + d, r.choice("ABCDE"), display=d, session=session) for s in range(40) for session in (1, 2) for d in (1, 2, 3)]
    missing = [x for x in rows if not (x[2] == 7 and x[1] == 2)]
    late = (1, 2, 7, 399, "Z", "late text", "z", "l")  # behind its sample, not behind the watermark
    got = drained(S.samples(streamed(spark, [*missing, late, frame(60, 400, "A"), frame(61, 401, "A", display=2)], str(tmp_path / "in"), 7), 3, wait=5), "append")
    batch = C.assembled(C.served(spark.createDataFrame(missing, FRAMES)), F.lit(3)).collect()
    key = lambda x, status: (x.session_id, x.seq, x.t, x.displays, x.reused, x.recognised, x.text, status)
    want = sorted(key(x, S.COMPLETE if x.complete else S.INCOMPLETE) for x in batch)
    assert sorted(key(x, x.status) for x in got if x.status != S.LATE and x.seq < 60) == want
    assert [x.status for x in got].count(S.INCOMPLETE) >= 2 and {x[7] for x in want} == {S.COMPLETE, S.INCOMPLETE}
    assert [(x.seq, x.text) for x in got if x.status == S.LATE] == [(7, "Display 2\nlate text")]
