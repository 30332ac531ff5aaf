"""What a memory of few texts lets go after every sample, against a plain scan, and against the stream."""

import random

import pytest
from pyspark.sql import functions as F

from sightstream.functions.text import text_hash
from sightstream.operators import windows as W
from sightstream.streaming import processors as P
from tests.test_streaming import drained, replay

SAMPLE = "session_id long, t long, seq long, display_id long, text string, role string, x double, y double, w double, h double"


def rows_of(seed, n, texts, step, more=1, sessions=2):
    """Samples of up to `more` texts each."""
    r, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += r.choice(step)
        for _ in range(r.randint(1, more)):
            out.append((r.randrange(sessions), t, i, r.randint(1, 2), f"text {r.choice('abcdefghijklmnop'[:texts])}", r.choice(["paragraph", "heading"]), 0.0, 0.0, 0.1, 0.1))
    return out


def scanned(rows, limit, ttl):
    """session, display, hash, run -> first time, last time, times seen; and what is held at each session's end."""
    runs, held = {}, {}
    for session in {r[0] for r in rows}:
        memory, number = {}, {}
        mine = [r for r in rows if r[0] == session]
        for t, seq in sorted({(r[1], r[2]) for r in mine}):
            memory = {k: v for k, v in memory.items() if v[0][0] >= t - ttl}
            for r in (r for r in mine if (r[1], r[2]) == (t, seq)):
                k = (r[3], r[10])
                if k not in memory:
                    number[k] = number.get(k, -1) + 1
                memory[k] = ((t, seq), -k[0], tuple(-ord(c) for c in k[1]))
                first, _, n = runs.get((session, *k, number[k]), (t, t, 0))
                runs[(session, *k, number[k])] = (first, t, n + 1)
            memory = dict(sorted(memory.items(), key=lambda kv: kv[1], reverse=True)[:limit])
        held |= {(session, *k, number[k]): runs[(session, *k, number[k])] for k in memory}
    return runs, held


@pytest.mark.parametrize(("limit", "ttl", "lives", "more", "step"), [(1, 20, 1, 1, [1]), (3, 20, 1, 1, [0, 1, 3]), (4, 7, 2, 1, [0, 1, 2, 9]), (3, 30, 1, 5, [1, 2]), (5, 1000, 16, 3, [0, 1]), (100, 10, 1, 2, [1, 12])])
def test_runs_equal_the_scan(spark, limit, ttl, lives, more, step):
    rows = rows_of(limit + ttl, 400, 9, step, more)
    df = spark.createDataFrame(rows, SAMPLE).withColumn("text_hash", text_hash("text"))
    runs, held = scanned([tuple(r) for r in df.collect()], limit, ttl)
    told = W.evictions(df.repartition(3), ["session_id"], limit, ttl, lives)
    assert told.columns == [*df.columns, "lost"] and told.count() == len(rows)
    by = ["session_id", "display_id", "text_hash"]
    got = W.gap_sessions(told, by, ttl, F.col("lost")).groupBy(*by, "run").agg(F.min("t"), F.max("t"), F.count("*")).collect()
    assert {tuple(r[:4]): tuple(r[4:]) for r in got} == runs
    found = W.encounters(df.drop("text_hash"), ["session_id"], ttl, limit)
    assert {(r.session_id, r.display_id, r.text_hash, r.run): (r.first_seen, r.last_seen, r.seen_count) for r in found.collect()} == runs
    now = found.join(df.groupBy("session_id").agg(F.max("t").alias("now")), "session_id")
    assert {(r.session_id, r.display_id, r.text_hash, r.run): (r.first_seen, r.last_seen, r.seen_count) for r in W.remembered(now, ["session_id"], F.col("now"), ttl, limit).collect()} == held


def test_long_session_is_many_tasks(spark):
    df = spark.createDataFrame(rows_of(1, 600, 12, [1, 2], sessions=1), SAMPLE).withColumn("text_hash", text_hash("text"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # what is small is put together by Spark
    try:
        many = W.evictions(df, ["session_id"], 4, 10, 1)
        assert many.select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.unset(key)
    rows = lambda d: sorted(map(tuple, d.select("t", "seq", "display_id", "text", "lost").collect()))
    one = W.evictions(df, ["session_id"], 4, 10, 10**6).withColumn("lost", F.col("lost"))
    gap = lambda d: W.gap_sessions(d, ["session_id", "display_id", "text_hash"], 10, F.col("lost")).drop("lost").withColumn("lost", F.col("run"))
    assert rows(gap(many)) == rows(gap(one))


def test_nulls_and_empty(spark):
    rows = [(1, None, 1, 1, "no time"), (1, 5, 1, 1, "no time"), (1, 6, 2, None, "text"), (1, 7, 3, None, None), (None, 8, 4, 1, "text"), (1, 8, None, 1, "no time"), (1, 9, 5, None, "text"), (1, 9, 5, None, "text")]
    df = spark.createDataFrame([(*r, None, 0.0, 0.0, 0.0, 0.0) for r in rows], "session_id long, t long, seq long, display_id long, text string, role string, x double, y double, w double, h double")
    got = W.encounters(df, ["session_id"], 60, 1).collect()
    # display null's text is seen at 6, lets "no time" go, is let go by it at 8
    assert sorted((str(r.session_id), str(r.display_id), r.text, r.run, r.seen_count) for r in got) == [("1", "1", "no time", 0, 2), ("1", "1", "no time", 1, 1), ("1", "None", "text", 0, 1), ("1", "None", "text", 1, 2), ("None", "1", "text", 0, 1)]
    assert W.encounters(df.limit(0), ["session_id"], 60, 1).count() == 0


@pytest.mark.parametrize(("limit", "more"), [(2, 1), (4, 1), (3, 4)])
def test_stream_equals_batch(spark, tmp_path, limit, more):
    rows = [r for r in rows_of(limit, 250, 8, [0, 1, 1, 2, 30], more)]
    # the sample that seals a window has one text: the stream begins the next window with what follows in it
    rows = [r for i, r in enumerate(rows) if more == 1 or r[1] % 5 or i == 0 or rows[i - 1][2] != r[2]]
    df = spark.createDataFrame(rows, SAMPLE)
    length = 10**6 if more > 1 else 40
    if more > 1:
        df = df.union(spark.createDataFrame([(s, 2 * 10**6, 10**6, 1, "the end", "paragraph", 0.0, 0.0, 0.1, 0.1) for s in range(2)], SAMPLE))
    ttl = 3 * 10**6 if more > 1 else 15
    got = drained(P.sealed_windows(replay(spark, df, str(tmp_path / "in"), 3, ["t", "seq"]), length, ttl, limit), "append")
    want = W.sealed_encounters(df, length, ttl, limit).collect()
    key = lambda r: (r.session_id, r.window_no, r.display_id, r.text_hash, r.first_seen, r.last_seen, r.seen_count, len(r.sightings))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) >= limit


def test_stretches_that_cannot_overflow_are_not_read_row_by_row(spark):
    df = spark.createDataFrame(rows_of(5, 300, 9, [1, 2]), SAMPLE).withColumn("text_hash", text_hash("text"))
    assert W.evictions(df, ["session_id"], 10**4, 10).where("lost").count() == 0
    # one long session overflows, many short ones beside it don't
    more = df.where("session_id = 0").union(df.where("session_id = 1").withColumn("session_id", F.col("session_id") + F.floor(F.col("t") / 20)))
    runs, _ = scanned([tuple(r) for r in more.collect()], 6, 40)
    told = W.evictions(more.repartition(3), ["session_id"], 6, 40, 1)
    by = ["session_id", "display_id", "text_hash"]
    got = W.gap_sessions(told, by, 40, F.col("lost")).groupBy(*by, "run").agg(F.min("t"), F.max("t"), F.count("*")).collect()
    assert {tuple(r[:4]): tuple(r[4:]) for r in got} == runs and told.where("lost and session_id > 0").count() < told.where("lost and session_id = 0").count()
