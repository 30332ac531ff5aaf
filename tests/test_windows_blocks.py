"""Seals of one long session found by many tasks, against the scan of all its ticks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightstream.operators import windows as W


def scanned(rows, length, start=None):
    """session -> seals, one tick after another."""
    out, sessions = [], {}
    for session, seq, t in rows:
        sessions.setdefault(session, {}).setdefault(t, []).append(seq)
    for session, ticks in sessions.items():
        anchor, number, since = min(ticks) if start is None else start, 0, (None, None)
        for t in sorted(ticks):
            if t >= anchor + length:
                number += 1
                out.append((session, number, anchor, t, min(ticks[t]), *since))
                anchor, since = t, (t, min(ticks[t]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "block", "gap"), [(60, 60, 1), (60, 61, 7), (60, 600, 40), (5, 7, 3), (1, 1, 2), (60, None, 90)])
def test_blocks_equal_the_scan(spark, length, block, gap):
    r = random.Random(length + gap)
    rows, t = [], -500
    for i in range(1500):
        t += r.choice([0, 0, 1, 1, gap, gap, r.randrange(1, 4 * length + 2) if i % 50 == 0 else 1])
        rows.append((i % 40 // 37, i, t))
    df = spark.createDataFrame(rows, "session_id long, seq long, t long").repartition(3)
    got = W.windows(df, length, block=block)
    assert sorted((tuple(x) for x in got.collect()), key=str) == scanned(rows, length)
    for start in (-10_000, rows[700][2], 10**7):
        got = W.windows(df, length, F.lit(start), block=block)
        assert sorted((tuple(x) for x in got.collect()), key=str) == scanned(rows, length, start)


def test_one_session_of_all_events_is_many_tasks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(1).cast("long").alias("session_id"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    rows = [tuple(x) for x in e.collect()]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # what is small is put together by Spark
    try:
        got = W.windows(e, 3600, block=7200).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    assert sorted((tuple(x)[:-1] for x in got), key=str) == scanned(rows, 3600) and len({x.task for x in got}) > 2
    assert W.windows(e.limit(0), 60).count() == 0


def test_many_blocks_are_one_batch(spark):
    """Blocks are read together, not one after another, and those that lie over the ends of batches are whole."""
    n = 3000
    rows = [(s, 0, t, 10 * s + t) for s in range(n) for t in (1, 5, 9, 12)]
    table = pa.table({"session_id": [r[0] for r in rows], "block": [0] * len(rows), "t": [r[2] for r in rows], "seq": [r[3] for r in rows], "start": pa.nulls(len(rows), pa.int64())})
    for size in (len(rows), 7, 1):
        told = list(W._tables(4, 100)(iter(table.to_batches(size))))
        assert [(e["t"], e["last"], e["n"]) for e in pa.Table.from_batches(told)["entries"][5].as_py()] == [(1, 9, 3), (5, 9, 2)]
        begun = pa.Table.from_batches(list(W._begun(4)(iter(told))))
        assert begun["anchor"].to_pylist() == [1] * n
        of = [i for i in range(n) for _ in range(4)]
        joined = table.drop_columns("start")
        for c in ("anchor", "number", "from_t", "from_seq"):
            joined = joined.append_column(c, begun[c].take(of))
        found = list(W._seals(4)(iter(joined.to_batches(size))))
        assert [tuple(r.values()) for r in pa.Table.from_batches(found).sort_by([("session_id", "ascending"), ("window_no", "ascending")]).slice(2, 2).to_pylist()] == [(1, 1, 1, 5, 15, None, None), (1, 2, 5, 9, 19, 5, 15)]
        assert size < len(rows) or max(len(told), len(found)) <= 2  # the last block waits for its end


def test_samples_without_a_time_or_session(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, None), (None, 3, 5), (None, 4, 90), (1, 5, 70)], "session_id long, seq long, t long")
    assert [tuple(r) for r in W.windows(df, 60).collect()] == [(1, 1, 0, 70, 5, None, None)]
