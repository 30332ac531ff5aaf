"""Rules about the snapshot before, in blocks of time, against a scan of each session."""

import random

import pytest
from pyspark.sql import functions as F

from sightstream.operators import memory as M

SCHEMA = "session_id long, display_id long, t long, seq long, text_hash string, layout_hash string, text string"


def rows_of(seed, n=500):
    r, out, t = random.Random(seed), [], -300
    for i in range(n):
        t += r.choice([0, 1, 5, 200])
        h = r.choice(["a", "b", None])
        out.append((r.choice([1, 1, 1, 2, None]), r.choice([1, 2]), None if i < 5 else t, i, h, r.choice(["x", "x", None]), r.choice([" ", "word", "stop"])))
    return out


def scan(rows, keys):
    """The rows of each key in order, with whether text or layout differ from those of the row before."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        mine = out.setdefault(tuple(r[k] for k in keys) if not callable(keys) else keys(r), [])
        mine.append((r, not mine or mine[-1][0][4:6] != r[4:6]))
    return out


@pytest.mark.parametrize("block", [1, 7, 1000, 10**6])
def test_blocks_equal_the_scan(spark, block):
    rows = rows_of(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    by_session, by_display = scan(rows, (0,)), scan(rows, (0, 1))
    got = M.changed(df, ["session_id"], block=block)
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for s in by_session.values() for r, new in s if new)

    want = set()
    for s in by_display.values():
        run, runs = -1, {}
        for r, new in s:
            run += new
            runs.setdefault(run, []).append(r[3])
        want |= {(q, k, min(seqs)) for k, seqs in runs.items() for q in seqs}
    assert {(r.seq, r.run, r.document_seq) for r in M.document_runs(df, block).collect()} == want

    want, n = set(), dict.fromkeys(by_session, 0)
    for k, s in by_session.items():
        for r, _ in s:
            n[k] += r[6] == "stop"
            want |= {(r[3], n[k])} if r[6] != "stop" else set()
    assert {(r.seq, r.epoch) for r in M.epochs(df, F.col("text") == "stop", block).collect()} == want

    texts = scan(rows, lambda r: (r[0], r[6] != " "))
    want = {k: (len(s), sum(r[6] == " " for r, _ in s), sum(not new for r, new in texts.get((k[0], True), [])), sum(new for r, new in texts.get((k[0], True), []))) for k, s in by_session.items()}
    assert {(r.session_id,): (r.captured, r.blank, r.skipped, r.cached) for r in M.run_counters(df, F.col("text") != " ", block).collect()} == want


def test_long_session_is_many_tasks_and_empty(spark):
    df = spark.createDataFrame([(1, 1, *r[2:]) for r in rows_of(3)], SCHEMA)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # what is small is put together by Spark
    try:
        for d in (M.changed(df, ["session_id"], block=600), M.epochs(df, F.col("text") == "stop", 600)):
            assert d.select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.unset(key)
    none = df.limit(0)
    assert M.changed(none, ["session_id"]).count() == M.document_runs(none).count() == M.epochs(none, F.lit(True)).count() == M.run_counters(none, F.lit(True)).count() == 0
