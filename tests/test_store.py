"""Stores in versions: ids that are never given twice, writers at once, what readers see, tables of a stream that are written whole."""

import threading

import pytest
from pyspark.sql import functions as F

from sightstream.operators import storage as Q
from sightstream.sources.versions import Versions

ROWS = "name string, t long"


def store(spark, path, key=None):
    return Q.Store(spark, str(path), "id bigint, name string, t bigint", key)


def rows(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], ROWS)


def held(s, version=None):
    return sorted((r.id, r.name) for r in s.read(version).collect())


def test_ids_are_never_given_twice(spark, tmp_path):
    s = store(spark, tmp_path)
    assert held(s) == []
    assert [(r.id, r.name) for r in s.append(rows(spark, "a", "b"), ["t"]).stored.orderBy("id").collect()] == [(1, "a"), (2, "b")]
    s.clear(F.col("name") == "b")
    assert [r.id for r in s.append(rows(spark, "c"), ["t"]).stored.collect()] == [3]
    assert held(s) == [(1, "a"), (3, "c")]
    s.clear()
    assert held(s) == [] and [r.id for r in s.append(rows(spark, "d", "d"), ["t"]).stored.orderBy("id").collect()] == [4, 5]
    s.delete_older("t", F.lit(1))
    assert held(s) == [(5, "d")]
    assert held(s, 1) == [(1, "a"), (2, "b")] and held(s, 3) == [(1, "a"), (3, "c")]  # versions stay as they were


def test_keys_are_unique_and_nulls_are_keys(spark, tmp_path):
    s = store(spark, tmp_path, ["name"])
    done = s.append(rows(spark, "a", None, "a", "b"), ["t"])
    assert sorted((r.name or "", r.t) for r in done.stored.collect()) == [("", 1), ("a", 0), ("b", 3)]
    assert [(r.name, r.t) for r in done.rejected.collect()] == [("a", 2)] and done.rejected.columns == ["name", "t"]
    done = s.append(rows(spark, None, "c"), ["t"])
    assert [(r.id, r.name) for r in done.stored.collect()] == [(4, "c")] and done.rejected.count() == 1
    assert s.append(rows(spark), ["t"]).stored.count() == 0
    assert s.read().count() == 4


def test_many_groups_of_ids_have_no_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q.Store, "GROUP", 7)
    s = store(spark, tmp_path)
    for n in (50, 23):
        s.append(spark.range(n).select(F.lit("x").alias("name"), F.col("id").alias("t")), ["t"])
    assert [i for i, _ in held(s)] == list(range(1, 74))


def test_two_writers_at_once(spark, tmp_path):
    """Both appends are whole and their ids differ; of one key one row is stored."""
    plain, keyed = store(spark, tmp_path / "plain"), store(spark, tmp_path / "keyed", ["name"])
    errors = []

    def work(k):
        try:
            for j in range(3):
                store(spark, tmp_path / "plain").append(rows(spark, *(f"{k}-{j}-{i}" for i in range(5))), ["t"])
            store(spark, tmp_path / "keyed", ["name"]).append(rows(spark, "same", f"own {k}"), ["t"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    assert [i for i, _ in held(plain)] == list(range(1, 46)) and len({n for _, n in held(plain)}) == 45
    assert sorted(n for _, n in held(keyed)) == ["own 0", "own 1", "own 2", "same"]


def test_a_number_is_taken_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    assert v.manifest() == (0, {"tables": {}})
    assert v.commit(1, {"tables": {}, "who": "a"}) and not v.commit(1, {"tables": {}, "who": "b"})
    assert v.manifest() == (1, {"tables": {}, "who": "a"})
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if Versions(spark, str(tmp_path)).commit(2, {"tables": {}, "who": k}) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and v.manifest()[1]["who"] == won[0]


def test_a_writer_that_dies_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.append(rows(spark, "a"), ["t"])
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        s.append(rows(spark, "b"), ["t"])
    assert held(s) == [(1, "a")]
    s.append(rows(spark, "c"), ["t"])
    assert held(s) == [(1, "a"), (2, "c")]
    assert s.versions.vacuum(older_than=3600) == []
    assert len(s.versions.vacuum(older_than=-60)) >= 1 and held(s) == [(1, "a"), (2, "c")]


def test_partitions_and_columns_added_later(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(rows(spark, "a", "b"), ["t"], partition_by="name")
    s.append(rows(spark, "a"), ["t"], partition_by="name")
    later = Q.Store(spark, str(tmp_path), "id bigint, name string, t bigint, kind string", None, {"kind": "old"})
    later.append(rows(spark, "z").withColumn("kind", F.lit("new")), ["t"], partition_by="name")
    assert sorted((r.id, r.name, r.kind) for r in later.read().collect()) == [(1, "a", "old"), (2, "b", "old"), (3, "a", "old"), (4, "z", "new")]


def test_rows_are_computed_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = rows(spark, *"abcde").mapInArrow(counted, ROWS)
    done = store(spark, tmp_path, ["name"]).append(df, ["t"])
    assert done.stored.count() == 5 and done.rejected.count() == 0 and made.value == 5


def test_groups_of_ids_are_parts_of_what_is_stored(spark, tmp_path):
    """Rows with their texts are numbered by many tasks, not by one for each million of them."""
    s = store(spark, tmp_path)
    df = spark.range(60_000).select(F.col("id").cast("string").alias("name"), F.col("id").alias("t"))
    assert s._grouped(df).groupBy("_g").count().agg(F.max("count")).first()[0] < 20_000
    told = s.append(df, ["t"]).stored.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(told) == (1, 60_000, 60_000)
