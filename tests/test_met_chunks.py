"""What chunks are compared by: words only of those that meet another one, beginnings without the whole text."""

from pyspark.sql import functions as F

from sightstream.functions import text as T
from sightstream.operators import transcript as R

CHUNK = "session_id long, source string, seq long, chunk_id string, start_time double, duration double, language string, text string"


def test_only_chunks_that_meet_get_words(spark, monkeypatch):
    rows = [(1, "computer" if i % 2 else "microphone", i, f"c{i}", 1000.0 * i, 5.0, "en", f"alone {i}") for i in range(30)]
    rows += [(1, "computer", 100, "a", 500.0, 5.0, "en", "the same words"), (1, "microphone", 101, "b", 500.1, 5.0, "en", "the same words"), (None, "computer", 102, "n", 500.0, 5.0, "en", "the same words")]
    given, plain = [], R.with_words
    monkeypatch.setattr(R, "with_words", lambda df: given.append(df) or plain(df))
    df = spark.createDataFrame(rows, CHUNK)
    got = R.candidates(df).collect()
    assert [(p.new_chunk_id, p.old_chunk_id, p.new_text, p.old_spoken) for p in got] == [("b", "a", "the same words", "the same words")]
    assert sorted(r.chunk_id for r in given[0].collect()) == ["a", "b"]


def test_chunks_of_one_id_keep_their_own_words(spark):
    rows = [(1, "computer", 1, "x", 0.0, 5.0, "en", "first words"), (1, "computer", 2, "x", 1.0, 5.0, "en", "second words"), (1, "microphone", 3, "y", 1.0, 5.5, "en", "third words")]
    got = R.candidates(spark.createDataFrame(rows, CHUNK)).collect()
    assert sorted((p.new_chunk_id, p.old_seq, p.old_spoken, p.new_spoken) for p in got) == [("y", 1, "first words", "third words"), ("y", 2, "second words", "third words")]


def test_beginning_is_that_of_the_normalised_text(spark):
    wide = " \n \t" * 400
    texts = [None, "", " ", wide, "a", wide + "A  b" + wide + "C" + wide + "d" * 300, "x" * 23 + "Σ", "x" * 23 + "Σ y", "x" * 23 + "Σ" + "'" * 60 + "y", "İ" * 40, "\U0001f600 " * 300, "ab " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", T.beginning("text", 24).alias("got"), F.substring(T.normalize("text"), 1, 24).alias("want")).collect()
    assert [(r.i, r.got) for r in rows] == [(r.i, r.want) for r in rows]
    plan = df.select(T.beginning("text", 24).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(text" not in plan
