"""Chunks of operator 6 that have bigrams without words in a range."""

import math

from sightstream.llm import lm


def test_a_range_with_bigrams_and_no_words(spark, monkeypatch):
    """A chunk has few distinct words for its ranges: op6 raised IndexError or joined shorter arrays."""
    texts = [(i, " ".join(["a b", "b a", "a a b b"][i % 3] for _ in range(20))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {r.doc_id: r for r in lm.op6(df).collect()}
    monkeypatch.setattr(lm, "CHUNK", 256)
    got = {r.doc_id: r for r in lm.op6(df).collect()}
    assert got.keys() == want.keys() and len(got) == 60
    for i, r in got.items():
        assert tuple(r)[:5] == tuple(want[i])[:5]
        assert math.isclose(r.score, want[i].score, rel_tol=1e-9)


def test_rows_without_a_doc_id_are_dealt_to_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 1024)
    df = spark.createDataFrame([(None if i % 2 else 7, f"word{i} " * 8) for i in range(400)], "doc_id long, text string")
    chunks, _ = lm.chunked(df, lm.F.lit(True))
    sizes = [r.n for r in chunks.groupBy("chunk").agg(lm.F.sum(lm.F.octet_length("text")).alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 4 * lm.CHUNK
