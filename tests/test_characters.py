"""Marks, letters and characters beyond ASCII, against DuckDB's own functions."""

import unicodedata

import duckdb
from pyspark.sql import functions as F

from sightstream.functions import text as T
from sightstream.operators import transcript as R
from sightstream.operators.storage import save_texts

TEXTS = ["čęőşāÉ ñ", "été café", "été café", "Ǖ ǘ ṩ ự Ω̈ ё й", "a\r\nb\rc\n", "\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7 flags", "\U0001f468‍\U0001f469‍\U0001f467 family", "한국어 가", "plain", "", "ﬁ ß ẞ", "ẍ́y", "ทำ กิ"]


def test_folding_is_duckdbs(spark):
    letters = [chr(i) for i in range(0x20, 0x3000) if unicodedata.category(chr(i)) != "Cn"]
    rows = [(i, f"a{c}b") for i, c in enumerate(letters)] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i long, s string")
    got = {r.i: r.f for r in df.select("i", T.fold("s").alias("f")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute("SELECT i, lower(strip_accents(s)) FROM t").fetchall())
    assert [(rows[i][1] if i < 10_000 else TEXTS[i - 10_000], got[i], want[i]) for i in got if got[i].lower() != want[i].lower()] == []


def test_lengths_are_duckdbs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, s string")
    con = duckdb.connect()
    want = [con.execute("SELECT length_grapheme(?)", [t.replace("\r\n", "\n")]).fetchone()[0] for t in TEXTS]  # a line end is one character
    assert [r.n for r in df.select("i", T.length("s").alias("n")).orderBy("i").collect()] == want
    assert [len(T.characters(t)) for t in TEXTS] == want
    assert all("".join(T.characters(t)) == t for t in TEXTS)
    kept = save_texts(df.withColumnRenamed("s", "text"))[0].orderBy("i").collect()
    assert kept[1].character_count == 8 and spark.range(1).select(T.length(F.lit(None).cast("string")).alias("n")).first().n is None


def test_utterances_that_differ_in_marks_only_match(spark):
    pairs = [("L’été était très chaud à Łódź", "L’ete etait tres chaud a Łodz"), ("café noir pour deux s'il vous", "café noir pour deux s'il vous"), ("una cosa", "otra cosa")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(F.array_join(T.normalized_words("a"), " ").alias("a"), F.array_join(T.normalized_words("b"), " ").alias("b")).collect()
    assert [r.a == r.b for r in got] == [True, True, False]


def test_running_text_counts_and_cuts_characters():
    assert R.addition("un café", "café noir") == " noir"
    assert R.addition("un café", "cafe noir") == " cafe noir"
    assert R.addition("hello world", "World again") == " again" and R.addition("same", "same") == "" and R.addition("", "hello") == "hello"
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    assert R.ending("ab" + family * 3, 2) == family * 2
    long = "é" * 400
    assert R.addition(R.ending(long), long) == " " + "é" * (400 - R.MAX_OVERLAP)
