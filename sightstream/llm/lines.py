"""Operator 8: lines that several documents share, kept once. DataFrame functions only.

Lines are exploded with their position, normalised and hashed (96 bits); for each hash the documents are counted, the
smallest doc_id keeps the line, and the positions that every other document loses come back to it. The document is then
put together again from the positions that are left, so that no line's text is ever shuffled.

Documents are split once: hashes and positions are a table in the shared folder, which both the count and the join read.
A frequent line is counted by partial aggregates before the shuffle; the join that brings positions back is split by
Spark where one hash has many rows. The last join sorts and spills.

Nulls and ties: a null or empty text is one empty line. A null doc_id keeps its lines and is not counted. Rows with one
doc_id count as one document; each loses lines of its own text. A line that a document repeats is lost, or kept, in all
its places. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import stored

MIN_CHARS = 10
MIN_DOCS = 2

_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, dropped (positions from 0), kept (the other lines, joined by newlines)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("text"))
    lines = stored(
        rows.where("doc_id is not null")
        .select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2")),
        "lines",
    )
    if min_docs == 2:  # some two documents differ: cheaper to tell than how many there are
        shared = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    else:
        shared = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1)).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # a key of its own for the join, so that both sides are dealt out for it and Spark can split a hash with many rows
    both = F.col("h1").bitwiseXOR(F.col("h2"))
    lost = (
        lines.withColumn("h", both)
        .join(shared.select("h1", "h2", "first", both.alias("h")), ["h", "h1", "h2"])
        .where("doc_id > first")
        .groupBy("doc_id", "row_key")
        .agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    )
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("dropped")), lambda i: F.get("parts", i))
    return rows.join(lost.hint("merge"), ["doc_id", "row_key"], "left").select("doc_id", "text", "dropped", F.split("text", "\n").alias("parts")).select(
        "doc_id",
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept"),
    )


def op8(docs: DataFrame) -> DataFrame:
    return drop_shared_lines(docs).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), shared AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT l.doc_id, l.i, l.line, s.key IS NOT NULL AND l.doc_id > s.first AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
