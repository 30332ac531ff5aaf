"""A corpus through five stages: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightstream.llm import decontaminate, language, mixing, near_copies, token_files
from sightstream.llm.common import new_path, table
from sightstream.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document goes if no language is likelier than this for it, or if it has no letter.
SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the input; documents without a language are rejected."""
    net = language.learn(docs.where("lang is not null").select("doc_id", "text", "lang"))
    return language.predict(docs, net).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash at the distance of near copies: groups are connected by pairs of texts whose 5-word shingles have a Jaccard
    similarity of at least 0.8; op5's rule of 4 bits isn't used here. One document of each group stays."""
    return near_copies.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Rows with one doc_id, or without one, each go for their own text."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), slop=None)
    hit = found.where("size(spans) > 0").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by Poisson counts, in shuffled order; a document's copies all have its doc_id."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pipeline-tokens")
    token_files.write(docs, path, tokenizer_file())
    return token_files.read(spark, path, digest=True)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture), ("token-ID / binary output", tokens)]

#: A recurrent network and a tokenizer decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
