"""Stored captures, snapshots, analyses and chunks: appends, latest N, existence, pruning (Q1-Q14)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightstream.functions.text import length, trimmed
from sightstream.sources.versions import Versions

TABLE = "rows"

CAPTURES = "id bigint, captured_at timestamp, source string, recognized_text string, character_count int"


def latest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Q2, Q4, Q7: the n latest by the columns of order, all descending; the last of them makes the order total."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def latest_per_source(rows: DataFrame, n: int, source: str, *order: str) -> DataFrame:
    """Q9"""
    w = Window.partitionBy(source).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pruned(rows: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Q6, Q10: what is left after everything strictly older than cutoff goes."""
    return rows.where(F.col(time) >= cutoff)


def exists(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Q5: rows with a flag whether the store holds their keys. The store's keys are made distinct before the join."""
    held = stored.select(*keys).distinct().withColumn("_held", F.lit(True))
    return rows.join(held, keys, "left").select(*rows.columns, F.coalesce("_held", F.lit(False)).alias("stored"))


def save_texts(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Q12: (texts trimmed, with character_count; rows that are rejected for being blank)."""
    t = rows.withColumn(text, trimmed(text))
    blank = F.coalesce(F.col(text) == "", F.lit(True))
    return t.where(~blank).withColumn("character_count", length(text)), t.where(blank).withColumn("error", F.lit("empty text"))


def segments_json(segments: Column) -> Column:
    """Q11: JSON, null if there is none."""
    return F.when(F.size(segments) > 0, F.to_json(segments))


def browser(computer: DataFrame, microphone: DataFrame, n: int = 50) -> DataFrame:
    """Q13: the n latest chunks of both sources as uniform rows, with an id that names the source."""
    tagged = [latest(df, n, "captured_at", "id").withColumn("source", F.lit(name)) for name, df in (("computer", computer), ("microphone", microphone))]
    return tagged[0].unionByName(tagged[1]).withColumn("row_id", F.concat_ws("-", "source", F.col("id").cast("string")))


def browser_totals(shown: DataFrame) -> DataFrame:
    """Q13: rows shown of each source, of both, and whether there are any; no row if nothing is shown."""
    counts = shown.groupBy("source").agg(F.count("*").alias("rows"))
    both = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return counts.select("source", "rows", both.alias("total_rows"), (both > 0).alias("has_rows"))


def numbered(rows: DataFrame, order: list[str], first: int) -> tuple[DataFrame, int]:
    """rows (with _g, the group of each) with ids from `first` on, without gaps, and how many there are. They are numbered within
    groups, as many as the rows need, and a group's ids follow those of the groups before it: only the groups' sizes are
    summed up."""
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_size"))
    base = sizes.select("_g", F.coalesce(F.sum("_size").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    count = sizes.agg(F.sum("_size")).first()[0] or 0
    return rows.withColumn("_i", number).join(base, "_g").withColumn("id", (F.col("_i") + F.col("_base") + F.lit(first - 1)).cast("long")).drop("_g", "_i", "_base"), count


class Appended(NamedTuple):
    """What an append did: the rows it stored, with their ids, and those it rejected."""

    stored: DataFrame
    rejected: DataFrame


class Store:
    """A table as Parquet in a folder, in versions: appended to with ids that go on and are never given twice, whatever was
    deleted since; unique by key, if it has one; read with columns it didn't have yet.

    Writers don't wait for each other. One that finds that another has made the version it was about to make judges its rows
    again, against that one (sources.versions). Readers see whole versions."""

    #: Rows of a group, which one task numbers: few, since they come with their texts.
    GROUP = 10_000

    #: How often a writer begins again before it gives up.
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str] | None = None, defaults: dict[str, object] | None = None) -> None:
        self.spark, self.schema, self.key, self.defaults = spark, schema, key or [], defaults or {}
        self.versions = Versions(spark, path)

    def read(self, version: int | None = None) -> DataFrame:
        """Q14: files written before a column was added give its default. version: that version's rows; None: the last one's."""
        return self._filled(self.versions.read(TABLE, self.schema, version))

    def _filled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.defaults.items()})

    def append(self, rows: DataFrame, order: list[str], partition_by: str | None = None) -> Appended:
        """Q1, Q3, Q7, Q8: stores rows, those whose key isn't there yet, under ids that follow the largest ever given."""
        rows = rows.drop("id")
        for _ in range(self.TRIES):
            number, manifest = self.versions.manifest()
            judged, name = self._judged(rows, order, manifest["tables"].get(TABLE, []))
            first = manifest.get("next_id", 1)
            new, count = numbered(self._grouped(judged.where("_new").drop("_new")), [*order, *self.key], first)
            folder = self.versions.write(TABLE, new, partition_by)
            if self.versions.commit(number + 1, self._next(manifest, [*manifest["tables"].get(TABLE, []), folder], first + count)):
                return Appended(self._filled(self.versions.rows(TABLE, self.schema, [folder])), judged.where("not _new").drop("_new"))
            self.versions.remove(TABLE, [folder])
            self.versions.remove("judged", [name])
        raise RuntimeError(f"{self.TRIES} other writers were faster")

    def _judged(self, rows: DataFrame, order: list[str], folders: list[str]) -> tuple[DataFrame, str]:
        """rows with _new, whether they can be stored, in a folder beside the table: rows are computed once, whatever they are made of."""
        if self.key:
            held = self.versions.rows(TABLE, self.schema, folders).select(*(F.col(k).alias(f"_held_{k}") for k in self.key)).distinct().withColumn("_held", F.lit(True))
            same = [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in self.key]
            n = F.row_number().over(Window.partitionBy(*self.key).orderBy(*order))
            judged = rows.withColumn("_n", n).join(held, reduce(and_, same), "left").select(*rows.columns, ((F.col("_n") == 1) & F.col("_held").isNull()).alias("_new"))
        else:
            judged = rows.select("*", F.lit(True).alias("_new"))
        name = self.versions.write("judged", judged)
        return self.spark.read.schema(judged.schema).parquet(self.versions.folder("judged", name)), name

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """rows with _g, their group: as many groups as the rows, which are stored already, need."""
        groups = max(1, -(-rows.count() // self.GROUP))
        return rows.withColumn("_g", F.pmod(F.xxhash64(*(self.key or rows.columns)), F.lit(groups)).cast("int"))

    def _next(self, manifest: dict, folders: list[str], next_id: int) -> dict:
        return {**manifest, "tables": {**manifest["tables"], TABLE: folders}, "next_id": next_id}

    def delete_older(self, time: str, cutoff: Column) -> None:
        """Q6, Q10: a version without rows strictly older than cutoff; rows without a time go too."""
        self._keep(lambda rows: pruned(rows, time, cutoff))

    def clear(self, condition: Column | None = None) -> None:
        """Q6, Q7, Q10: everything goes, or what condition holds for (a source, for one). Ids go on."""
        self._keep(None if condition is None else lambda rows: rows.where(~F.coalesce(condition, F.lit(False))))

    def _keep(self, rule: Callable[[DataFrame], DataFrame] | None) -> None:
        for _ in range(self.TRIES):
            number, manifest = self.versions.manifest()
            held = manifest["tables"].get(TABLE, [])
            folders = [self.versions.write(TABLE, rule(self.versions.rows(TABLE, self.schema, held)))] if rule and held else []
            if self.versions.commit(number + 1, self._next(manifest, folders, manifest.get("next_id", 1))):
                return
            self.versions.remove(TABLE, folders)
        raise RuntimeError(f"{self.TRIES} other writers were faster")
