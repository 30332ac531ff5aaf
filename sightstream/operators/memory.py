"""Snapshots that are skipped, cached, expired (W15-W18) and run counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CACHE_SECONDS = 600
CACHE_SIZE = 20

#: Seconds of a session that are read together, so that a long session is many tasks.
BLOCK = 86_400

#: The time of a snapshot in seconds, and its number.
ORDER = ("t", "seq")


def _dealt(rows: DataFrame, block: int, time: str = "t") -> DataFrame:
    return rows.withColumns({"_block": F.floor(F.col(time).cast("double") / max(1, block)).cast("long"), "_real": F.lit(True)})


def _in_block(keys: list[str], order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy("_real", *order)


def _same(one: Column, other: Column) -> Column:
    return one.text_hash.eqNullSafe(other.text_hash) & one.layout_hash.eqNullSafe(other.layout_hash)


def _differing(snapshots: DataFrame, keys: list[str], block: int, order: Sequence[str] = ORDER) -> DataFrame:
    """snapshots with _new: whether text or layout differ from those of the one before of the same keys. The last snapshot of
    each block of time goes to the next block that has any, as a row that comes before the others."""
    dealt = _dealt(snapshots, block, order[0])
    own = F.struct("text_hash", "layout_hash")
    last = dealt.groupBy(*keys, "_block").agg(F.max_by(own, F.struct(*order)).alias("_own"))
    following = last.withColumn("_block", F.lead("_block").over(Window.partitionBy(*keys).orderBy("_block"))).where("_block is not null")
    both = dealt.unionByName(following.select(*keys, "_block", "_own.*", F.lit(False).alias("_real")), allowMissingColumns=True)
    w = _in_block(keys, order)
    new = (F.row_number().over(w) == 1) | ~_same(F.lag(own).over(w), own)
    return both.withColumn("_new", new).where("_real").drop("_block", "_real")


def _summed(rows: DataFrame, keys: list[str], amount: str, block: int) -> DataFrame:
    """rows with the running sum of a column of theirs, in its place. Each block of time has a row before the others, with the sum of
    the blocks before it."""
    dealt = _dealt(rows, block)
    sums = dealt.groupBy(*keys, "_block").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(amount), F.lit(False).alias("_real"))
    both = dealt.unionByName(begun, allowMissingColumns=True)
    running = F.sum(amount).over(_in_block(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn(amount, running).where("_real").drop("_block", "_real")


def changed(snapshots: DataFrame, keys: list[str], order: Sequence[str] = ORDER, block: int = BLOCK) -> DataFrame:
    """Snapshots whose text or layout differs from the one before; null hashes equal each other. order: a time in seconds,
    and what orders snapshots of one time."""
    return _differing(snapshots, keys, block, order).where("_new").select(*snapshots.columns)


def first_of_each(snapshots: DataFrame, order: list[str]) -> DataFrame:
    """Of all snapshots with one text and layout, in any session, the first."""
    w = Window.partitionBy("text_hash", "layout_hash").orderBy(*order)
    return snapshots.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def not_stored(snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """W18 for an increment: those whose text and layout the sink doesn't hold."""
    return snapshots.join(stored.select("text_hash", "layout_hash").distinct(), ["text_hash", "layout_hash"], "left_anti").select(*snapshots.columns)


def document_runs(snapshots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The document that each snapshot of a display is served: that of the first of its run of equal text and layout.
    Adds run (from 0) and document_seq.

    A block of time counts the runs that begin within it after its first snapshot, and whether that one begins a run follows from
    the block before, so that one summary of the blocks gives the number of each block's first run."""
    keys = ["session_id", "display_id"]
    dealt = _dealt(snapshots, block)
    w = _in_block(keys)
    own = F.struct("text_hash", "layout_hash")
    inner = dealt.withColumns({"_own": own, "_new": ((F.row_number().over(w) > 1) & ~_same(F.lag(own).over(w), own)).cast("long")})
    at = F.struct("t", "seq")
    blocks = inner.groupBy(*keys, "_block").agg(F.min_by("_own", at).alias("_first"), F.max_by("_own", at).alias("_last"), F.sum("_new").alias("_inner"))
    order = Window.partitionBy(*keys).orderBy("_block")
    begins = (F.row_number().over(order) > 1) & ~_same(F.lag("_last").over(order), F.col("_first"))
    numbered = blocks.withColumn("_begins", begins.cast("long"))
    number = F.sum(F.col("_begins") + F.col("_inner")).over(order) - F.col("_inner")
    begun = numbered.select(*keys, "_block", number.alias("_new"), F.lit(False).alias("_real"))
    both = inner.drop("_own").unionByName(begun, allowMissingColumns=True)
    runs = both.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_real").select(*snapshots.columns, "run")
    return runs.withColumn("document_seq", F.min("seq").over(Window.partitionBy(*keys, "run")))


def cached_documents(runs: DataFrame, at: Column | None = None, max_age: int = CACHE_SECONDS, limit: int = CACHE_SIZE) -> DataFrame:
    """Documents that a display's cache holds: not older than max_age (strictly older ones go), the newest `limit`.
    at: the time to judge by; None: the display's last snapshot."""
    last = F.max("t").over(Window.partitionBy("session_id", "display_id"))
    docs = runs.withColumn("_at", last if at is None else at).where("seq = document_seq").where(~(F.col("t") < F.col("_at") - max_age))
    w = Window.partitionBy("session_id", "display_id").orderBy(F.desc("t"), F.desc("seq"))
    return docs.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") <= limit).drop("_at")


def run_counters(snapshots: DataFrame, has_text: Column, block: int = BLOCK) -> DataFrame:
    """Per session, samples captured, blank ones, consecutive duplicates skipped, and what was cached."""
    rows = _differing(snapshots.withColumn("_text", has_text), ["session_id", "_text"], block).withColumn("_skip", F.col("_text") & ~F.col("_new"))
    return rows.groupBy("session_id").agg(F.count("*").alias("captured"), F.count_if(~F.col("_text")).alias("blank"), F.count_if("_skip").alias("skipped"), F.count_if(F.col("_text") & ~F.col("_skip")).alias("cached"))


def epochs(rows: DataFrame, control: Column, block: int = BLOCK) -> DataFrame:
    """Rows with epoch, how often their session was started, cleared or reset before them; the rows that say so
    (control is true) go. With it as a part of the session's key, memory, windows and texts begin anew at each."""
    said = rows.withColumn("epoch", F.coalesce(control, F.lit(False)).cast("long")).withColumn("_control", F.col("epoch") > 0)
    return _summed(said, ["session_id"], "epoch", block).where(~F.col("_control")).drop("_control")
