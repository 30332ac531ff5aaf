"""Reading order and grouping of text boxes: duplicates, lines, blocks, regions.

Folds that depend on order run over one document's boxes as an array; everything else is windows over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.functions.text import aggregate_hash, layout_hash, normalize, text_hash, trimmed

SAME_BOX = 0.72


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def same_box(a: Column, b: Column) -> Column:
    """Whether the intersection is at least SAME_BOX of the smaller area."""
    shared = overlap(a.x, a.x + a.w, b.x, b.x + b.w) * overlap(a.y, a.y + a.h, b.y, b.y + b.h)
    smaller = F.least(a.w * a.h, b.w * b.h)
    return (smaller > 0) & (shared / smaller >= SAME_BOX)


def drop_duplicate_boxes(boxes: DataFrame) -> DataFrame:
    """L1: from the surest on, a box stays unless one with the same text that stays lies over it. A box that only a dropped
    box lies over stays, which a join can't tell; so it is a fold over the boxes of one document and text."""
    box = F.struct((-F.col("confidence")).alias("order"), "obs_idx", "x", "y", "w", "h", "display_id", "text", "confidence")
    groups = boxes.where(trimmed("text") != "").groupBy("doc_id", normalize("text").alias("norm")).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: same_box(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return groups.select("doc_id", F.explode(kept).alias("b")).select("doc_id", "b.obs_idx", "b.display_id", "b.text", "b.x", "b.y", "b.w", "b.h", "b.confidence")


def lines(boxes: DataFrame) -> DataFrame:
    """L2, L3: boxes in reading order (middle height, then x, then number) join the first line whose first box is level with
    them: doc_id, display_id, line_no, text, x, y, w, h, n_boxes."""
    box = F.struct((F.col("y") + F.col("h") / 2).alias("mid"), "x", "obs_idx", "y", "w", "h", "text")
    docs = boxes.groupBy("doc_id", "display_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    level = lambda line, b: F.abs(line[0].mid - b.mid) <= F.greatest(F.lit(4.0), 0.65 * F.greatest(line[0].h, b.h))

    def put(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda line: level(line, b)), True)
        return F.when(at > 0, F.transform(acc, lambda line, i: F.when(i + 1 == at, F.concat(line, F.array(b))).otherwise(line))).otherwise(F.concat(acc, F.array(F.array(b))))

    grouped = docs.select("doc_id", "display_id", F.posexplode(F.aggregate("boxes", F.array(F.slice("boxes", 1, 1)), lambda acc, b: F.when(F.get(F.get(acc, F.lit(0)), F.lit(0)).obs_idx == b.obs_idx, acc).otherwise(put(acc, b)))).alias("line_no", "line"))
    return grouped.select("doc_id", "display_id", "line_no", F.array_join(F.transform(F.array_sort(F.transform("line", lambda b: F.struct(b.x.alias("x"), b.obs_idx.alias("i"), trimmed(b.text).alias("t")))), lambda b: b.t), " ").alias("text"), *union_box("line"), F.size("line").alias("n_boxes"))


def union_box(boxes: str) -> list[Column]:
    """L6, over an array of boxes."""
    least = lambda f: F.array_min(F.transform(boxes, f))
    most = lambda f: F.array_max(F.transform(boxes, f))
    x, y = least(lambda b: b.x), least(lambda b: b.y)
    return [x.alias("x"), y.alias("y"), (most(lambda b: b.x + b.w) - x).alias("w"), (most(lambda b: b.y + b.h) - y).alias("h")]


def union_box_agg() -> list[Column]:
    """L6, over the rows of a group."""
    x, y = F.min("x"), F.min("y")
    return [x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h")]


def _islands(rows: DataFrame, order: str, joins: Column, name: str) -> DataFrame:
    """A number for each run of rows that each join the row before."""
    w = Window.partitionBy("doc_id", "display_id").orderBy(order)
    return rows.withColumn(name, F.sum(F.when(joins, 0).otherwise(1)).over(w) - 1)


def _before(rows: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "display_id").orderBy(order)
    return rows.withColumns({f"p{c}": F.lag(c).over(w) for c in ("x", "y", "w", "h")})


def share_of_width() -> Column:
    narrow = F.least("w", "pw")
    return F.when(narrow > 0, overlap(F.col("x"), F.col("x") + F.col("w"), F.col("px"), F.col("px") + F.col("pw")) / narrow).otherwise(0.0)


def blocks(lines: DataFrame) -> DataFrame:
    """L4: doc_id, display_id, block_no, text, x, y, w, h, n_lines."""
    gap, h = F.col("y") - (F.col("py") + F.col("ph")), F.greatest("h", "ph")
    joins = (gap <= F.greatest(F.lit(10.0), 1.6 * h)) & ((F.abs(F.col("x") - F.col("px")) <= F.greatest(F.lit(16.0), 2 * h)) | (share_of_width() >= 0.25))
    rows = _islands(_before(lines, "line_no"), "line_no", joins, "block_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s.text), "\n")
    return rows.groupBy("doc_id", "display_id", "block_no").agg(text.alias("text"), *union_box_agg(), F.count("*").alias("n_lines"))


def regions(blocks: DataFrame) -> DataFrame:
    """doc_id, display_id, region_no, x, y, w, h, n_blocks, first_block, last_block."""
    gap = F.col("y") - (F.col("py") + F.col("ph"))
    joins = (gap <= F.greatest(F.lit(24.0), 1.2 * (F.col("h") + F.col("ph")) / 2)) & (share_of_width() >= 0.15)
    rows = _islands(_before(blocks, "block_no"), "block_no", joins, "region_no")
    return rows.groupBy("doc_id", "display_id", "region_no").agg(*union_box_agg(), F.count("*").alias("n_blocks"), F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"))


def digests(boxes: DataFrame) -> DataFrame:
    """T3, T6 for each document and display: doc_id, display_id, text_hash, layout_hash."""
    parts = F.collect_list(F.struct("obs_idx", "x", "y", "w", "h", "text"))
    rows = boxes.groupBy("doc_id", "display_id").agg(parts.alias("b"))
    text = F.array_join(F.transform(F.array_sort("b"), lambda b: b.text), "\n")
    return rows.select("doc_id", "display_id", text_hash(text).alias("text_hash"), layout_hash(F.col("b")).alias("layout_hash"))


def build(boxes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines, blocks, regions and digests of boxes after L1."""
    kept = drop_duplicate_boxes(boxes)
    found = lines(kept)
    grouped = blocks(found)
    return found, grouped, regions(grouped), digests(kept)


def aggregate_digests(digests: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One text and one layout hash over all displays of a sample. digests also has display_index."""
    part = lambda c: F.collect_list(F.struct(F.col("display_index").alias("index"), "display_id", F.col(c).alias("hash")))
    return digests.groupBy(sample).agg(aggregate_hash(part("text_hash")).alias("text_hash"), aggregate_hash(part("layout_hash")).alias("layout_hash"))
