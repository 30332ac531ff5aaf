"""Documents for language models: aliases, Markdown, JSON, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.functions.text import bounds_list, bounds_text, normalized_bounds, ratio, word_count
from sightstream.operators.classify import CLASSIFIER

MAX_CHARACTERS = 6000


def aliased(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """Alias d<display>.<kind><n> and reading_order of rows (doc_id, display_id, order); n and the order count from 1."""
    w = Window.partitionBy("doc_id", "display_id").orderBy(order)
    n = F.row_number().over(w)
    return rows.withColumn("reading_order", n).withColumn("alias", F.concat(F.lit("d"), F.col("display_id").cast("string"), F.lit(f".{kind}"), n.cast("string")))


def metrics(rows: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """T11, T12 of rows with text and a box."""
    return rows.withColumns({
        "character_count": F.length("text"),
        "word_count": word_count("text"),
        "area_ratio": ratio(F.col("w") * F.col("h"), frame_w * frame_h),
        "normalized_bounds": normalized_bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h"), frame_w, frame_h),
        "bounds": F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")),
    })


def block_aliases(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """The aliases of each region's blocks, by a join on the region's range of blocks."""
    b = aliased(blocks, "b", "block_no").select("doc_id", "display_id", "block_no", F.col("alias").alias("block_alias"), "text")
    r = aliased(regions, "r", "region_no")
    inside = r.withColumn("block_no", F.explode(F.sequence("first_block", "last_block"))).join(b, ["doc_id", "display_id", "block_no"])
    listed = F.array_sort(F.collect_list(F.struct("block_no", "block_alias", "text")))
    return inside.groupBy("doc_id", "display_id", "region_no", "alias", "reading_order", "x", "y", "w", "h").agg(listed.alias("blocks"))


def anchored_markdown(regions: DataFrame, blocks: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """A document of each doc_id, its display, regions and their blocks. Blocks outside regions are left out."""
    r = block_aliases(regions, blocks)
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    share = normalized_bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h"), frame_w, frame_h)
    one = F.concat_ws(
        "\n", F.concat(F.lit("### "), F.col("alias")), F.lit(""), F.concat(F.lit("- order: "), F.col("reading_order").cast("string")), F.concat(F.lit("- bounds: "), bounds_text(box)), F.concat(F.lit("- normalizedBounds: "), bounds_text(share)),
        F.concat(F.lit("- blockAliases: "), F.array_join(F.transform("blocks", lambda b: b.block_alias), ", ")), F.lit(""),
        F.array_join(F.transform("blocks", lambda b: F.concat_ws("\n", F.concat(F.lit("#### "), b.block_alias), F.lit(""), b.text, F.lit(""))), "\n"),
    )
    docs = r.withColumn("md", one).groupBy("doc_id", "display_id").agg(F.array_sort(F.collect_list(F.struct("region_no", "md"))).alias("r"), F.sum(F.size("blocks")).alias("n"))
    text = F.concat_ws(
        "\n", F.lit("# Screen Text"), F.lit(""), F.concat(F.lit("- blockCount: "), F.col("n").cast("string")), F.concat(F.lit("- regionCount: "), F.size("r").cast("string")), F.lit(""),
        F.concat(F.lit("## d"), F.col("display_id").cast("string")), F.lit(""), F.array_join(F.transform("r", lambda x: x.md), "\n"),
    )
    return docs.select("doc_id", text.alias("markdown"))


def structured_markdown(classified: DataFrame, frame_w: Column, frame_h: Column) -> DataFrame:
    """Blocks with role, confidence and place."""
    rows = aliased(classified, "b", "block_no")
    share = normalized_bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h"), frame_w, frame_h)
    head = F.concat(F.lit("["), F.col("alias"), F.lit(" role="), F.col("role"), F.format_string(" confidence=%.2f", "confidence"), F.lit(" bounds="), bounds_list(share), F.lit("]"))
    docs = rows.groupBy("doc_id", "display_id").agg(F.array_sort(F.collect_list(F.struct("block_no", F.concat_ws("\n", head, F.col("text"), F.lit("")).alias("md")))).alias("b"))
    text = F.concat_ws(
        "\n", F.lit("# Screen Text Structure"), F.lit(""), F.concat(F.lit("- blockCount: "), F.size("b").cast("string")), F.lit(f"- classifier: {CLASSIFIER}"),
        F.lit("- structureNote: Roles are deterministic layout hints derived from OCR text and geometry."), F.lit(""), F.concat(F.lit("## d"), F.col("display_id").cast("string")), F.lit(""),
        F.when(F.size("b") > 0, F.array_join(F.transform("b", lambda x: x.md), "\n")).otherwise(F.lit("_No OCR blocks detected._")),
    )
    return docs.select("doc_id", text.alias("markdown"))


def compact_json(rows: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """Each row's other columns as JSON with sorted keys; times as ISO 8601 in whole seconds; nulls left out."""
    fields = []
    for c, kind in sorted(rows.dtypes):
        if c not in keys:
            fields.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if kind.startswith("timestamp") else F.col(c))
    return rows.select(*keys, F.to_json(F.struct(*fields)).alias(name))


def split_oversized(text: Column, limit: Column) -> Column:
    """Lines packed greedily into parts of at most limit characters; a longer line is cut hard."""
    cut = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / limit).cast("int") - 1, F.lit(0))), lambda i: F.substring(line, i * limit + 1, limit))
    pieces = F.flatten(F.transform(F.split(text, "\n"), cut))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    joined = lambda s, p: F.when(s.cur == "", p).otherwise(F.concat(s.cur, F.lit("\n"), p))
    step = lambda s, p: F.when(F.length(joined(s, p)) <= limit, F.struct(s.done.alias("done"), joined(s, p).alias("cur"))).otherwise(F.struct(F.concat(s.done, F.array(s.cur)).alias("done"), p.alias("cur")))
    return F.aggregate(pieces, start, step, lambda s: F.when(s.cur != "", F.concat(s.done, F.array(s.cur))).otherwise(s.done))


def chunks(regions: DataFrame, blocks: DataFrame, limit: int = MAX_CHARACTERS) -> DataFrame:
    """A document's regions, as lines `[alias] text`, packed in order into chunks of at most limit characters; a region that
    is longer is split by itself. Chunk numbers go on over all displays of a document."""
    r = block_aliases(regions, blocks).select("doc_id", "display_id", "region_no", F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("["), b.block_alias, F.lit("] "), b.text)), "\n").alias("text"))
    docs = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("display_id", "region_no", "text"))).alias("r"))
    parts = F.flatten(F.transform("r", lambda x: F.when(F.length(x.text) <= limit, F.array(x.text)).otherwise(split_oversized(x.text, F.lit(limit)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    joined = lambda s, p: F.when(s.cur == "", p).otherwise(F.concat(s.cur, F.lit("\n"), p))
    step = lambda s, p: F.when(F.length(joined(s, p)) <= limit, F.struct(s.done.alias("done"), joined(s, p).alias("cur"))).otherwise(F.struct(F.concat(s.done, F.array(s.cur)).alias("done"), p.alias("cur")))
    packed = F.aggregate(parts, start, step, lambda s: F.when(s.cur != "", F.concat(s.done, F.array(s.cur))).otherwise(s.done))
    return docs.select("doc_id", F.posexplode(packed).alias("i", "text")).select("doc_id", F.concat(F.lit("c"), (F.col("i") + 1).cast("string")).alias("alias"), "text", F.length("text").alias("character_count"))


def prepared(regions: DataFrame, blocks: DataFrame, classified: DataFrame, frame_w: Column, frame_h: Column, limit: int = MAX_CHARACTERS) -> DataFrame:
    """doc_id, markdown, structured (Markdown with roles) and chunks (alias, text in order) of each document."""
    md = anchored_markdown(regions, blocks, frame_w, frame_h)
    structured = structured_markdown(classified, frame_w, frame_h).withColumnRenamed("markdown", "structured")
    packed = chunks(regions, blocks, limit).withColumn("n", F.substring("alias", 2, 20).cast("int"))
    packed = packed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alias", "text"))), lambda c: F.struct(c["alias"].alias("alias"), c["text"].alias("text"))).alias("chunks"))
    return md.join(structured, "doc_id").join(packed, "doc_id")


def segment_document(segments: DataFrame) -> DataFrame:
    """A window's segments as one compact JSON document."""
    keys = ["session_id", "window_no", "started_at", "ended_at"]
    seg = F.struct("display_id", "role", "first_seen", "last_seen", "lines", "repeated_ui", "sightings", "text", F.struct("h", "w", "x", "y").alias("bounds"))
    rows = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(seg)).alias("s"), F.count_distinct("display_id").alias("displays"), F.sum("lines").alias("encounters"))
    doc = F.struct(F.col("displays").alias("displayCount"), F.col("encounters").alias("encounterCount"), F.col("ended_at").alias("endedAt"), F.col("s").alias("segments"), F.col("window_no").alias("sequenceNumber"), F.col("session_id").alias("sessionID"), F.col("started_at").alias("startedAt"))
    return rows.select(*keys, "displays", "encounters", F.to_json(doc).alias("json"))


def transcript_document(chunks: DataFrame) -> DataFrame:
    """X11: a session's chunks of both sources in order of (start, source, seq) as JSON of schema version 1. language: the
    microphone's latest, else the computer's; annotations are null where there is none."""
    notes = F.struct(F.col("duplicate_of"), F.col("duplicate_confidence").alias("confidence"))
    part = F.struct("start_time", "source", "seq", F.col("chunk_id"), (F.col("start_time") + F.col("duration")).alias("end_time"), "text", F.when(F.col("duplicate_of").isNotNull(), notes).alias("annotation"))
    latest = lambda s: F.max_by(F.when(F.col("source") == s, F.col("language")), F.when((F.col("source") == s) & F.col("language").isNotNull(), F.col("seq")))
    rows = chunks.groupBy("session_id").agg(F.array_sort(F.collect_list(part)).alias("c"), F.coalesce(latest("microphone"), latest("computer")).alias("language"))
    doc = F.struct(F.lit(1).alias("schema_version"), F.col("session_id").cast("string").alias("session_id"), "language", F.transform("c", lambda c: F.struct(c.chunk_id.alias("id"), c.source.alias("source"), c.start_time.alias("start_time"), c.end_time.alias("end_time"), c.text.alias("text"), c.annotation.alias("annotation"))).alias("chunks"))
    return rows.select("session_id", "language", F.size("c").alias("chunks"), F.to_json(doc).alias("json"))


def plain_text(rows: DataFrame, keys: list[str], order: str, detail: Column | None = None) -> DataFrame:
    """Texts of a group in order, with detail before each if given."""
    line = F.col("text") if detail is None else F.concat(detail, F.lit(" "), F.col("text"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda s: s.line), "\n").alias("export"))
