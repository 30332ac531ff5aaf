"""Transcripts: running text without repeated overlap, and utterances that two sources share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.functions.audio import correlation
from sightstream.functions.text import characters, normalized_words, trimmed

MAX_OVERLAP = 160

#: Seconds and chunks of a source that a chunk of the other source is compared with.
RECENT_SECONDS, RECENT_CHUNKS = 30.0, 20
DUPLICATE = 0.50

#: Chunks of two sources whose starts are nearer than this are compared though they don't overlap.
GATE_SECONDS = 0.5

#: Seconds of a session that are numbered by one task; sums over these blocks number the session.
BLOCK_SECONDS = 600.0

#: White space as the engine's trimming takes it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def append_deduplicated(text: Column, more: Column, limit: int = MAX_OVERLAP) -> Column:
    """More without the longest prefix that text ends with, whatever the case, after a space."""
    m = F.least(F.length(text), F.length(more), F.lit(limit))
    ks = F.when(m > 0, F.sequence(m, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    same = F.filter(ks, lambda k: F.lower(F.right(text, k)) == F.lower(F.left(more, k)))
    rest = trimmed(F.substring(more, F.coalesce(F.get(same, F.lit(0)), F.lit(0)) + 1, F.length(more)))
    return F.when(text == "", more).when(rest == "", text).otherwise(F.concat(text, F.lit(" "), rest))


def addition(tail: str, more: str, limit: int = MAX_OVERLAP) -> str:
    """What a trimmed chunk adds to a text that ends with tail (its last `limit` characters, or all)."""
    if not tail:
        return more
    before, after = characters(tail)[-limit:], characters(more)
    m = min(len(before), len(after))
    end, start = [c.lower() for c in before[-m:]], [c.lower() for c in after[:m]]
    k = next((k for k in range(m, 0, -1) if end[m - k :] == start[:k]), 0)
    rest = "".join(after[k:]).strip(WHITE)
    return f" {rest}" if rest else ""


def ending(text: str, limit: int = MAX_OVERLAP) -> str:
    """The last `limit` characters."""
    return "".join(characters(text[-64 * limit :])[-limit:])


def trimmed_parts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, no (from 1), seq, language and part, what each chunk adds to its session's text; blank chunks are left out.

    What a chunk adds depends on what stands before it, so a session is read once in its order; all that is held of it is
    the end of its text. No row has more than its chunk, however long the session is."""
    rows = chunks.select(*keys, F.col("seq").cast("long").alias("seq"), F.col("language").cast("string").alias("language"), trimmed("text").alias("text")).where("text <> ''")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "text", "language")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tail, no = None, "", 0
        for b in batches:
            parts, numbers = [], []
            texts = b.column(len(keys) + 2).to_pylist()
            for key, text in zip(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True), texts, strict=True):
                if key != current:
                    current, tail, no = key, "", 0
                part = addition(tail, text)
                tail, no = ending(tail + part), no + 1
                parts.append(part)
                numbers.append(no)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(numbers, pa.int64()), *b.columns[len(keys) : len(keys) + 2], pa.array(parts, pa.string())], [*keys, "no", "seq", "language", "part"])

    return dealt.mapInArrow(scan, f"{kinds}, no long, seq long, language string, part string")


def running_state(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Text, number of chunks, characters and latest language of each session, in the order of its chunks. The text
    is put together here, once; who needs no text takes running_sums."""
    parts = trimmed_parts(chunks, keys)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda p: p.part), "")
    return parts.groupBy(*keys).agg(text.alias("text"), *_sums())


def running_sums(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Number of chunks, characters and latest language of each session."""
    return trimmed_parts(chunks, keys).groupBy(*keys).agg(*_sums())


def _sums() -> list[Column]:
    known = F.col("language").isNotNull()
    return [F.count("*").cast("int").alias("chunks"), F.sum(F.length("part")).cast("long").alias("characters"), F.max_by("language", F.when(known, F.col("no"))).alias("language")]


def with_words(chunks: DataFrame) -> DataFrame:
    """What a comparison needs of a chunk's text, computed once: n_words, spoken (the words joined) and distinct_words."""
    words = normalized_words("text")
    return chunks.withColumn("_words", words).withColumns({"n_words": F.size("_words"), "spoken": F.array_join("_words", " "), "distinct_words": F.array_distinct("_words")}).drop("_words")


def utterance_match(a: str, b: str) -> Column:
    """Whether two chunks of with_words, their columns prefixed by a and b, are one utterance."""
    ta, tb, da, db = (F.col(f"{p}{c}") for c in ("spoken", "distinct_words") for p in (a, b))
    a_short = F.length(ta) <= F.length(tb)
    within = F.when(a_short, F.contains(tb, ta)).otherwise(F.contains(ta, tb))
    smaller = F.least(F.size(da), F.size(db))
    return F.coalesce((ta != "") & (tb != "") & ((ta == tb) | ((F.least(F.length(ta), F.length(tb)) >= 24) & within) | ((smaller >= 4) & (F.size(F.array_intersect(da, db)) / smaller >= 0.82))), F.lit(False))


def recent(chunks: DataFrame) -> DataFrame:
    """The newest chunks of each source, of those that end in the last RECENT_SECONDS."""
    w = Window.partitionBy("session_id", "source").orderBy(F.desc("seq"))
    newest = F.max(F.col("start_time") + F.col("duration")).over(Window.partitionBy("session_id", "source"))
    rows = chunks.withColumns({"_rank": F.row_number().over(w), "_newest": newest})
    return rows.where((F.col("_rank") <= RECENT_CHUNKS) & (F.col("start_time") + F.col("duration") >= F.col("_newest") - RECENT_SECONDS)).drop("_rank", "_newest")


def arrivals(chunks: DataFrame, first: str = "computer", second: str = "microphone") -> DataFrame:
    """chunks of the two sources with end_time, rank (in its source, from 1), others (how many of the other source have come
    before) and others_end (when the last of those ends). Chunks come when they end, equal ones by seq, source and id.

    Prefix sums on two levels: tasks number blocks of BLOCK_SECONDS, and a session's blocks, a row each, are summed up, so
    that a long session is many tasks."""
    one, key = F.col("source") == first, ["session_id", "_block"]
    rows = chunks.where(F.col("source").isin(first, second)).withColumn("end_time", F.col("start_time") + F.col("duration")).where("end_time is not null")
    rows = rows.withColumn("_block", F.floor(F.col("end_time") / BLOCK_SECONDS).cast("long"))
    so_far = Window.partitionBy(*key).orderBy("end_time", "seq", "source", "chunk_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = {"a": (F.count_if(one), F.max(F.when(one, F.col("end_time")))), "b": (F.count_if(~one), F.max(F.when(~one, F.col("end_time"))))}
    numbered = rows.withColumns({f"_{what}{s}": x.over(so_far) for s, both in facts.items() for what, x in zip("ne", both, strict=True)})
    blocks = rows.groupBy(*key).agg(*(x.alias(f"{what}{s}") for s, both in facts.items() for what, x in zip("ne", both, strict=True)))
    before = Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(*key, *(F.coalesce(F.sum(f"n{s}").over(before), F.lit(0)).alias(f"n{s}") for s in "ab"), *(F.max(f"e{s}").over(before).alias(f"e{s}") for s in "ab"))
    n = {s: F.col(f"_n{s}") + F.col(f"n{s}") for s in "ab"}
    e = {s: F.greatest(f"_e{s}", f"e{s}") for s in "ab"}
    return numbered.join(base, key).select(*chunks.columns, "end_time", F.when(one, n["a"]).otherwise(n["b"]).alias("rank"), F.when(one, n["b"]).otherwise(n["a"]).alias("others"), F.when(one, e["b"]).otherwise(e["a"]).alias("others_end"))


def candidates(chunks: DataFrame, first: str = "computer", second: str = "microphone") -> DataFrame:
    """Each chunk (columns new_*) with those of the other source (old_*) that it is compared with when it comes: the
    newest RECENT_CHUNKS, of those that end in the last RECENT_SECONDS of that source, that overlap it or start within
    GATE_SECONDS of it.

    Which chunks are compared is known from their times. So they meet without their texts first, and only those that some chunk
    is compared with get words."""
    rows = arrivals(chunks, first, second)
    key = ["session_id", "source", "rank"]
    times = _meeting(rows.select(*key, "start_time", "duration", "end_time", "others", "others_end"), first, second)
    sides = F.array(*(F.struct(*(F.col(f"{p}_{c}").alias(c) for c in key[1:])) for p in ("new", "old")))
    met = times.select("session_id", F.explode(sides).alias("c")).select("session_id", "c.*").distinct()
    return _meeting(with_words(rows.join(met, key, "left_semi")), first, second)


def _meeting(rows: DataFrame, first: str, second: str) -> DataFrame:
    """The pairs of candidates, of rows of arrivals.

    The join's key is a number of RECENT_CHUNKS chunks in a row: whatever comes together or goes on for long, a chunk
    meets two such runs, and a session is as many keys as it has runs."""
    run = lambda rank: F.floor(rank / RECENT_CHUNKS)
    at, by = F.col("others") - 1, F.greatest(F.col("others") - RECENT_CHUNKS, F.lit(0))
    # no chunk before it reaches this far: nothing can overlap
    near = rows.where((F.col("others") > 0) & (F.col("start_time") < F.col("others_end") + GATE_SECONDS))
    new = near.select("session_id", F.explode(F.array_distinct(F.array(run(at), run(by)))).alias("_run"), F.when(F.col("source") == first, second).otherwise(first).alias("_source"), *(F.col(c).alias(f"new_{c}") for c in rows.columns if c != "session_id"))
    old = rows.select("session_id", run(F.col("rank") - 1).alias("_run"), F.col("source").alias("_source"), *(F.col(c).alias(f"old_{c}") for c in rows.columns if c not in ("session_id", "others", "others_end")))
    held = (F.col("old_rank") <= F.col("new_others")) & (F.col("old_rank") > F.col("new_others") - RECENT_CHUNKS) & (F.col("old_end_time") >= F.col("new_others_end") - RECENT_SECONDS)
    a0, b0, ad, bd = (F.col(c) for c in ("new_start_time", "old_start_time", "new_duration", "old_duration"))
    gate = (ad + bd > F.greatest("new_end_time", "old_end_time") - F.least(a0, b0)) | (F.abs(a0 - b0) < GATE_SECONDS)
    return new.join(old, ["session_id", "_run", "_source"]).where(held & gate).drop("_run", "_source")


def scored(pairs: DataFrame, pcm: bool = False) -> DataFrame:
    """Confidence and signals of each pair. pcm: the sides have samples and sample_rate."""
    a0, b0, ad, bd = (F.col(c) for c in ("new_start_time", "old_start_time", "new_duration", "old_duration"))
    ratio = F.when(bd > 0, ad / bd).otherwise(0.0)
    tests = [
        ("time_overlap", 0.10, F.abs(a0 - b0) < 0.3),
        ("duration_match", 0.05, (ratio > 0.85) & (ratio < 1.15)),
        ("language_match", 0.05, F.coalesce(F.col("new_language") == F.col("old_language"), F.lit(False))),
        ("text_jaccard", 0.45, utterance_match("new_", "old_")),
    ]
    if pcm:
        alike = (F.size("new_samples") > 0) & (F.size("old_samples") > 0) & (F.col("new_sample_rate") == F.col("old_sample_rate")) & (correlation(F.col("new_samples"), F.col("old_samples")) >= 0.50)
        tests.append(("pcm_correlation", 0.35, F.coalesce(alike, F.lit(False))))
    total = F.lit(0.0)
    for _, points, test in tests:
        total = total + F.when(test, points).otherwise(0.0)
    filler = (F.col("new_n_words") < 3) | (F.col("old_n_words") < 3)
    signals = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, _, test in tests), F.when(filler, F.lit("filler_penalty"))))
    return pairs.withColumns({"confidence": F.least(F.lit(1.0), F.when(filler, total * 0.3).otherwise(total)), "signals": signals})


def duplicates(chunks: DataFrame, first: str = "computer", second: str = "microphone", pcm: bool = False) -> DataFrame:
    """session_id, primary_id, duplicate_id, confidence, signals, at (when the pair was found: in the order of chunks that
    come, then of those they are compared with). The primary starts first; ties go to `first`, then by id."""
    found = scored(candidates(chunks, first, second), pcm).where(F.col("confidence") >= DUPLICATE)
    place = lambda p: F.struct(F.col(f"{p}_start_time"), F.when(F.col(f"{p}_source") == first, 0).otherwise(1), F.col(f"{p}_chunk_id"))
    new_first = place("new") <= place("old")
    pick = lambda x, y: F.when(new_first, F.col(x)).otherwise(F.col(y))
    at = F.struct(F.col("new_end_time").alias("time"), F.col("new_seq").alias("seq"), F.col("old_rank").alias("rank"))
    pairs = found.select("session_id", pick("new_chunk_id", "old_chunk_id").alias("primary_id"), pick("old_chunk_id", "new_chunk_id").alias("duplicate_id"), F.struct(at.alias("at"), "confidence", "signals").alias("x"))
    return pairs.groupBy("session_id", "primary_id", "duplicate_id").agg(F.min("x").alias("x")).select("session_id", "primary_id", "duplicate_id", "x.confidence", "x.signals", "x.at")


def first_annotation(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with the primary that each was first found to be a duplicate of."""
    first = found.groupBy("session_id", F.col("duplicate_id").alias("chunk_id")).agg(F.min(F.struct("at", "primary_id", "confidence")).alias("a"))
    return chunks.join(first, ["session_id", "chunk_id"], "left").select(*chunks.columns, F.col("a.primary_id").alias("duplicate_of"), F.col("a.confidence").alias("duplicate_confidence"))
