"""Queries over transcripts and stored rows, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightstream.functions import text as T
from sightstream.operators import export as X
from sightstream.operators import storage as Q
from sightstream.operators import transcript as R
from sightstream.plans.text import TRIM
from sightstream.sources import asr
from sightstream.sources.derived import signals, table, transcript_chunks


def with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_chunks(spark, sf_dir).withColumn("chunk_id", F.format_string("%s_%03d", "source", F.col("seq")))


def parse_timestamps(spark, sf_dir):
    s = F.col("event_id") * 1234567 % 86_400_000
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3_600_000), F.floor(s / 60_000) % 60, F.floor(s / 1000) % 60, s % 1000)
    text = F.when(F.col("event_id") % 9 == 0, "12:30").when(F.col("event_id") % 10 == 0, "aa:bb:cc").otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", text.alias("stamp"), F.coalesce(T.timestamp_seconds(text), F.lit(-1.0)).alias("seconds"))


def asr_parse(spark, sf_dir):
    """Recognised turns as the JSON that a recogniser writes, and what is read from it."""
    stamp = lambda n: F.format_string("00:00:%02d,500", n)
    plain = F.regexp_replace("text", r"[^A-Za-z ]", " ")
    doc = F.format_string('{"result":{"language":"en"},"transcription":[{"timestamps":{"from":"00:00:00,000","to":"%s"},"text":" %s"},{"timestamps":{"from":"%s","to":"%s"},"text":" end."}]}', stamp(F.col("turn") + 1), plain, stamp(F.col("turn") + 1), stamp(F.col("turn") + 2))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", asr.parse(doc).alias("r"))
    return rows.select("conv_id", "turn", "r.language", "r.text", F.size("r.segments").alias("n_segments"), "r.duration")


def transcript_segments(spark, sf_dir):
    """Each chunk with two segments, one of which goes beyond its end."""
    segment = lambda a, b, t: F.struct(F.lit(a).alias("start_time"), F.lit(b).alias("end_time"), t.alias("text"))
    segments = F.array(segment(0.5, 2.0, F.col("text")), segment(2.0, 9.0, F.lit("more")), segment(3.0, 4.0, F.lit("  ")))
    c = transcript_chunks(spark, sf_dir).select("session_id", "seq", asr.transcript_chunk(F.col("source"), F.col("seq"), F.col("start_time"), F.col("duration"), segments).alias("c"))
    return c.select("session_id", "seq", "c.chunk_id", "c.end_time", F.explode("c.segments").alias("s")).select("session_id", "seq", "chunk_id", F.col("s.start_time").alias("start_time"), F.least("end_time", "s.end_time").alias("end_time"), F.col("s.text").alias("text"))


def append_dedup(spark, sf_dir):
    """The running text of each conversation; some turns begin with the end of the turn before."""
    return R.running_state(with_ids(spark, sf_dir), ["session_id"]).select("session_id", "text")


def transcript_state(spark, sf_dir):
    s = R.running_state(with_ids(spark, sf_dir), ["session_id", "source"])
    return s.select("session_id", "source", "chunks", F.coalesce("language", F.lit("none")).alias("language"), F.col("characters").cast("int").alias("characters"), T.sha("text").alias("text_sha256"))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of two sources; those with one beginning are close in time, so that near copies can be told."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.beginning("text", 24).alias("k"))
    first = d.groupBy("k").agg(F.min("doc_id").alias("first"))
    rows = d.join(first, "k")
    return rows.select(
        F.lit(1).alias("session_id"), F.when(F.col("doc_id") % 2 == 0, "computer").otherwise("microphone").alias("source"), F.col("doc_id").alias("seq"), (F.col("first") * 10.0).alias("start_time"), F.lit(5.0).alias("duration"),
        F.lit("en").alias("language"), "text", F.format_string("d_%09d", "doc_id").alias("chunk_id"),
    )


def recent_chunks(spark, sf_dir):
    """The chunks of each source that one of the other source would be compared with at the end of the session."""
    return R.recent(with_ids(spark, sf_dir)).select("session_id", "chunk_id")


def utterance_similarity(spark, sf_dir):
    p = R.candidates(searched(spark, sf_dir))
    of = lambda source: F.when(F.col("new_source") == source, F.col("new_seq")).otherwise(F.col("old_seq"))
    return p.select(of("computer").alias("computer_doc"), of("microphone").alias("microphone_doc"), R.utterance_match("new_", "old_").alias("same"))


def cross_source_duplicates(spark, sf_dir):
    return R.duplicates(searched(spark, sf_dir)).select("primary_id", "duplicate_id", F.round("confidence", 9).alias("confidence"), F.array_join("signals", ",").alias("signals"))


def first_annotation(spark, sf_dir):
    c = searched(spark, sf_dir)
    return R.first_annotation(c, R.duplicates(c)).where("duplicate_of is not null").select("chunk_id", "duplicate_of")


def heard_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as chunks of one source and, a tenth of a second later, of the other: quieter, or for every third packet the sound
    of the packet five numbers on; every fourth has other words."""
    s = signals(spark, sf_dir).select(F.col("packet_id").alias("p"), "samples")
    five_on = s.select((F.col("p") - 5).alias("p"), F.col("samples").alias("later"))
    words = F.format_string("spoken line number %d now", "p")
    side = lambda df, name, samples, late, text: df.select(
        F.floor(F.col("p") / 10).alias("session_id"), F.lit(name).alias("source"), F.col("p").alias("seq"), ((F.col("p") % 10) * 10.0 + late).alias("start_time"), F.lit(5.0).alias("duration"),
        F.lit(None).cast("string").alias("language"), text.alias("text"), F.format_string(f"{name}_%05d", "p").alias("chunk_id"), samples.alias("samples"), F.lit(200.0).alias("sample_rate"),
    )
    quieter = F.transform("samples", lambda x: (x * 0.5).cast("float"))
    heard = s.join(five_on, "p", "left").withColumn("heard", F.when(F.col("p") % 3 == 1, F.col("later")).otherwise(quieter))
    return side(s, "computer", F.col("samples"), 0.0, words).unionByName(side(heard, "microphone", F.col("heard"), 0.1, F.when(F.col("p") % 4 == 0, "something else that was said").otherwise(words)))


def pcm_duplicates(spark, sf_dir):
    """Duplicates by text and sound."""
    return R.duplicates(heard_twice(spark, sf_dir), pcm=True).select("session_id", "primary_id", "duplicate_id", F.round("confidence", 9).alias("confidence"), F.array_join("signals", ",").alias("signals"))


def transcript_document(spark, sf_dir):
    """What each session's document holds, read back from its JSON."""
    c = with_ids(spark, sf_dir).withColumns({"duplicate_of": F.when(F.col("seq") % 4 == 3, F.lit("computer_001")), "duplicate_confidence": F.when(F.col("seq") % 4 == 3, F.lit(0.75))})
    d = X.transcript_document(c)
    schema = "schema_version int, session_id string, language string, chunks array<struct<id: string, source: string, start_time: double, end_time: double, text: string, annotation: struct<duplicate_of: string, confidence: double>>>"
    rows = d.select("session_id", F.from_json("json", schema).alias("j")).select("session_id", F.coalesce("j.language", F.lit("none")).alias("language"), "j.schema_version", F.posexplode("j.chunks").alias("i", "c"))
    return rows.select("session_id", "language", "schema_version", "i", "c.id", "c.source", "c.start_time", "c.end_time", "c.text", F.coalesce("c.annotation.duplicate_of", F.lit("none")).alias("duplicate_of"))


def latest_n(spark, sf_dir):
    return Q.latest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 20, "o_orderdate", "o_orderkey")


def latest_n_per_source(spark, sf_dir):
    return Q.latest_per_source(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), 5, "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderpriority", "o_orderkey", "rank")


def prune_older(spark, sf_dir):
    """What is left of each status after the oldest orders go."""
    left = Q.pruned(table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"))
    return left.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_key"))


def stored_flag(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return Q.exists(o.select("o_orderkey", "o_custkey"), o.where("o_totalprice > 300000").select("o_custkey"), ["o_custkey"]).select("o_orderkey", "o_custkey", "stored")


def union_sources(spark, sf_dir):
    part = lambda s: table(spark, sf_dir, "events").where(F.col("event_id") % 2 == s).select(F.col("event_id").alias("id"), F.col("ts").alias("captured_at"), F.col("event_type").alias("text"))
    return Q.browser(part(0), part(1)).select("row_id", "source", "id", "text")


def save_texts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 13 == 0, " \n").otherwise(F.col("text")).alias("text"))
    good, bad = Q.save_texts(t)
    return good.select("doc_id", "character_count", F.lit("").alias("error")).unionByName(bad.select("doc_id", F.lit(0).alias("character_count"), "error"))


def segments_json(spark, sf_dir):
    seg = F.array(F.struct(F.col("turn").alias("n"), F.col("role").alias("role")))
    none = F.slice(seg, 1, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(Q.segments_json(F.when(F.col("turn") % 2 == 0, seg).otherwise(none)), F.lit("null")).alias("segments"))


CHUNKS = """chunks AS (
  SELECT conv_id AS session_id, CASE WHEN role = 'assistant' THEN 'computer' ELSE 'microphone' END AS source, turn AS seq, 4.0::DOUBLE * turn AS start_time, 5.0::DOUBLE AS duration, CASE WHEN turn % 3 = 0 THEN 'en' END AS language, text,
    (CASE WHEN role = 'assistant' THEN 'computer' ELSE 'microphone' END) || '_' || printf('%03d', turn) AS chunk_id FROM conversations WHERE role IN ('assistant', 'user')
)"""
_KS = "range(least(length(f.text), length(o.text), 160), 0, -1)"
_FOUND = f"list_filter({_KS}, lambda k: lower(right(f.text, k)) = lower(left(o.text, k)))"
_CUT = f"CASE WHEN len({_FOUND}) > 0 THEN {_FOUND}[1] ELSE 0 END"
_REST = TRIM.format(f"substr(o.text, {_CUT} + 1)")
FOLD = lambda keys: f"""RECURSIVE {CHUNKS}, ordered AS (
  SELECT {keys}, seq, language, {TRIM.format('text')} AS text, row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS rn FROM chunks WHERE {TRIM.format('text')} <> ''
), fold AS (
  SELECT {keys}, rn, text, language FROM ordered WHERE rn = 1
  UNION ALL
  SELECT {', '.join('o.' + k for k in keys.split(', '))}, o.rn, CASE WHEN {_REST} = '' THEN f.text ELSE f.text || ' ' || {_REST} END, coalesce(o.language, f.language) FROM fold f JOIN ordered o ON {' AND '.join(f'o.{k} = f.{k}' for k in keys.split(', '))} AND o.rn = f.rn + 1
), states AS (
  SELECT *, max(rn) OVER (PARTITION BY {keys}) AS n FROM fold
)"""  # noqa: E731
_FOLDED = "lower(strip_accents(text))"
_WORDS = f"list_filter(regexp_split_to_array(regexp_replace({_FOLDED}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda v: v <> '')"
PAIRS = f"""d AS (
  SELECT doc_id, text, substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 24) AS k FROM documents
), s AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY k) * 10.0::DOUBLE AS start, {_WORDS} AS words FROM d
), o AS (
  SELECT *, start + 5.0::DOUBLE AS e, doc_id % 2 AS src, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY start, doc_id) AS rank,
    CASE WHEN doc_id % 2 = 0 THEN count(*) FILTER (WHERE doc_id % 2 = 1) OVER w ELSE count(*) FILTER (WHERE doc_id % 2 = 0) OVER w END AS others,
    CASE WHEN doc_id % 2 = 0 THEN max(start + 5.0::DOUBLE) FILTER (WHERE doc_id % 2 = 1) OVER w ELSE max(start + 5.0::DOUBLE) FILTER (WHERE doc_id % 2 = 0) OVER w END AS others_end
  FROM s WINDOW w AS (ORDER BY start, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), pairs AS (
  SELECT CASE WHEN a.src = 0 THEN a.doc_id ELSE b.doc_id END AS a, CASE WHEN a.src = 0 THEN b.doc_id ELSE a.doc_id END AS b, a.e AS found_at, a.doc_id AS found_id, b.rank AS found_rank, a.words AS wa, b.words AS wb, coalesce(array_to_string(a.words, ' '), '') AS ta, coalesce(array_to_string(b.words, ' '), '') AS tb,
    len(list_distinct(a.words)) AS na, len(list_distinct(b.words)) AS nb, len(list_intersect(list_distinct(a.words), list_distinct(b.words))) AS common
  FROM o a JOIN o b ON a.src <> b.src AND b.rank <= a.others AND b.rank > a.others - 20 AND b.e >= a.others_end - 30 AND (10 > greatest(a.e, b.e) - least(a.start, b.start) OR abs(a.start - b.start) < 0.5)
), matched AS (
  SELECT *, ta <> '' AND tb <> '' AND (ta = tb OR (least(length(ta), length(tb)) >= 24 AND (CASE WHEN length(ta) <= length(tb) THEN contains(tb, ta) ELSE contains(ta, tb) END)) OR (least(na, nb) >= 4 AND CAST(common AS DOUBLE) / least(na, nb) >= 0.82)) AS same FROM pairs
), dups AS (
  SELECT *, (CASE WHEN same THEN 0.65::DOUBLE ELSE 0.2::DOUBLE END) * (CASE WHEN len(wa) < 3 OR len(wb) < 3 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) AS confidence FROM matched
)"""
_STAMP = "CASE WHEN event_id % 9 = 0 THEN '12:30' WHEN event_id % 10 = 0 THEN 'aa:bb:cc' ELSE printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) END"

QUERIES = {
    "parse_timestamps": (parse_timestamps, f"WITH e AS (SELECT event_id, event_id * 1234567 % 86400000 AS ms FROM events) SELECT event_id, {_STAMP} AS stamp, CASE WHEN event_id % 9 = 0 OR event_id % 10 = 0 THEN -1.0::DOUBLE ELSE CAST(ms // 3600000 AS DOUBLE) * 3600 + CAST((ms // 60000) % 60 AS DOUBLE) * 60 + CAST(printf('%02d.%03d', (ms // 1000) % 60, ms % 1000) AS DOUBLE) END AS seconds FROM e"),
    "asr_parse": (asr_parse, "SELECT conv_id, turn, 'en' AS language, trim(regexp_replace(text, '[^A-Za-z ]', ' ', 'g') || ' end.') AS text, 2::INTEGER AS n_segments, turn + 2.5::DOUBLE AS duration FROM conversations"),
    "transcript_segments": (transcript_segments, f"""WITH {CHUNKS} SELECT session_id, seq, chunk_id, start_time + 0.5::DOUBLE AS start_time, start_time + 2.0::DOUBLE AS end_time, {TRIM.format('text')} AS text FROM chunks WHERE {TRIM.format('text')} <> ''
UNION ALL SELECT session_id, seq, chunk_id, start_time + 2.0::DOUBLE, start_time + 5.0::DOUBLE, 'more' FROM chunks"""),
    "append_dedup": (append_dedup, f"WITH {FOLD('session_id')} SELECT session_id, text FROM states WHERE rn = n"),
    "transcript_state": (transcript_state, f"WITH {FOLD('session_id, source')} SELECT session_id, source, CAST(n AS INTEGER) AS chunks, coalesce(language, 'none') AS language, CAST(length(text) AS INTEGER) AS characters, sha256(text) AS text_sha256 FROM states WHERE rn = n"),
    "recent_chunks": (recent_chunks, f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, source ORDER BY seq DESC) AS n, max(start_time + duration) OVER (PARTITION BY session_id, source) AS newest FROM chunks)
SELECT session_id, chunk_id FROM r WHERE n <= {R.RECENT_CHUNKS} AND start_time + duration >= newest - {R.RECENT_SECONDS}"""),
    "utterance_similarity": (utterance_similarity, f"WITH {PAIRS} SELECT a AS computer_doc, b AS microphone_doc, same FROM matched"),
    "cross_source_duplicates": (cross_source_duplicates, f"""WITH {PAIRS} SELECT 'd_' || printf('%09d', a) AS primary_id, 'd_' || printf('%09d', b) AS duplicate_id, round(confidence, 9) AS confidence, 'time_overlap,duration_match,language_match,text_jaccard' AS signals FROM dups WHERE confidence >= 0.5"""),
    "first_annotation": (first_annotation, f"WITH {PAIRS} SELECT 'd_' || printf('%09d', b) AS chunk_id, first('d_' || printf('%09d', a) ORDER BY found_at, found_id, found_rank) AS duplicate_of FROM dups WHERE confidence >= 0.5 GROUP BY b"),
    "pcm_duplicates": (pcm_duplicates, """WITH el AS (SELECT vec_id AS p, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings), heard AS (
  SELECT a.p, sum(CAST(a.v AS DOUBLE) * CAST(b.v AS DOUBLE) ORDER BY a.i) AS d, sum(CAST(a.v AS DOUBLE) * CAST(a.v AS DOUBLE) ORDER BY a.i) AS x, sum(CAST(b.v AS DOUBLE) * CAST(b.v AS DOUBLE) ORDER BY a.i) AS y
  FROM el a JOIN el b ON b.p = CASE WHEN a.p % 3 = 1 THEN a.p + 5 ELSE a.p END AND b.i = a.i GROUP BY a.p
), judged AS (
  SELECT e.vec_id AS p, e.vec_id % 4 <> 0 AS said, coalesce(x * y > 0 AND abs(d) / sqrt(x * y) >= 0.5, false) AS sound FROM embeddings e LEFT JOIN heard h ON h.p = e.vec_id
), scored AS (SELECT *, 0.1::DOUBLE + 0.05::DOUBLE + (CASE WHEN said THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN sound THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END) AS confidence FROM judged)
SELECT p // 10 AS session_id, 'computer_' || printf('%05d', p) AS primary_id, 'microphone_' || printf('%05d', p) AS duplicate_id, round(confidence, 9) AS confidence, 'time_overlap,duration_match' || CASE WHEN said THEN ',text_jaccard' ELSE '' END || CASE WHEN sound THEN ',pcm_correlation' ELSE '' END AS signals
FROM scored WHERE confidence >= 0.5"""),
    "transcript_document": (transcript_document, f"""WITH {CHUNKS}, l AS (SELECT session_id, last(language ORDER BY seq) FILTER (WHERE source = 'microphone' AND language IS NOT NULL) AS m, last(language ORDER BY seq) FILTER (WHERE source = 'computer' AND language IS NOT NULL) AS c FROM chunks GROUP BY session_id)
SELECT k.session_id, coalesce(l.m, l.c, 'none') AS language, 1::INTEGER AS schema_version, CAST(row_number() OVER (PARTITION BY k.session_id ORDER BY start_time, source, seq) - 1 AS INTEGER) AS i, chunk_id AS id, source, start_time, start_time + 5.0::DOUBLE AS end_time, text, CASE WHEN seq % 4 = 3 THEN 'computer_001' ELSE 'none' END AS duplicate_of
FROM chunks k JOIN l ON l.session_id = k.session_id"""),
    "latest_n": (latest_n, "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
    "latest_n_per_source": (latest_n_per_source, "SELECT o_orderpriority, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5"),
    "prune_older": (prune_older, "SELECT o_orderstatus, count(*) AS orders, min(o_orderkey) AS first_key FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderstatus"),
    "stored_flag": (stored_flag, "SELECT o_orderkey, o_custkey, o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS stored FROM orders"),
    "union_sources": (union_sources, """WITH c AS (SELECT 'computer' AS source, event_id AS id, event_type AS text FROM events WHERE event_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 50), m AS (SELECT 'microphone' AS source, event_id AS id, event_type AS text FROM events WHERE event_id % 2 = 1 ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT source || '-' || CAST(id AS VARCHAR) AS row_id, source, id, text FROM (SELECT * FROM c UNION ALL SELECT * FROM m)"""),
    "save_texts": (save_texts, f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE CAST(length_grapheme({TRIM.format('text')}) AS INTEGER) END AS character_count, CASE WHEN doc_id % 13 = 0 THEN 'empty text' ELSE '' END AS error FROM documents"),
    "segments_json": (segments_json, """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[{"n":' || CAST(turn AS VARCHAR) || ',"role":"' || role || '"}]' ELSE 'null' END AS segments FROM conversations"""),
}
