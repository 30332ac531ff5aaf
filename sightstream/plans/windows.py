"""Queries over streams of samples: encounters, windows, segments, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightstream.functions import text as T
from sightstream.operators import classify as C
from sightstream.operators import export as X
from sightstream.operators import framecache
from sightstream.operators import memory as M
from sightstream.operators import windows as W
from sightstream.plans.text import norm, role_sql
from sightstream.sources.derived import TTL, WINDOW, samples

NORM_TEXT = norm("text")


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a place on the display and the role of their text there."""
    rows = samples(spark, sf_dir)
    s = F.col("seq")
    rows = rows.withColumns({"x": (s % 10) / 10.0, "y": (s % 7) / 10.0, "w": F.lit(0.2), "h": F.lit(0.05)})
    found = C.rules(F.col("text"), T.word_count("text"), F.length("text"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("text"))
    role = F.lit("unknown")
    for name, _, test in reversed(found):
        role = F.when(test, "unknown" if name == "empty" else name).otherwise(role)
    return rows.withColumn("role", role)


def sealed(spark, sf_dir):
    return W.sealed_encounters(seen(spark, sf_dir), WINDOW, TTL)


def encounters_session(spark, sf_dir):
    return W.encounters(seen(spark, sf_dir), ["session_id"], TTL).select("session_id", "display_id", "text_hash", "run", "text", "first_seen", "last_seen", "seen_count")


def ingest_summary(spark, sf_dir):
    return W.ingest_summary(samples(spark, sf_dir), TTL)


def encounter_topk_cap(spark, sf_dir):
    found = W.encounters(seen(spark, sf_dir), ["session_id"], TTL)
    return W.capped(found, ["session_id"], 5).select("session_id", "display_id", "text_hash", "first_seen", "last_seen")


def sighting_cap(spark, sf_dir):
    """The numbers of the last sightings that each text of a display keeps, over all time."""
    found = W.encounters(seen(spark, sf_dir).withColumn("session_id", F.lit(0)), ["session_id"], 10**9)
    return found.select("display_id", "text_hash", "seen_count", F.size("sightings").alias("kept"), F.get("sightings", F.lit(0)).seq.alias("oldest"), F.element_at("sightings", -1).seq.alias("newest"))


def recent_encounters(spark, sf_dir):
    """Encounters that memory holds at the end of each session, first seen first."""
    found = W.encounters(seen(spark, sf_dir), ["session_id"], TTL, W.MAX_ENCOUNTERS)
    last = samples(spark, sf_dir).groupBy("session_id").agg(F.max("t").alias("now"))
    return W.remembered(found.join(last, "session_id"), ["session_id"], F.col("now"), TTL).select("session_id", "display_id", "text", "first_seen", "last_seen").orderBy("session_id", "first_seen", "text")


#: Texts that the memory of the queries below holds, about half of what a user's day of events has.
FEW, DAY = 3, 2 * TTL


def evicted_encounters(spark, sf_dir):
    """Encounters of a memory that lets texts go after every sample."""
    return W.encounters(seen(spark, sf_dir), ["session_id"], DAY, FEW).select("session_id", "display_id", "text_hash", "run", "first_seen", "last_seen", "seen_count", F.size("sightings").alias("kept"))


def remembered_encounters(spark, sf_dir):
    """What is left in that memory at the end of each session."""
    last = samples(spark, sf_dir).groupBy("session_id").agg(F.max("t").alias("now"))
    found = W.encounters(seen(spark, sf_dir), ["session_id"], DAY, FEW).join(last, "session_id")
    return W.remembered(found, ["session_id"], F.col("now"), DAY, FEW).select("session_id", "display_id", "text_hash", "run", "first_seen", "last_seen", "seen_count")


def dominant_role(spark, sf_dir):
    found = W.encounters(seen(spark, sf_dir), ["session_id"], TTL)
    return found.select("session_id", "display_id", "text_hash", "run", W.dominant_role(F.col("roles")).alias("role"))


def seal_windows(spark, sf_dir):
    return W.windows(samples(spark, sf_dir), WINDOW).select("session_id", "window_no", "started_at", "ended_at", "seal_seq")


def window_samples(spark, sf_dir):
    return W.assign(samples(spark, sf_dir), WINDOW).select("session_id", "seq", "window_no", "started_at", "ended_at")


def sealed_encounters(spark, sf_dir):
    return sealed(spark, sf_dir).select("session_id", "window_no", "display_id", "text_hash", "first_seen", "last_seen", "seen_count", "role")


def segment_reduce(spark, sf_dir):
    s = W.segments(sealed(spark, sf_dir))
    r = lambda c: F.round(c, 9).alias(c)
    return s.select("session_id", "window_no", "display_id", "role", "text", r("x"), r("y"), r("w"), r("h"), "first_seen", "last_seen", "sightings", "lines")


def repeated_ui(spark, sf_dir):
    return W.segments(sealed(spark, sf_dir)).groupBy("role", "repeated_ui").agg(F.count("*").alias("segments"))


def window_analysis_top10(spark, sf_dir):
    return W.analysis(W.segments(sealed(spark, sf_dir))).select("session_id", "window_no", "analyzer_id", "payload_bytes", "summary_markdown")


def window_prompt(spark, sf_dir):
    return W.window_prompt(sealed(spark, sf_dir)).select("session_id", "window_no", "prompt")


def segment_document(spark, sf_dir):
    """What the documents hold, read back from their JSON."""
    d = X.segment_document(W.segments(sealed(spark, sf_dir)))
    schema = "displayCount long, encounterCount long, sequenceNumber int, sessionID long, startedAt long, endedAt long, segments array<struct<display_id: long, role: string, first_seen: long, last_seen: long, lines: long, repeated_ui: boolean, sightings: long, text: string, bounds: struct<h: double, w: double, x: double, y: double>>>"
    rows = d.select(F.from_json("json", schema).alias("j")).select("j.*", F.posexplode("j.segments").alias("i", "s"))
    r = lambda c: F.round(f"s.bounds.{c}", 9).alias(c)
    return rows.select(
        F.col("sessionID").alias("session_id"), F.col("sequenceNumber").alias("window_no"), F.col("startedAt").alias("started_at"), F.col("endedAt").alias("ended_at"), F.col("displayCount").alias("displays"), F.col("encounterCount").alias("encounters"),
        "i", "s.display_id", "s.role", "s.first_seen", "s.last_seen", "s.lines", "s.repeated_ui", "s.sightings", "s.text", r("x"), r("y"), r("w"), r("h"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each sample: what was seen, and where."""
    return samples(spark, sf_dir).select("session_id", "display_id", "seq", "t", "text", T.text_hash("text").alias("text_hash"), T.sha((F.col("seq") % 3).cast("string")).alias("layout_hash"))


def snapshot_consecutive_skip(spark, sf_dir):
    return M.changed(snapshots(spark, sf_dir), ["session_id"], ["t", "seq"]).select("session_id", "seq")


def snapshot_global_dedup(spark, sf_dir):
    return M.first_of_each(snapshots(spark, sf_dir), ["t", "seq"]).select("session_id", "seq", "text_hash", "layout_hash")


def snapshot_exists(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    return M.not_stored(s, s.where("seq % 250 = 0")).select("session_id", "seq")


def document_runs(spark, sf_dir):
    return M.document_runs(snapshots(spark, sf_dir)).select("session_id", "display_id", "seq", F.col("run").cast("long").alias("run"), "document_seq")


#: Seconds and documents that the caches of the queries below hold: about as many as a user's events can expire and fill.
AGE, HELD = 20 * TTL, 6


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of two displays, by their type and number; a text is that of several frames, and of two layouts."""
    n = F.floor(F.col("seq") / 2)
    return samples(spark, sf_dir).select(
        "session_id", n.alias("sample"), "display_id", "seq", "t", F.concat_ws("-", "text", (n % 3).cast("string")).alias("frame_hash"), "text", T.text_hash("text").alias("text_hash"), T.sha((n % 2).cast("string")).alias("layout_hash")
    )


def frame_cache(spark, sf_dir):
    """The document that each frame is served."""
    return framecache.served(frames(spark, sf_dir), AGE, HELD).select("session_id", "display_id", "seq", "document_seq", "reused")


def sample_assembly(spark, sf_dir):
    """Events of a user in pairs as samples of two displays."""
    rows = frames(spark, sf_dir)
    told = framecache.served(rows, AGE, HELD).join(rows.select(F.col("seq"), "sample"), "seq").drop("seq").withColumnRenamed("sample", "seq")
    return framecache.assembled(told, F.lit(2)).select("session_id", "seq", "displays", "reused", "recognised", "text", "complete")


def cache_expiry(spark, sf_dir):
    return M.cached_documents(M.document_runs(snapshots(spark, sf_dir)), max_age=20 * TTL).select("session_id", "display_id", "seq", "age_rank")


def session_epochs(spark, sf_dir):
    """Samples by how often their session was started anew before them; a signup starts it."""
    return M.epochs(samples(spark, sf_dir), F.col("text") == "signup").select("session_id", "seq", "epoch")


def run_counters(spark, sf_dir):
    return M.run_counters(snapshots(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 11 == 0, " ").otherwise(F.col("text"))), T.has_text("text"))


_ROLE = role_sql("text", "len(string_split(text, ' '))", "length(text)", "x", "y", "w", "h", "text")[0]
SEEN = f"""samples AS (
  SELECT user_id AS session_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id % 2 + 1 AS display_id, event_type AS text FROM events
), placed AS (
  SELECT *, (seq % 10) / 10.0::DOUBLE AS x, (seq % 7) / 10.0::DOUBLE AS y, 0.2::DOUBLE AS w, 0.05::DOUBLE AS h, sha256({NORM_TEXT}) AS text_hash FROM samples
), seen AS (SELECT *, {_ROLE} AS role FROM placed)"""
RUNS = f"""{SEEN}, gaps AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id, display_id, text_hash ORDER BY t, seq) > {TTL} THEN 1 ELSE 0 END AS brk FROM seen WHERE length({NORM_TEXT}) > 1
), runs AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY session_id, display_id, text_hash ORDER BY t, seq) AS BIGINT) AS run FROM gaps
), enc AS (
  SELECT session_id, display_id, text_hash, run, first(text ORDER BY t, seq) AS text, min(t) AS first_seen, max(t) AS last_seen, count(*) AS seen_count FROM runs GROUP BY session_id, display_id, text_hash, run
)"""
SEALS = f"""RECURSIVE {SEEN}, ordered AS (
  SELECT session_id, seq, t, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS rn FROM samples
), fold(session_id, rn, seq, t, anchor, window_no, started_at, sealed) AS (
  SELECT session_id, rn, seq, t, t, 0, t, false FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.session_id, o.rn, o.seq, o.t, CASE WHEN o.t - f.anchor >= {WINDOW} THEN o.t ELSE f.anchor END, f.window_no + CASE WHEN o.t - f.anchor >= {WINDOW} THEN 1 ELSE 0 END, f.anchor, o.t - f.anchor >= {WINDOW}
  FROM fold f JOIN ordered o ON o.session_id = f.session_id AND o.rn = f.rn + 1
), wins AS (
  SELECT session_id, CAST(window_no AS INTEGER) AS window_no, started_at, t AS ended_at, seq AS seal_seq, rn FROM fold WHERE sealed
), assigned AS (
  SELECT s.*, w.window_no, w.started_at, w.ended_at FROM fold f JOIN seen s ON s.session_id = f.session_id AND s.seq = f.seq JOIN wins w ON w.session_id = f.session_id AND w.window_no = f.window_no + CASE WHEN f.sealed THEN 0 ELSE 1 END
)"""
SEALED = f"""{SEALS}, wgaps AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session_id, window_no, display_id, text_hash ORDER BY t, seq) > {TTL} THEN 1 ELSE 0 END AS brk FROM assigned WHERE length({NORM_TEXT}) > 1
), wruns AS (
  SELECT *, sum(brk) OVER (PARTITION BY session_id, window_no, display_id, text_hash ORDER BY t, seq) AS run FROM wgaps
), wlast AS (
  SELECT *, max(run) OVER (PARTITION BY session_id, window_no, display_id, text_hash) AS last_run FROM wruns
), wenc AS (
  SELECT session_id, window_no, started_at, ended_at, display_id, text_hash, first(text ORDER BY t, seq) AS text, min(t) AS first_seen, max(t) AS last_seen, count(*) AS seen_count, last(x ORDER BY t, seq) AS x, last(y ORDER BY t, seq) AS y, last(w ORDER BY t, seq) AS w, last(h ORDER BY t, seq) AS h
  FROM wlast WHERE run = last_run GROUP BY session_id, window_no, started_at, ended_at, display_id, text_hash HAVING max(t) >= ended_at - {TTL}
), wroles AS (
  SELECT session_id, window_no, display_id, text_hash, role, row_number() OVER (PARTITION BY session_id, window_no, display_id, text_hash ORDER BY count(*) DESC, role) AS r FROM wlast WHERE run = last_run GROUP BY session_id, window_no, display_id, text_hash, role
), sealed_enc AS (
  SELECT e.*, r.role FROM wenc e JOIN wroles r ON e.session_id = r.session_id AND e.window_no = r.window_no AND e.display_id = r.display_id AND e.text_hash = r.text_hash AND r.r = 1
), segs AS (
  SELECT session_id, window_no, started_at, ended_at, display_id, role, string_agg(text, ' ' ORDER BY y, x, text_hash, text) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
    CAST(sum(seen_count) AS BIGINT) AS sightings, count(*) AS lines FROM sealed_enc GROUP BY session_id, window_no, started_at, ended_at, display_id, role
), segments AS (
  SELECT *, role IN ({', '.join(repr(r) for r in W.CHROME_ROLES)}) AND CAST(sightings AS DOUBLE) / lines / greatest(ended_at - started_at, 1) >= {W.REPEATED} AS repeated_ui FROM segs
)"""
#: A text is let go once FEW others were seen since: the distinct ones between two of its sightings are counted.
EVICTED = f"""{SEEN}, units AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, seq) AS rn FROM seen WHERE length({NORM_TEXT}) > 1
), again AS (
  SELECT *, lag(t) OVER w AS before, lag(rn) OVER w AS before_rn FROM units WINDOW w AS (PARTITION BY session_id, display_id, text_hash ORDER BY rn)
), others AS (
  SELECT a.session_id, a.rn, count(DISTINCT CAST(o.display_id AS VARCHAR) || o.text_hash) AS n FROM again a JOIN units o ON o.session_id = a.session_id AND o.rn > a.before_rn AND o.rn < a.rn GROUP BY a.session_id, a.rn
), eruns AS (
  SELECT a.*, CAST(sum(CASE WHEN a.t - before > {DAY} OR o.n >= {FEW} THEN 1 ELSE 0 END) OVER (PARTITION BY a.session_id, display_id, text_hash ORDER BY a.rn) AS BIGINT) AS run FROM again a LEFT JOIN others o ON o.session_id = a.session_id AND o.rn = a.rn
), ev AS (
  SELECT session_id, display_id, text_hash, run, min(t) AS first_seen, max(t) AS last_seen, max(rn) AS last_rn, count(*) AS seen_count FROM eruns GROUP BY session_id, display_id, text_hash, run
)"""
SNAPS = f"""{SEEN}, snaps AS (SELECT session_id, display_id, seq, t, text, text_hash, sha256(CAST(seq % 3 AS VARCHAR)) AS layout_hash FROM placed)"""
_SAME = "lag(text_hash) OVER {0} IS NOT DISTINCT FROM text_hash AND lag(layout_hash) OVER {0} IS NOT DISTINCT FROM layout_hash AND row_number() OVER {0} > 1"
_W1 = "(PARTITION BY session_id ORDER BY t, seq)"
_W2 = "(PARTITION BY session_id, display_id ORDER BY t, seq)"
DOCUMENTS = f"""{SNAPS}, marked AS (SELECT *, CASE WHEN {_SAME.format(_W2)} THEN 0 ELSE 1 END AS brk FROM snaps), druns AS (
  SELECT *, CAST(sum(brk) OVER {_W2} - 1 AS BIGINT) AS run FROM marked
), docs AS (SELECT *, min(seq) OVER (PARTITION BY session_id, display_id, run) AS document_seq FROM druns)"""

#: A display's cache step by step: `held` has its documents, the newest first, cur its current one.
CACHE = f"""{SEEN}, frames AS (
  SELECT session_id, display_id, seq, t, seq // 2 AS sample, text, text || '-' || CAST(seq // 2 % 3 AS VARCHAR) AS frame, text || '/' || CAST(seq // 2 % 2 AS VARCHAR) AS content, row_number() OVER (PARTITION BY session_id, display_id ORDER BY t, seq) AS n FROM samples
), steps AS (
  SELECT session_id, display_id, n, seq AS document_seq, false AS reused, [{{'seq': seq, 'at': t, 'frame': frame, 'text': text}}] AS held, {{'seq': seq, 'at': t, 'content': content, 'text': text}} AS cur, text AS served FROM frames WHERE n = 1
  UNION ALL
  SELECT session_id, display_id, n, document_seq, reused, held, cur, CASE WHEN reused THEN hit.text ELSE cur.text END FROM (
    SELECT *, CASE WHEN reused THEN hit.seq ELSE cur.seq END AS document_seq FROM (
      SELECT session_id, display_id, n, hit, hit IS NOT NULL AS reused,
        CASE WHEN hit IS NOT NULL OR same THEN live ELSE list_concat([{{'seq': seq, 'at': t, 'frame': frame, 'text': text}}], live)[1 : {HELD}] END AS held,
        CASE WHEN hit IS NOT NULL OR same THEN now ELSE {{'seq': seq, 'at': t, 'content': content, 'text': text}} END AS cur
      FROM (SELECT *, list_filter(live, lambda d: d.frame = frame)[1] AS hit, coalesce(now.content = content, false) AS same FROM (
        SELECT f.*, list_filter(s.held, lambda d: d.at >= f.t - {AGE}) AS live, CASE WHEN s.cur.at >= f.t - {AGE} THEN s.cur END AS now
        FROM steps s JOIN frames f ON f.session_id = s.session_id AND f.display_id = s.display_id AND f.n = s.n + 1
      ))
    )
  )
), told AS (SELECT f.*, s.document_seq, s.reused, s.served FROM steps s JOIN frames f ON f.session_id = s.session_id AND f.display_id = s.display_id AND f.n = s.n)"""

QUERIES = {
    "frame_cache": (frame_cache, f"WITH RECURSIVE {CACHE} SELECT session_id, display_id, seq, document_seq, reused FROM told"),
    "sample_assembly": (sample_assembly, f"""WITH RECURSIVE {CACHE} SELECT session_id, sample AS seq, count(*) AS displays, count(*) FILTER (WHERE reused) AS reused, count(*) FILTER (WHERE NOT reused) AS recognised,
  string_agg('Display ' || CAST(display_id AS VARCHAR) || chr(10) || served, chr(10) || chr(10) ORDER BY display_id) AS text, count(*) >= 2 AS complete FROM told GROUP BY session_id, sample"""),
    "encounters_session": (encounters_session, f"WITH {RUNS} SELECT session_id, display_id, text_hash, run, text, first_seen, last_seen, seen_count FROM enc"),
    "ingest_summary": (ingest_summary, f"WITH {RUNS} SELECT session_id, CAST(sum(seen_count) AS BIGINT) AS total, count(*) AS new, CAST(sum(seen_count) - count(*) AS BIGINT) AS updated, count(*) FILTER (WHERE run > 0) AS pruned FROM enc GROUP BY session_id"),
    "encounter_topk_cap": (encounter_topk_cap, f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, first_seen DESC, display_id, text_hash) AS n FROM enc) SELECT session_id, display_id, text_hash, first_seen, last_seen FROM r WHERE n <= 5"),
    "sighting_cap": (sighting_cap, f"""WITH {SEEN}, r AS (SELECT *, row_number() OVER (PARTITION BY display_id, text_hash ORDER BY t DESC, seq DESC) AS n, count(*) OVER (PARTITION BY display_id, text_hash) AS c FROM seen WHERE length({NORM_TEXT}) > 1)
SELECT display_id, text_hash, max(c) AS seen_count, CAST(count(*) AS INTEGER) AS kept, first(seq ORDER BY n DESC) AS oldest, first(seq ORDER BY n) AS newest FROM r WHERE n <= {W.MAX_SIGHTINGS} GROUP BY display_id, text_hash"""),
    "recent_encounters": (recent_encounters, f"WITH {RUNS}, l AS (SELECT session_id, max(t) AS now FROM samples GROUP BY session_id) SELECT e.session_id, display_id, text, first_seen, last_seen FROM enc e JOIN l ON e.session_id = l.session_id WHERE last_seen >= now - {TTL}"),
    "evicted_encounters": (evicted_encounters, f"WITH {EVICTED} SELECT session_id, display_id, text_hash, run, first_seen, last_seen, seen_count, CAST(least(seen_count, {W.MAX_SIGHTINGS}) AS INTEGER) AS kept FROM ev"),
    "remembered_encounters": (remembered_encounters, f"""WITH {EVICTED}, l AS (SELECT session_id, max(t) AS now FROM samples GROUP BY session_id), texts AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, display_id, text_hash ORDER BY run DESC) AS newest FROM ev
), r AS (SELECT texts.*, now, row_number() OVER (PARTITION BY texts.session_id ORDER BY last_rn DESC) AS n FROM texts JOIN l ON l.session_id = texts.session_id WHERE newest = 1)
SELECT session_id, display_id, text_hash, run, first_seen, last_seen, seen_count FROM r WHERE n <= {FEW} AND last_seen >= now - {DAY}"""),
    "dominant_role": (dominant_role, f"WITH {RUNS}, c AS (SELECT session_id, display_id, text_hash, run, role, row_number() OVER (PARTITION BY session_id, display_id, text_hash, run ORDER BY count(*) DESC, role) AS r FROM runs GROUP BY session_id, display_id, text_hash, run, role) SELECT session_id, display_id, text_hash, run, role FROM c WHERE r = 1"),
    "seal_windows": (seal_windows, f"WITH {SEALS} SELECT session_id, window_no, started_at, ended_at, seal_seq FROM wins"),
    "window_samples": (window_samples, f"WITH {SEALS} SELECT session_id, seq, window_no, started_at, ended_at FROM assigned"),
    "sealed_encounters": (sealed_encounters, f"WITH {SEALED} SELECT session_id, window_no, display_id, text_hash, first_seen, last_seen, seen_count, role FROM sealed_enc"),
    "segment_reduce": (segment_reduce, f"WITH {SEALED} SELECT session_id, window_no, display_id, role, text, round(x, 9) AS x, round(y, 9) AS y, round(w, 9) AS w, round(h, 9) AS h, first_seen, last_seen, sightings, lines FROM segments"),
    "repeated_ui": (repeated_ui, f"WITH {SEALED} SELECT role, repeated_ui, count(*) AS segments FROM segments GROUP BY role, repeated_ui"),
    "window_analysis_top10": (window_analysis_top10, f"""WITH {SEALED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, window_no ORDER BY first_seen, display_id, role) AS n FROM segments
), parts AS (
  SELECT session_id, window_no, started_at, ended_at, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS segs,
    CAST(strlen('[' || string_agg('{{"display_id":' || CAST(display_id AS VARCHAR) || ',"role":"' || role || '","first_seen":' || CAST(first_seen AS VARCHAR) || ',"text":"' || text || '","lines":' || CAST(lines AS VARCHAR) || ',"sightings":' || CAST(sightings AS VARCHAR) || ',"repeated_ui":' || CASE WHEN repeated_ui THEN 'true' ELSE 'false' END || '}}', ',') || ']') AS INTEGER) AS bytes,
    string_agg('- d' || CAST(display_id AS VARCHAR) || ' role=' || role || ' lines=' || CAST(lines AS VARCHAR) || ' sightings=' || CAST(sightings AS VARCHAR) || ' repeatedUI=' || CASE WHEN repeated_ui THEN 'true' ELSE 'false' END, chr(10) ORDER BY display_id, role) AS listed,
    string_agg('- [role ' || role || ', lines ' || CAST(lines AS VARCHAR) || '] ' || text, chr(10) ORDER BY n) FILTER (WHERE n <= 10) AS first
  FROM ranked GROUP BY session_id, window_no, started_at, ended_at
)
SELECT session_id, window_no, '{W.ANALYZER}' AS analyzer_id, bytes AS payload_bytes, '## Stub Window Summary' || chr(10) || chr(10) || '- Sequence: ' || CAST(window_no AS VARCHAR) || chr(10) || '- Window: ' || CAST(started_at AS VARCHAR) || ' → ' || CAST(ended_at AS VARCHAR) || chr(10) || '- Duration: ' || CAST(ended_at - started_at AS VARCHAR) || ' s'
  || chr(10) || '- Unique lines: ' || CAST(lines AS VARCHAR) || chr(10) || '- Segments: ' || CAST(segs AS VARCHAR) || chr(10) || chr(10) || '### Segments' || chr(10) || listed || chr(10) || chr(10) || '### Top segment text (chronological, first 10)' || chr(10) || first || chr(10) || chr(10) || '---' || chr(10)
  || 'LLM payload size: ' || CAST(bytes AS VARCHAR) || ' bytes (segment document; would be sent to a real LLM here)' AS summary_markdown FROM parts"""),
    "window_prompt": (window_prompt, f"""WITH {SEALED} SELECT session_id, window_no, '# Screen Text Window' || chr(10) || chr(10) || '- sessionID: ' || CAST(session_id AS VARCHAR) || chr(10) || '- sequence: ' || CAST(window_no AS VARCHAR) || chr(10) || '- startedAt: ' || CAST(started_at AS VARCHAR) || chr(10) || '- endedAt: ' || CAST(ended_at AS VARCHAR) || chr(10)
  || '- durationSeconds: ' || CAST(ended_at - started_at AS VARCHAR) || chr(10) || '- encounterCount: ' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) || '## Encounters (chronological)' || chr(10) || chr(10)
  || string_agg('- [' || CAST(first_seen AS VARCHAR) || ' → ' || CAST(last_seen AS VARCHAR) || ' ×' || CAST(seen_count AS VARCHAR) || ', display ' || CAST(display_id AS VARCHAR) || '] ' || text, chr(10) ORDER BY first_seen, text, last_seen, seen_count, display_id) AS prompt
FROM sealed_enc GROUP BY session_id, window_no, started_at, ended_at"""),
    "segment_document": (segment_document, f"""WITH {SEALED} SELECT session_id, window_no, started_at, ended_at, count(DISTINCT display_id) OVER win AS displays, CAST(sum(lines) OVER win AS BIGINT) AS encounters,
  CAST(row_number() OVER (PARTITION BY session_id, window_no ORDER BY display_id, role) - 1 AS INTEGER) AS i, display_id, role, first_seen, last_seen, lines, repeated_ui, sightings, text, round(x, 9) AS x, round(y, 9) AS y, round(w, 9) AS w, round(h, 9) AS h
FROM segments WINDOW win AS (PARTITION BY session_id, window_no)"""),
    "session_epochs": (session_epochs, f"WITH {SEEN}, e AS (SELECT session_id, seq, text, count(*) FILTER (WHERE text = 'signup') OVER (PARTITION BY session_id ORDER BY t, seq) AS epoch FROM samples) SELECT session_id, seq, epoch FROM e WHERE text <> 'signup'"),
    "snapshot_consecutive_skip": (snapshot_consecutive_skip, f"WITH {SNAPS}, m AS (SELECT *, {_SAME.format(_W1)} AS same FROM snaps) SELECT session_id, seq FROM m WHERE NOT same"),
    "snapshot_global_dedup": (snapshot_global_dedup, f"WITH {SNAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY text_hash, layout_hash ORDER BY t, seq) AS n FROM snaps) SELECT session_id, seq, text_hash, layout_hash FROM r WHERE n = 1"),
    "snapshot_exists": (snapshot_exists, f"WITH {SNAPS} SELECT session_id, seq FROM snaps s WHERE NOT EXISTS (SELECT 1 FROM snaps o WHERE o.seq % 250 = 0 AND o.text_hash = s.text_hash AND o.layout_hash = s.layout_hash)"),
    "document_runs": (document_runs, f"WITH {DOCUMENTS} SELECT session_id, display_id, seq, run, document_seq FROM docs"),
    "cache_expiry": (cache_expiry, f"""WITH {DOCUMENTS}, l AS (SELECT *, max(t) OVER (PARTITION BY session_id, display_id) AS now FROM docs), r AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, display_id ORDER BY t DESC, seq DESC) AS age_rank FROM l WHERE seq = document_seq AND t >= now - {20 * TTL}
) SELECT session_id, display_id, seq, CAST(age_rank AS INTEGER) AS age_rank FROM r WHERE age_rank <= {M.CACHE_SIZE}"""),
    "run_counters": (run_counters, f"""WITH {SNAPS}, b AS (SELECT *, seq % 11 <> 0 AS has FROM snaps), m AS (SELECT *, has AND {_SAME.format('(PARTITION BY session_id, has ORDER BY t, seq)')} AS skip FROM b)
SELECT session_id, count(*) AS captured, count(*) FILTER (WHERE NOT has) AS blank, count(*) FILTER (WHERE skip) AS skipped, count(*) FILTER (WHERE has AND NOT skip) AS cached FROM m GROUP BY session_id"""),
}
