"""Queries over stores: appends that go on, pruning, clearing, columns added later; catalogs of devices and displays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightstream.functions import text as T
from sightstream.operators import storage as Q
from sightstream.plans.transcript import CHUNKS, with_ids
from sightstream.plans.windows import SEALED, SNAPS, sealed, snapshots
from sightstream.sources.derived import table
from sightstream.sources.files import new_path
from sightstream.sources.providers import input_devices, main_display


#: The time that reused_ids deletes before.
MIDDLE = "1995-01-01"


def numbered(store: Q.Store, first_ids: int) -> DataFrame:
    """A store's rows, and which append gave them their id."""
    return store.read().withColumn("batch", F.when(F.col("id") <= first_ids, 1).otherwise(2))


def stored_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captures, half of them in a first append, all in a second, which rejects that half."""
    rows = table(spark, sf_dir, "documents").select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("captured_at"), F.format_string("doc-%d", "doc_id").alias("source"), F.coalesce("text", F.lit("")).alias("recognized_text"), F.coalesce(F.length("text"), F.lit(0)).alias("character_count"), "doc_id")
    store = Q.Store(spark, new_path(spark, "captures"), Q.CAPTURES + ", doc_id bigint", ["source"])
    store.append(rows.where("doc_id % 2 = 0"), ["captured_at"])
    n = store.read().count()
    rejected = store.append(rows, ["captured_at"]).rejected.select("doc_id", F.lit(0).alias("batch"), "character_count", F.lit("").alias("text_sha256"))
    return numbered(store, n).select("doc_id", "batch", "character_count", T.sha("recognized_text").alias("text_sha256")).union(rejected)


def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all snapshots the store keeps the first with each text and layout."""
    store = Q.Store(spark, new_path(spark, "snapshots"), "id bigint, session_id bigint, display_id bigint, seq bigint, t bigint, text string, text_hash string, layout_hash string", ["text_hash", "layout_hash"])
    store.append(snapshots(spark, sf_dir), ["t", "seq"])
    least, most, n = store.read().agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    return store.read().select("session_id", "seq", "text_hash", "layout_hash", F.lit(least == 1 and most == n).alias("ids_are_dense"))


def reused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of three appends: all orders of the first half of the customers, then those are deleted that are older than the
    middle of the time, then all others, then everything goes and the urgent ones come again. Ids are as they were given."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("at"))
    store = Q.Store(spark, new_path(spark, "ids"), "id bigint, o_orderkey bigint, o_custkey bigint, o_orderpriority string, at timestamp, given bigint")
    given = lambda df: df.withColumn("given", F.lit(None).cast("long"))
    first = store.append(given(o.where("o_custkey % 2 = 0")), ["at", "o_orderkey"]).stored
    store.delete_older("at", F.lit(MIDDLE).cast("timestamp"))
    second = store.append(given(o.where("o_custkey % 2 = 1")), ["at", "o_orderkey"]).stored
    held = store.read()
    store.clear()
    third = store.append(given(o.where("o_orderpriority = '1-URGENT'")), ["at", "o_orderkey"]).stored
    told = lambda df, step: df.groupBy(F.lit(step).alias("step")).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count_distinct("id").alias("ids"), F.count("*").alias("n"))
    return told(first, 1).union(told(second, 2)).union(told(held.where("o_custkey % 2 = 0"), 3).select("step", F.lit(0).alias("least"), F.lit(0).alias("most"), "ids", "n")).union(told(third, 4)).union(told(store.read(), 5))


def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest analyses of sealed windows, after those of the first ten windows of a session were cleared."""
    rows = sealed(spark, sf_dir).groupBy("session_id", "window_no", F.col("ended_at").alias("generated_at")).agg(F.count("*").alias("encounter_count"))
    store = Q.Store(spark, new_path(spark, "analyses"), "id bigint, session_id bigint, window_no int, generated_at bigint, encounter_count bigint", ["session_id", "window_no"])
    store.append(rows, ["generated_at"])
    store.clear(F.col("window_no") <= 10)
    return Q.latest(store.read(), 50, "generated_at", "session_id", "window_no").select("session_id", "window_no", "generated_at", "encounter_count")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by source: what is left once both sources were pruned and the microphone's were cleared from turn 6 on."""
    store = Q.Store(spark, new_path(spark, "chunks"), "id bigint, session_id bigint, seq bigint, start_time double, duration double, language string, text string, chunk_id string, source string", ["session_id", "chunk_id"])
    store.append(with_ids(spark, sf_dir), ["seq"], partition_by="source")
    store.delete_older("start_time", F.lit(8.0))
    store.clear((F.col("source") == "microphone") & (F.col("seq") >= 6))
    return store.read().select("session_id", "chunk_id", "source", "start_time", T.sha("text").alias("text_sha256"))


def evolved_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored before the store had a column for their priority, and after."""
    path = new_path(spark, "orders")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    Q.Store(spark, path, "id bigint, o_orderkey bigint, o_custkey bigint", ["o_orderkey"]).append(o.where("o_orderkey % 2 = 0").drop("o_orderpriority"), ["o_orderkey"])
    store = Q.Store(spark, path, "id bigint, o_orderkey bigint, o_custkey bigint, o_orderpriority string", ["o_orderkey"], {"o_orderpriority": "not known"})
    store.append(o, ["o_orderkey"])
    return store.read().select("o_orderkey", "o_custkey", "o_orderpriority")


def browser_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda s: table(spark, sf_dir, "events").where(F.col("event_id") % 2 == s).select(F.col("event_id").alias("id"), F.col("ts").alias("captured_at"), F.col("event_type").alias("text"))
    return Q.browser_totals(Q.browser(part(0), part(1)))


def device_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the devices of a host for each nation; the one with the least balance is the default."""
    s = table(spark, sf_dir, "supplier")
    least = s.groupBy("s_nationkey").agg(F.min(F.struct("s_acctbal", "s_suppkey")).alias("least"))
    name = F.when(F.col("s_suppkey") % 7 == 0, F.lit(None)).when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise(F.col("s_name"))
    rows = s.join(least, "s_nationkey").select(F.col("s_nationkey").alias("host"), F.col("s_suppkey").alias("id"), name.alias("name"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(None)).otherwise("ACME").alias("manufacturer"), (F.col("s_suppkey") % 3).alias("channels"), (F.col("least.s_suppkey") == F.col("s_suppkey")).alias("is_default"))
    return input_devices(rows).select("host", "position", "id", "label", "is_default")


def main_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in pairs as samples of two displays; an error is a display that gives no frame."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 2).alias("seq"), F.when(F.col("event_type") != "error", F.col("event_id") % 2 + 1).alias("display_id"), F.sha2("event_type", 256).alias("frame_hash"))
    return main_display(e)


QUERIES = {
    "stored_captures": (stored_captures, """SELECT doc_id, CAST(doc_id % 2 + 1 AS INTEGER) AS batch, CAST(coalesce(length(text), 0) AS INTEGER) AS character_count, sha256(coalesce(text, '')) AS text_sha256 FROM documents
UNION ALL SELECT doc_id, 0::INTEGER, CAST(coalesce(length(text), 0) AS INTEGER), '' FROM documents WHERE doc_id % 2 = 0"""),
    "stored_snapshots": (stored_snapshots, f"WITH {SNAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY text_hash, layout_hash ORDER BY t, seq) AS n FROM snaps) SELECT session_id, seq, text_hash, layout_hash, true AS ids_are_dense FROM r WHERE n = 1"),
    "stored_analyses": (stored_analyses, f"WITH {SEALED} SELECT session_id, window_no, ended_at AS generated_at, count(*) AS encounter_count FROM sealed_enc WHERE window_no > 10 GROUP BY session_id, window_no, ended_at ORDER BY generated_at DESC, session_id DESC, window_no DESC LIMIT 50"),
    "stored_chunks": (stored_chunks, f"WITH {CHUNKS} SELECT session_id, chunk_id, source, start_time, sha256(text) AS text_sha256 FROM chunks WHERE start_time >= 8 AND NOT (source = 'microphone' AND seq >= 6)"),
    "reused_ids": (reused_ids, f"""WITH n AS (SELECT count(*) FILTER (WHERE o_custkey % 2 = 0) AS a, count(*) FILTER (WHERE o_custkey % 2 = 1) AS b, count(*) FILTER (WHERE o_custkey % 2 = 0 AND o_orderdate >= TIMESTAMP '{MIDDLE}') AS k, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u FROM orders)
SELECT 1::INTEGER AS step, 1::BIGINT AS least, a AS most, a AS ids, a AS n FROM n UNION ALL SELECT 2, a + 1, a + b, b, b FROM n UNION ALL SELECT 3, 0, 0, k, k FROM n UNION ALL SELECT 4, a + b + 1, a + b + u, u, u FROM n UNION ALL SELECT 5, a + b + 1, a + b + u, u, u FROM n"""),
    "evolved_store": (evolved_store, "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'not known' ELSE o_orderpriority END AS o_orderpriority FROM orders"),
    "browser_totals": (browser_totals, """WITH n AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'computer' ELSE 'microphone' END AS source, least(count(*), 50) AS rows FROM events GROUP BY 1)
SELECT source, rows, CAST(sum(rows) OVER () AS BIGINT) AS total_rows, true AS has_rows FROM n"""),
    "device_catalog": (device_catalog, """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) = 1 AS is_default FROM supplier), d AS (
  SELECT s_nationkey AS host, s_suppkey AS id, is_default, s_suppkey % 3 AS channels, coalesce(CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE s_name END, 'Input ' || CAST(s_suppkey AS VARCHAR)) AS name FROM s
), l AS (SELECT *, name || CASE WHEN id % 5 = 0 THEN '' ELSE ' - ACME' END AS label FROM d WHERE channels > 0)
SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY is_default DESC, lower(label), id) AS INTEGER) AS position, id, label, is_default FROM l"""),
    "main_displays": (main_displays, """WITH f AS (SELECT user_id AS session_id, event_id // 2 AS seq, CASE WHEN event_type <> 'error' THEN event_id % 2 + 1 END AS display_id, sha256(event_type) AS frame_hash FROM events), r AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY display_id NULLS LAST, frame_hash) AS n FROM f
) SELECT session_id, seq, display_id, CASE WHEN display_id IS NOT NULL THEN frame_hash END AS frame_hash, CASE WHEN display_id IS NULL THEN 'no display' END AS error FROM r WHERE n = 1"""),
}
