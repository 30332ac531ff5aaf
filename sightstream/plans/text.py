"""Queries over texts and boxes, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightstream.functions import text as T
from sightstream.operators import classify as C
from sightstream.operators import export as X
from sightstream.operators import layout as L
from sightstream.sources.derived import FRAME_WIDTH, doubled, observations, table

NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
norm = NORM.format

OBS = f"""lines AS (
  SELECT doc_id, CAST(i AS INTEGER) AS obs_idx, t AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE {norm("t")} <> ''
), obs AS (
  SELECT doc_id, obs_idx, doc_id % 2 + 1 AS display_id, text, CAST(16 * ((obs_idx // 4) % 2) AS DOUBLE) AS x, CAST(24 * obs_idx + 60 * (obs_idx // 4) + 200 * (obs_idx // 8) AS DOUBLE) AS y,
    CAST(8 * least(length(text), 100) AS DOUBLE) AS w, 20.0::DOUBLE AS h, 1.0::DOUBLE / (1 + obs_idx) AS confidence FROM lines
)"""


#: A frame of prime sides: shares of it never lie halfway between two decimals, which engines round differently.
ODD_FRAME = (1913.0, 10_007.0)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def as_lines(boxes: DataFrame) -> DataFrame:
    """Boxes that are lines already: numbered by their order."""
    return boxes.withColumn("line_no", F.col("obs_idx")).select("doc_id", "display_id", "line_no", "text", "x", "y", "w", "h")


def framed_blocks(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Blocks with frame_h, the height of their document's frame."""
    lines = as_lines(observations(spark, sf_dir, dealt))
    heights = lines.groupBy("doc_id").agg((F.max("y") + 20).alias("frame_h"))
    return L.blocks(lines).join(heights, "doc_id")


def classified(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return C.classify(framed_blocks(spark, sf_dir, dealt), F.lit(float(FRAME_WIDTH)), F.col("frame_h"))


def doc_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize("text").alias("norm_text"))


def doc_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.text_hash("text").alias("text_hash"))


def doc_dedup_hash(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(T.text_hash("text").alias("text_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def doc_metrics(spark, sf_dir):
    box = F.length("text") * 8.0
    return docs(spark, sf_dir).select("doc_id", T.length("text").alias("character_count"), T.word_count("text").alias("word_count"), T.ratio(box * 20, F.lit(1920.0 * 1080)).alias("area_ratio"), T.has_text("text").alias("has_text"))


def normalized_words(spark, sf_dir):
    words = T.normalized_words("text")
    return docs(spark, sf_dir).select("doc_id", F.size(words).alias("n_words"), F.array_join(words, " ").alias("words"))


def trimmed_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.trimmed("text").alias("text"))


def frame_hashes(spark, sf_dir):
    d = F.col("doc_id") % 2 + 1
    return docs(spark, sf_dir).select("doc_id", T.sha("text").alias("frame_hash"), T.display_frame_hash(d, T.sha("text")).alias("display_frame_hash"))


def time_formats(spark, sf_dir):
    s = (F.col("event_id") * 37 % 7200) / 8.0
    return table(spark, sf_dir, "events").select("event_id", T.clock(s).alias("clock"), T.clock_range(s, s + 5).alias("clock_range"), T.percent((F.col("event_id") % 101) / 100.0).alias("percent"))


def device_labels(spark, sf_dir):
    maker = F.concat(F.lit("maker "), (F.col("s_suppkey") % 3).cast("string"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" by "), maker)).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.device_label(name, F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(maker)).alias("label"))


def layout_lines(spark, sf_dir):
    """Two columns: a box and its neighbour on the right, three pixels lower, are one line."""
    i = F.col("obs_idx")
    boxes = observations(spark, sf_dir).withColumns({"y": (24 * F.floor(i / 2) + 3 * (i % 2)).cast("double"), "x": (900 * (i % 2)).cast("double")})
    return L.lines(boxes).select("doc_id", "line_no", "text", "x", "y", "w", "h", "n_boxes")


def layout_blocks(spark, sf_dir):
    return L.blocks(as_lines(observations(spark, sf_dir))).select("doc_id", "block_no", "text", "x", "y", "w", "h", "n_lines")


def layout_regions(spark, sf_dir):
    return L.regions(L.blocks(as_lines(observations(spark, sf_dir)))).select("doc_id", "region_no", "x", "y", "w", "h", "n_blocks", "first_block", "last_block")


def layout_bbox_union(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("doc_id").agg(*L.union_box_agg())


def layout_hash(spark, sf_dir):
    return L.digests(observations(spark, sf_dir))


def near_dup_boxes(spark, sf_dir):
    return L.drop_duplicate_boxes(doubled(observations(spark, sf_dir))).select("doc_id", "obs_idx", "x", "y", "confidence")


def aggregate_text_hash(spark, sf_dir):
    d = L.digests(observations(spark, sf_dir)).withColumns({"sample_id": F.floor(F.col("doc_id") / 2), "display_index": F.col("display_id") - 1})
    return L.aggregate_digests(d)


def classify_blocks(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "block_no", "role", "confidence", F.array_join("reasons", "; ").alias("reasons"))


def role_histogram(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("role").agg(F.count("*").alias("blocks"))


def export_aliases(spark, sf_dir):
    rows = X.metrics(X.aliased(framed_blocks(spark, sf_dir), "b", "block_no"), F.lit(float(FRAME_WIDTH)), F.col("frame_h"))
    share = lambda c: F.round(F.col(f"normalized_bounds.{c}"), 9).alias(f"n{c}")
    return rows.select("doc_id", "alias", "reading_order", "character_count", "word_count", F.round("area_ratio", 9).alias("area_ratio"), share("x"), share("y"), share("width"), share("height"))


def chunk_pack(spark, sf_dir):
    b = L.blocks(as_lines(observations(spark, sf_dir)))
    return X.chunks(L.regions(b), b, 2000)


def split_oversized(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.split_oversized(F.col("text"), F.lit(500))).alias("part", "text"))


def anchored_markdown(spark, sf_dir):
    b = L.blocks(as_lines(observations(spark, sf_dir)))
    return X.anchored_markdown(L.regions(b), b, *map(F.lit, ODD_FRAME))


def structured_markdown(spark, sf_dir):
    return X.structured_markdown(classified(spark, sf_dir), *map(F.lit, ODD_FRAME))


def compact_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return X.compact_json(e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id"), ["event_id"])


def recognized_text(spark, sf_dir):
    """Documents with the fewest lines as lone observations, others as blocks; two documents make a sample of two displays."""
    b = L.blocks(as_lines(observations(spark, sf_dir))).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s.text).alias("blocks"))
    none = F.array().cast("array<string>")
    text = b.select("doc_id", T.recognized_text(F.when(F.size("blocks") > 1, F.col("blocks")).otherwise(none), none, F.col("blocks")).alias("text"))
    return text.groupBy(F.floor(F.col("doc_id") / 2).alias("sample_id")).agg(T.displays_text(F.collect_list(F.struct((F.col("doc_id") % 2).alias("index"), "text"))).alias("text"))


def page_blocks(spark, sf_dir):
    """Classified text blocks of pages, without their markup."""
    body = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    parts = F.filter(F.transform(F.split(F.regexp_replace(body, r"(?s)<[^>]*>", "\n"), "\n"), T.trimmed), lambda t: t != "")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(parts).alias("block_no", "text"))
    h = 0.05
    rows = rows.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("display_id"), "block_no", "text", F.lit(0.1).alias("x"), (F.col("block_no") * h).alias("y"), F.lit(0.5).alias("w"), F.lit(h).alias("h"))
    return C.classify(rows, F.lit(1.0), F.lit(1.0)).groupBy("role").agg(F.count("*").alias("blocks"), F.count_distinct("doc_id").alias("pages"))


def pixel_hashes(spark, sf_dir):
    """Each document's bytes as the pixels of a frame."""
    n = F.length("text")
    return docs(spark, sf_dir).select("doc_id", T.frame_hash(n, F.lit(1), F.lit(32), n * 4, F.lit(1), F.col("text").cast("binary")).alias("frame_hash"))


def recognised_boxes(spark, sf_dir):
    """Boxes as shares of a frame of 1000 x 500 with y upward, turned into pixels."""
    from sightstream.sources.providers import recognised

    i = F.col("obs_idx")
    boxes = observations(spark, sf_dir).withColumns({"x": (i % 8) / 8.0, "y": (i % 4) / 4.0, "w": F.lit(0.125), "h": F.lit(0.125)})
    return recognised(boxes, F.lit(1000.0), F.lit(500.0)).select("doc_id", "obs_idx", "text", "x", "y", "w", "h")


def joined_observations(spark, sf_dir):
    from sightstream.sources.providers import joined_text

    return joined_text(observations(spark, sf_dir), ["doc_id"])


def plain_export(spark, sf_dir):
    """Blocks of a document as text, with their roles."""
    return X.plain_text(classified(spark, sf_dir), ["doc_id"], "block_no", F.concat(F.lit("["), F.col("role"), F.lit("]")))


def prepared_documents(spark, sf_dir):
    """Everything that is prepared of a document: its Markdown, structured Markdown and chunks, by their hashes."""
    b = L.blocks(as_lines(observations(spark, sf_dir, dealt=True)))
    p = X.prepared(L.regions(b), b, classified(spark, sf_dir, dealt=True), *map(F.lit, ODD_FRAME), limit=2000)
    return p.select("doc_id", T.sha("markdown").alias("markdown_sha256"), T.sha("structured").alias("structured_sha256"), F.size("chunks").alias("chunks"), T.sha(F.array_join(F.transform("chunks", lambda c: c["text"]), "\n")).alias("chunks_sha256"))


def document_build(spark, sf_dir):
    """The whole build of a document's boxes: how many lines, blocks and regions they make, and their hashes."""
    lines, blocks, regions, digests = L.build(observations(spark, sf_dir))
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    return digests.join(n(lines, "n_lines"), "doc_id").join(n(blocks, "n_blocks"), "doc_id").join(n(regions, "n_regions"), "doc_id").select("doc_id", "n_lines", "n_blocks", "n_regions", "text_hash", "layout_hash")


BLOCKS = f"""{OBS}, lagged AS (
  SELECT *, lag(x) OVER win AS px, lag(y) OVER win AS py, lag(w) OVER win AS pw, lag(h) OVER win AS ph FROM obs WINDOW win AS (PARTITION BY doc_id ORDER BY obs_idx)
), flags AS (
  SELECT *, CASE WHEN px IS NOT NULL AND y - (py + ph) <= greatest(10.0, 1.6 * greatest(h, ph)) AND (abs(x - px) <= greatest(16.0, 2 * greatest(h, ph))
      OR (CASE WHEN least(w, pw) > 0 THEN greatest(0.0, least(x + w, px + pw) - greatest(x, px)) / least(w, pw) ELSE 0.0 END) >= 0.25) THEN 0 ELSE 1 END AS brk FROM lagged
), numbered AS (
  SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY obs_idx) - 1 AS block_no FROM flags
), blocks AS (
  SELECT doc_id, display_id, CAST(block_no AS BIGINT) AS block_no, string_agg(text, chr(10) ORDER BY obs_idx) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(count(*) AS BIGINT) AS n_lines
  FROM numbered GROUP BY doc_id, display_id, block_no
)"""
REGIONS = f"""{BLOCKS}, blagged AS (
  SELECT *, lag(x) OVER win AS px, lag(y) OVER win AS py, lag(w) OVER win AS pw, lag(h) OVER win AS ph FROM blocks WINDOW win AS (PARTITION BY doc_id ORDER BY block_no)
), bflags AS (
  SELECT *, CASE WHEN px IS NOT NULL AND y - (py + ph) <= greatest(24.0, 1.2 * (h + ph) / 2) AND (CASE WHEN least(w, pw) > 0 THEN greatest(0.0, least(x + w, px + pw) - greatest(x, px)) / least(w, pw) ELSE 0.0 END) >= 0.15 THEN 0 ELSE 1 END AS brk FROM blagged
), rnumbered AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS BIGINT) AS region_no FROM bflags
), regions AS (
  SELECT doc_id, display_id, region_no, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(count(*) AS BIGINT) AS n_blocks, min(block_no) AS first_block, max(block_no) AS last_block
  FROM rnumbered GROUP BY doc_id, display_id, region_no
)"""


def pack_sql(name: str, source: str, key: str, limit: int) -> str:
    """CTEs that pack pieces of source (key, rn from 1, piece) greedily into parts of at most limit characters: name (key, part, text)."""
    joined = "CASE WHEN f.cur = '' THEN o.piece ELSE f.cur || chr(10) || o.piece END"
    return f"""{name}_fold(k, rn, part, cur) AS (
  SELECT {key}, rn, 0, piece FROM {source} WHERE rn = 1
  UNION ALL
  SELECT o.{key}, o.rn, f.part + CASE WHEN length({joined}) <= {limit} THEN 0 ELSE 1 END, CASE WHEN length({joined}) <= {limit} THEN {joined} ELSE o.piece END FROM {name}_fold f JOIN {source} o ON o.{key} = f.k AND o.rn = f.rn + 1
), {name} AS (
  SELECT k AS {key}, CAST(part AS INTEGER) AS part, last(cur ORDER BY rn) AS text FROM {name}_fold GROUP BY k, part HAVING last(cur ORDER BY rn) <> ''
)"""


def cut_sql(name: str, source: str, key: str, limit: int) -> str:
    """CTEs that cut the lines of source (key, text) hard: name (key, rn, piece)."""
    return f"""{name}_lines AS (
  SELECT {key}, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {source}
), {name}_cut AS (
  SELECT {key}, i, line, unnest(range(greatest(CAST(ceil(length(line) / {limit}.0) AS BIGINT), 1))) AS j FROM {name}_lines
), {name} AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i, j) AS rn, substr(line, j * {limit} + 1, {limit}) AS piece FROM {name}_cut
)"""


def sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def role_sql(text: str, n: str, c: str, x: str, y: str, w: str, h: str, first: str) -> tuple[str, str, str]:
    """CASE expressions for role, confidence and reasons, written from the rules' own constants."""
    low = f"lower({text})"
    has = lambda words, of=low: "(" + " OR ".join(f"contains({of}, {sql_string(v)})" for v in words) + ")"
    begins = lambda words: "(" + " OR ".join(f"starts_with({low}, {sql_string(v)})" for v in words) + ")"
    one = lambda words: f"{low} IN ({', '.join(map(sql_string, words))})"
    digits = f"length(regexp_replace({text}, '[^0-9]', '', 'g'))"
    solid = f"length(regexp_replace({text}, '\\s', '', 'g'))"
    ch = f"substr({text}, 1, 1)"
    tests = {
        "empty": (0.2, f"{text} = ''"),
        "codeOrLog": (0.78, f"{has(C.CODE_ANYWHERE)} OR {begins(C.CODE_PREFIX)} OR {has(C.CODE_TOKENS, text)}"),
        "priceOrNumber": (0.74, f"{digits} > 0 AND ({has(C.PRICE_MARKS, text)} OR CAST({digits} AS DOUBLE) / greatest({solid}, 1) >= 0.55)"),
        "ad": (0.7, f"{one(C.AD_EXACT)} OR {begins(C.AD_PREFIX)} OR {has(C.AD_ANYWHERE)}"),
        "buttonLike": (0.76, f"{n} <= 5 AND {w} <= 0.45 AND {h} <= 0.12 AND ({one(C.BUTTON_EXACT)} OR {begins(C.BUTTON_PREFIX)})"),
        "linkLike": (0.7, f"{n} <= 7 AND ({begins(C.LINK_PREFIX)} OR {has(C.LINK_ANYWHERE)} OR {one(C.LINK_EXACT)})"),
        "navigation": (0.68, f"{n} <= 4 AND ({y} <= 0.18 OR {x} <= 0.18 OR {x} + {w} >= 0.82) AND {one(C.NAVIGATION_EXACT)}"),
        "formLabel": (0.72, f"{n} <= 5 AND (ends_with({low}, ':') OR {one(C.LABEL_EXACT)})"),
        "inputPlaceholder": (0.68, f"{n} <= 8 AND ({begins(C.PLACEHOLDER_PREFIX)} OR {has(['placeholder'])})"),
        "tableHeader": (0.64, f"{n} <= 4 AND {y} <= 0.35 AND {one(C.TABLE_EXACT)}"),
        "paragraph": (0.7, f"{c} >= 90 OR {n} >= 14"),
        "chatMessage": (0.62, f"{c} BETWEEN 12 AND 280 AND {has(['.', '?', '!'])} AND {w} BETWEEN 0.25 AND 0.85 AND {x} >= 0.05 AND {x} + {w} <= 0.95"),
        "heading": (0.72, f"{n} <= 10 AND (({ch} = upper({ch}) AND {ch} <> lower({ch})) OR {n} <= 3) AND ({y} <= 0.28 OR {text} = {first})"),
        "metadata": (0.64, f"{n} <= 8 AND ({has(C.METADATA_ANYWHERE)} OR ({digits} > 0 AND {has([':', '/', '-'])}))"),
        "tableCell": (0.48, f"{n} <= 8"),
    }
    case = lambda value, last: "CASE " + " ".join(f"WHEN {t} THEN {value(k, v)}" for k, (v, t) in tests.items()) + f" ELSE {last} END"
    return (
        case(lambda k, v: sql_string("unknown" if k == "empty" else k), "'unknown'"),
        case(lambda k, v: f"{v}::DOUBLE", "0.4::DOUBLE"),
        case(lambda k, v: sql_string("; ".join(C.REASONS[k])), sql_string("; ".join(C.REASONS["unknown"]))),
    )


_ROLE, _CONF, _WHY = role_sql("t", "n", "c", "nx", "ny", "nw", "nh", "first_t")
TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
COUNT = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda v: v <> ''))"
CLASSIFIED = f"""{BLOCKS}, framed AS (
  SELECT b.*, f.frame_h, {TRIM.format('text')} AS t, {COUNT.format('text')} AS n, length(text) AS c, x / 1920.0 AS nx, y / f.frame_h AS ny, w / 1920.0 AS nw, h / f.frame_h AS nh
  FROM blocks b JOIN (SELECT doc_id, max(y) + 20 AS frame_h FROM obs GROUP BY doc_id) f ON b.doc_id = f.doc_id
), firsts AS (
  SELECT *, first_value(t) OVER (PARTITION BY doc_id ORDER BY block_no) AS first_t FROM framed
), classified AS (
  SELECT *, {_ROLE} AS role, {_CONF} AS confidence, {_WHY} AS reasons FROM firsts
)"""
_FOLDED = "lower(strip_accents(text))"
_WORDS = f"list_filter(regexp_split_to_array(regexp_replace({_FOLDED}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda v: v <> '')"
_CLOCK = lambda s: f"printf('%02d:%02d.%02d', CAST(round({s} * 100) AS BIGINT) // 6000, (CAST(round({s} * 100) AS BIGINT) // 100) % 60, CAST(round({s} * 100) AS BIGINT) % 100)"
_S = "(event_id * 37 % 7200 / 8.0)"
_DIGEST = f"""{OBS}, digests AS (
  SELECT doc_id, display_id, sha256({norm("string_agg(text, chr(10) ORDER BY obs_idx)")}) AS text_hash,
    sha256(string_agg({norm("text")} || '|' || CAST(CAST(round(x) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(y) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(w) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(h) AS BIGINT) AS VARCHAR), chr(10) ORDER BY round(y), x, y, w, h, {norm("text")})) AS layout_hash
  FROM obs GROUP BY doc_id, display_id
)"""
_PLACE = lambda a, b, c, d, f: "'" + f"[x: ' || printf('%.4f', {a}) || ', y: ' || printf('%.4f', {b}) || ', w: ' || printf('%.4f', {c}) || ', h: ' || printf('%.4f', {d}) || ']'"
_PAGE_ROLE = role_sql("text", "n", "c", "0.1", "block_no * 0.05", "0.5", "0.05", "first_t")[0]

QUERIES = {
    "doc_normalize": (doc_normalize, f"SELECT doc_id, {norm('text')} AS norm_text FROM documents"),
    "doc_hash": (doc_hash, f"SELECT doc_id, sha256({norm('text')}) AS text_hash FROM documents"),
    "doc_dedup_hash": (doc_dedup_hash, f"SELECT sha256({norm('text')}) AS text_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1"),
    "doc_metrics": (doc_metrics, f"SELECT doc_id, CAST(length_grapheme(text) AS INTEGER) AS character_count, CAST({COUNT.format('text')} AS INTEGER) AS word_count, length(text) * 8.0::DOUBLE * 20 / (1920.0::DOUBLE * 1080) AS area_ratio, {norm('text')} <> '' AS has_text FROM documents"),
    "normalized_words": (normalized_words, f"SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n_words, coalesce(array_to_string({_WORDS}, ' '), '') AS words FROM documents"),
    "trimmed_text": (trimmed_text, f"SELECT doc_id, {TRIM.format('text')} AS text FROM documents"),
    "frame_hashes": (frame_hashes, "SELECT doc_id, sha256(text) AS frame_hash, sha256('display:' || CAST(doc_id % 2 + 1 AS VARCHAR) || '|frame:' || sha256(text)) AS display_frame_hash FROM documents"),
    "time_formats": (time_formats, f"SELECT event_id, {_CLOCK(_S)} AS clock, {_CLOCK(_S)} || ' - ' || {_CLOCK('(' + _S + ' + 5)')} AS clock_range, CAST(event_id % 101 AS VARCHAR) || '%' AS percent FROM events"),
    "device_labels": (device_labels, """WITH d AS (SELECT s_suppkey, 'maker ' || CAST(s_suppkey % 3 AS VARCHAR) AS m, s_name FROM supplier), e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' by ' || m ELSE s_name END AS name, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE m END AS maker FROM d)
SELECT s_suppkey, CASE WHEN maker <> '' AND NOT contains(name, maker) THEN name || ' - ' || maker ELSE name END AS label FROM e"""),
    "layout_lines": (layout_lines, f"""WITH {OBS}, pairs AS (SELECT doc_id, obs_idx, obs_idx // 2 AS r, text, 900.0::DOUBLE * (obs_idx % 2) AS x, CAST(24 * (obs_idx // 2) + 3 * (obs_idx % 2) AS DOUBLE) AS y, w, h FROM obs)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INTEGER) AS line_no, string_agg({TRIM.format('text')}, ' ' ORDER BY x) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(count(*) AS INTEGER) AS n_boxes FROM pairs GROUP BY doc_id, r"""),
    "layout_blocks": (layout_blocks, f"WITH {BLOCKS} SELECT doc_id, block_no, text, x, y, w, h, n_lines FROM blocks"),
    "layout_regions": (layout_regions, f"WITH {REGIONS} SELECT doc_id, region_no, x, y, w, h, n_blocks, first_block, last_block FROM regions"),
    "layout_bbox_union": (layout_bbox_union, f"WITH {OBS} SELECT doc_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM obs GROUP BY doc_id"),
    "layout_hash": (layout_hash, f"WITH {_DIGEST} SELECT doc_id, display_id, text_hash, layout_hash FROM digests"),
    "near_dup_boxes": (near_dup_boxes, f"""WITH {OBS}, two AS (SELECT doc_id, obs_idx, text, x, y, w, h, confidence FROM obs UNION ALL SELECT doc_id, obs_idx + 100000, text, x + 2, y + 2, w, h, confidence / 2 FROM obs WHERE obs_idx % 3 = 0)
SELECT a.doc_id, a.obs_idx, a.x, a.y, a.confidence FROM two a WHERE NOT EXISTS (SELECT 1 FROM two b WHERE b.doc_id = a.doc_id AND {norm('b.text')} = {norm('a.text')} AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.obs_idx < a.obs_idx))
  AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) >= 0.72)"""),
    "aggregate_text_hash": (aggregate_text_hash, f"""WITH {_DIGEST} SELECT doc_id // 2 AS sample_id, sha256(string_agg('display:' || CAST(display_id AS VARCHAR) || '|' || text_hash, chr(10) ORDER BY display_id)) AS text_hash,
  sha256(string_agg('display:' || CAST(display_id AS VARCHAR) || '|' || layout_hash, chr(10) ORDER BY display_id)) AS layout_hash FROM digests GROUP BY doc_id // 2"""),
    "classify_blocks": (classify_blocks, f"WITH {CLASSIFIED} SELECT doc_id, block_no, role, confidence, reasons FROM classified"),
    "role_histogram": (role_histogram, f"WITH {CLASSIFIED} SELECT role, count(*) AS blocks FROM classified GROUP BY role"),
    "export_aliases": (export_aliases, f"""WITH {CLASSIFIED} SELECT doc_id, 'd' || CAST(display_id AS VARCHAR) || '.b' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS VARCHAR) AS alias, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS INTEGER) AS reading_order,
  CAST(c AS INTEGER) AS character_count, CAST(n AS INTEGER) AS word_count, round(w * h / (1920.0::DOUBLE * frame_h), 9) AS area_ratio, round(nx, 9) AS nx, round(ny, 9) AS ny, round(nw, 9) AS nwidth, round(nh, 9) AS nheight FROM classified"""),
    "chunk_pack": (chunk_pack, f"""WITH RECURSIVE {REGIONS}, b AS (
  SELECT doc_id, region_no, block_no, '[d' || CAST(display_id AS VARCHAR) || '.b' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS VARCHAR) || '] ' || text AS line FROM rnumbered
), r AS (
  SELECT doc_id * 1000000 + region_no AS rid, doc_id, region_no, string_agg(line, chr(10) ORDER BY block_no) AS text FROM b GROUP BY doc_id, region_no
), long AS (SELECT rid, text FROM r WHERE length(text) > 2000), {cut_sql('cuts', 'long', 'rid', 2000)}, {pack_sql('parts', 'cuts', 'rid', 2000)}, pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rid, part) AS rn, text AS piece FROM (
    SELECT rid // 1000000 AS doc_id, rid, part, text FROM parts UNION ALL SELECT doc_id, rid, 0, text FROM r WHERE length(text) <= 2000)
), {pack_sql('packed', 'pieces', 'doc_id', 2000)}
SELECT doc_id, 'c' || CAST(part + 1 AS VARCHAR) AS alias, text, CAST(length(text) AS INTEGER) AS character_count FROM packed"""),
    "split_oversized": (split_oversized, f"WITH RECURSIVE {cut_sql('cuts', 'documents', 'doc_id', 500)}, {pack_sql('parts', 'cuts', 'doc_id', 500)} SELECT doc_id, part, text FROM parts"),
    "anchored_markdown": (anchored_markdown, f"""WITH {REGIONS}, b AS (
  SELECT doc_id, display_id, block_no, region_no, text, 'd' || CAST(display_id AS VARCHAR) || '.b' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS VARCHAR) AS alias FROM rnumbered
), rb AS (
  SELECT doc_id, region_no, string_agg(alias, ', ' ORDER BY block_no) AS aliases, string_agg('#### ' || alias || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY block_no) AS body, count(*) AS n FROM b GROUP BY doc_id, region_no
), parts AS (
  SELECT r.doc_id, r.display_id, r.region_no, rb.n, '### d' || CAST(r.display_id AS VARCHAR) || '.r' || CAST(r.region_no + 1 AS VARCHAR) || chr(10) || chr(10) || '- order: ' || CAST(r.region_no + 1 AS VARCHAR) || chr(10)
    || '- bounds: ' || {_PLACE('x', 'y', 'w', 'h', 4)} || chr(10) || '- normalizedBounds: ' || {_PLACE('x / 1913.0::DOUBLE', 'y / 10007.0::DOUBLE', 'w / 1913.0::DOUBLE', 'h / 10007.0::DOUBLE', 4)} || chr(10)
    || '- blockAliases: ' || rb.aliases || chr(10) || chr(10) || rb.body AS md FROM regions r JOIN rb ON r.doc_id = rb.doc_id AND r.region_no = rb.region_no
)
SELECT doc_id, '# Screen Text' || chr(10) || chr(10) || '- blockCount: ' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || chr(10) || '- regionCount: ' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) || '## d' || CAST(display_id AS VARCHAR) || chr(10) || chr(10) || string_agg(md, chr(10) ORDER BY region_no) AS markdown
FROM parts GROUP BY doc_id, display_id"""),
    "structured_markdown": (structured_markdown, f"""WITH {CLASSIFIED}, parts AS (
  SELECT doc_id, display_id, block_no, '[d' || CAST(display_id AS VARCHAR) || '.b' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS VARCHAR) || ' role=' || role || ' confidence=' || printf('%.2f', confidence) || ' bounds=['
    || printf('%.3f', x / 1913.0::DOUBLE) || ',' || printf('%.3f', y / 10007.0::DOUBLE) || ',' || printf('%.3f', w / 1913.0::DOUBLE) || ',' || printf('%.3f', h / 10007.0::DOUBLE) || ']]' || chr(10) || text || chr(10) AS md FROM classified
)
SELECT doc_id, '# Screen Text Structure' || chr(10) || chr(10) || '- blockCount: ' || CAST(count(*) AS VARCHAR) || chr(10) || '- classifier: {C.CLASSIFIER}' || chr(10) || '- structureNote: Roles are deterministic layout hints derived from OCR text and geometry.' || chr(10) || chr(10)
  || '## d' || CAST(display_id AS VARCHAR) || chr(10) || chr(10) || string_agg(md, chr(10) ORDER BY block_no) AS markdown FROM parts GROUP BY doc_id, display_id"""),
    "pixel_hashes": (pixel_hashes, "SELECT doc_id, sha256(CAST(length(text) AS VARCHAR) || 'x1|32|' || CAST(length(text) * 4 AS VARCHAR) || '|1' || text) AS frame_hash FROM documents"),
    "recognised_boxes": (recognised_boxes, f"WITH {OBS} SELECT doc_id, obs_idx, {TRIM.format('text')} AS text, 125.0::DOUBLE * (obs_idx % 8) AS x, (1 - ((obs_idx % 4) / 4.0::DOUBLE + 0.125::DOUBLE)) * 500 AS y, 125.0::DOUBLE AS w, 62.5::DOUBLE AS h FROM obs"),
    "joined_observations": (joined_observations, f"WITH {OBS}, j AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY obs_idx) AS text FROM obs GROUP BY doc_id) SELECT doc_id, {TRIM.format('text')} AS text FROM j"),
    "plain_export": (plain_export, f"WITH {CLASSIFIED} SELECT doc_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY block_no) AS export FROM classified GROUP BY doc_id"),
    "document_build": (document_build, f"""WITH {REGIONS}{_DIGEST.removeprefix(OBS)}, n AS (SELECT doc_id, count(*) AS n_lines FROM obs GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n_blocks FROM blocks GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n_regions FROM regions GROUP BY doc_id)
SELECT d.doc_id, n_lines, n_blocks, n_regions, text_hash, layout_hash FROM digests d JOIN n ON n.doc_id = d.doc_id JOIN b ON b.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id"""),
    "compact_json": (compact_json, """SELECT event_id, '{"event_type":"' || event_type || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","user_id":' || CAST(user_id AS VARCHAR) || '}' AS json FROM events"""),
    "recognized_text": (recognized_text, f"""WITH {BLOCKS}, t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY doc_id)
SELECT doc_id // 2 AS sample_id, coalesce(string_agg('Display ' || CAST(doc_id % 2 + 1 AS VARCHAR) || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE {norm('text')} <> ''), '') AS text FROM t GROUP BY doc_id // 2"""),
    "page_blocks": (page_blocks, f"""WITH s AS (
  SELECT page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda v: {TRIM.format('v')}), lambda v: v <> '') AS l FROM pages
), b AS (SELECT page_id, unnest(l) AS text, unnest(range(len(l))) AS block_no FROM s), f AS (SELECT *, {COUNT.format('text')} AS n, length(text) AS c, first_value(text) OVER (PARTITION BY page_id ORDER BY block_no) AS first_t FROM b)
SELECT {_PAGE_ROLE} AS role, count(*) AS blocks, count(DISTINCT page_id) AS pages FROM f GROUP BY 1"""),
}

QUERIES["prepared_documents"] = (
    prepared_documents,
    f"""SELECT m.doc_id, sha256(m.markdown) AS markdown_sha256, sha256(s.markdown) AS structured_sha256, c.chunks, c.chunks_sha256 FROM ({QUERIES["anchored_markdown"][1]}) m JOIN ({QUERIES["structured_markdown"][1]}) s ON s.doc_id = m.doc_id
JOIN (SELECT doc_id, CAST(count(*) AS INTEGER) AS chunks, sha256(string_agg(text, chr(10) ORDER BY CAST(substr(alias, 2) AS INTEGER))) AS chunks_sha256 FROM ({QUERIES["chunk_pack"][1]}) GROUP BY doc_id) c ON c.doc_id = m.doc_id""",
)
