"""Windows that the data drives, encounters with a time to live, and the segments they are reduced to.

A window is sealed by the first sample that is at least `length` after its anchor; that sample belongs to it and its time
is the next anchor. An encounter is a text on a display; it is forgotten once it was not seen for longer than `ttl`."""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.functions.text import normalize, text_hash, trimmed

WINDOW_SECONDS = 60
TTL_SECONDS = 60
MAX_SIGHTINGS = 60

#: Windows that a block of a session's time is as long as.
BLOCKS = 64

MAX_ENCOUNTERS = 1500

#: Times to live that memory is read in at once, after one that only tells what it holds.
LIVES = 16

REPEATED = 0.5

#: Roles that chrome of a user interface can have.
CHROME_ROLES = ["navigation", "buttonLike", "linkLike", "formLabel", "tableHeader", "chrome"]
ANALYZER = "stub-summary-1"


def text_units(samples: DataFrame) -> DataFrame:
    """Trimmed texts; those of one character or none after normalisation are left out."""
    return samples.withColumn("text", trimmed("text")).where(F.length(normalize("text")) > 1)


def windows(samples: DataFrame, length: int = WINDOW_SECONDS, start: Column | None = None, block: int | None = None) -> DataFrame:
    """session_id, window_no (from 1), started_at, ended_at, seal_seq, and from_t, from_seq: where the window's samples
    begin (null: with the session). The last, open window is never given out. start: when the session began; None: at its
    first sample. block: seconds of a session that are read together; None: BLOCKS windows.

    Each seal depends on the one before, yet a session is as many tasks as it has blocks of time. Whatever came before a block,
    the first seal in it is the first of its ticks at or after some time within `length` of its beginning: of those ticks a
    table tells, by pointer jumping, which seal is the block's last and how many there are. These tables, a fraction of
    the ticks, are composed in order of time, and with what each block begins with all blocks find their seals. Of samples at
    one time only the first can seal, so that ticks are aggregated before the shuffle."""
    length = max(1, length)
    block = max(length, block or BLOCKS * length)
    begin = F.lit(None).cast("long") if start is None else start.cast("long")
    ticks = samples.where("session_id is not null and t is not null").groupBy("session_id", F.col("t").cast("long").alias("t")).agg(F.min(F.col("seq").cast("long")).alias("seq"), F.min(begin).alias("start"))
    ticks = ticks.withColumn("block", F.floor(F.col("t") / block).cast("long")).repartition("session_id", "block").sortWithinPartitions("session_id", "block", "t")
    kind = samples.select("session_id").schema[0].dataType.simpleString()
    tables = ticks.mapInArrow(_tables(length, block), f"session_id {kind}, block long, first_t long, start long, last_t long, entries array<struct<t: long, last: long, last_seq: long, n: int>>")
    begun = tables.repartition("session_id").sortWithinPartitions("session_id", "block").mapInArrow(_begun(length), f"session_id {kind}, block long, anchor long, number long, from_t long, from_seq long")
    rows = ticks.select("session_id", "block", "t", "seq").join(begun.hint("merge"), ["session_id", "block"]).sortWithinPartitions("session_id", "block", "t")
    return rows.select("session_id", "block", "t", "seq", "anchor", "number", "from_t", "from_seq").mapInArrow(_seals(length), f"session_id {kind}, window_no int, started_at long, ended_at long, seal_seq long, from_t long, from_seq long")


class _Groups:
    """Rows of whole groups in order of time, as arrays, so that all groups of a batch are searched at once."""

    def __init__(self, table: pa.Table, keys: list[str]) -> None:
        self.table, self.t = table, table["t"].to_numpy()
        self.starts = np.append(0, _changes(table, keys))
        self.ends = np.append(self.starts[1:], table.num_rows)
        self.first, span = self.t[self.starts], self.t[self.ends - 1] - self.t[self.starts]
        # one axis for all groups: after each is a place that no row has
        self.after = span + 1
        self.base = np.cumsum(self.after + 1) - self.after - 1
        self.of = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        self.place = self.base[self.of] + self.t - self.first[self.of]

    def find(self, group: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of each of these groups the first row at or after t; its end if there is none."""
        return np.searchsorted(self.place, self.base[group] + np.clip(t - self.first[group], 0, self.after[group]))

    def head(self, name: str) -> pa.ChunkedArray:
        """A column of the groups' first rows."""
        return self.table[name].take(self.starts)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows whose key isn't that of the row before."""
    n = table.num_rows
    changed = np.zeros(max(0, n - 1), bool)
    for k in keys:
        changed |= pc.not_equal(table[k].slice(1), table[k].slice(0, n - 1)).to_numpy()
    return np.flatnonzero(changed) + 1


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[_Groups]:
    """All groups of one batch after another, of batches in which rows of a key lie together: the last group waits for its end."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cuts = _changes(t, keys)
        if not len(cuts) and held and not len(_changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t.slice(0, 1)]), keys)):
            held.append(t)
            continue
        cut = int(cuts[-1]) if len(cuts) else 0
        if held or cut:
            yield _Groups(pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks(), keys)
        held = [t.slice(cut)]
    if held:
        yield _Groups(pa.concat_tables(held).combine_chunks(), keys)


def _tables(length: int, block: int):  # noqa: ANN202
    """Of each block: for the ticks that can be its first seal, the last seal that follows from it and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole(batches, ["session_id", "block"]):
            t, seq, n = g.t, g.table["seq"], len(g.t)
            then, end = g.find(g.of, g.t + length), g.ends[g.of]
            last, many = np.arange(n), np.ones(n, np.int32)
            while len(at := np.flatnonzero(then < end)):
                to = then[at]
                last[at], many[at], then[at] = last[to], many[at] + many[to], then[to]
            # a time to seal at is at most `length` after the block's beginning, unless the session begins in it
            begins = np.maximum(g.first, pc.coalesce(g.head("start"), pa.array(g.first)).to_numpy())
            top = g.find(np.arange(len(g.starts)), np.maximum(g.head("block").to_numpy() * block, begins) + length) + 1
            size = np.minimum(top, g.ends) - g.starts
            ends = np.cumsum(size)
            i = np.arange(ends[-1]) + np.repeat(g.starts - ends + size, size)
            entries = pa.StructArray.from_arrays([pa.array(t[i]), pa.array(t[last[i]]), seq.take(last[i]).combine_chunks(), pa.array(many[i])], ["t", "last", "last_seq", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), entries)
            yield from pa.table([g.head("session_id"), g.head("block"), pa.array(g.first), g.head("start"), pa.array(t[g.ends - 1]), lists], ["session_id", "block", "first_t", "start", "last_t", "entries"]).to_batches()

    return run


def _begun(length: int):  # noqa: ANN202
    """The blocks of a session that seal something: the anchor they begin with, how many windows were sealed, where the window began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = None
        anchor, number, since = 0, 0, (None, None)
        for b in batches:
            out: list[tuple] = []
            entries = b.column("entries")
            t, last, last_seq, n = (x.to_pylist() for x in entries.flatten().flatten())
            at = entries.offsets.to_numpy()
            ranges = zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)
            for i, (session, first_t, start, last_t, (lo, hi)) in enumerate(zip(*(b.column(c).to_pylist() for c in ("session_id", "first_t", "start", "last_t")), ranges, strict=True)):
                if current is None or session != current:
                    current, anchor, number, since = session, first_t if start is None else start, 0, (None, None)
                if last_t < anchor + length:
                    continue
                out.append((i, anchor, number, *since))
                e = bisect_left(t, anchor + length, lo, hi)
                anchor, number, since = last[e], number + n[e], (last[e], last_seq[e])
            rows, *more = zip(*out, strict=True) if out else [()] * 5
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("session_id").take(rows), b.column("block").take(rows), *(pa.array(x, pa.int64()) for x in more)], ["session_id", "block", "anchor", "number", "from_t", "from_seq"])

    return run


def _seals(length: int):  # noqa: ANN202
    """The seals of each block, from what it begins with. From one anchor the next seal is found by binary search, in all blocks
    of a batch at once."""
    names = ["session_id", "window_no", "started_at", "ended_at", "seal_seq", "from_t", "from_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole(batches, ["session_id", "block"]):
            live, found = np.arange(len(g.starts)), []
            anchor, number, since = g.head("anchor").to_numpy(), g.head("number").to_numpy(), np.full(len(live), -1)
            while True:
                at = g.find(live, anchor + length)
                on = at < g.ends[live]
                live, at, number = live[on], at[on], number[on] + 1
                if not len(live):
                    break
                found.append((live, number, anchor[on], at, since[on]))
                anchor, since = g.t[at], at
            if not found:
                continue
            live, number, anchor, at, since = (np.concatenate(x) for x in zip(*found, strict=True))
            begun, start = pa.array(since < 0), g.starts[live]
            since_row = np.maximum(since, 0)
            before = [pc.if_else(begun, g.table[f"from_{c}"].take(start), g.table[c].take(since_row)) for c in ("t", "seq")]
            yield from pa.table([g.table["session_id"].take(start), pa.array(number, pa.int32()), pa.array(anchor), pa.array(g.t[at]), g.table["seq"].take(at), *before], names).to_batches()

    return run


def assign(samples: DataFrame, length: int = WINDOW_SECONDS, start: Column | None = None) -> DataFrame:
    """samples with window_no, started_at, ended_at; those of the open window are left out.

    A window's samples are all within `length` of its anchor, but for the one that seals it. So a window goes to the three
    stretches of `length` seconds that these can be in, and a sample looks in its own: the join has a key, which parts a
    long session, and a sample meets a few windows however many the session has."""
    length = max(1, length)
    stretch = lambda t: F.floor(t / length)
    first = F.col("from_t").isNull()
    spans = windows(samples, length, start)
    # before the anchor there are samples only if the session's start was given and lies after them
    lowest = samples.groupBy("session_id").agg(F.min(F.col("t").cast("long")).alias("_lowest")) if start is not None else None
    near = F.array_distinct(F.array(stretch(F.col("started_at")), stretch(F.col("started_at")) + 1, stretch(F.col("ended_at"))))
    if lowest is not None:
        spans = spans.join(lowest, "session_id")
        near = F.when(first & (F.col("_lowest") < F.col("started_at")), F.array_union(near, F.sequence(stretch(F.col("_lowest")), stretch(F.col("started_at"))))).otherwise(near)
    spans = spans.select("session_id", "window_no", "started_at", "ended_at", "seal_seq", "from_t", "from_seq", F.explode(near).alias("_stretch"))
    at = F.struct(F.col("t").cast("long").alias("t"), F.col("seq").cast("long").alias("seq"))
    after = first | (at > F.struct(F.col("from_t").alias("t"), F.col("from_seq").alias("seq")))
    inside = after & (at <= F.struct(F.col("ended_at").alias("t"), F.col("seal_seq").alias("seq")))
    return samples.withColumn("_stretch", stretch(F.col("t").cast("long"))).join(spans, ["session_id", "_stretch"]).where(inside).select(*samples.columns, "window_no", "started_at", "ended_at")


def gap_sessions(rows: DataFrame, keys: list[str], ttl: int = TTL_SECONDS, lost: Column | None = None) -> DataFrame:
    """Rows with a number for each run of sightings of one key that are at most ttl apart. lost: whether memory had let
    the key go before a row for another reason, which begins a run too."""
    w = Window.partitionBy(*keys).orderBy("t", "seq")
    new = F.col("t") - F.lag("t").over(w) > ttl
    if lost is not None:
        new = new | (lost & (F.rank().over(w) - 1 > F.count_if(F.col("t").isNull()).over(w)))
    return rows.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("run", F.sum("_new").over(w)).drop("_new")


def evictions(rows: DataFrame, keys: list[str], limit: int, ttl: int = TTL_SECONDS, lives: int = LIVES) -> DataFrame:
    """Rows with `lost`: whether their text on their display isn't among the `limit` that memory of its keys holds when the
    row comes. Memory lets those go that were seen least recently, after every sample, which is the rows of one (t, seq). Of
    one sample's texts those go first that are last by display and hash. rows: keys, display_id, text_hash, t, seq; rows
    without a t are never held.

    What memory holds are the texts seen last, however it came to hold them. So the rows of one time to live before a stretch of
    time tell what it holds when the stretch begins, and each stretch of `lives` of them is a task's work of its own: a row goes
    to its stretch, and to the next one if it is at most ttl before it. A task reads its rows in order and holds `limit`
    texts and those of one sample. Where a stretch and what comes to it have at most `limit` rows, memory lets nothing go and none
    is `lost`: a text that it doesn't hold there is its first, or was last seen longer than ttl before."""
    t, order = F.col("t").cast("double"), ["t", "seq", F.desc("display_id"), F.desc("text_hash")]
    size = max(1, ttl) * max(1, lives)
    own = F.floor(t / size).cast("long")
    following = F.floor((t + ttl) / size).cast("long")
    dealt = rows.withColumn("_own", own).withColumn("_stretch", F.explode(F.when(following > own, F.array(own, own + 1)).otherwise(F.array(own))))
    stretch = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    full = F.count("*").over(stretch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > max(1, limit)
    dealt = dealt.withColumns({"_first": F.row_number().over(stretch) == 1, "_full": full}).sortWithinPartitions(*keys, "_stretch", *order)
    told = dealt.withColumn("_here", F.coalesce(F.col("_own") == F.col("_stretch"), F.lit(True))).drop("_own", "_stretch")
    schema = rows.withColumn("lost", F.lit(True)).schema
    return told.mapInArrow(_evicted(max(1, limit), rows.columns), schema)


def _evicted(limit: int, columns: list[str]):  # noqa: ANN202
    """The rows that are a stretch's own, with `lost`. Texts are held in the order in which they were seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple, None] = OrderedDict()
        sample = None
        for b in batches:
            lost = []
            full = b.filter(b.column("_full"))
            for first, t, seq, *text in zip(*(full.column(c).to_pylist() for c in ("_first", "t", "seq", "display_id", "text_hash")), strict=True):
                if first:
                    held.clear()
                if t is None:
                    lost.append(False)
                    continue
                if first or (t, seq) != sample:
                    sample = (t, seq)
                    while len(held) > limit:
                        held.popitem(last=False)
                k = tuple(text)
                lost.append(k not in held)
                held[k] = None
                held.move_to_end(k)
            told = np.zeros(b.num_rows, bool)
            told[b.column("_full").to_numpy(zero_copy_only=False)] = lost
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(told)], names=[*columns, "lost"])
            yield out.filter(b.column("_here"))

    return run


def encounters(samples: DataFrame, keys: list[str], ttl: int = TTL_SECONDS, limit: int | None = None) -> DataFrame:
    """For each key, display, text and run: the first text, first and last time, how often it was seen, the last
    MAX_SIGHTINGS sightings and how often it had which role. samples: keys, display_id, t, seq, text, role, x, y, w, h.
    limit: texts that memory of a key holds after each sample; one that it let go begins a new run."""
    rows = text_units(samples).withColumn("text_hash", text_hash("text"))
    by = [*keys, "display_id", "text_hash"]
    if limit is not None:
        rows = evictions(rows.select(*by, "t", "seq", "text", "role", "x", "y", "w", "h"), keys, limit, ttl)
    newest = Window.partitionBy(*by, "run").orderBy(F.desc("t"), F.desc("seq"))
    ranked = gap_sessions(rows, by, ttl, None if limit is None else F.col("lost")).withColumn("_n", F.row_number().over(newest))
    sighting = F.when(F.col("_n") <= MAX_SIGHTINGS, F.struct("t", "seq", "x", "y", "w", "h"))
    by_role = ranked.groupBy(*by, "run", "role").agg(F.min(F.struct("t", "seq", "text")).alias("first"), F.max("t").alias("last_seen"), F.count("*").alias("n"), F.collect_list(sighting).alias("s"))
    return by_role.groupBy(*by, "run").agg(
        F.min("first").text.alias("text"), F.min("first").t.alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("seen_count"),
        F.array_sort(F.flatten(F.collect_list("s"))).alias("sightings"), F.collect_list(F.struct("role", "n")).alias("roles"),
    )


def remembered(found: DataFrame, keys: list[str], now: Column, ttl: int = TTL_SECONDS, limit: int = MAX_ENCOUNTERS) -> DataFrame:
    """The encounters that memory of each key holds at the time `now`, of those that `encounters` found with this limit: the
    last run of a text, if it was seen in the ttl before, of the `limit` that were seen last."""
    seen = F.element_at("sightings", -1)
    last = found.withColumn("_last", F.max("run").over(Window.partitionBy(*keys, "display_id", "text_hash"))).where((F.col("run") == F.col("_last")) & (F.col("last_seen") >= now - ttl))
    w = Window.partitionBy(*keys).orderBy(seen.t.desc(), seen.seq.desc(), "display_id", "text_hash")
    return last.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_last", "_n")


def dominant_role(roles: Column) -> Column:
    """The most frequent role of an array of (role, n), ties to the first by name; unknown if there is none."""
    return F.coalesce(F.array_min(F.transform(roles, lambda r: F.struct((-r.n).alias("n"), r.role.alias("role")))).role, F.lit("unknown"))


def capped(found: DataFrame, keys: list[str], limit: int = MAX_ENCOUNTERS) -> DataFrame:
    """Encounters of all times, the `limit` seen last, ties to those first seen later, then by display and hash."""
    w = Window.partitionBy(*keys).orderBy(F.desc("last_seen"), F.desc("first_seen"), "display_id", "text_hash")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def sealed_encounters(samples: DataFrame, length: int = WINDOW_SECONDS, ttl: int = TTL_SECONDS, limit: int = MAX_ENCOUNTERS) -> DataFrame:
    """What memory holds when a window is sealed: of each key its last run, if it was seen in the ttl before the end.
    Memory is cleared at a seal, so that runs never cross windows."""
    keys = ["session_id", "window_no", "started_at", "ended_at"]
    found = encounters(assign(samples, length), keys, ttl, limit)
    return remembered(found, keys, F.col("ended_at"), ttl, limit).drop("run").withColumn("role", dominant_role(F.col("roles")))


def segments(found: DataFrame) -> DataFrame:
    """A window's encounters by display and role."""
    keys = ["session_id", "window_no", "started_at", "ended_at", "display_id", "role"]
    latest = F.element_at("sightings", -1)
    rows = found.withColumn("_l", latest)
    line = F.struct(F.col("_l.y").alias("y"), F.col("_l.x").alias("x"), "text_hash", "text")
    least = lambda c: F.min(f"_l.{c}")
    out = rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s.text), " ").alias("text"),
        least("x").alias("x"),
        least("y").alias("y"),
        (F.max(F.col("_l.x") + F.col("_l.w")) - least("x")).alias("w"),
        (F.max(F.col("_l.y") + F.col("_l.h")) - least("y")).alias("h"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("seen_count").alias("sightings"),
        F.count("*").alias("lines"),
    )
    seconds = F.greatest(F.col("ended_at") - F.col("started_at"), F.lit(1))
    rate = F.col("sightings") / F.col("lines") / seconds
    return out.withColumn("repeated_ui", F.col("role").isin(CHROME_ROLES) & (rate >= REPEATED))


def ingest_summary(samples: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Per session, how many sightings there were, how many were new and how many updated an encounter, and how many
    encounters were pruned and seen again."""
    rows = gap_sessions(text_units(samples).withColumn("text_hash", text_hash("text")), ["session_id", "display_id", "text_hash"], ttl)
    runs = rows.groupBy("session_id", "display_id", "text_hash", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("session_id").agg(F.sum("n").alias("total"), F.count("*").alias("new"), (F.sum("n") - F.count("*")).alias("updated"), F.count_if(F.col("run") > 0).alias("pruned"))


def analysis(found: DataFrame, top: int = 10) -> DataFrame:
    """A Markdown summary of each window's segments. payload_bytes: size of the segments as JSON."""
    keys = ["session_id", "window_no", "started_at", "ended_at"]
    seg = F.struct("display_id", "role", "first_seen", "text", "lines", "sightings", "repeated_ui")
    rows = found.groupBy(*keys).agg(F.array_sort(F.collect_list(seg)).alias("s"))
    chronological = F.slice(F.array_sort(F.transform("s", lambda s: F.struct(s.first_seen.alias("t"), s.display_id.alias("d"), s.role.alias("role"), s.text.alias("text"), s.lines.alias("lines")))), 1, top)
    num = lambda c: c.cast("string")
    listed = F.transform("s", lambda s: F.concat(F.lit("- d"), num(s.display_id), F.lit(" role="), s.role, F.lit(" lines="), num(s.lines), F.lit(" sightings="), num(s.sightings), F.lit(" repeatedUI="), num(s.repeated_ui)))
    first = F.transform(chronological, lambda s: F.concat(F.lit("- [role "), s.role, F.lit(", lines "), num(s.lines), F.lit("] "), s.text))
    size = F.octet_length(F.to_json("s"))
    some = lambda a: F.when(F.size(a) > 0, F.array_join(a, "\n")).otherwise(F.lit("_(none)_"))
    text = F.concat_ws(
        "\n", F.lit("## Stub Window Summary"), F.lit(""), F.concat(F.lit("- Sequence: "), num(F.col("window_no"))), F.concat(F.lit("- Window: "), num(F.col("started_at")), F.lit(" → "), num(F.col("ended_at"))),
        F.concat(F.lit("- Duration: "), num(F.col("ended_at") - F.col("started_at")), F.lit(" s")), F.concat(F.lit("- Unique lines: "), num(F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + s.lines))), F.concat(F.lit("- Segments: "), num(F.size("s"))),
        F.lit(""), F.lit("### Segments"), some(listed), F.lit(""), F.lit(f"### Top segment text (chronological, first {top})"), some(first), F.lit(""), F.lit("---"),
        F.concat(F.lit("LLM payload size: "), num(size), F.lit(" bytes (segment document; would be sent to a real LLM here)")),
    )
    return rows.select(*keys, F.lit(ANALYZER).alias("analyzer_id"), size.alias("payload_bytes"), text.alias("summary_markdown"))


def window_prompt(found: DataFrame) -> DataFrame:
    """A window's encounters in chronological order as Markdown."""
    keys = ["session_id", "window_no", "started_at", "ended_at"]
    rows = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_seen", "text", "last_seen", "seen_count", "display_id"))).alias("e"))
    num = lambda c: c.cast("string")
    line = F.transform("e", lambda e: F.concat(F.lit("- ["), num(e.first_seen), F.lit(" → "), num(e.last_seen), F.lit(" ×"), num(e.seen_count), F.lit(", display "), num(e.display_id), F.lit("] "), e.text))
    text = F.concat_ws(
        "\n", F.lit("# Screen Text Window"), F.lit(""), F.concat(F.lit("- sessionID: "), num(F.col("session_id"))), F.concat(F.lit("- sequence: "), num(F.col("window_no"))), F.concat(F.lit("- startedAt: "), num(F.col("started_at"))),
        F.concat(F.lit("- endedAt: "), num(F.col("ended_at"))), F.concat(F.lit("- durationSeconds: "), num(F.col("ended_at") - F.col("started_at"))), F.concat(F.lit("- encounterCount: "), num(F.size("e"))),
        F.lit(""), F.lit("## Encounters (chronological)"), F.lit(""), F.array_join(line, "\n"),
    )
    return rows.select(*keys, text.alias("prompt"))
