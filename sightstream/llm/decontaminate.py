"""Operator 7: passages of a benchmark in documents, by a positional inverted index that is distributed by document.

The index is a table: documents are cut into segments of about SEGMENT bytes, and a row for each segment and term holds the
term's posting list, its positions in the segment as differences; a row without a term holds the segment's documents and
how many words each has. Texts are read once, to build it; searches read the index alone.

A search takes the rows of the benchmark's terms and brings those of a segment together. Summed lengths of the lists tell
each window of an item its rarest term. Of that list alone each posting is moved by the term's offset to the place where
the window would start, and the places are intersected with the lists of the other terms, moved likewise, from the next
rarest on. What is left are exact phrase matches. For matches in proximity, the same postings are intersected with
stretches of the other lists: every term of the window has to be within SLOP words of the rarest one, in any order.

To every task goes a slice of the benchmark: its terms, its words as 4-byte numbers and, for each window, 23 bytes. SLICE
bounds what is sent; a larger benchmark goes slice by slice over one index. Windows of the same words are one window with
a list of its items, however many items are one common word, and a task pairs at most PAIRS postings and windows at once.

Nulls and ties: a null text has no words, an item without words matches nothing, a null item_id covers words but is not
named. Items with one id count once. Of equally rare terms the first of the window counts as rarest. Rows with one doc_id
are judged each by its own text. Other columns are ignored. An empty benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import Words, byte_set, lower_ascii, stored, text_slices, trim, tune, words_of

WINDOW = 10

#: How far the words of a window may be from its rarest one for a match in proximity.
SLOP = 10

#: Bytes that a task is sent of a benchmark at once, as one 6 bytes of text are taken to be a word.
SLICE = 32 << 20
SENT_PER_BYTE = 4

#: Bytes of text that a segment of the index has at most, unless it is one longer document.
SEGMENT = 4 << 20

#: Pairs of a posting and a window that are looked at together.
PAIRS = 1 << 20

_WORD = byte_set(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def index_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return words_of(lower_ascii(data), offsets, _WORD)


INDEX = "segment long, term long, postings array<int>, docs array<struct<doc_id: long, row_key: long, n: int>>"


def index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """docs: doc_id, text, row_key -> INDEX, in the shared folder. Positions count a segment's words; the first of a list is one
    itself, the others are differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        hashes, counts, rows, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            h, n = np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(h, kind="stable")
            h = h[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            gaps = np.diff(order, prepend=0)
            gaps[starts] = order[starts]
            t = len(starts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(h)], [len(h)]]).astype(np.int32)), pa.array(gaps.astype(np.int32)))
            held = pa.Table.from_batches(rows)
            kind = pa.struct([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int32())])
            docs = pa.StructArray.from_arrays([held["doc_id"].combine_chunks(), held["row_key"].combine_chunks(), pa.array(n.astype(np.int32))], fields=list(kind))
            docs = pa.ListArray.from_arrays(pa.array([*[None] * t, 0, len(n)], pa.int32()), docs) if not t else pa.concat_arrays([pa.nulls(t, pa.list_(kind)), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), docs)])
            terms = pa.array(np.concatenate([h[starts].view(np.int64), [0]]), mask=np.arange(t + 1) == t)
            return pa.RecordBatch.from_arrays([pa.array(np.full(t + 1, number)), terms, lists, docs], ["segment", "term", "postings", "docs"])

        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(1), segment):
                if rows and size + len(data) > segment:
                    yield out()
                    hashes, counts, rows, size, number = [], [], [], 0, number + 1
                words = index_words(data, offsets)
                hashes.append(words.hash)
                counts.append(np.diff(words.first))
                rows.append(pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)], ["doc_id", "row_key"]))
                size += len(data)
        if rows:
            yield out()
        trim()

    return stored(tune(docs).select("doc_id", "text", "row_key").mapInArrow(run, INDEX), "postings")


class Probes(NamedTuple):
    """Distinct windows of a slice of items, ready for search."""

    terms: np.ndarray  # hashes of all terms, ascending, as signed integers
    words: np.ndarray  # uint32: the terms of the items' words, one item after another
    start: np.ndarray  # uint32: where each window begins in words
    item: np.ndarray  # uint32: items of the windows, one window after another
    item_cut: np.ndarray  # those of window w are item[item_cut[w]:item_cut[w + 1]]
    size: np.ndarray  # uint8: words of each window
    order: np.ndarray  # uint8, windows x WINDOW: offsets, rarest term first
    by_anchor: np.ndarray  # windows in the order of their rarest terms
    cut: np.ndarray  # windows whose rarest term is t are by_anchor[cut[t]:cut[t + 1]]
    ids: list[str | None]


def item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all items' words, number of words before each item and in all)."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        w = index_words(data, offsets)
        hashes.append(w.hash)
        counts.append(np.diff(w.first))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)


def probes(ids: list[str | None], hashes: np.ndarray, first: np.ndarray, terms: np.ndarray, count: np.ndarray, n: int) -> Probes:
    words = np.searchsorted(terms, hashes.view(np.int64)).astype(np.uint32)
    length = np.diff(first)
    k = np.minimum(n, length)
    many = np.where(k > 0, length - k + 1, 0)
    item = np.repeat(np.arange(len(length)), many)
    start = np.repeat(first[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    size = k[item]
    there = np.arange(n) < size[:, None]
    at = np.minimum(start[:, None] + np.arange(n), max(len(words) - 1, 0))
    if len(start):
        # windows of the same words become one
        same = np.ascontiguousarray(np.where(there, words[at], np.uint32(0xFFFFFFFF)))
        _, one, of = np.unique(same.view(f"V{4 * n}").reshape(-1), return_index=True, return_inverse=True)
        pairs = np.unique(of.astype(np.int64) << 32 | item)
        item, item_cut = pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(len(one) + 1))
        start, size, there, at = start[one], size[one], there[one], at[one]
    else:
        item_cut = np.zeros(1, np.int64)
    freq = np.where(there, count[words[at]], np.iinfo(np.int64).max) if len(start) else np.zeros((0, n), np.int64)
    order = np.argsort(freq, axis=1, kind="stable").astype(np.uint8)
    anchor = words[start + order[:, 0]] if len(start) else np.zeros(0, np.int64)
    cut = np.concatenate([[0], np.cumsum(np.bincount(anchor, minlength=len(terms)))])
    return Probes(terms, words, start.astype(np.uint32), item.astype(np.uint32), item_cut, size.astype(np.uint8), order, np.argsort(anchor, kind="stable").astype(np.uint32), cut, ids)


def found_in(posting: np.ndarray, first: np.ndarray, p: Probes, slop: int | None) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """posting: ascending term << 32 | position. first: words before each document and in all. -> (first word, window) of each
    exact match and (place of the rarest term, window) of each match in proximity, PAIRS pairs looked at by PAIRS."""
    if not len(posting) or not len(p.start):
        return
    many = (p.cut[1:] - p.cut[:-1])[posting >> 32]
    ends = np.cumsum(many)
    lo = 0
    while lo < len(posting):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        if ends[hi - 1] > before:
            yield _found(posting[lo:hi], many[lo:hi], posting, first, p, slop)
        lo = hi


def _found(own: np.ndarray, many: np.ndarray, posting: np.ndarray, first: np.ndarray, p: Probes, slop: int | None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """found_in for some of the postings, `own`; many: windows whose rarest term is that of each."""
    none = np.zeros(0, np.int64)
    term, pos = own >> 32, own & 0xFFFFFFFF
    pos, w = np.repeat(pos, many), p.by_anchor[np.repeat(p.cut[term], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    doc = np.searchsorted(first, pos, "right") - 1
    lowest, highest = first[doc], first[doc + 1]

    def holds(w: np.ndarray, r: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of the windows' r-th rarest term has a place from low to high."""
        wanted = p.words[p.start[w].astype(np.int64) + p.order[w, r]].astype(np.int64) << 32
        i = np.searchsorted(posting, wanted | low)
        return (i < len(posting)) & (posting[np.minimum(i, len(posting) - 1)] <= (wanted | high))

    start = pos - p.order[w, 0]
    fits = (start >= lowest) & (start + p.size[w] <= highest)
    exact, ew = start[fits], w[fits]
    for r in range(1, p.order.shape[1]):
        more = np.flatnonzero(r < p.size[ew])
        if not len(more):
            break
        place = exact[more] + p.order[ew[more], r]
        keep = np.ones(len(ew), bool)
        keep[more] = holds(ew[more], r, place, place)
        exact, ew = exact[keep], ew[keep]
    if slop is None:
        return (exact, ew), (none, none)
    low, high = np.maximum(pos - slop, lowest), np.minimum(pos + slop, highest - 1)
    for r in range(1, p.order.shape[1]):
        more = np.flatnonzero(r < p.size[w])
        if not len(more):
            break
        keep = np.ones(len(w), bool)
        keep[more] = holds(w[more], r, low[more], high[more])
        pos, w, low, high = pos[keep], w[keep], low[keep], high[keep]
    return (exact, ew), (pos, w)


HITS = "doc_id long, row_key long, n_words long, spans array<array<long>>, items array<string>, near_items array<string>"


def _search(postings: DataFrame, items: list, n: int, slop: int | None) -> DataFrame:
    spark = postings.sparkSession
    ids = [None if r.item_id is None else str(r.item_id) for r in items]
    hashes, first = item_words([r.text for r in items])
    terms = np.unique(hashes.view(np.int64))
    # a row for each term of the slice, which SLICE bounds: the index's other rows stay where they are
    wanted = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(terms, pa.int64())}).to_pandas(), "term long"))
    rows = postings.where("term is not null").join(wanted, "term", "left_semi").select("segment", "term", "postings", F.lit(None).cast("array<struct<doc_id: long, row_key: long, n: int>>").alias("docs"))
    count = np.zeros(len(terms), np.int64)
    for r in rows.groupBy("term").agg(F.sum(F.size("postings")).alias("n")).toLocalIterator():
        count[np.searchsorted(terms, r.term)] = r.n
    held = spark.sparkContext.broadcast(probes(ids, hashes, first, terms, count, n))

    def run(t: pa.Table) -> pa.Table:
        p = held.value
        facts = t.filter(pa.compute.is_null(t["term"]))["docs"].combine_chunks().flatten()
        lists = t.filter(pa.compute.is_valid(t["term"]))
        term = np.searchsorted(p.terms, lists["term"].to_numpy())
        by_term = np.argsort(term, kind="stable")
        lists, term = lists.take(pa.array(by_term)), term[by_term]
        found = lists["postings"].combine_chunks()
        many, gaps = found.value_lengths().to_numpy(), found.flatten().to_numpy().astype(np.int64)
        pos = np.cumsum(gaps)
        before = np.cumsum(many) - many
        pos -= np.repeat(np.concatenate([[0], pos])[before], many) if len(pos) else 0
        first = np.concatenate([[0], np.cumsum(facts.field(2).to_numpy())]).astype(np.int64)
        cover = np.zeros(int(first[-1]) + 1, np.int64)
        pairs: tuple[list, list] = ([], [])  # documents << 32 | windows, exact and in proximity
        for (start, w), (near, v) in found_in(np.repeat(term.astype(np.int64) << 32, many) | pos, first, p, slop):
            cover += np.bincount(start, minlength=len(cover)) - np.bincount(start + p.size[w], minlength=len(cover))
            for seen, at, x in zip(pairs, (start, near), (w, v), strict=True):
                seen.append(np.unique((np.searchsorted(first, at, "right") - 1) << 32 | x))
        covered = np.cumsum(cover[:-1]) > 0
        spans, named, close = ([[] for _ in range(len(facts))], *([set() for _ in range(len(facts))] for _ in "ab"))
        for d in np.unique(np.searchsorted(first, np.flatnonzero(cover[:-1] > 0), "right") - 1):
            c = covered[first[d] : first[d + 1]]
            spans[d] = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
        for out, seen in zip((named, close), pairs, strict=True):
            both = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]))
            for d, x in zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist(), strict=True):
                out[d].update(i for i in map(p.ids.__getitem__, p.item[p.item_cut[x] : p.item_cut[x + 1]]) if i is not None)
        kind = pa.list_(pa.string())
        return pa.table(
            [facts.field(0), facts.field(1), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in named], kind), pa.array([sorted(x) for x in close], kind)],
            ["doc_id", "row_key", "n_words", "spans", "items", "near_items"],
        )

    return rows.union(postings.where("term is null").select("segment", "term", "postings", "docs")).groupBy("segment").applyInArrow(run, HITS)


def _merged(spans):  # noqa: ANN001, ANN202
    """Overlapping and touching spans become one."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<array<bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= s[0]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.get(F.get(acc, F.size(acc) - 1), F.lit(0)), F.greatest(F.get(F.get(acc, F.size(acc) - 1), F.lit(1)), s[1]))))
        ).otherwise(F.concat(acc, F.array(s))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int | None = SLOP, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, row_key (hash of the text), n_words, spans (words inside exact matches: first, after the last), items (ids, sorted as strings), and
    near_items (items of which a window is matched in proximity; none if slop is None)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("row_key"))
    return search(index(docs), benchmark, n, slop, slice_bytes)


def search(postings: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int | None = SLOP, slice_bytes: int = SLICE) -> DataFrame:
    """postings: what index() gave. -> the columns of contamination."""
    items = benchmark.select("item_id", F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-max(total * SENT_PER_BYTE, 1) // slice_bytes)
    of = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(slices))
    out = None
    for k in range(slices):
        found = _search(postings, items.where(of == k).collect(), n, slop)
        if out is None:
            out = found
            continue
        more = found.where("size(spans) > 0 or size(near_items) > 0").dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", *(F.col(c).alias(f"more_{c}") for c in ("spans", "items", "near_items")))
        empty = {c: F.coalesce(f"more_{c}", F.array().cast(kind)) for c, kind in (("spans", "array<array<bigint>>"), ("items", "array<string>"), ("near_items", "array<string>"))}
        out = out.join(more, out.doc_id.eqNullSafe(more.doc_id) & out.row_key.eqNullSafe(more.row_key), "left").select(
            out.doc_id, out.row_key, "n_words", _merged(F.concat("spans", empty["spans"])).alias("spans"), *(F.array_sort(F.array_union(c, empty[c])).alias(c) for c in ("items", "near_items"))
        )
    return out


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, and near_items long, near_sha256 for matches in proximity."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    named = lambda c: F.sha2(F.array_join(c, ","), 256)
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), named("items").alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("near_items"), named("near_items").alias("near_sha256")
    )
