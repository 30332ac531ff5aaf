"""Operator 2: removal of word sequences that an earlier document holds, over a compacted de Bruijn graph.

Every run of K words is an edge of a de Bruijn graph. Edges are too many to shuffle one by one, so each document's
edges are first compacted into paths: the run of K-word windows whose smallest M-word sequence (by hash), the anchor, is
the same occurrence. Equal windows always have an equal anchor, so all occurrences of an edge meet under one.

1. Anchors, each once a document, are counted: those of one document only are done with. The others are joined back to
   their documents.
2. There their paths are read again with where they stand: (anchor, digest of the words, document, first word, windows).
   An anchor under which all digests are one does not branch: the path repeats as a whole, and its source is the place in
   the smallest doc_id. This settles copies and shared passages without a row for each edge.
3. Anchors that branch (the ends of repeated passages, common short sequences) are joined with their documents and
   taken apart into edges, which meet by the digest of their words; the source of an edge is its smallest doc_id's place.
4. Each document gets what repeats of it, with its place and that of the source, by a join. A place is removed only if the
   words that stand there have the digest of the source's words (128 bits of BLAKE2b, so that equal digests mean equal
   words; 64-bit hashes only bring candidates together). So are other places of the same words in the document. Pieces
   that follow each other here and in their source are one copy.

Counts by anchor, digest and edge are aggregates that combine before the shuffle, joined back by the same key, so that
Spark can split one that a third of all documents share. Text that repeats itself within a document gives no more rows than
text that doesn't.

Nulls and ties: a null text has no words. A null doc_id neither loses words nor makes others lose them. Rows with one
doc_id count as one document, each judged by its own text. Fewer than K words have no window. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import SPACES, Words, bounded, byte_set, grams, mix, signed, stored, text_slices, tune, words_of

K = 13
M = 5

_WORD = byte_set(SPACES)


def path_hash(windows: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of n <= k windows from start: the first and the last window together hold all words of the path."""
    return mix(windows[start] * np.uint64(0x9E3779B97F4A7C15) + windows[start + n - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64))


def paths_of(words: Words, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window in the document, windows, path hash) for each path."""
    w, doc = grams(words.hash, k), words.doc
    if not len(w):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    valid = doc[: len(w)] == doc[k - 1 :]
    g = grams(words.hash, m)
    n = len(w)
    least, where = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, k - m + 1):
        other = g[j : j + n]
        less = other < least
        np.copyto(least, other, where=less)
        where[less] = j
    where = where + np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:n] != doc[: n - 1])
    start = np.flatnonzero(new & valid)
    # windows of a document are consecutive, so a path ends at the next start or at the document's last window
    end = np.minimum(np.append(start[1:], n), words.first[1:][doc[start]] - k + 1)
    return doc[start], least[start], start - words.first[doc[start]], end - start, path_hash(w, start, end - start)


def of_document(doc: np.ndarray, path: np.ndarray) -> np.ndarray:
    return mix(path + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def once_a_document(doc: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Indices of the first place of each path of each document."""
    return np.unique(of_document(doc, path), return_index=True)[1]


def single(windows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Path hashes of one window each."""
    return path_hash(windows, at, np.ones(len(at), np.int64)) if len(at) else np.zeros(0, np.uint64)


def digests(words: Words, first: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Of n_words words from each first word of the slice, joined by a space: two 64-bit integers."""
    raw = words.data.tobytes()
    starts, ends = words.start[first].tolist(), words.end[first + n_words - 1].tolist() if len(first) else []
    found = b"".join(blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(starts, ends, strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def anchors(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """anchor, doc_id: a row for each anchor of a document, however often it is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, data, offsets in text_slices(b.column(1)):
                doc, anchor, _, _, _ = paths_of(words_of(data, offsets, _WORD), k, m)
                one = once_a_document(doc, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[one])), pa.array(ids[lo + doc[one]])], ["anchor", "doc_id"])

    return docs.where("text is not null").mapInArrow(run, "anchor long, doc_id long")


PLACE = "anchor long, p long, q long, doc_id long, start long, n long"


def places(marked: DataFrame, k: int = K, m: int = M, edges: bool = False) -> DataFrame:
    """marked: doc_id, text, marks (anchors, or null). -> PLACE: the paths of the marked anchors, or each of their windows, by the
    digest (p, q) of their words; each once a document, where it stands first. start counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            b = b.filter(b.column(2).is_valid())
            if not b.num_rows:
                continue
            ids, marks = b.column(0).to_numpy(), b.column(2)
            flat, cut = marks.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(marks.value_lengths().to_numpy())])
            for lo, hi, data, offsets in text_slices(b.column(1)):
                words = words_of(data, offsets, _WORD)
                doc, anchor, start, n, path = paths_of(words, k, m)
                own = of_document(np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1])), flat[cut[lo] : cut[hi]])
                hit = np.isin(of_document(doc, anchor), own)
                doc, anchor, start, n, path = doc[hit], anchor[hit], start[hit], n[hit], path[hit]
                if edges:
                    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    doc, anchor, start = np.repeat(doc, n), np.repeat(anchor, n), np.repeat(start, n) + inside
                    n = np.ones(len(doc), np.int64)
                    path = single(grams(words.hash, k), words.first[doc] + start)
                one = np.sort(once_a_document(doc, path))
                doc, anchor, start, n = doc[one], anchor[one], start[one], n[one]
                pq = digests(words, words.first[doc] + start, n + k - 1)
                columns = [signed(anchor), pq[:, 0].copy(), pq[:, 1].copy(), ids[lo + doc], start.astype(np.int64), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "p", "q", "doc_id", "start", "n"])

    return marked.mapInArrow(run, PLACE)


SOURCE = "struct(doc_id, start)"
FOUND = ["doc_id", "start", "n", "p", "source_id", "source_start"]


def repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """docs: doc_id, text -> FOUND: places of a document whose words an earlier one holds, and where.

    Each step is a table in the shared folder, so that what was shuffled for it goes before the next."""
    every = anchors(docs, k, m)
    shared = stored(every.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor"), "shared")
    marks = lambda rows, name: stored(rows.groupBy("doc_id").agg(F.collect_list("anchor").alias("marks")), name)
    marked = lambda marks: docs.join(marks, "doc_id").select("doc_id", "text", "marks")
    paths = stored(places(marked(marks(every.join(shared, "anchor"), "marks")), k, m), "paths")
    least = lambda c: F.min(c).alias(f"low_{c}")
    most = lambda c: F.max(c).alias(f"high_{c}")
    facts = stored(paths.groupBy("anchor").agg(least("p"), most("p"), least("q"), most("q"), F.min(F.expr(SOURCE)).alias("source")), "anchors")
    judged = paths.join(facts.select("anchor", F.expr("low_p = high_p and low_q = high_q").alias("whole"), "source"), "anchor")
    found = lambda rows: rows.where("doc_id > source.doc_id").select("doc_id", "start", "n", "p", F.col("source.doc_id").alias("source_id"), F.col("source.start").alias("source_start"))
    whole = stored(found(judged.where("whole")), "whole")
    edges = stored(places(marked(marks(judged.where("not whole").select("anchor", "doc_id").distinct(), "branches")), k, m, edges=True), "edges")
    sources = stored(edges.groupBy("p").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("p"), "edge-keys")
    again = stored(edges.join(sources, "p"), "edges-again")
    source = stored(again.groupBy("p", "q").agg(F.min(F.expr(SOURCE)).alias("source")), "edge-sources")
    return whole.union(found(again.join(source, ["p", "q"])))


def removed(words: Words, doc: np.ndarray, start: np.ndarray, n: np.ndarray, p: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray]:
    """Places found (document, first word in it, windows, digest) -> (which words of the slice go, which places are right). A
    place is right if its words have the digest p. Its words go, and so do other paths and windows of that document with
    the same words."""
    gone = np.zeros(len(words.hash) + 1, np.int64)
    w = grams(words.hash, k)
    at = words.first[doc] + start
    ours = at + n + k - 1 <= words.first[doc + 1]
    some = np.flatnonzero(ours)
    ours[some] = digests(words, at[some], n[some] + k - 1)[:, 0] == p[some]
    doc, at, n, p = doc[ours], at[ours], n[ours], p[ours]
    if not len(at):
        return np.zeros(len(words.hash), bool), ours
    key, first = np.unique(of_document(doc, path_hash(w, at, n)), return_index=True)
    p = p[first]
    of = words.doc
    path_doc, _, path_start, many, path = paths_of(words, k, m)
    valid = np.flatnonzero(of[: len(w)] == of[k - 1 :])
    place = np.concatenate([words.first[path_doc] + path_start, valid])
    length = np.concatenate([many, np.ones(len(valid), np.int64)])
    own = np.concatenate([of_document(path_doc, path), of_document(of[valid], single(w, valid))])
    i = np.minimum(np.searchsorted(key, own), len(key) - 1)
    hit = np.flatnonzero((key[i] == own) & ~np.isin(place << 8 | length, at << 8 | n))
    hit = hit[digests(words, place[hit], length[hit] + k - 1)[:, 0] == p[i[hit]]]
    for a, many in ((at, n), (place[hit], length[hit])):
        np.add.at(gone, a, 1)
        np.add.at(gone, a + many + k - 1, -1)
    return np.cumsum(gone[:-1]) > 0, ours


def copies_of(start: np.ndarray, n: np.ndarray, source: np.ndarray, source_start: np.ndarray, k: int) -> list[list[int]]:
    """[first word, word after the last, source's doc_id, its first word]: pieces that go on from one another, here and in the
    source, are one."""
    out: list[list[int]] = []
    for a, m, s, b in sorted(zip(start.tolist(), n.tolist(), source.tolist(), source_start.tolist(), strict=True)):
        end = a + m + k - 1
        if out and out[-1][2] == s and a <= out[-1][1] - k + 1 and b - a == out[-1][3] - out[-1][0]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end, s, b])
    return out


def remove_repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, spans (removed words: first, after the last), copies (where repeated words have their source, see
    copies_of), kept (the other words, joined by one space)."""
    if not m <= k <= 128:
        raise ValueError("m <= k <= 128 is needed")
    docs = tune(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = docs.where("doc_id is not null")
    by_doc = stored(repeats(known, k, m).groupBy("doc_id").agg(F.collect_list(F.struct(*FOUND[1:])).alias("found")), "repeats")
    joined = known.join(by_doc, "doc_id", "left").select("doc_id", "text", "found")
    joined = joined.union(docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(joined.schema["found"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            n_words, spans, copies, kept = [], [], [], []
            found = b.column(2)
            columns = [c.to_numpy() for c in found.flatten().flatten()]
            cut = np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())])
            for lo, hi, data, offsets in text_slices(b.column(1)):
                words = words_of(data, offsets, _WORD)
                start, n, p, source, source_start = (c[cut[lo] : cut[hi]] for c in columns)
                doc = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                gone, ours = removed(words, doc, start, n, p, k, m)
                lost = np.concatenate([[0], np.cumsum(gone)])[words.first]
                raw = data.tobytes()
                for i in range(hi - lo):
                    own = raw[offsets[i] : offsets[i + 1]].split()
                    n_words.append(len(own))
                    spans.append([])
                    copies.append([])
                    if lost[i + 1] > lost[i]:
                        away = gone[words.first[i] : words.first[i + 1]]
                        spans[-1] = np.flatnonzero(np.diff(np.concatenate([[0], away.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                        mine = slice(cut[lo + i] - cut[lo], cut[lo + i + 1] - cut[lo])
                        right = np.flatnonzero(ours[mine]) + mine.start
                        copies[-1] = copies_of(start[right], n[right], source[right], source_start[right], k)
                        own = [own[j] for j in np.flatnonzero(~away).tolist()]
                    kept.append(b" ".join(own).decode())
            pairs = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pairs), pa.array(copies, pairs), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "copies", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, spans array<array<long>>, copies array<array<long>>, kept string")


def op2(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
