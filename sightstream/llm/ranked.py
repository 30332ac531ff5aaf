"""Operator 11: exact top-k ranked search over dual-sorted wavelet trees, one for each shard of documents.

A shard has the postings of about SHARD bytes of text. The lists of its terms stand one after another, each ordered by
falling impact (by document where impacts are equal), and the sequence of their documents (their ranks by doc_id in the
shard) is kept as a wavelet tree, level by level: a bit of each document's rank, from the highest on, zeros before ones
and in their order otherwise. So the tree is sorted twice. A term's range at a node holds its postings among the documents
of that node, a range of doc_ids, and still begins with the largest impact. The tree's nodes are all ranges of doc_ids, down to single
documents.

A search begins at the root with the ranges of a query's terms. A node's bound is the sum, over its terms, of the weight
times the first impact of the term's range: no document below scores more, and a single document scores just that. Nodes are
opened best bound first, BEST at a time, and split into their halves by two rank queries a term; a node goes once its
bound can't reach the query's k-th best so far, which a task carries from shard to shard. What a task finds, k rows a query
at most, meets in a ranked window. Nothing is approximate: all documents are indexed and searched.

Texts are read twice, since impacts need the number and the mean length of all documents: once to count, once to write
the index, a table with a row a shard. Searches read the index alone, first its terms to count documents for each term
of the queries, then its trees. Queries go slice by slice (SLICE bytes of their text), so that what is broadcast is bounded.

Terms are told apart by 64-bit hashes. Nulls and ties: a null text has no terms; documents without terms aren't counted. A
null doc_id counts as a document and comes last among equal scores. Rows with one doc_id are documents of their own, and so
are rows with one item_id queries of their own; an item without terms, or with a null text, gets no rows, a null item_id
stays null. Other columns are ignored. Without documents or without items there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightstream.llm.common import Words, byte_set, lower_ascii, stored, text_slices, trim, tune, words_of

K = 10

#: Bytes of text in a shard. A longer document is a shard of its own.
SHARD = 8 << 20

#: Nodes that are opened together; entries (nodes times terms) of the nodes that wait, beyond which the deepest go first.
BEST, WAITING = 48, 4 << 20

#: Bytes of the queries' text that are searched for at once.
SLICE = 4 << 20

#: A null doc_id: after all others.
LAST = np.iinfo(np.int64).max

#: Fixed values of the score: the share of the mean length that counts, in hundredths, and the weight of a document's length.
SHARE, LENGTH, UNIT = 90, 8, 1000

_TERM = byte_set(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

INDEX = "docs binary, levels int, terms binary, starts binary, impacts binary, bits binary"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return words_of(lower_ascii(data), offsets, _TERM)


# --- counts of the whole collection ---


class Collection(NamedTuple):
    docs: int  # with a term
    terms: int  # of all documents, with repeats


def collection(docs: DataFrame) -> Collection:
    """docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for _, _, data, offsets in text_slices(b.column(0)):
                inside = _TERM[data]
                starts = inside.copy()
                starts[1:] &= ~inside[:-1]
                first = offsets[:-1][offsets[:-1] < len(data)]
                starts[first] = inside[first]
                many = np.diff(np.concatenate([[0], np.cumsum(starts)])[offsets])
                n, total = n + int((many > 0).sum()), total + int(many.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})
        trim()

    r = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return Collection(r[0] or 0, r[1] or 0)


def impacts_of(tf: np.ndarray, length: np.ndarray, c: Collection) -> np.ndarray:
    """The part of a term's score that its document gives; lengths are those of the postings' documents."""
    exact = length if int(length.max(initial=0)) * c.docs < (1 << 63) // SHARE else length.astype(object)
    m = (100 - SHARE + (SHARE * exact * c.docs) // c.terms).astype(np.int64)
    return (10**9 * tf) // (UNIT * tf + LENGTH * m)


# --- the index ---


def levels_of(n: int) -> int:
    return max(n - 1, 0).bit_length()


def pack(flags: np.ndarray) -> np.ndarray:
    """Bits in 64-bit words, the first one lowest, with a word of zeros or more at the end."""
    out = np.zeros((len(flags) // 64 + 1) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def shard_row(term: np.ndarray, doc: np.ndarray, ids: np.ndarray, length: np.ndarray, c: Collection) -> pa.RecordBatch:
    """term, doc (a row of ids) of each word; ids and length of each document."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    names, term = np.unique(term, return_inverse=True)
    pair = np.sort(term.astype(np.int64) * len(ids) + rank[doc])
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    tf = np.diff(np.append(starts, len(pair)))
    pair = pair[starts]
    term, doc = pair // len(ids), pair % len(ids)
    impact = impacts_of(tf, length[order][doc], c)
    by = np.lexsort((doc, -impact, term))
    doc, impact = doc[by], impact[by]
    bits, seq, levels = [], doc, levels_of(len(ids))
    for level in range(levels):
        one = (seq >> (levels - 1 - level) & 1).astype(bool)
        bits.append(pack(one))
        seq = np.concatenate([seq[~one], seq[one]])
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
    return pa.RecordBatch.from_pydict(
        {"docs": [ids[order].astype("<i8").tobytes()], "levels": pa.array([levels], pa.int32()), "terms": [names.astype("<u8").tobytes()], "starts": [starts.astype("<u4").tobytes()], "impacts": [impact.astype("<u4").tobytes()], "bits": [b"".join(x.tobytes() for x in bits)]}
    )


def index(docs: DataFrame, c: Collection, shard: int = SHARD) -> DataFrame:
    """docs: doc_id, text, and the counts of them -> INDEX, in the shared folder."""
    docs = tune(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = many = 0

        def out() -> pa.RecordBatch:
            term, doc, ids, length = (np.concatenate(x) for x in zip(*held, strict=True))
            return shard_row(term, doc, ids, length, c)

        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(1), shard):
                w = terms_of(data, offsets)
                length = np.diff(w.first)
                some = length > 0
                if some.any():
                    ids = b.column(0).slice(lo, hi - lo).fill_null(int(LAST)).to_numpy(zero_copy_only=False)
                    held.append((w.hash, (np.cumsum(some) - 1)[w.doc] + many, ids[some], length[some]))
                    size, many = size + len(data), many + int(some.sum())
                if size >= shard:
                    yield out()
                    held, size, many = [], 0, 0
        if held:
            yield out()
        del held
        trim()

    return stored(docs.mapInArrow(run, INDEX), "ranked-index")


class Tree:
    """A shard, ready for search: counts of ones before each word of bits, and the impacts in the order of each level."""

    def __init__(self, row: dict) -> None:
        self.docs = np.frombuffer(row["docs"], "<i8")
        self.terms, self.starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.levels = row["levels"]
        impact = np.frombuffer(row["impacts"], "<u4")
        self.n, self.words = len(impact), len(impact) // 64 + 1
        self.bits = np.frombuffer(row["bits"], "<u8")
        ones = np.bitwise_count(self.bits).astype(np.int64).reshape(self.levels, self.words)
        before = np.cumsum(ones, axis=1) - ones
        self.before = before.reshape(-1)
        self.zeros = self.n - ones.sum(1)
        self.impacts = np.empty((self.levels + 1) * self.n, np.uint32)
        self.impacts[: self.n] = impact
        for level in range(self.levels):
            one = np.unpackbits(self.bits[level * self.words : (level + 1) * self.words].view(np.uint8), bitorder="little")[: self.n].astype(bool)
            here, there = (self.impacts[k * self.n : (k + 1) * self.n] for k in (level, level + 1))
            there[: self.zeros[level]], there[self.zeros[level] :] = here[~one], here[one]

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before the places `at` of a level."""
        word = (at >> 6) + level * self.words
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & below)

    def bound(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
        there = lo < hi
        first = self.impacts[np.where(there, lo + level * self.n, 0)]
        return (np.where(there, first, 0) * weight).sum(1)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Puts the shard's documents that are among the k best into best."""
        at = np.searchsorted(self.terms, terms)
        found = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weight > 0))
        if not len(found):
            return
        at, weight = at[found], weight[found]
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = self.starts[at][None, :], self.starts[at + 1][None, :]
        bound = self.bound(level[:, None], lo, hi, weight)
        while len(bound):
            leaf = level == self.levels
            if leaf.any():
                best.offer(bound[leaf], self.docs[prefix[leaf]])
            # a node that the k-th best already outdoes goes; of equal scores the smaller doc_id counts
            live = ~leaf & ((bound > best.least) | ((bound == best.least) & (self.docs[np.minimum(prefix << (self.levels - level), len(self.docs) - 1)] < best.last)))
            if not live.all():
                level, prefix, lo, hi, bound = level[live], prefix[live], lo[live], hi[live], bound[live]
            n = len(bound)
            if not n:
                return
            if n > BEST:
                order = np.lexsort((-bound, -level))[:BEST] if lo.size > WAITING else np.argpartition(-bound, BEST)[:BEST]
                rest = np.ones(n, bool)
                rest[order] = False
            else:
                order, rest = np.arange(n), np.zeros(n, bool)
            up = level[order][:, None]
            one_lo, one_hi = self.ones(up, lo[order]), self.ones(up, hi[order])
            zeros = self.zeros[up]
            new_level = np.concatenate([level[order]] * 2) + 1
            new_lo, new_hi = np.concatenate([lo[order] - one_lo, zeros + one_lo]), np.concatenate([hi[order] - one_hi, zeros + one_hi])
            new_prefix = np.concatenate([prefix[order] * 2, prefix[order] * 2 + 1])
            new_bound = self.bound(new_level[:, None], new_lo, new_hi, weight)
            some = new_bound > 0
            level, prefix = np.concatenate([level[rest], new_level[some]]), np.concatenate([prefix[rest], new_prefix[some]])
            lo, hi = np.concatenate([lo[rest], new_lo[some]]), np.concatenate([hi[rest], new_hi[some]])
            bound = np.concatenate([bound[rest], new_bound[some]])


class Best:
    """The k best documents so far: by falling score, then by doc_id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = 0, np.iinfo(np.int64).min  # of the k-th; only scores above 0 count

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.k:
            self.least, self.last = int(self.score[-1]), int(self.doc[-1])


# --- search ---

FOUND = "query long, item_id string, doc_id long, score long"


def queries_of(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct terms of each text, ascending hashes."""
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        w = terms_of(data, offsets)
        out += [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def _search(postings: DataFrame, c: Collection, items: list, first: int, k: int) -> DataFrame:
    spark = postings.sparkSession
    wanted = queries_of([r.text for r in items])
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *wanted]))
    known = spark.sparkContext.broadcast(every)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for b in batches:
            for terms, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms = np.frombuffer(terms, "<u8")
                at = np.searchsorted(terms, known.value)
                there = np.flatnonzero((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == known.value))
                total[there] += np.diff(np.frombuffer(starts, "<u4").astype(np.int64))[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    df = np.zeros(len(every), np.int64)
    if len(every):
        # a row for each term of the slice, which SLICE bounds
        for r in postings.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * c.docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    held = spark.sparkContext.broadcast([(first + i, None if r.item_id is None else str(r.item_id), t, weight[np.searchsorted(every, t)]) for i, (r, t) in enumerate(zip(items, wanted, strict=True)) if len(t)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in held.value]
        for b in batches:
            for i in range(b.num_rows):
                tree = Tree({name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)})
                for (_, _, terms, weight), top in zip(held.value, best, strict=True):
                    tree.search(terms, weight, top)
                del tree
        n = [len(x.doc) for x in best]
        doc = np.concatenate([np.zeros(0, np.int64), *(x.doc for x in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([q[0] for q in held.value], np.int64), n)), pa.array([q[1] for q, m in zip(held.value, n, strict=True) for _ in range(m)], pa.string()), pa.array(doc, mask=doc == LAST), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.score for x in best)]))],
            ["query", "item_id", "doc_id", "score"],
        )
        trim()

    return tune(postings).mapInArrow(run, FOUND)


def search(postings: DataFrame, c: Collection, items: DataFrame, k: int = K, slice_bytes: int = SLICE) -> DataFrame:
    """postings: what index() gave; c: counts of the collection; items: item_id, text -> item_id, rank (from 1), doc_id, score of
    each item's k best documents."""
    kind = items.schema["item_id"].dataType
    rows = items.select("item_id", F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    of = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(slices))
    out, first = None, 0
    for s in range(slices):
        own = rows.where(of == s).collect()
        found = _search(postings, c, own, first, k)
        out, first = found if out is None else out.union(found), first + len(own)
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD, slice_bytes: int = SLICE) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs (doc_id, text) for each item (item_id, text)."""
    c = collection(tune(docs))
    return search(index(docs, c, shard), c, items, k, slice_bytes)


def op11(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0
), p AS (
  SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term
), q AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, c.n
), s AS (
  SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + ((90 * p.n * c.n) // c.l))))) AS BIGINT) AS score
  FROM q JOIN w ON w.term = q.term JOIN p ON p.term = q.term, c GROUP BY q.item_id, p.doc_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
