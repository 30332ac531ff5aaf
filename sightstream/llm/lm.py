"""Operator 6: language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

    p(w | v) = a(b) c(v w) / c(v)  +  b(b) c(w) / N  +  c(b) / (V + 1),   b = bucket of the context's frequency c(v)

v is the word before w; the end of a document stands before its first word too. Weights are learned for each bucket by
expectation-maximisation on held-out counts: a fold of the training documents is deleted from the counts and predicted
from the rest. The counts that score are those of all training documents.

Bigrams are nearly as many as words, so no row is made for each. Documents are dealt out into chunks of about CHUNK
bytes; a chunk's distinct n-grams, as sorted 64-bit hashes with their counts, are cut by hash range into blocks, and
blocks of one range meet in one task. It adds up the counts over all chunks and answers every block with the totals in
the block's own order, so that hashes travel once and only counts travel back to be joined with the chunk's documents.
An n-gram has at most one entry in a chunk, so a frequent one is no hot key. The weights' statistics are a histogram of
fixed size over all held-out tokens.

Nulls and ties: a null text is empty (its end alone is scored); a null doc_id belongs to the training documents. Rows
with one doc_id are each counted and scored. Other columns are ignored. With no training documents every probability
is 1 (N and V are 0). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import SPACES, byte_set, lower_ascii, mix, stored, text_slices, tune, words_of

#: Bytes of text in a chunk, on average, and in each range of hashes, as many bytes' n-grams.
CHUNK = 16 << 20

#: One training document in so many is deleted to learn the weights.
FOLDS = 10

#: Buckets of a context's frequency, by powers of 2.
BUCKETS = 32

#: Cells of the held-out histogram for each estimate: half powers of 2.
CELLS = 64

EM_ROUNDS = 60

END = np.uint64(0x1F83D9ABFB41BD6B)
_WORD = byte_set(SPACES)
FOLD, MAIN, TEST = 0, 1, 2


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all documents' words and ends, number of tokens before each document and in all)."""
    out, sizes = [], []
    for _, _, data, offsets in text_slices(texts):
        w = words_of(lower_ascii(data), offsets, _WORD)
        n = np.diff(w.first) + 1
        tok = np.full(len(w.hash) + len(n), END, np.uint64)
        tok[np.arange(len(w.hash)) + w.doc] = w.hash
        out.append(tok)
        sizes.append(n)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def bigrams_of(tok: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it. A document's first token follows an end."""
    before = np.concatenate([[END], tok[:-1]]).astype(np.uint64)
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(tok))


def pack(keys: np.ndarray) -> bytes:
    """Ascending hashes as differences of 6 bytes, or of 8 where 6 don't do."""
    d = np.diff(keys, prepend=np.uint64(0))
    wide = 8 if len(d) and (d[0] >= 1 << 48 or d[1:].max(initial=0) >= 1 << 48) else 6
    return bytes([wide]) + d.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    wide = blob[0]
    d = np.zeros((len(blob) // wide, 8), np.uint8)
    d[:, :wide] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, wide)
    return np.cumsum(d.reshape(-1).view(np.uint64), dtype=np.uint64)


def chunked(docs: DataFrame, learns: Column) -> tuple[DataFrame, int]:
    """doc_id, text, kind, chunk; and the number of hash ranges, a power of 2. Rows with one doc_id, or with none, are dealt by
    their text; only rows that are equal in both stay together. The fold goes by doc_id."""
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)) == 0
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.when(~learns, TEST).when(fold, FOLD).otherwise(MAIN).alias("kind"))
    size = {r.kind: r.n or 0 for r in rows.groupBy("kind").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    chunk, base = F.lit(0), 0
    for kind in (FOLD, MAIN, TEST):
        n = -(-max(size.get(kind, 0), 1) // CHUNK)
        chunk = F.when(F.col("kind") == kind, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) + base).otherwise(chunk)
        base += n
    return rows.withColumn("chunk", chunk.cast("long")), 1 << max(0, (sum(size.values()) // CHUNK)).bit_length()


BLOCK = "chunk long, range long, kind int, words binary, word_counts binary, pairs binary, pair_counts binary"


def blocks_of(chunks: DataFrame, ranges: int) -> DataFrame:
    """For each chunk and hash range: its distinct words and bigrams with their counts in the chunk. A range that a chunk has
    nothing in gets no block, so that there are never more blocks than n-grams, however many chunks and ranges there are."""
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def run(t: pa.Table) -> pa.Table:
        tok, _ = tokens_of(t["text"].combine_chunks())
        found = []
        for h in (tok, bigrams_of(tok)):
            keys, n = np.unique(h, return_counts=True)
            found.append((keys, n.astype("<u4"), keys >> shift if ranges > 1 else np.zeros(len(keys), np.uint64)))
        there = np.union1d(found[0][2], found[1][2])
        start = there << shift if ranges > 1 else np.zeros(len(there), np.uint64)
        columns = []
        for keys, n, of in found:
            lo, hi = np.searchsorted(of, there), np.searchsorted(of, there, "right")
            columns += [[pack(keys[a:b] - s) for s, a, b in zip(start, lo, hi, strict=True)], [n[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]]
        m = len(there)
        return pa.table(
            [pa.array([t["chunk"][0].as_py()] * m, pa.int64()), pa.array(there.astype(np.int64)), pa.array([t["kind"][0].as_py()] * m, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
            ["chunk", "range", "kind", "words", "word_counts", "pairs", "pair_counts"],
        )

    return chunks.groupBy("chunk").applyInArrow(run, BLOCK)


TOTALS = "chunk long, range long, words binary, pairs binary, fold_words binary, fold_pairs binary, n long, n_fold long, v long"


def totals_of(blocks: DataFrame) -> DataFrame:
    """For each block the counts in all training chunks, and for the fold's blocks also those in the fold; a row with
    chunk -1 for each range has the range's share of N, of the fold's tokens, and of V."""

    def run(t: pa.Table) -> pa.Table:
        kind, columns, facts = t["kind"].to_numpy(), [], []
        for keys, counts in (("words", "word_counts"), ("pairs", "pair_counts")):
            own = [unpack(x) for x in t[keys].to_pylist()]
            n = np.concatenate([np.frombuffer(x, "<u4") for x in t[counts].to_pylist()])
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            uniq, where = np.unique(np.concatenate(own), return_inverse=True)
            of = np.repeat(kind, np.diff(at))
            every = np.bincount(where, np.where(of == TEST, 0, n), len(uniq)).astype("<u4")
            fold = np.bincount(where, np.where(of == FOLD, n, 0), len(uniq)).astype("<u4")
            columns.append([every[where[a:b]].tobytes() for a, b in zip(at, at[1:], strict=False)])
            columns.append([fold[where[a:b]].tobytes() if k == FOLD else b"" for k, a, b in zip(kind, at, at[1:], strict=False)])
            facts += [int(every.sum(dtype=np.int64)), int(fold.sum(dtype=np.int64)), int((every > 0).sum())]
        m, r = len(kind), t["range"][0].as_py()
        zero = [0] * m
        return pa.table(
            [pa.array([*t["chunk"].to_pylist(), -1], pa.int64()), pa.array([r] * (m + 1), pa.int64()), *(pa.array([*columns[i], b""], pa.binary()) for i in (0, 2, 1, 3)), *(pa.array([*zero, x], pa.int64()) for x in facts[:3])],
            ["chunk", "range", "words", "pairs", "fold_words", "fold_pairs", "n", "n_fold", "v"],
        )

    return blocks.groupBy("range").applyInArrow(run, TOTALS)


def looked_up(t: pa.Table, totals: pa.Table, fold: bool) -> tuple[np.ndarray, ...]:
    """(tokens before each document, c(w), c(v), c(v w)) for all tokens of a chunk; fold: less the fold's own."""
    tok, cut = tokens_of(t["text"].combine_chunks())
    order = np.argsort(totals["range"].to_numpy())
    whole = lambda name: np.frombuffer(b"".join(totals[name][int(i)].as_py() for i in order), "<u4").astype(np.int64)
    words, pairs = whole("words"), whole("pairs")
    if fold:
        words, pairs = words - whole("fold_words"), pairs - whole("fold_pairs")
    keys, where = np.unique(tok, return_inverse=True)
    c1 = words[where]
    _, where = np.unique(bigrams_of(tok), return_inverse=True)
    end = words[np.searchsorted(keys, END)] if len(keys) else 0
    return cut, c1, np.concatenate([[end], c1[:-1]]), pairs[where]


def estimates(c1: np.ndarray, cv: np.ndarray, c2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the context, bigram estimate, word estimate)."""
    bucket = np.minimum(np.where(cv > 0, np.floor(np.log2(np.maximum(cv, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)
    return bucket, c2 / np.maximum(cv, 1), c1 / max(n, 1)


def held_out_histogram(chunks: DataFrame, totals: DataFrame, n: int) -> DataFrame:
    """cell, tokens, sums of both estimates there."""

    def run(t: pa.Table, totals: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({"cell": pa.array([], pa.int64()), "tokens": pa.array([], pa.int64()), "s2": pa.array([], pa.float64()), "s1": pa.array([], pa.float64())})
        _, c1, cv, c2 = looked_up(t, totals, fold=True)
        bucket, p2, p1 = estimates(c1, cv, c2, n)
        step = lambda p: np.where(p > 0, np.clip(np.floor(-2 * np.log2(np.maximum(p, 1e-30))), 0, CELLS - 2) + 1, 0).astype(np.int64)
        cell = (bucket * CELLS + step(p2)) * CELLS + step(p1)
        some, where = np.unique(cell, return_inverse=True)
        return pa.table({"cell": some, "tokens": np.bincount(where).astype(np.int64), "s2": np.bincount(where, p2), "s1": np.bincount(where, p1)})

    found = chunks.where(F.col("kind") == FOLD).groupBy("chunk").cogroup(totals.where("length(fold_words) > 0 or length(fold_pairs) > 0").groupBy("chunk")).applyInArrow(run, "cell long, tokens long, s2 double, s1 double")
    return found.groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1"))


def learn_weights(cell: np.ndarray, tokens: np.ndarray, s2: np.ndarray, s1: np.ndarray, v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """BUCKETS x 3 weights of the bigram's, the word's and the uniform estimate, by expectation-maximisation. Held-out
    tokens of all buckets together weigh as one more token in each, so that an empty bucket takes the common weights."""
    bucket = cell // (CELLS * CELLS)
    p = np.stack([s2 / tokens, s1 / tokens, np.full(len(tokens), 1 / (v + 1))], 1) if len(cell) else np.zeros((0, 3))
    common = np.array([0.5, 0.4, 0.1])
    w = np.tile(common, (BUCKETS, 1))
    for _ in range(rounds):
        part = p * w[bucket]
        part *= (tokens / np.maximum(part.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, part[:, j], BUCKETS) for j in range(3)], 1)
        if sums.sum():
            common = sums.sum(0) / sums.sum()
        w = (sums + common) / (sums.sum(1, keepdims=True) + 1)
    w[0] = [0, *w[0, 1:] / w[0, 1:].sum()]  # a context that was never seen has no bigram estimate
    return w


def score(docs: DataFrame, learns: Column) -> DataFrame:
    """doc_id, kind, n_tokens, n_known, train_tokens, base_score, score. learns: condition on docs for training documents."""
    chunks, ranges = chunked(tune(docs), learns)
    totals = stored(totals_of(blocks_of(chunks, ranges)), "lm-counts")
    n, n_fold, v = (int(x or 0) for x in totals.where("chunk = -1").agg(F.sum("n"), F.sum("n_fold"), F.sum("v")).first())
    rows = held_out_histogram(chunks, totals, n - n_fold).orderBy("cell").collect()
    weights = learn_weights(*(np.array([r[i] for r in rows], np.int64 if i < 2 else float) for i in range(4)), v)
    if not n:
        weights[:] = [0, 0, 1]

    def run(t: pa.Table, totals: pa.Table) -> pa.Table:
        cut, c1, cv, c2 = looked_up(t, totals, fold=False) if len(t) else (np.zeros(1, np.int64), *(np.zeros(0, np.int64),) * 3)
        bucket, p2, p1 = estimates(c1, cv, c2, n)
        w = weights[bucket]
        logs = np.log10(np.maximum(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1), 1e-300))
        base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
        of = lambda x: np.add.reduceat(x, cut[:-1]) if len(x) else x  # noqa: E731  every document has a token, its end
        ids, kinds = (t[c].combine_chunks() if len(t) else pa.array([], k) for c, k in (("doc_id", pa.int64()), ("kind", pa.int32())))
        return pa.table(
            [ids, kinds, pa.array(np.diff(cut), pa.int64()), pa.array(of((c1 > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(ids), n), pa.int64()), pa.array(of(base), pa.float64()), pa.array(of(logs), pa.float64())],
            ["doc_id", "kind", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    scored = chunks.groupBy("chunk").cogroup(totals.where("chunk >= 0").select("chunk", "range", "words", "pairs").groupBy("chunk"))
    return scored.applyInArrow(run, "doc_id long, kind int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6(docs: DataFrame) -> DataFrame:
    learns = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) != 1
    return score(docs, learns).select("doc_id", (F.col("kind") == TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
