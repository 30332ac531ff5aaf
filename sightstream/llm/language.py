"""Operator 10: language of whole texts by a bidirectional gated recurrent network over bytes.

Each direction has one gate: f = sigmoid(A[x] + U h), c = tanh(B[x] + f * (V h)), h' = h + f * (c - h). At every byte, a
softmax over both directions' states labels the position; a document's probabilities are the mean over its letters.
Texts are cut into windows of WINDOW bytes, all of which are read, so that windows of many documents run side by side.

The network is trained here in numpy by backpropagation through time, on a bounded sample: PER_LANG documents of each
language, the smallest by a hash of doc_id and text, SPOTS windows of each. Counts tell which hashes can be among the
smallest, so that only about twice the sample is ever compared; a language that gets fewer than it could (many equal rows
have one hash) is sampled again from all its rows. That sample is what the driver gets.

A state is as long as a window: the network is begun anew every WINDOW bytes, so no context reaches further.

Nulls and ties: rows without a doc_id are learned from like others. A null text, or one without a letter, is 'und' with score 0. Rows with a null lang aren't learned from.
Equal probabilities go to the language first by name. Other columns are ignored. Without a learned language all is
'und'; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sightstream.llm.common import bounded, free_name, text_slices, tune

WINDOW = 64
HIDDEN = 8
PER_LANG = 400
SPOTS = 4
STEPS = 350
BATCH = 256
RATE = 0.02

#: Windows that run side by side.
SIDE = 2048

PAD = 256
UNKNOWN = "und"

_LETTER = np.zeros(257, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Net(NamedTuple):
    """x: a row for each byte and for padding, inputs of gate and state; u: from state to both; out: from both states to languages."""

    langs: list[str]
    x: tuple[np.ndarray, np.ndarray]  # (2 * HIDDEN, 257) of each direction
    u: tuple[np.ndarray, np.ndarray]  # (2 * HIDDEN, HIDDEN)
    out: np.ndarray  # (languages, 2 * HIDDEN)
    bias: np.ndarray


def run_direction(x: np.ndarray, u: np.ndarray, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
    """seq: WINDOW x windows. -> states, WINDOW x HIDDEN x windows. keep: gets what backpropagation needs."""
    k, n = u.shape[1], seq.shape[1]
    h, states = np.zeros((k, n), np.float32), np.empty((len(seq), k, n), np.float32)
    half = x * np.array([0.5] * k + [1.0] * k, np.float32)[:, None]
    hu = u * np.array([0.5] * k + [1.0] * k, np.float32)[:, None]
    for t in range(len(seq)):
        a = np.take(half, seq[t], axis=1)
        r = hu @ h
        f = a[:k]
        f += r[:k]
        np.tanh(f, out=f)  # sigmoid(z) = tanh(z / 2) / 2 + 1 / 2
        f *= 0.5
        f += 0.5
        c = a[k:]
        if keep is not None:
            keep.append((h, f, r[k:].copy(), c))
        r[k:] *= f
        c += r[k:]
        np.tanh(c, out=c)
        new = states[t]
        np.subtract(c, h, out=new)
        new *= f
        new += h
        h = new
    return states


def probabilities(net: Net, seq: np.ndarray) -> np.ndarray:
    """WINDOW x windows -> languages x WINDOW x windows."""
    fwd = run_direction(net.x[0], net.u[0], seq)
    bwd = run_direction(net.x[1], net.u[1], seq[::-1])[::-1]
    k = fwd.shape[1]
    z = np.stack([net.out[:, :k] @ a + net.out[:, k:] @ b + net.bias[:, None] for a, b in zip(fwd, bwd, strict=True)], 1)
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def backward(x: np.ndarray, u: np.ndarray, seq: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = u.shape[1]
    dx, du, dh = np.zeros_like(x), np.zeros_like(u), np.zeros_like(d_states[0])
    inputs = np.empty((len(seq), 2 * k, seq.shape[1]), np.float32)
    for t in range(len(seq) - 1, -1, -1):
        h, f, r, c = kept[t]
        dh = dh + d_states[t]
        dc = dh * f * (1 - c * c)
        df = (dh * (c - h) + dc * r) * f * (1 - f)
        inputs[t, :k], inputs[t, k:] = df, dc
        d = np.concatenate([df, dc * f])
        du += d @ h.T
        dh = dh * (1 - f) + u.T @ d
    flat = seq.reshape(-1)
    for j in range(2 * k):
        dx[j] = np.bincount(flat, inputs[:, j].reshape(-1), 257)
    return dx, du


def train(langs: list[str], seqs: np.ndarray, labels: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Net:
    """seqs: WINDOW x windows; labels: a language's number for each window. Languages are drawn equally often."""
    rng = np.random.default_rng(seed)
    n = len(langs)
    p = [rng.normal(0, 0.3, (2 * hidden, 257)), rng.normal(0, 0.3, (2 * hidden, 257)), rng.normal(0, 0.3, (2 * hidden, hidden)), rng.normal(0, 0.3, (2 * hidden, hidden)), rng.normal(0, 0.3, (n, 2 * hidden)), np.zeros(n)]
    p = [a.astype(np.float32) for a in p]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    of = [np.flatnonzero(labels == i) for i in range(n)]
    for step in range(1, steps + 1):
        which = rng.integers(0, n, BATCH)
        pick = np.array([of[i][rng.integers(len(of[i]))] for i in which])
        seq = seqs[:, pick]
        kept: tuple[list, list] = ([], [])
        fwd = run_direction(p[0], p[2], seq, kept[0])
        bwd = run_direction(p[1], p[3], seq[::-1], kept[1])[::-1]
        both = np.concatenate([fwd, bwd], 1)
        z = np.einsum("lk,tkb->tlb", p[4], both) + p[5][:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[:, which, np.arange(BATCH)] -= 1
        z *= (_LETTER[seq] / max(1, _LETTER[seq].sum()))[:, None, :]
        d_out, d_bias = np.einsum("tlb,tkb->lk", z, both), z.sum((0, 2))
        d_both = np.einsum("lk,tlb->tkb", p[4], z)
        dx0, du0 = backward(p[0], p[2], seq, kept[0], d_both[:, :hidden])
        dx1, du1 = backward(p[1], p[3], seq[::-1], kept[1], d_both[::-1, hidden:])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate((dx0, dx1, du0, du1, d_out, d_bias)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Net(langs, (p[0], p[1]), (p[2], p[3]), p[4], p[5])


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, document) of each window; documents are cut into windows of WINDOW bytes."""
    n = -(-np.diff(offsets) // WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    start = offsets[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(start + WINDOW, offsets[doc + 1]), doc


def sequences(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start + np.arange(WINDOW)[:, None]
    return np.where(at < end, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(PAD))


def learn(docs: DataFrame, hidden: int = HIDDEN, steps: int = STEPS, per_lang: int = PER_LANG, spots: int = SPOTS) -> Net:
    """docs: text, lang and doc_id of labelled documents."""
    spot = lambda j: F.substring("text", F.greatest(F.lit(1), (F.pmod(F.xxhash64("doc_id", F.lit(j)), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1)).cast("int"), F.lit(WINDOW))
    labelled = docs.where("lang is not null").withColumn("lang", F.col("lang").cast("string")).where(F.col("text").rlike(r"\p{L}"))
    # twice as many as are wanted come near the smallest by hash; the rest needn't be compared
    count = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not count:
        return Net([], *((np.zeros((0, 0)),) * 2,) * 2, np.zeros((0, 0)), np.zeros(0))
    h = F.xxhash64("doc_id", "text", F.lit("sample"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "spots")

    def sample(rows: DataFrame) -> list[tuple]:
        found = rows.select("lang", "doc_id", h.alias("h"), F.array(*(spot(j) for j in range(spots))).alias("spots"))
        return [tuple(r) for r in found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("lang", "h", "doc_id", "spots").collect()]

    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(count.items()) for x in (lang, 2 * per_lang / n))), F.col("lang"))
    rows = sample(labelled.where(h.cast("double") / 2.0**64 + 0.5 <= share))
    got = Counter(r[0] for r in rows)
    if short := [lang for lang, n in count.items() if got[lang] < min(n, per_lang)]:
        rows = [r for r in rows if r[0] not in short] + sample(labelled.where(F.col("lang").isin(short)))
    rows.sort(key=str)
    langs = sorted({r[0] for r in rows})
    raw = [(langs.index(lang), s.encode()[:WINDOW]) for lang, _, _, found in rows for s in found if s]
    if not raw:
        return Net([], *((np.zeros((0, 0)),) * 2,) * 2, np.zeros((0, 0)), np.zeros(0))
    data = np.frombuffer(b"".join(s for _, s in raw), np.uint8)
    ends = np.cumsum([len(s) for _, s in raw])
    seqs = sequences(data, ends - [len(s) for _, s in raw], ends)
    return train(langs, seqs, np.array([i for i, _ in raw]), hidden, steps)


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x languages: mean probabilities over the letters of each document, 0 where there is none."""
    start, end, doc = windows_of(data, offsets)
    sums, letters = np.zeros((len(offsets) - 1, len(net.langs))), np.zeros(len(offsets) - 1)
    for lo in range(0, len(start), SIDE):
        own = slice(lo, lo + SIDE)
        seq = sequences(data, start[own], end[own])
        there = _LETTER[seq]
        p = probabilities(net, seq)
        for i in range(len(net.langs)):
            sums[:, i] += np.bincount(doc[own], (p[i] * there).sum(0), len(letters))
        letters += np.bincount(doc[own], there.sum(0), len(letters))
    return sums / np.maximum(letters, 1)[:, None]


def predict(docs: DataFrame, net: Net) -> DataFrame:
    """The columns of docs, lang_pred and score (which replace columns of these names)."""
    docs = tune(docs).drop("lang_pred", "score")
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, at):
            known = b.column(b.num_columns - 1).to_pylist()
            lang, score = [UNKNOWN] * len(known), [0.0] * len(known)
            if net.langs:
                for lo, _, data, offsets in text_slices(b.column(at)):
                    p = pooled(net, data, offsets)
                    for i, (j, q) in enumerate(zip(p.argmax(1).tolist(), p.max(1).tolist(), strict=True)):
                        if known[lo + i]:
                            lang[lo + i], score[lo + i] = net.langs[j], min(max(q, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return docs.withColumn(free_name(docs, "_letters"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def fold_of(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def op10(docs: DataFrame) -> DataFrame:
    held_out = fold_of(F.col("doc_id"), 4) == 2
    net = learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
