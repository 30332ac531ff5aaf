"""Operator 5: near-duplicates by SimHash, found in an inverted index of positional bytes.

A fingerprint has 64 bits, so 8 positional bytes. Fingerprints that differ in d <= 4 bits differ in at most d bytes and
share at least 8 - d of them. Every set of 4 of the 8 positions contains one of the 20 triples of a covering design, so
a pair that can link meets under at least one of 20 index keys (triple of positions, three bytes). Under a key, the
shared positional bytes of a pair are tallied, pairs reaching 8 - d go on, and their differing bits are counted.

Equal fingerprints are one row before anything is indexed. Under a key, only a spanning forest of the links is given
out, never all pairs. A key of more than SPLIT fingerprints is cut into chunks; each pair of chunks is then a unit of
its own, so that no group has to fit into one task. Components of the forests' union are those of all links.

Nulls and ties: a null text or one without words has fingerprint zero, which links like any other; equal texts in
several rows, and several rows with one doc_id, each give a row. A null doc_id stays null and never names a component
unless all its members are null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import bounded, stored, tune
from sightstream.llm.components import components

SHINGLE = 4
BITS = 4

#: Fingerprints of one index key that one unit compares; more are cut into chunks of about this many.
SPLIT = 20_000


def covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that every 4 positions contain one: positions lie in three groups on a circle; a
    triple is taken if it lies in one group, or has two in a group and one in the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    of = {p: g for g, ps in enumerate(groups) for p in ps}
    out = []
    for t in combinations(range(8), 3):
        n = [sum(of[p] == g for p in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[shingle - 1 :].tolist() if len(words) > shingle else [len(norm)]
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(norm[s:e], 42) for s, e in zip(starts, ends)], np.uint64)  # noqa: B905  starts go on beyond the last shingle
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        counts += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_key (hash of the text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    return tune(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("row_key")).mapInArrow(run, "doc_id long, row_key long, fp long")


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of fingerprints link: enough shared positional bytes, then few enough differing bits."""
    x = a ^ b
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = tally >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def forest(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints: who is reached leaves the rest, so dense groups end soon."""
    one, two, rest = [], [], fps
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            f = stack.pop()
            hit = near(rest, np.uint64(f), bits)
            if hit.any():
                found = rest[hit]
                one.append(np.full(len(found), f, np.uint64))
                two.append(found)
                stack.extend(found)
                rest = rest[~hit]
    return one, two


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps: distinct (fp). -> edges (a, b) whose components are those of all pairs at bits or fewer differing bits.

    For bits up to 4, the 20 triples cover any 4 of 8 positions. More bits aren't supported."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be from 0 to 4")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(i << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for i, (a, b, c) in enumerate(covering_triples())]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = index.groupBy("key").count().where(F.col("count") > SPLIT).select("key", F.ceil(F.col("count") / SPLIT).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    unit = F.when(F.col("chunks").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    )
    units = index.join(hot, "key", "left").select("fp", F.explode(unit).alias("unit")).repartition("unit").sortWithinPartitions("unit", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one unit lie together; the last run of a batch may go on in the next."""

        def out(u: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(u[1:] != u[:-1]) + 1
            starts, n = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(u)]]))
            pair = starts[n == 2]
            a, b = f[pair], f[pair + 1]
            hit = near(a, b, bits)
            one, two = [a[hit]], [b[hit]]
            for s, k in zip(starts[n > 2], n[n > 2], strict=True):
                x, y = forest(np.unique(f[s : s + k]), bits)
                one += x
                two += y
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64))], ["a", "b"])

        held_u: list[np.ndarray] = []
        held_f: list[np.ndarray] = []
        held = 0
        for batch in batches:
            u, f = batch.column(1).to_numpy(), batch.column(0).to_numpy().view(np.uint64)
            if not len(u):
                continue
            held_u.append(u)
            held_f.append(f)
            held += len(u)
            if held >= 1 << 16 and u[-1] != held_u[0][0]:
                u, f = np.concatenate(held_u), np.concatenate(held_f)
                last = int(np.searchsorted(u, u[-1]))
                yield out(u[:last], f[:last])
                held_u, held_f, held = [u[last:]], [f[last:]], len(u) - last
        if held:
            yield out(np.concatenate(held_u), np.concatenate(held_f))

    return units.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, row_key, fp, group (a fingerprint that names the component), component_id: the smallest doc_id among all documents
    reachable over links."""
    by_doc = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = by_doc.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reach = components(links(distinct.select("fp"), bits))
    linked = reach.join(distinct, reach.node == distinct.fp).select("root", "fp", "first")
    least = stored(linked.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = linked.join(least, "root").select("fp", "root", "least")
    every = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group"), F.coalesce("least", "first").alias("component_id"))
    # tables of their own, so that both sides are dealt out for the join alone and Spark can split a root or fingerprint with many rows
    every = stored(every, "components")
    return by_doc.join(every, "fp").select("doc_id", "row_key", "fp", "group", "component_id")


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
