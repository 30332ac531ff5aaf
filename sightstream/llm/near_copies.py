"""Operator 5 at a wider distance, for the pipeline: groups of texts whose 5-word shingles have a Jaccard similarity of 0.8.

Two texts of similarity 0.8 differ in about 10 of a fingerprint's 64 bits, too many for one fingerprint's index. So a text
gets SEEDS fingerprints, each of other hashes of the same shingles: 96 positional bytes in all, of which such a pair shares
about 26, and texts that have nothing in common 1 or none. The positional bytes are indexed by triples of positions; a
pair of similarity 0.8 meets under about 8 of the KEYS keys, one of 0.9 under 27. Texts that meet tally the positional
bytes that they share and count the bits that differ; pairs with LEAST bytes and at most MOST bits are candidates. A link
is a candidate whose two sets of shingles (64-bit hashes) were intersected and reach SIMILAR.

Texts with equal sets are one node. A key's texts are joined to each other like a minimum spanning tree: every part is
linked with the nearest text outside of it, until no part has one near enough, so that a group of n near copies gives n
candidates a key and not n * n. That is done twice: once for the first FIRST keys of each text, then, with the links found
by then as parts, for all of them, so that a large group has little left to give. A key with more than SPLIT texts is cut
into chunks, and each pair of chunks is a unit of its own.

What can be missed: a pair that meets under no key (about 1 of 100 at a similarity of exactly 0.8, none of hundreds at
0.85, measured), and a link that only a text farther than the nearest one would have.

Chance meetings under a key of 3 bytes grow with the number of texts: one a text and key at 2 ** 24 texts.

Whole texts are hardly shuffled: a filter of fixed size (bits of hashes) parts documents that can't be candidates, and those
that can't go, from the rest, and only the rest is joined.

Nulls and ties: null texts and texts without words are one node. Texts of fewer than 5 words are one shingle. Words are
maximal runs of bytes that aren't ASCII white space, ASCII letters in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import SPACES, bounded, byte_set, grams, lower_ascii, mix, stored, text_slices, trim, tune, words_of
from sightstream.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
SEEDS = 12
LEAST, MOST = 8, 170

#: A key is the bytes at positions p, p + a, p + b (modulo their number) for each position p and each of these steps.
STEPS = ((1, 3), (5, 14), (7, 27), (11, 29))
KEYS = 8 * SEEDS * len(STEPS)
FIRST = 32

#: Hashes whose ones are added up in a byte.
LANE = 255

#: Bits of the filter that spares whole texts the shuffle, in 64-bit words: so many rows are broadcast at most.
FILTER = 1 << 24

#: Texts of one key that one unit compares.
SPLIT = 2048

_WORD = byte_set(SPACES)
_SEEDS = mix(np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def triples() -> np.ndarray:
    """KEYS x 3 positions, those of one step first spread over all positions."""
    n = 8 * SEEDS
    return np.array([(p, (p + a) % n, (p + b) % n) for a, b in STEPS for p in range(n)])


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """For each slice of texts: the ascending distinct hashes of each text's shingles."""
    for _, _, data, offsets in text_slices(texts):
        w = words_of(lower_ascii(data), offsets, _WORD)
        g = grams(w.hash, SHINGLE)
        yield [np.unique(g[a : b - SHINGLE + 1]) if b - a >= SHINGLE else grams(w.hash[a:b], int(b - a))[:1] if b > a else np.zeros(0, np.uint64) for a, b in zip(w.first, w.first[1:], strict=False)]


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x SEEDS fingerprints: a bit is 1 if set in over half of the set's hashes under that seed."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), SEEDS), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    every = np.concatenate([sets[i] for i in some])
    size = size[some]
    # ones are added up in the 8 lanes of a 64-bit integer, of 255 hashes at most
    blocks = -(-size // LANE)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(size) - size, blocks) + LANE * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
    ones = np.empty((len(some), 8, 8), np.uint32)
    for seed in range(SEEDS):
        h = mix(every ^ _SEEDS[seed])
        for j in range(8):
            sums = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), starts)
            ones[:, :, j] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.uint32)
        out[some, seed] = np.packbits((ones.reshape(-1, 64) * 2 > size[:, None]), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


NODE = "_id long, _key long, node long, n long, fps binary"


def nodes_of(docs: DataFrame) -> DataFrame:
    """_id (doc_id, the last number for null), _key (hash of the text), node (hash of the set), n (its size), fps (8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 2):
            node, size, fps = [], [], []
            for sets in shingle_sets(b.column(2)):
                node += [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                size += [len(s) for s in sets]
                fps += [x.tobytes() for x in fingerprints_of(sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(fps, pa.binary())], ["_id", "_key", "node", "n", "fps"])

    return docs.select("_id", "_key", "text").mapInArrow(run, NODE)


def matrix(fps: pa.Array) -> np.ndarray:
    """Texts x SEEDS, of a column of binaries of one length."""
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, SEEDS)


def index(nodes: DataFrame) -> DataFrame:
    """nodes: node, n, fps -> kn (key << 16 | size of the set, the last number for larger ones), node: KEYS rows a node."""
    of = triples()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                x = matrix(b.column(2)).view(np.uint8).astype(np.int64)[:, of]
                key = (np.arange(len(of)) << 24) + (x[:, :, 0] << 16) + (x[:, :, 1] << 8) + x[:, :, 2]
                kn = (key << 16) + np.minimum(b.column(1).to_numpy(), 65535)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(kn.reshape(-1)), pa.array(np.repeat(b.column(0).to_numpy(), len(of)))], ["kn", "node"])
        trim()

    return nodes.where("n > 0").select("node", "n", "fps").mapInArrow(run, "kn long, node long")


def sized(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sets whose sizes differ more can't be similar."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def met(rows: DataFrame) -> DataFrame:
    """key, chunk, node of those rows of the index that have another of like size under their key; a chunk is SPLIT such rows of
    a key in order of size. Rows of a key lie together in that order, so that a row is held beside the one before it and the
    one after, however many there are."""
    dealt = rows.repartition(F.shiftright("kn", 16)).sortWithinPartitions("kn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 2
        held = False  # whether the row that waits has one before it
        at, many = -1, 0  # the last key that was given out, and how many rows of it

        def out(kn: np.ndarray, node: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            nonlocal at, many
            key, node = kn[keep] >> 16, node[keep]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
            if len(key):
                place[: starts[1] if len(starts) > 1 else len(key)] += many if key[0] == at else 0
                at, many = int(key[-1]), int(place[-1]) + 1
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place // SPLIT), pa.array(node)], ["key", "chunk", "node"])

        for b in batches:
            if not b.num_rows:
                continue
            kn, node = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(last))
            n = kn & 65535
            with_next = (kn[1:] >> 16 == kn[:-1] >> 16) & sized(n[1:], n[:-1])
            keep = np.zeros(len(kn), bool)
            keep[0] = held
            keep[:-1] |= with_next
            keep[1:] |= with_next
            yield out(kn[:-1], node[:-1], keep[:-1])
            last, held = [kn[-1:], node[-1:]], bool(keep[-1])
        if held:
            yield out(*last, np.ones(1, bool))
        trim()

    return dealt.mapInArrow(run, "key long, chunk long, node long")


def units_of(rows: DataFrame) -> DataFrame:
    """rows: met() -> node, units: where a node is compared, its chunks and, under a key of several, each pair of them. The units
    of the first FIRST keys are negative."""
    sign = F.when(F.col("key") < FIRST << 24, -1).otherwise(1)
    own = F.xxhash64("key", "chunk", "chunk")
    several = rows.where("chunk > 0").groupBy("key").agg(F.max("chunk").alias("top"))
    others = F.expr("filter(sequence(0L, top), j -> j <> chunk)")
    pairs = rows.join(several, "key").select("node", F.explode(F.transform(others, lambda j: F.xxhash64("key", F.least("chunk", j), F.greatest("chunk", j)))).alias("u"), sign.alias("sign"))
    named = rows.select("node", own.alias("u"), sign.alias("sign")).union(pairs)
    return named.groupBy("node").agg(F.collect_list(F.col("sign") * (F.shiftrightunsigned("u", 2) + 1)).alias("units"))


def near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of rows are candidates."""
    d = x ^ y
    return sized(n, m) & ((d.view(np.uint8).reshape(len(d), -1) == 0).sum(1) >= LEAST) & (np.bitwise_count(d).sum(1) <= MOST)


def tree(n: np.ndarray, x: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows that join parts to the nearest row outside of them, until no part has one near enough."""
    part = np.unique(part, return_inverse=True)[1]
    mine = np.flatnonzero(part != np.bincount(part).argmax())
    far = np.empty((len(mine), len(n)), np.uint16)
    for lo in range(0, len(mine), 64):
        own = mine[lo : lo + 64]
        far[lo : lo + 64] = sum(np.bitwise_count(x[own, None, j] ^ x[None, :, j]).astype(np.uint16) for j in range(SEEDS))
        far[lo : lo + 64][~sized(n[own, None], n)] = 65535
    out = []
    while len(mine):
        apart = np.where(part[mine, None] == part, np.uint16(65535), far)
        at = apart.argmin(1)
        least = apart[np.arange(len(mine)), at]
        order = np.lexsort((least, part[mine]))
        first = order[np.unique(part[mine][order], return_index=True)[1]]
        first = first[least[first] <= MOST]
        first = first[near(x[mine[first]], x[at[first]], n[mine[first]], n[at[first]])] if len(first) else first
        joined = False
        for i in first.tolist():
            a, b = part[mine[i]], part[at[i]]
            if a != b:
                out.append((int(mine[i]), int(at[i])))
                part[part == a] = b
                joined = True
        if not joined:
            return out
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """rows: node, n, fps, part, units -> pairs (a, b) that join the parts in each unit."""
    wide = rows.select("node", "n", "fps", "part", F.explode("units").alias("unit")).select("unit", "node", "n", "fps", "part").repartition("unit").sortWithinPartitions("unit")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one unit lie together; the last run of a batch may go on in the next."""

        def out(t: pa.Table) -> pa.RecordBatch:
            unit, node, n, part = (t[c].to_numpy() for c in ("unit", "node", "n", "part"))
            x = matrix(t["fps"].combine_chunks())
            cut = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
            starts, many = cut[:-1], np.diff(cut)
            two = starts[many == 2]
            two = two[near(x[two], x[two + 1], n[two], n[two + 1]) & (part[two] != part[two + 1])] if len(two) else two
            one, other = [node[two]], [node[two + 1]]
            for s, k in zip(starts[many > 2].tolist(), many[many > 2].tolist(), strict=True):
                if (part[s : s + k] == part[s]).all():
                    continue
                own = np.arange(s, s + k)[np.unique(node[s : s + k], return_index=True)[1]]
                pairs = np.array(tree(n[own], x[own], part[own]), np.int64).reshape(-1, 2)
                one.append(node[own[pairs[:, 0]]])
                other.append(node[own[pairs[:, 1]]])
            a, b = np.concatenate(one), np.concatenate(other)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        many = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            many += b.num_rows
            if many >= 1 << 15 and b.column(0)[b.num_rows - 1] != held[0].column(0)[0]:
                t = pa.Table.from_batches(held)
                unit = t["unit"].to_numpy()
                last = int(np.searchsorted(unit, unit[-1]))
                yield out(t.slice(0, last))
                held, many = t.slice(last).combine_chunks().to_batches(), len(t) - last
        if held:
            yield out(pa.Table.from_batches(held))
        trim()

    return wide.mapInArrow(compare, "a long, b long").distinct()


def sets_of(texts: DataFrame) -> DataFrame:
    """node, text -> node, shingles (ascending hashes of 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for sets in shingle_sets(b.column(1)) for s in sets], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def similar(one: bytes, two: bytes) -> bool:
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)  # SIMILAR, in whole numbers


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that reach SIMILAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield t.filter(pa.array([similar(x, y) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)], pa.bool_())).select(["a", "b"])
        trim()

    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("a", "b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def place() -> Column:
    """Where a row stands in the filter."""
    return F.pmod(F.xxhash64("_id", "_key", F.lit("filter")), F.lit(FILTER))


def parted(rows: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among some: _id, _key; rows that surely aren't). The filter is a table of FILTER // 64 words at most,
    however many rows there are; when it fills up, more rows are taken for possible ones, and a join has to tell."""
    parts = {"_near_word": F.shiftright(place(), 6), "_near_bit": (place() % 64).cast("int")}
    bit = F.expr("shiftleft(1L, _near_bit)")
    words = stored(some.withColumns(parts).groupBy("_near_word").agg(F.bit_or(bit).alias("_near_mask")), "near-filter")
    told = rows.withColumns(parts).join(F.broadcast(words), "_near_word", "left").withColumn("_near_may", F.coalesce(F.col("_near_mask").bitwiseAND(bit) != 0, F.lit(False)))
    return tuple(told.where(c).select(*rows.columns) for c in ("_near_may", "not _near_may"))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: _id, _key, text -> (_id, _key, node: of each document; node, root: of nodes that are linked)."""
    by_doc = stored(nodes_of(docs), "near-documents")
    nodes = stored(by_doc.groupBy("node").agg(F.min(F.struct("_id", "_key")).alias("k"), F.first("n").alias("n"), F.first("fps").alias("fps")).select("node", "k.*", "n", "fps"), "near-nodes")
    units = units_of(stored(met(index(nodes)), "near-index"))
    # joined once a node, not once for each of its places
    rows = stored(nodes.select("node", "n", "fps").join(units, "node"), "near-units")

    def links(rows: DataFrame) -> DataFrame:
        pairs = stored(candidates(rows), "near-pairs")
        of = nodes.select("_id", "_key", "node").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node")
        of = stored(of, "near-candidates")
        return stored(verified(pairs, sets_of(parted(docs, of)[0].join(of, ["_id", "_key"]))), "near-links")

    first = links(rows.withColumns({"part": F.col("node"), "units": F.filter("units", lambda u: u < 0)}))
    roots = stored(components(first), "near-parts").select("node", F.col("root").alias("part"))
    second = links(rows.join(roots, "node", "left").withColumn("part", F.coalesce("part", "node")))
    return by_doc.select("_id", "_key", "node"), components(first.union(second))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) without near copies: of each group the one with the smallest doc_id stays,
    without repeated rows. Rows without a doc_id come last; rows with one doc_id are told apart by their text. Columns of docs
    named _id or _key are lost."""
    rows = tune(docs).withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "_key": F.xxhash64("text")})
    by_doc, group = groups(rows.select("_id", "_key", "text"))
    least = by_doc.groupBy("node").agg(F.min(F.struct("_id", "_key")).alias("k")).join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = least.groupBy("root").agg(F.min("k").alias("kept"))
    named = stored(least.select("node", "root").join(kept, "root").select("node", F.col("kept._id").alias("kept_id"), F.col("kept._key").alias("kept_key")), "near-kept")
    gone = stored(by_doc.join(named, "node").where("_id <> kept_id or _key <> kept_key").select("_id", "_key").distinct(), "near-gone")
    repeated = by_doc.groupBy("_id", "_key").count().where("count > 1").select("_id", "_key")
    may, sure = parted(rows, gone.union(repeated))
    left = may.join(gone, ["_id", "_key"], "left_anti").dropDuplicates(["_id", "_key"])
    return sure.unionByName(left.select(*rows.columns)).drop("_id", "_key")
