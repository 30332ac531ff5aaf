"""Operator 12: the trie of all prefixes of conversations, by MSD radix partitioning over dictionary-encoded turns.

Turns (role and text) are encoded once: a dictionary gives each distinct one a number, and from then on a conversation is
an array of numbers with the bytes of their texts beside them. Conversations of one sequence are one row that counts them
(and knows the smallest conv_id), so that thousands of copies weigh as much as one.

The root's bucket holds all sequences. A round takes the large buckets, each a node and the sequences below it, and
deals every sequence by the turn that follows the node, its next digit: a groupBy counts each digit's sequences before
anything is shuffled, and a digit with more than LOCAL turns below it is a large bucket of the next round. What its
sequences still have in common, told by the smallest and the largest of them, is skipped at once, so that there are as
many rounds as large nodes branch below each other, not as many as turns. All other digits are local buckets: their
rows go to one task each, in their order, where multikey quicksort parts them by one turn after another and its recursion
emits the nodes. Sums over subtrees (leaves, saved bytes) are made there and go up from round to round in the end, a
row for each child.

A node's ends, the conversations that stop there, are hashed in order of conv_id: tasks join ranges of ids to strings, and
one task a node hashes these strings one after another as they come, since SHA-256 can't be split.

Bounds: a conversation is one row, of 16 bytes a turn; a local bucket has LOCAL turns, or is one conversation.

Nulls and ties: a null role or text is empty; a null turn comes first; turns of one number go by role, then text, and
repeated rows are repeated turns. Rows without a conv_id belong to no conversation. Other columns are ignored. A
conversation that is turnless once rebuilt ends at the root. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightstream.llm.common import stored, trim, tune

#: Turns below a node that one task sorts.
LOCAL = 50_000

#: Conversation ids that are joined to one string before they are hashed.
CHUNK = 65_536

#: How many conversations share a base, and the number of different lengths of what they take of it.
GROUP, HEADS = 5, 9

NODE = "round int, bucket long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_seq long, end_n long"
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]
_KINDS = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in NODE.split(", ")])


# --- sequences ---


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: the turns of each conversation in their order, as numbers, and the bytes of their texts."""
    rows = tune(conversations).where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    named = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256))
    turns = stored(rows.select("conv_id", place.alias("place"), named.alias("name"), F.octet_length("text").cast("long").alias("size")), "turns")
    numbers = stored(turns.groupBy("name").agg(F.count("*")).select("name", F.monotonically_increasing_id().alias("id")), "turn-ids")
    each = F.array_sort(F.collect_list(F.struct("place", "id", "size")))
    held = turns.join(numbers, "name").groupBy("conv_id").agg(each.alias("s"))
    return held.select("conv_id", F.col("s.id").alias("ids"), F.col("s.size").alias("sizes"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation with its beginning taken from the one that its group of GROUP shares: the first h turns of that, then
    its own after its first h. h is the crc32 of its decimal id modulo HEADS."""
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    heads = sequences.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, HEADS - 1).alias(f"head_{c}") for c in ("ids", "sizes")))
    own = sequences.select("*", base, (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("h"))
    both = lambda c: F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.array().cast("array<long>")), F.slice(c, F.col("h") + 1, F.size(c)))
    return own.join(heads, "base", "left").select("conv_id", both("ids").alias("ids"), both("sizes").alias("sizes"))


# --- what ends at a node ---


def ends_of(members: DataFrame) -> DataFrame:
    """members: seq, conv_id -> seq, ends: the hash of each sequence's conversations, in their order, joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, conv = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.union1d(np.flatnonzero(np.diff(seq, prepend=seq[:1] - 1)), np.arange(0, len(seq), CHUNK))
            parts = [",".join(map(str, x.tolist())) for x in np.split(conv, cuts[1:])] if len(seq) else []
            yield pa.RecordBatch.from_arrays([pa.array(seq[cuts]), pa.array(conv[cuts]), pa.array(parts, pa.string())], ["seq", "first", "part"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, h = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"seq": [seq], "ends": [h.hexdigest()]})

        for b in batches:
            for s, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s != seq:
                    if h is not None:
                        yield out()
                    seq, h = s, hashlib.sha256(part.encode())
                else:
                    h.update(b"," + part.encode())
        if h is not None:
            yield out()

    parts = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined, "seq long, first long, part string")
    return parts.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "seq long, ends string")


# --- local buckets ---


def sorted_nodes(seqs: list[tuple[int, int, list[int], list[int]]]) -> dict[str, list]:
    """Multikey quicksort of distinct sequences (conv, n, ids, sizes) that share their first turn. Nodes of depth 1 on, a parent
    before its children: parent (-1 for the first), depth, conv, n, size of the last turn, end_seq, end_n."""
    nodes: dict[str, list] = {c: [] for c in ("parent", "depth", "conv", "n", "size", "end_seq", "end_n")}

    def node(parent: int, depth: int, members: list[int], of: int) -> int:
        values = (parent, depth, min(seqs[i][0] for i in members), sum(seqs[i][1] for i in members), seqs[of][3][depth - 1], None, None)
        for column, value in zip(nodes.values(), values, strict=True):
            column.append(value)
        return len(nodes["depth"]) - 1

    todo = [(-1, 0, list(range(len(seqs))))]
    while todo:
        parent, depth, members = todo.pop()
        if len(members) == 1:  # what is left of one sequence is a path
            (only,) = members
            for d in range(depth, len(seqs[only][2])):
                parent = node(parent, d + 1, members, only)
            nodes["end_seq"][parent], nodes["end_n"][parent] = seqs[only][:2]
            continue
        digit = [seqs[i][2][depth] if depth < len(seqs[i][2]) else -1 for i in members]
        pivot = sorted((digit[0], digit[len(digit) // 2], digit[-1]))[1]
        less, more = ([i for i, x in zip(members, digit, strict=True) if x < pivot], [i for i, x in zip(members, digit, strict=True) if x > pivot])
        same = [i for i, x in zip(members, digit, strict=True) if x == pivot]
        todo += [(parent, depth, part) for part in (more, less) if part]
        if pivot < 0:
            nodes["end_seq"][parent], nodes["end_n"][parent] = seqs[same[0]][:2]
        else:
            todo.append((node(parent, depth + 1, same, same[0]), depth + 1, same))
    return nodes


def bucket_nodes(number: int, bucket: int, depth: int, seqs: list[tuple]) -> pa.RecordBatch:
    """The nodes of a local bucket, below the node `bucket` at `depth`, with sums over their subtrees."""
    x = sorted_nodes(seqs)
    n = len(x["depth"])
    children, leaves, saved = [0] * n, [0] * n, [(many - 1) * size for many, size in zip(x["n"], x["size"], strict=True)]
    for i in range(n - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if (p := x["parent"][i]) >= 0:
            children[p], leaves[p], saved[p] = children[p] + 1, leaves[p] + leaves[i], saved[p] + saved[i]
    above = [x["conv"][p] if p >= 0 else bucket for p in x["parent"]]
    top = [p < 0 for p in x["parent"]]
    columns = ([number] * n, [bucket] * n, top, x["conv"], [depth + d for d in x["depth"]], above, x["n"], children, leaves, saved, x["end_seq"], x["end_n"])
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS.types, strict=True)], schema=_KINDS)


def local_nodes(rows: DataFrame, number: int) -> DataFrame:
    """rows: bucket, depth, digit, conv, n, ids and sizes after the bucket's node -> NODE. Rows of a bucket and digit come one
    after another; a task holds those of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for bucket, depth, digit, *seq in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if (bucket, depth, digit) != key:
                    if held:
                        yield bucket_nodes(number, *key[:2], held)
                    key, held = (bucket, depth, digit), []
                held.append(tuple(seq))
        if held:
            yield bucket_nodes(number, *key[:2], held)
        trim()

    dealt = rows.select("bucket", "depth", "digit", "conv", "n", "ids", "sizes").repartition("bucket", "digit").sortWithinPartitions("bucket", "digit")
    return dealt.mapInArrow(run, NODE)


# --- large buckets ---


def common(lo: Column, hi: Column) -> Column:
    """How many elements two arrays begin with alike."""
    same = F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("long")


def facts(rows: DataFrame) -> DataFrame:
    """rows: bucket, parent, since (depth of the bucket's first node), conv, n, ids, sizes -> a row for each large bucket: until, the
    depth of the node at which its sequences part, n, and the sizes of the turns from since to until."""
    by = F.struct("ids", "sizes")
    found = rows.groupBy("bucket", "parent", "since").agg(F.sum("n").alias("n"), F.min(by).alias("lo"), F.max("ids").alias("hi"))
    found = found.withColumn("until", common(F.col("lo.ids"), F.col("hi")))
    first = F.greatest(F.col("since"), F.lit(1)).cast("int")
    return found.select("bucket", "parent", "since", "until", "n", F.slice("lo.sizes", first, (F.col("until") - first + 1).cast("int")).alias("sizes"))


def chains(rows: DataFrame, number: int) -> DataFrame:
    """rows: facts() with children, leaves, saved (sums over the children of the last node), end_seq, end_n -> NODE: the nodes from
    since to until, one below the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                k = r["until"] - r["since"] + 1
                sizes = np.array([0] * (k - len(r["sizes"])) + r["sizes"], np.int64)  # the root has no text
                saved = r["saved"] + np.cumsum((r["n"] - 1) * sizes[::-1])[::-1]
                last = np.arange(k) == k - 1
                columns = {
                    "round": np.full(k, number, np.int32), "bucket": pa.array([r["parent"]] * k, pa.int64()), "top": np.arange(k) == 0,
                    "conv_id": np.full(k, r["bucket"]), "depth": np.arange(r["since"], r["until"] + 1),
                    "parent_conv_id": pa.array([r["parent"], *[r["bucket"]] * (k - 1)], pa.int64()),
                    "n_convs": np.full(k, r["n"]), "n_children": np.where(last, r["children"], 1), "n_leaves": np.full(k, r["leaves"]), "saved_tokens": saved,
                    "end_seq": pa.array([*[None] * (k - 1), r["end_seq"]], pa.int64()), "end_n": pa.array([*[None] * (k - 1), r["end_n"]], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], kind) for c, kind in zip(_KINDS.names, _KINDS.types, strict=True)], schema=_KINDS)

    return rows.mapInArrow(run, NODE)


def trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """seqs: conv (the smallest conv_id), n (conversations), ids, sizes of each distinct sequence -> NODE."""
    root = F.lit(seqs.agg(F.min("conv")).first()[0]).cast("long")
    rows = seqs.withColumns({"bucket": root, "parent": F.lit(None).cast("long"), "since": F.lit(0).cast("long")})
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []  # large buckets, what ends at them, nodes of their local buckets
    while True:
        number = len(rounds)
        large = stored(facts(rows), "trie-buckets")
        if not large.count():
            break
        if number:
            rows = rows.join(large.select("bucket", F.col("until").alias("depth")), "bucket")
        else:  # the root alone
            rows = rows.withColumn("depth", F.lit(large.first().until))
        after = F.size("ids") > F.col("depth")
        ended = stored(rows.where(~after).select("bucket", F.col("conv").alias("end_seq"), F.col("n").alias("end_n")), "trie-ends")
        going = rows.where(after).select("bucket", "depth", F.get("ids", F.col("depth").cast("int")).alias("digit"), "conv", "n", "ids", "sizes")
        counts = going.groupBy("bucket", "digit").agg(F.count("*").alias("seqs"), F.min("conv").alias("next"), F.sum(F.size("ids") - F.col("depth")).alias("turns"))
        split = stored(counts.where((F.col("turns") > local) & (F.col("seqs") > 1)).select("bucket", "digit", "next"), "trie-digits")
        rest = lambda c: F.slice(c, (F.col("depth") + 1).cast("int"), F.size(c))
        here = going.join(split, ["bucket", "digit"], "left_anti").withColumns({c: rest(c) for c in ("ids", "sizes")})
        rounds.append((large, ended, stored(local_nodes(here, number), "trie-nodes")))
        rows = stored(going.join(split, ["bucket", "digit"]).select(F.col("next").alias("bucket"), F.col("bucket").alias("parent"), (F.col("depth") + 1).alias("since"), "conv", "n", "ids", "sizes"), "trie-rows")
    out, below = None, None
    for number, (large, ended, nodes) in reversed([*enumerate(rounds)]):
        tops = nodes.where("top").select("bucket", "n_leaves", "saved_tokens")
        tops = tops if below is None else tops.union(below.where("top").select("bucket", "n_leaves", "saved_tokens"))
        sums = tops.groupBy("bucket").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        told = large.join(sums, "bucket", "left").join(ended, "bucket", "left").fillna({"children": 0, "leaves": 1, "saved": 0})
        below = stored(chains(told, number), "trie-chains")
        out = nodes.union(below) if out is None else out.union(nodes).union(below)
    return out if out is not None else seqs.sparkSession.createDataFrame([], NODE)


def prefix_trie(conversations: DataFrame, rebuild: bool = True, local: int = LOCAL) -> DataFrame:
    """conversations: conv_id, turn, role, text. -> a row for each distinct beginning of conversations: conv_id (the smallest of those that
    begin so), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. rebuild: whether conversations take
    their beginning from the first of their group (rebuilt)."""
    convs = sequences(conversations)
    convs = stored((rebuilt(convs) if rebuild else convs).withColumn("key", F.unhex(F.sha2(F.array_join("ids", ","), 256))), "conversations")
    seqs = stored(convs.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.min(F.struct("ids", "sizes")).alias("s")).select("key", "conv", "n", "s.ids", "s.sizes"), "conversation-sequences")
    nodes = trie(seqs.drop("key"), local)
    members = convs.select("key", "conv_id").join(seqs.where("n > 1").select("key", F.col("conv").alias("seq")), "key").select("seq", "conv_id")
    ends = stored(ends_of(members), "conversation-ends")
    one = F.sha2(F.when(F.col("end_n") == 1, F.col("end_seq").cast("string")).otherwise(F.lit("")), 256)
    told = nodes.withColumn("seq", F.when(F.col("end_n") > 1, F.col("end_seq"))).join(ends, "seq", "left")
    return told.select(*NODE_NAMES[3:10], F.coalesce("ends", one).alias("ends_sha256"))


def op12(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations)


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT role, text, row_number() OVER () AS id, octet_length(encode(text)) AS size FROM (SELECT DISTINCT role, text FROM t)
), o AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, t.role, t.text) AS own FROM t JOIN ids ON ids.role = t.role AND ids.text = t.text GROUP BY conv_id
), h AS (
  SELECT conv_id, own, CAST(xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x) + 256, 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 256) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 9 AS INTEGER) AS h FROM o
), s AS (
  SELECT a.conv_id, list_concat(coalesce(b.own[1 : a.h], []), a.own[a.h + 1 :]) AS seq FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 5
), m AS (
  SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM s
), n AS (
  SELECT seq[1 : depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '') AS ends FROM m GROUP BY ALL
), k AS (
  SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN k.path IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * coalesce(ids.size, 0) AS saved
  FROM n LEFT JOIN k ON k.path = n.path LEFT JOIN ids ON ids.id = n.path[n.depth]
), a AS (
  SELECT path[1 : up] AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT path, leaf, saved, unnest(range(depth + 1)) AS up FROM f) GROUP BY ALL
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN a ON a.path = f.path LEFT JOIN n p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.path[1 : f.depth - 1]
"""
