"""Operator 1: token ids in flat binary files that are read by memory mapping.

Layout of a folder: for each shard s, in ascending document order,
    tokens-s.bin   flat unsigned integers, little-endian, 16 bits if the vocabulary fits, else 32
    offsets-s.bin  n_docs + 1 unsigned 64-bit integers: at which token of the whole collection each document starts
    ids-s.bin      n_docs signed 64-bit doc ids; a null id is the smallest 64-bit integer
and manifest.json with a record for each shard (documents, tokens, base). The base of a shard is the prefix sum
of the token counts of the shards before it, so that only one record a shard ever reaches the driver.

Documents are range-partitioned by doc_id and the first characters of their text, so that many rows with one id, or without
one, are many ranges in the order that sorting gives them; each task encodes and writes its range, and files get their names by an
atomic rename of what a task finished, so that a task that runs again or twice leaves the same files.

Nulls and ties: a null text is empty (its document is the end id alone), rows with the same doc_id are kept, ordered by
their text; null ids come first. Other columns are ignored. An empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightstream.llm.common import bounded, new_path, tune

NO_ID = np.iinfo(np.int64).min
MANIFEST = "shard long, docs long, tokens long"

#: A space between two characters that are not white space starts a new pre-token of byte-level BPE, and nothing reaches over it.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
NEAR_SPACE = re.compile(r" \s|\s ")

#: Characters of a text by which rows of one doc_id, or without one, are ranged.
HEAD = 64

#: Pieces that a Python worker remembers, at most but for those of one batch; pieces that are encoded together.
CACHE = 1_000_000
TOGETHER = 64


class PieceEncoder:
    """The tokenizers library over pieces between safe cuts; what it gave for a piece is remembered, since words recur."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.byte_level = type(self.tok.pre_tokenizer).__name__ == "ByteLevel" and self.tok.normalizer is None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known until `known` was half of CACHE: words that recur move on
        special = [(i, t.content) for i, t in sorted(self.tok.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.marker = special[0] if special else None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str]) -> list[bytes]:
        """whole() of many short texts, of which some are encoded as one: a special token stands between them."""
        if self.marker is None or not texts:
            return self.whole(texts)
        number, name = self.marker
        groups = [texts[lo : lo + TOGETHER] for lo in range(0, len(texts), TOGETHER)]
        out: list[bytes] = []
        wide = self.dtype.itemsize
        for own, e in zip(groups, self.tok.encode_batch_fast([name.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(ids == number) * wide).tolist()
            if len(ends) != len(own) - 1:  # it is in a text, too
                out += self.whole(own)
                continue
            raw, starts = ids.tobytes(), [0, *(x + wide for x in ends)]
            out += [raw[a:b] for a, b in zip(starts, [*ends, len(raw)], strict=True)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.byte_level:
            return self.whole(texts)
        parts = []
        for t in texts:
            if t[:1].isspace() or t[-1:].isspace() or NEAR_SPACE.search(t):
                p = SAFE_CUT.split(t)
            else:
                p = t.split(" ")
            first, rest = p[0], p[1:]
            parts.append((first, rest))
        if len(self.known) > CACHE // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        distinct: set[str] = set()
        for _, rest in parts:
            distinct.update(rest)
        missing = [x for x in distinct if x not in known]
        known.update((x, before[x]) for x in missing if x in before)
        new = [x for x in missing if x not in known]
        known.update(zip(new, self.pieces([" " + x for x in new]), strict=True))
        heads = self.whole([first for first, _ in parts])
        get = known.__getitem__
        return [h + b"".join(map(get, rest)) for h, (_, rest) in zip(heads, parts, strict=True)]


@lru_cache(1)
def encoder(tokenizer: str) -> PieceEncoder:
    return PieceEncoder(tokenizer)


def _store(path: str):  # noqa: ANN202
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _put(path: str, name: str, attempt: str, chunks: Iterator[bytes]) -> None:
    """Written aside and renamed. A task that runs again may find the file there: it is the same, so its own goes. Some stores
    refuse to rename onto a file, which then is the same case."""
    store, at = _store(path)
    aside, whole = f"{at}/_{name}.{attempt}", f"{at}/{name}"
    with store.open_output_stream(aside) as f:
        for c in chunks:
            f.write(c)
    there = lambda: store.get_file_info(whole).type.name == "File"
    try:
        if not there():
            store.move(aside, whole)
            return
    except OSError:
        if not there():
            raise
    store.delete_file(aside)


def _tidy(path: str) -> None:
    """What attempts that failed have left goes, once all files are whole."""
    from pyarrow import fs

    store, at = _store(path)
    for f in store.get_file_info(fs.FileSelector(at)):
        if f.base_name.startswith("_"):
            store.delete_file(f.path)


def _get(path: str, name: str, dtype: str) -> np.ndarray:
    """Mapped into memory where the store is a file system of the machine, else read."""
    if local := _local(path):
        file = f"{local}/{name}"
        return np.memmap(file, dtype, "r") if os.path.getsize(file) else np.zeros(0, dtype)
    store, at = _store(path)
    return np.frombuffer(store.open_input_file(f"{at}/{name}").read(), dtype)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0) -> dict:
    """Encodes docs (doc_id, text) and writes the folder; returns its manifest. end_id is appended to each document."""
    spark = docs.sparkSession

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        ids, lengths, s = [], [], task.partitionId()

        def chunks() -> Iterator[bytes]:
            for b in bounded(batches, 1):
                ids.append(b.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False))
                coded = enc([t or "" for t in b.column(1).to_pylist()])
                lengths.append(np.fromiter(map(len, coded), np.int64, len(coded)) // enc.dtype.itemsize + bool(end))
                yield b"".join(x for c in coded for x in (c, end))

        attempt = str(task.taskAttemptId())
        _put(path, f"tokens-{s:06d}.bin", attempt, chunks())
        n = sum(map(len, lengths))
        if n:
            sizes = np.concatenate(lengths)
            _put(path, f"ids-{s:06d}.bin", attempt, iter([np.concatenate(ids).astype("<i8").tobytes()]))
            _put(path, f"lengths-{s:06d}.bin", attempt, iter([sizes.astype("<i8").tobytes()]))
            yield pa.RecordBatch.from_pydict({"shard": [s], "docs": [n], "tokens": [int(sizes.sum())]})

    store, at = _store(path)
    store.create_dir(at, recursive=True)
    ordered = tune(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    shards = sorted((r.asDict() for r in ordered.mapInArrow(shard, MANIFEST).collect()), key=lambda r: r["shard"])
    base = 0
    for r in shards:
        r["base"], base = base, base + r["tokens"]
    manifest = {"dtype": encoder(tokenizer).dtype.str, "end_id": end_id, "tokens": base, "docs": sum(r["docs"] for r in shards), "shards": shards}
    bases = {r["shard"]: r["base"] for r in shards}

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                lengths = _get(path, f"lengths-{s:06d}.bin", "<i8")
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(bases[s])
                _put(path, f"offsets-{s:06d}.bin", str(TaskContext.get().taskAttemptId()), iter([starts.tobytes()]))
            yield b

    _each(spark, shards).mapInArrow(offsets, "shard long").count()
    _tidy(path)
    _put(path, "manifest.json", "driver", iter([json.dumps(manifest).encode()]))
    return manifest


def _each(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """A row for each shard, each in a partition of its own."""
    if not shards:
        return spark.createDataFrame([], "shard long")
    numbers = [r["shard"] for r in shards]
    return spark.range(0, len(numbers), 1, len(numbers)).select(F.element_at(F.lit(numbers), (F.col("id") + 1).cast("int")).cast("long").alias("shard"))


def manifest_of(path: str) -> dict:
    store, at = _store(path)
    return json.loads(store.open_input_file(f"{at}/manifest.json").read())


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and either the token ids, or with digest the crc32 of them as 32-bit integers, by one task a shard."""
    manifest = manifest_of(path)
    dtype = manifest["dtype"]
    last = "ids_crc32 long" if digest else "tokens array<long>"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                tokens, starts, ids = _get(path, f"tokens-{s:06d}.bin", dtype), _get(path, f"offsets-{s:06d}.bin", "<u8").astype(np.int64), _get(path, f"ids-{s:06d}.bin", "<i8")
                local = starts - starts[0]
                for lo in range(0, len(ids), 256):
                    hi = min(lo + 256, len(ids))
                    own = [tokens[local[i] : local[i + 1]] for i in range(lo, hi)]
                    if digest:
                        x = pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in own], pa.int64())
                    else:
                        x = pa.array([t.astype(np.int64) for t in own], pa.list_(pa.int64()))
                    doc = np.asarray(ids[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(starts[lo:hi]), pa.array(np.diff(starts[lo : hi + 1])), x], ["doc_id", "start", "n_tokens", last.split()[0]])

    return _each(spark, manifest["shards"]).mapInArrow(load, f"doc_id long, start long, n_tokens long, {last}")


def op1(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from files that were written and read again."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer)
    return read(spark, path, digest=True)
