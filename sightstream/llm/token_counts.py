"""Operator 13: how many tokens each text has, by lookups in two tiers on the map side.

Byte-level BPE cuts a text into pre-tokens, and no merge reaches over a cut, so a text's count is the sum of its
pre-tokens' lengths. Tier 1 is a table of the TABLE most frequent pre-tokens and their lengths, broadcast to all workers
as one buffer. What it lacks is looked up in tier 2, a cache that each worker fills by encoding its misses with the
library, a batch at a time. No pre-token is ever shuffled.

The frequent pre-tokens come from all texts: each task keeps a summary of SUMMARY counts (Misra and Gries: when it
overflows, the count of the first one that has to go is taken off all), and summaries, a row each, are merged FAN at a
time until one is left. Whatever the table holds, counts are exact: it only saves work.

Pre-tokens are found by the tokenizer's own pattern. Python's classes of characters are of another Unicode version than
the library's, so a character counts as known once both cut it alike; a piece with any other character goes to the
library whole. Long texts are cut where a single space stands between two other characters, since nothing reaches over
that. Tokenizers that are not byte-level BPE (.json of other kinds, sentencepiece's .model) get whole texts.

Nulls and ties: a null text is empty and has no tokens; a null doc_id stays null. Each row is counted by itself, also
repeated ones. Other columns are ignored. An empty table gives no rows, from an empty table of frequent pre-tokens.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import bounded, stored, trim, tune

#: Pre-tokens that are broadcast; counts that a summary has in the end, and while a task makes it; summaries merged at once.
TABLE = 32_768
SUMMARY, COUNTING = 32_768, 400_000
FAN = 32

#: Pre-tokens that a worker remembers beside the table.
CACHE = 1_000_000

#: Characters of a piece of a long text, about.
PIECE = 1 << 18

LIMIT = 1024

#: How byte-level BPE cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> Iterator[str]:
    """The text in parts that are encoded alike alone."""
    lo = 0
    while len(text) - lo > PIECE:
        cut = _CUT.search(text, lo + PIECE)
        if not cut:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


class Lengths:
    """A tokenizer's token counts, by pre-tokens where that gives the library's counts."""

    def __init__(self, tokenizer: str) -> None:
        import regex

        self.known: dict[str, int] = {}
        self.frequent: dict[str, int] = {}
        self.pattern = None
        if tokenizer.endswith(".model"):
            import sentencepiece

            self.piece_model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.piece_model = None
        self.tok = Tokenizer.from_file(tokenizer)
        self.tok.no_truncation()
        self.tok.no_padding()
        what = json.loads(self.tok.to_str())
        pre, added = what["pre_tokenizer"] or {}, what["added_tokens"]
        plain = not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if plain and what["normalizer"] is None and what["model"]["type"] == "BPE" and not what["model"].get("dropout") and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.pattern = regex.compile(PATTERN)
            names = sorted((a["content"] for a in added), key=len, reverse=True)
            self.special = re.compile("|".join(map(re.escape, names))) if names else None
            self.alike, self.unlike = set(), set()

    def whole(self, texts: list[str]) -> list[int]:
        if self.piece_model:
            return list(map(len, self.piece_model.encode(texts, num_threads=1)))
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _told(self, text: str) -> bool:
        """Whether the pattern cuts all characters of text as the library does; new ones are tried by themselves."""
        if self.alike.issuperset(text):
            return True
        for c in set(text) - self.alike - self.unlike:
            probe = f"a{c}! a{c}1 "
            spans = [span for _, span in self.tok.pre_tokenizer.pre_tokenize_str(probe)]
            (self.alike if spans == [m.span() for m in self.pattern.finditer(probe)] else self.unlike).add(c)
        return self.alike.issuperset(text)

    def cut(self, text: str) -> tuple[int, list[list[str]], list[str]]:
        """(special tokens, lists of pre-tokens, parts that the library has to take whole)."""
        specials, found, rest = 0, [], []
        for piece in pieces(text):
            parts = [piece]
            if self.special and self.special.search(piece):
                parts = self.special.split(piece)
                specials += len(parts) - 1
            for p in parts:
                if self._told(p):
                    found.append(self.pattern.findall(p))
                elif p:
                    rest.append(p)
        return specials, found, rest

    def remember(self, frequent: dict[str, int]) -> None:
        """Tier 1; what a worker remembered beside an older table is kept."""
        self.frequent = frequent
        self.known.update(frequent)

    def __call__(self, texts: list[str]) -> list[int]:
        if self.pattern is None:
            return self.whole(texts)
        if len(self.known) > len(self.frequent) + CACHE:
            self.known = dict(self.frequent)
        cuts = [self.cut(t) for t in texts]
        known = self.known
        if new := list({x for _, found, _ in cuts for pre in found for x in pre if x not in known}):
            known.update(zip(new, self.whole(new), strict=True))
        get = known.__getitem__
        return [n + sum(sum(map(get, pre)) for pre in found) + sum(self.whole(rest) if rest else ()) for n, found, rest in cuts]


@lru_cache(1)
def lengths(tokenizer: str) -> Lengths:
    return Lengths(tokenizer)


# --- the table of frequent pre-tokens ---

KIND = "part long, tokens array<string>, counts array<long>"


def cut_down(counts: Counter, n: int) -> Counter:
    """The n largest counts, less the largest of the others. Equal counts go by name."""
    if len(counts) <= n:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    least = int(np.partition(values, len(values) - n - 1)[len(values) - n - 1])
    return Counter({k: v - least for k, v in counts.items() if v > least})


def _row(part: int, counts: Counter) -> pa.RecordBatch:
    kept = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    return pa.RecordBatch.from_pydict({"part": [part], "tokens": [[k for k, _ in kept]], "counts": [[v for _, v in kept]]}, pa.schema([("part", pa.int64()), ("tokens", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))


def summaries(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs: text -> a row for each task: its most frequent pre-tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = lengths(tokenizer), Counter()
        for b in bounded(batches, 0):
            for t in b.column(0).to_pylist():
                for pre in of.cut(t or "")[1]:
                    counts.update(pre)
                    if len(counts) > 2 * COUNTING:
                        counts = cut_down(counts, COUNTING)
        yield _row(TaskContext.get().partitionId(), cut_down(counts, SUMMARY))
        del counts
        trim()

    return docs.select("text").mapInArrow(run, KIND)


def merged(rows: pa.Table) -> pa.Table:
    counts: Counter = Counter()
    for tokens, many in zip(rows["tokens"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        counts.update(dict(zip(tokens, many, strict=True)))
    return pa.Table.from_batches([_row(rows["part"][0].as_py(), cut_down(counts, SUMMARY))])


def frequent(docs: DataFrame, tokenizer: str, size: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of all texts, as far as summaries tell, most frequent first."""
    rows = stored(summaries(tune(docs), tokenizer), "pre-tokens")
    parts = rows.count()
    while parts > 1:
        parts = -(-parts // FAN)
        rows = stored(rows.withColumn("part", F.col("part") % parts).groupBy("part").applyInArrow(merged, KIND), "pre-tokens")
    found = rows.select(F.slice("tokens", 1, size).alias("tokens")).collect()
    return list(found[0].tokens) if found else []


def packed(tokens: list[str], counts: list[int]) -> bytes:
    """One buffer: lengths of the pre-tokens in tokens and in bytes, then their bytes."""
    raw = [t.encode() for t in tokens]
    return np.array([len(raw), *counts, *map(len, raw)], "<u4").tobytes() + b"".join(raw)


def unpacked(buffer: bytes) -> dict[str, int]:
    n = int(np.frombuffer(buffer, "<u4", 1)[0])
    head = np.frombuffer(buffer, "<u4", 2 * n, 4)
    ends = np.cumsum(head[n:]) + 4 + 8 * n
    return {buffer[end - size : end].decode(): many for many, size, end in zip(head[:n].tolist(), head[n:].tolist(), ends.tolist(), strict=True)}


def token_counts(docs: DataFrame, tokenizer: str, size: int = TABLE) -> DataFrame:
    """The columns of docs (text and any others) and n_tokens, which replaces a column of that name."""
    of = lengths(tokenizer)
    docs = tune(docs).drop("n_tokens")
    tokens = frequent(docs, tokenizer, size) if of.pattern else []
    table = docs.sparkSession.sparkContext.broadcast(packed(tokens, of.whole(tokens) if tokens else []))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lengths(tokenizer)
        of.remember(unpacked(table.value))
        for b in bounded(batches, at):
            n = of([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(n, pa.int64())], [*b.schema.names, "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, n_tokens long")


def op13(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = token_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), tokenizer)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
