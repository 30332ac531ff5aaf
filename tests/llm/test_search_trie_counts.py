"""Operators 11 to 13 against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightstream.llm import prefix_trie, ranked, token_counts
from sightstream.llm.queries import tokenizer_file
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- operator 11 ---


def plain_ranked(docs, items, k=10):
    terms = [(i, Counter(TERM.findall((t or "").translate(brute.LOWER)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(x for _, c in terms for x in c)
    out = []
    for item, text in items:
        wanted = set(TERM.findall((text or "").translate(brute.LOWER)))
        found = []
        for i, c in terms:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m)) for x in wanted if x in c)
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -score) for r, (score, i) in enumerate(sorted(found)[:k], 1)]
    return out


def texts(r, n):
    words = [f"w{i}" for i in range(30)] + ["É", "漢字", "x1", "The", "the"]
    docs = [(i * 7 % 1009, " ".join(r.choices(words, range(len(words), 0, -1), k=r.choice([0, 1, 5, 40])))) for i in range(n)]
    docs += [(2000 + i, "w3 w3 copy w9") for i in range(30)] + [(None, "w3 w29 w28"), (None, None), (3001, None), (3002, ""), (3003, "-- ..."), (3004, "w1 " * 5000 + "rare"), (5, "w29 twice"), (5, "w29 twice")]
    return docs


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("shard", [1, 400, 1 << 20])
def test_ranked_against_all_scores(spark, shard):
    r = random.Random(shard)
    docs = texts(r, 150)
    items = [(1, "w3 W9 w28, the"), (2, "rare w1"), (3, None), (4, "not-there"), (5, ""), (None, "É 漢字 x1"), (7, "copy"), (7, "w29"), (8, " ".join(t or "" for _, t in docs[:20]))]
    df = spark.createDataFrame([(i, t, 1, 2, "q") for i, t in docs], "doc_id long, text string, score int, rank int, query string").repartition(3)
    of = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    want = key(plain_ranked(docs, items))
    assert key(ranked.ranked(df, of, shard=shard).collect()) == want and len(want) > 50
    assert key(ranked.ranked(df, of, shard=shard, slice_bytes=40).collect()) == want
    assert key(ranked.ranked(df, of, k=3, shard=shard).collect()) == key(plain_ranked(docs, items, 3))
    assert ranked.op11(df.limit(0), of).count() == ranked.op11(df, of.limit(0)).count() == 0
    assert ranked.op11(df.where("text is null"), of).count() == 0


def test_ranges_of_a_tree_begin_with_the_largest_impact():
    """At each node, a term's range has its postings among the node's documents, by falling impact."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(37)
    doc = rng.integers(0, 37, 900)
    term = rng.integers(1, 9, 900).astype(np.uint64)
    length = np.bincount(doc, minlength=37)
    row = ranked.shard_row(term, doc, ids.astype(np.int64), length, ranked.Collection(37, 900)).to_pylist()[0]
    tree = ranked.Tree(row)
    postings = {t: {int(ids[d]): int(ranked.impacts_of(np.array([n]), np.array([length[d]]), ranked.Collection(37, 900))[0]) for d, n in Counter(doc[term == t].tolist()).items()} for t in range(1, 9)}
    for t in range(1, 9):
        nodes = [(0, 0, int(tree.starts[t - 1]), int(tree.starts[t]))]
        while nodes:
            level, prefix, lo, hi = nodes.pop()
            below = [v for i, v in postings[t].items() if i >> (tree.levels - level) == prefix]
            assert hi - lo == len(below) and tree.impacts[level * tree.n + lo : level * tree.n + hi].tolist() == sorted(below, reverse=True)
            if level < tree.levels and hi > lo:
                a, b = tree.ones(np.array([level, level]), np.array([lo, hi])).tolist()
                z = int(tree.zeros[level])
                nodes += [(level + 1, 2 * prefix, lo - a, hi - b), (level + 1, 2 * prefix + 1, z + a, z + b)]


def test_waiting_nodes_are_bounded(spark, monkeypatch):
    """Deepest nodes first once too many wait: the same results."""
    docs = texts(random.Random(8), 120)
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = key(ranked.op11(df, items).collect())
    monkeypatch.setattr(ranked, "WAITING", 8)
    monkeypatch.setattr(ranked, "BEST", 2)
    assert key(ranked.op11(df, items).collect()) == want


# --- operator 12 ---


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seq = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    nodes = {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        gain = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += gain
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if seq[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


CONV = "conv_id long, turn long, role string, text string, n int, ids string, bucket int, seq int, depth int, key string"


def conversations(r, n):
    rows = []
    for c in range(n):
        if c % 7 == 3:
            continue
        for t in range(r.choice([1, 2, 5, 12])):
            rows.append((c, t, r.choice("ab"), r.choice(["hi", "ho", "é", "long text"])))
    rows += [(c, t, "a", f"common {t}") for c in range(1000, 1060) for t in range(25)]  # copies
    rows += [(c, t, "a", f"common {t}" if t < 20 else f"own {c} {t}") for c in range(1100, 1130) for t in range(22)]
    rows += [(2000, None, None, None), (2000, None, "z", ""), (2000, 1, "a", None), (2000, 1, "a", None), (2000, 1, "A", "x"), (None, 0, "a", "hi"), (3000, 0, "", ""), (3001, 5, "q", "0"), (3001, -5, "q", "1")]
    rows += [(4001, i, "u", f"{i % 3}") for i in range(250)]
    return rows


@pytest.mark.parametrize("local", [1, 12, 100_000])
def test_trie_against_all_prefixes(spark, local):
    rows = conversations(random.Random(local), 90)
    df = spark.createDataFrame([(*x, 1, "i", 2, 3, 4, "k") for x in rows], CONV).repartition(3)
    assert trie_rows(prefix_trie.prefix_trie(df, local=local)) == plain_trie(rows)


def test_trie_of_little(spark):
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie.op12(empty).count() == 0
    none = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.op12(none).count() == 0
    for rows in ([(1, 0, "a", "b")], [(1, 0, "a", "b"), (2, 0, "a", "b")], [(5, t, "a", "b") for t in range(3)] + [(6, t, "a", "b") for t in range(3)]):
        assert trie_rows(prefix_trie.op12(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == plain_trie(rows)


def test_ends_of_many_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(s, c) for s in (1, 2, 9) for c in range(s, 200, 3)]
    got = {r.seq: r.ends for r in prefix_trie.ends_of(spark.createDataFrame(rows, "seq long, conv_id long").repartition(4)).collect()}
    assert got == {s: hashlib.sha256(",".join(map(str, range(s, 200, 3))).encode()).hexdigest() for s in (1, 2, 9)}


# --- operator 13 ---

ODD = ["", None, " ", "\n\n x", "it's 'tis we'll 'S", "a  b   c\t\td ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "<|endoftext", "É漢字 ١٢ x²", "\x1c \x1d\x85x", "a​b \U0001e5d0\U00010d4a", "don't 1234 ...!?", "word " * 200_000, "x" * 5000]


def test_token_counts_are_the_librarys(spark, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "twice"), (1, "twice"), (None, "no id")]
    want = sorted((str(i), len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens int, tokens string").repartition(5)
    told = lambda out: sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    assert told(token_counts.op13(df, tokenizer_file())) == want
    assert token_counts.token_counts(df, tokenizer_file(), size=3).columns == ["doc_id", "text", "tokens", "n_tokens"]
    assert sorted(r.n_tokens for r in token_counts.token_counts(df, tokenizer_file(), size=1).collect()) == sorted(w[2] for w in want)
    assert token_counts.op13(df.limit(0), tokenizer_file()).count() == 0


def test_all_characters_are_cut_as_by_the_library():
    """Each character between others: told by the pattern, or left to the library."""
    of = token_counts.Lengths(tokenizer_file())
    for lo in range(0, 0x110000, 0x400):
        cs = [chr(c) for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000]
        if lo < 0x3000 or lo % 0x4000 == 0:
            sample = ["".join(f"{c}1 {c}{c}a'{c}s " for c in cs)] + [f"a{c} {c}1" for c in cs[::37]]
            assert of(sample) == of.whole(sample)


def test_other_tokenizers_take_whole_texts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD[:12])], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.op13(df, path).collect()} == {i: len(model.encode(t or "")) for i, t in enumerate(ODD[:12])}


def test_long_texts_are_cut_where_nothing_reaches_over(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "PIECE", 5)
    of, tok = token_counts.Lengths(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    for t in [x for x in ODD[:13] if x] + ["a b  c d e  f <|endoftext|> g h \n i"]:
        assert "".join(token_counts.pieces(t)) == t
        assert of([t]) == [len(tok.encode(t, add_special_tokens=False).ids)]


def test_frequent_pre_tokens_are_the_frequent_ones(spark, monkeypatch):
    """Summaries that overflow and are merged still hold what is frequent; the table holds lengths by pre-token."""
    for name, value in (("SUMMARY", 20), ("COUNTING", 30), ("FAN", 2)):
        monkeypatch.setattr(token_counts, name, value)
    r = random.Random(2)
    df = spark.createDataFrame([(" ".join([f"r{r.randrange(10**6)}", "often", "often", f"m{r.randrange(3)}"]),) for _ in range(400)], "text string").repartition(7)
    counts = token_counts.cut_down(Counter({"a": 9, "b": 5, "c": 5, "d": 1}), 2)
    assert counts == {"a": 4}
    got = token_counts.frequent(df, tokenizer_file(), 5)
    assert " often" in got and len(got) <= 5
    table = {" a": 1, "漢": 3, "": 0}
    assert token_counts.unpacked(token_counts.packed(list(table), list(table.values()))) == table


def test_the_cache_of_a_worker_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 10)
    of = token_counts.Lengths(tokenizer_file())
    of.remember({" word": 1})
    for i in range(50):
        of([f" word x{i} y{i}"])
        assert len(of.known) <= 10 + 1 + 4
    assert " word" in of.known
