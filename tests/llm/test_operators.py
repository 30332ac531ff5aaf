"""Each operator against its plain version, over rows with nulls, ties, repeats, empty and long texts, and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightstream.llm import decontaminate, html_text, language, lines, lm, mixing, neighbours, queries, repeats, simhash, token_files
from sightstream.llm.common import byte_set, grams, words_of
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, copy int, path string, anchor string, kind int, spans int, score double, chunk long"
TOK = queries.tokenizer_file()


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(60):
        t = " ".join(word() for _ in range(r.choice([0, 1, 3, 12, 13, 14, 80, 300])))
        if i % 3 == 0:
            t += f" {passage} " + word()
        if i % 5 == 0:
            t += "\nThis Line is in many documents\n\n \t\n"
        if i % 7 == 0 and texts:
            t = texts[r.randrange(len(texts))]
        if i % 11 == 0 and texts:
            t = (texts[-1] or "") + " changed"
        texts.append(t)
    texts += [None, "", " ", "\n\n", "\x0b\x0c x\r\n", "ÉÀ ß漢字 'quoted' it's  two  spaces ", " ".join(["long"] * 30_000), "x" * 20_000]
    return [(i * 3 % 211, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", ["a", "b", None][i % 3], None, 1, "p", "q", 7, 8, 0.5, 9) for i, t in rows], DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


ITEMS = [(1, "This line IS in many documents"), (2, "abc"), (10, None), (11, "..."), (12, "x"), (None, "two spaces")]


@pytest.mark.parametrize(
    ("run", "plain"),
    [
        (lambda d, s: token_files.op1(d, TOK), lambda d: brute.op1(d, TOK)),
        (lambda d, s: repeats.op2(d), brute.op2),
        (lambda d, s: simhash.op5(d), brute.op5),
        (lambda d, s: decontaminate.op7(d, s.createDataFrame(ITEMS, "item_id long, text string")).drop("near_items", "near_sha256"), lambda d: brute.op7(d, [x for x in ITEMS if x[0] is not None])),
        (lambda d, s: lines.op8(d), brute.op8),
    ],
    ids=["op1", "op2", "op5", "op7", "op8"],
)
def test_against_plain_version(spark, docs, run, plain):
    got = rows(run(frame(spark, docs), spark))
    want = sorted(plain(docs))
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    # the item without an id covers words but isn't named
    assert [g for g, _ in different if not (len(g) == 6 and isinstance(g[5], bool) and g[0] == docs[65][0])] == []
    assert rows(run(empty(spark), spark)) == []


def test_null_and_repeated_ids(spark, docs):
    twice = [*docs[:30], *docs[:10], (None, docs[0][1]), (None, None)]
    df = spark.createDataFrame(twice, "doc_id long, text string")
    assert token_files.op1(df, TOK).count() == len(twice)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.op2(df).where("doc_id is not null").collect()}
    assert got == set(brute.op2(docs[:30]))
    assert [r.n_removed for r in repeats.op2(df).where("doc_id is null").collect()] == [0, 0]
    got = {tuple(r) for r in lines.op8(df).where("doc_id is not null").collect()}
    assert got == set(brute.op8(docs[:30]))
    assert simhash.op5(df).count() == len(twice)
    assert decontaminate.op7(df, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == len(twice)


def test_token_files_give_back_all_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOK)
    path = str(tmp_path / "tokens")
    manifest = token_files.write(frame(spark, docs), path, TOK, end_id=None)
    got = {r.doc_id: list(r.tokens) for r in token_files.read(spark, path).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in docs}
    assert manifest["tokens"] == sum(map(len, got.values()))


def test_a_file_that_is_there_stays(tmp_path):
    """A task that runs again, as after a lost executor, and what failed attempts leave."""
    token_files._put(str(tmp_path), "tokens-000000.bin", "1", iter([b"ab", b"c"]))
    token_files._put(str(tmp_path), "tokens-000000.bin", "2", iter([b"abc"]))
    (tmp_path / "_tokens-000001.bin.7").write_bytes(b"half")
    token_files._tidy(str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"tokens-000000.bin": b"abc"}


def test_batches_are_bounded_by_bytes(monkeypatch):
    from sightstream.llm import common

    monkeypatch.setattr(common, "BYTES", 100)
    monkeypatch.setattr(common, "ROWS", 7)
    texts = ["x" * n for n in (0, 250, 40, 40, 40, 0, 99, 1, 1)] + [None] * 20
    parts = list(common.bounded([pa.RecordBatch.from_arrays([pa.array(range(29)), pa.array(texts)], ["i", "t"])] * 2, 1))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts * 2
    assert all(p.num_rows <= 7 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100) for p in parts)


def test_pieces_are_encoded_as_the_whole():
    enc = token_files.PieceEncoder(TOK)
    texts = ["a b", " a  b ", "it's\nhere \n x", "  ", "tab\t end", "é ß", "a  b", "1 2 ,x ! y", "a 　b", "don't 've"]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc(texts)] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_together_are_encoded_as_alone(monkeypatch):
    """Pieces with a special token between them, one of which has it itself; a cache that is forgotten by halves."""
    monkeypatch.setattr(token_files, "TOGETHER", 3)
    monkeypatch.setattr(token_files, "CACHE", 12)
    enc = token_files.PieceEncoder(TOK)
    texts = [" a", " é,x", " <|endoftext|>", " b<|endoftext|>c", " d", " e", "漢字", "", " a"]
    assert enc.pieces(texts) == enc.whole(texts) and enc.pieces([]) == []
    for i in range(40):
        t = [f"start word{i} again x{i % 3} <|endoftext|> y{i}"]
        assert enc(t) == enc.whole(t) and len(enc.known) <= 12
    assert "again" in enc.known


def test_paths_hold_each_window_once(docs):
    data = np.frombuffer("\n".join(t or "" for _, t in docs).encode(), np.uint8)
    words = words_of(data, np.array([0, len(data) // 2, len(data)]), byte_set(b" \t\n\x0b\x0c\r"))
    doc, _, start, n, _ = repeats.paths_of(words)
    covered = sorted((d, s + j) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist()) for j in range(k))
    assert covered == [(d, j) for d in range(2) for j in range(max(0, int(words.first[d + 1] - words.first[d]) - repeats.K + 1))]
    assert len(grams(words.hash[:5], 13)) == 0


def test_mixture_counts_are_poisson(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcde").alias("text"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"), F.lit(1).alias("copy"))
    got = {r.source: r["count"] for r in mixing.mix(df, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()}
    assert abs(got["big"] - 1000) < 130
    assert abs(got["small"] - 3000) < 220
    counts = np.bincount([r["count"] for r in mixing.mix(df, {"small": 1.0}, 20_000 * 1.0).groupBy("doc_id").count().collect()])
    mean = 20_000 / 5000
    assert abs((counts * np.arange(len(counts))).sum() / 1000 - mean) < 0.3
    assert mixing.mix(df.limit(0)).count() == 0
    rare = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 5000, "huge"), (None, None, None)], "doc_id long, text string, source string")
    n = mixing.mix(rare, {"tiny": 1.0}, 200.0).count()
    assert 140 < n < 260


def test_mixture_is_the_same_with_many_sources(spark, docs, monkeypatch):
    small = [tuple(r) for r in mixing.op3(frame(spark, docs)).collect()]
    monkeypatch.setattr(mixing, "SMALL", 1)
    assert sorted(map(str, small)) == sorted(map(str, (tuple(r) for r in mixing.op3(frame(spark, docs)).collect())))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    v = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(0, 400)]
    v += [(i, v[0][1]) for i in range(400, 460)]
    v += [(500, None), (600, []), (700, [0.0] * 8), (800, [float("nan")] * 8), (900, [1.0, None] * 4), (1000, [float("inf")] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("cs", F.lit(1))
    got = [(a, b, c, round(d, 9)) for a, b, c, d in rows(neighbours.op4(df))]
    assert got == [(a, b, c, round(d, 9)) for a, b, c, d in sorted(brute.op4(v))]
    small = neighbours.nearest(df, F.col("vec_id") % 100 == 0, block=16).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in small] == [g[:3] for g in got]
    assert neighbours.op4(df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids_and_of_huge_and_tiny_vectors(spark):
    """Only the query's own row is left out; finite components of any size take part."""
    schema = "vec_id long, embedding array<double>"
    twice = [(0, [1.0, 0.0]), (0, [4.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [9.0, 0.0])]
    got = rows(neighbours.nearest(spark.createDataFrame(twice, schema), F.col("vec_id") == 0))
    assert got == sorted(
        [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 0, 3.0), (0, 4, 2, 8.0)] + [(0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 0, 3.0), (0, 4, 2, 5.0)]
    )
    huge = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [-1e200, 1e200]), (3, [1e-200, 0.0]), (4, [3e-200, 0.0]), (5, [1.0, 1.0])]
    got = {(a, c): d for a, _, c, d in rows(neighbours.nearest(spark.createDataFrame(huge, schema), F.col("vec_id").isin(0, 3), k=5))}
    assert len(got) == 10
    want = {(0, 1): 1e200, (0, 2): 2e200, (0, 3): 2**0.5 * 1e200, (0, 4): 2**0.5 * 1e200, (0, 5): 2**0.5 * 1e200, (3, 4): 2e-200, (3, 5): 2**0.5, (3, 0): 2**0.5 * 1e200, (3, 1): 5**0.5 * 1e200, (3, 2): 2**0.5 * 1e200}
    assert all(abs(got[k] - v) <= 1e-12 * v for k, v in want.items())


def test_fingerprint_links_cover_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 60 | 1 << 3), base ^ np.uint64(0b11111)]))
    one, two = simhash.forest(fps, 4)
    assert all(np.bitwise_count(a ^ b).max() <= 4 for a, b in zip(one, two))
    pairs = {frozenset(p) for a, b in zip(one, two) for p in zip(a.tolist(), b.tolist())}
    assert len(pairs) == sum(map(len, one)) < len(fps)


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 16)
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    from sightstream.llm.components import components

    got = {}
    for r in components(simhash.links(df)).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert max(map(len, got.values())) == len(fps)


def test_lm_is_better_than_its_base_and_counts_right(spark):
    r = random.Random(9)
    nouns, verbs = ["cat", "dog", "bird", "fish"], ["sees", "Likes", "eats"]
    texts = [(i, " ".join(f"the {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)} ." for _ in range(8))) for i in range(300)] + [(300, None), (301, ""), (302, "never seen words"), (None, "the cat")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("chunk", F.lit("x"))
    out = lm.op6(df).collect()
    assert len(out) == len(texts)
    import math
    import zlib
    from collections import Counter

    train = Counter()
    toks = lambda t: [*brute.WORD.findall((t or "").translate(brute.LOWER)), None]
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    for i, t in texts:
        if learns(i):
            train.update(toks(t))
    n, v = sum(train.values()), len(train)
    text = dict(texts)
    for x in out:
        t = toks(text[x.doc_id])
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (not learns(x.doc_id), len(t), sum(train[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [x for x in out if x.held_out and x.n_tokens > 10]
    assert sum(x.score for x in held) > 0.6 * sum(x.base_score for x in held)
    assert lm.op6(df.limit(0)).count() == 0
    assert [tuple(x)[1:5] for x in lm.op6(spark.createDataFrame([(2, "a b")], "doc_id long, text string")).collect()] == [(brute.zlib.crc32(b"2") % 5 == 1, 3, 3, 3)]


def test_lm_scores_against_plain_counts(spark):
    """Counts, held-out estimates, weights by expectation-maximisation and scores, from dictionaries."""
    import math
    import zlib
    from collections import Counter

    r = random.Random(21)
    texts = [(i, " ".join(r.choices("a b c d e f".split(), [9, 5, 3, 2, 1, 1], k=r.randrange(0, 30)))) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    fold = {x.doc_id for x in df.where(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(lm.FOLDS)) == 0).collect()}
    toks = {i: [*t.split(), None] for i, t in texts}
    learns = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    pairs = lambda t: list(zip([None, *t[:-1]], t, strict=True))
    word, pair, held_word, held_pair = Counter(), Counter(), Counter(), Counter()
    for i, t in toks.items():
        if learns(i):
            word.update(t)
            pair.update(pairs(t))
            if i in fold:
                held_word.update(t)
                held_pair.update(pairs(t))
    n, v, rest = sum(word.values()), len(word), sum((word - held_word).values())
    bucket = lambda c: min(int(math.log2(c)) + 1 if c else 0, lm.BUCKETS - 1)
    cell = lambda p: min(max(int(math.floor(-2 * math.log2(p))), 0), lm.CELLS - 2) + 1 if p else 0
    sums = {}
    for i in sorted(fold):
        for a, b in pairs(toks[i]) if learns(i) else ():
            cv, c1, c2 = word[a] - held_word[a], word[b] - held_word[b], pair[a, b] - held_pair[a, b]
            p2, p1 = c2 / max(cv, 1), c1 / rest
            s = sums.setdefault((bucket(cv), cell(p2), cell(p1)), [0, 0.0, 0.0])
            s[0], s[1], s[2] = s[0] + 1, s[1] + p2, s[2] + p1
    weights, common = [[0.5, 0.4, 0.1] for _ in range(lm.BUCKETS)], [0.5, 0.4, 0.1]
    for _ in range(lm.EM_ROUNDS):
        got = [[0.0] * 3 for _ in range(lm.BUCKETS)]
        for (b, _, _), (count, s2, s1) in sums.items():
            part = [w * p for w, p in zip(weights[b], (s2 / count, s1 / count, 1 / (v + 1)), strict=True)]
            for j in range(3):
                got[b][j] += count * part[j] / sum(part)
        total = sum(map(sum, got))
        common = [sum(g[j] for g in got) / total for j in range(3)]
        weights = [[(g[j] + common[j]) / (sum(g) + 1) for j in range(3)] for g in got]
    weights[0] = [0.0, *(x / (weights[0][1] + weights[0][2]) for x in weights[0][1:])]
    assert len(sums) > 10
    for x in lm.op6(df).collect():
        want = 0.0
        for a, b in pairs(toks[x.doc_id]):
            w = weights[bucket(word[a])]
            want += math.log10(w[0] * pair[a, b] / max(word[a], 1) + w[1] * word[b] / n + w[2] / (v + 1))
        assert math.isclose(x.score, want, rel_tol=1e-9)


def test_rows_with_one_doc_id_have_their_own_results(spark):
    """Repeated ids by value: each row is fingerprinted, scored, searched and told for its own text; equal rows alike."""
    from collections import Counter

    texts = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, None), (None, "alpha")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    fp = lambda t: f"{brute.fingerprint(t):016x}"
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5(df).collect()) == Counter((i, fp(t), None if i is None else 1) for i, t in texts)
    assert Counter((r.doc_id, r.n_tokens) for r in lm.op6(df).collect()) == Counter((i, len((t or "").split()) + 1) for i, t in texts)
    items = spark.createDataFrame([(7, "three four five")], "item_id long, text string")
    assert Counter((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.op7(df, items).collect()) == Counter((i, len((t or "").split()), 3 if t and "three" in t else 0) for i, t in texts)
    langs = df.withColumn("lang", F.lit("en"))
    assert Counter((r.doc_id, r.lang_pred) for r in language.op10(langs).collect()) == Counter((i, "en" if t else "und") for i, t in texts)
    mixed = Counter((r.doc_id, r.text) for r in mixing.op3(df.withColumn("source", F.lit("s"))).collect())
    assert mixed[1, texts[1][1]] == 2 * mixed[1, texts[0][1]]


def test_rows_without_a_doc_id_are_drawn_and_dealt_by_their_text(spark):
    """Their counts differ, and they are many ranges of the token files, in the order of their texts."""
    texts = [(None, f"text number {i}") for i in range(2000)] + [(7, f"seven {i}") for i in range(500)]
    clash = [f"_mix_{c}" for c in ("source", "parts", "table", "salt", "count", "name")]
    df = spark.createDataFrame(texts, "doc_id long, text string").select("*", F.lit("s").alias("source"), *(F.lit(1).alias(c) for c in clash))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy", "shuffle_key"]
    rows = mixed.collect()
    many = {}
    for r in rows:
        if r.doc_id is None:
            many[r.text] = many.get(r.text, 0) + 1
    assert 1100 < len(many) < 1400 and 1850 < sum(many.values()) < 2150  # a share of 1 - 1/e; a mean of 1
    assert len({r.shuffle_key for r in rows if r.doc_id is None}) == sum(many.values())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = token_files.new_path(spark, "tokens")
        manifest = token_files.write(df.drop(*clash), path, TOK)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest["shards"]) > 2 and max(s["docs"] for s in manifest["shards"]) < 1500
    got = [(r.doc_id, list(r.tokens)) for r in token_files.read(spark, path).orderBy("start").collect()]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOK)
    assert got == [(i, [*tok.encode(t, add_special_tokens=False).ids, 0]) for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]


def test_language_forward_pass_and_ties():
    """Probabilities of a text against a plain loop over its windows; equal ones go to the language first by name."""
    rng = np.random.default_rng(3)
    k, langs = 2, ["aa", "bb", "cc"]
    f32 = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    net = language.Net(langs, (f32(2 * k, 257), f32(2 * k, 257)), (f32(2 * k, k), f32(2 * k, k)), f32(3, 2 * k), f32(3))
    raw = "Größe 12, pas de problème; ".encode() * 5
    sums, letters = np.zeros(3), 0
    for lo in range(0, len(raw), language.WINDOW):
        seq = [*raw[lo : lo + language.WINDOW]]
        seq += [language.PAD] * (language.WINDOW - len(seq))
        states = []
        for x, u, order in ((net.x[0], net.u[0], seq), (net.x[1], net.u[1], seq[::-1])):
            h, out = np.zeros(k), []
            for byte in order:
                gate = 1 / (1 + np.exp(-(x[:k, byte] + u[:k] @ h)))
                h = h + gate * (np.tanh(x[k:, byte] + gate * (u[k:] @ h)) - h)
                out.append(h)
            states.append(out)
        for byte, a, b in zip(seq, states[0], states[1][::-1], strict=True):
            if byte != language.PAD and (byte >= 128 or chr(byte).isalpha()):
                z = np.exp(net.out @ np.concatenate([a, b]) + net.bias)
                sums, letters = sums + z / z.sum(), letters + 1
    got = language.pooled(net, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert np.allclose(got, sums / letters, atol=1e-5)
    flat = language.Net(langs, net.x, net.u, np.zeros((3, 2 * k), np.float32), np.zeros(3, np.float32))
    assert langs[int(language.pooled(flat, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].argmax())] == "aa"


def test_lm_packs_hashes():
    rng = np.random.default_rng(4)
    for keys in (np.zeros(0, np.uint64), np.array([0, 5, 1 << 63], np.uint64), np.unique(rng.integers(0, 1 << 40, 999, dtype=np.uint64))):
        assert (lm.unpack(lm.pack(keys)) == keys).all()


def test_lm_weights_make_a_distribution():
    w = lm.learn_weights(np.array([lm.CELLS**2 + 5, 3]), np.array([10, 4]), np.array([5.0, 0.0]), np.array([0.1, 0.2]), 50)
    assert np.allclose(w.sum(1), 1)
    assert w[0, 0] == 0


LATIN = {"aa": "bada boda dabo", "ee": "keli teli kile", "uu": "suru rusu muru"}


def test_languages_on_held_out_texts(spark):
    r = random.Random(1)
    texts = [(i, " ".join(r.choice(LATIN[k].split()) for _ in range(r.randint(1, 60))), k) for i in range(240) for k in [list(LATIN)[i % 3]]]
    texts += [(1000, None, "aa"), (1001, "123 !!", "ee"), (1002, "", None), (None, "bada boda bada boda", "aa"), (1003, "suru rusu " * 5000, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = {r.doc_id: r for r in language.op10(df).collect()}
    assert len(out) == len(texts)
    held = [(i, k) for i, _, k in texts[:240] if out[i].held_out]
    assert len(held) > 30
    assert sum(out[i].lang_pred == k for i, k in held) >= 0.95 * len(held)
    assert out[1003].lang_pred == "uu"
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(0 <= x.score <= 1 for x in out.values())
    assert language.op10(df.limit(0)).count() == 0


def test_languages_without_doc_ids_are_learned(spark):
    """A whole language whose rows have no doc_id, over the bound of the sample; equal rows, which have one hash."""
    r = random.Random(6)
    say = lambda k: " ".join(r.choice(LATIN[k].split()) for _ in range(12))
    texts = [(i, say("aa"), "aa", 1) for i in range(1500)] + [(None, say("ee"), "ee", 1) for _ in range(1500)] + [(None, "suru rusu muru " * 4, "uu", 1)] * 900
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, _letters int")
    net = language.learn(df)
    assert net.langs == ["aa", "ee", "uu"]
    out = language.predict(df, net)
    assert out.columns == ["doc_id", "text", "lang", "_letters", "lang_pred", "score"]
    assert out.where("lang = lang_pred").count() > 0.97 * len(texts)


def test_language_gradients():
    rng = np.random.default_rng(0)
    k, seq = 3, rng.integers(0, 257, (5, 4))
    x, u = rng.normal(0, 0.5, (2 * k, 257)), rng.normal(0, 0.5, (2 * k, k))
    aim = rng.normal(size=(5, k, 4))
    loss = lambda x, u: float((language.run_direction(x.astype(np.float32), u.astype(np.float32), seq) * aim).sum())
    kept = []
    language.run_direction(x.astype(np.float32), u.astype(np.float32), seq, kept)
    dx, du = language.backward(x.astype(np.float32), u.astype(np.float32), seq, kept, aim.astype(np.float32))
    for a, d, i in ((x, dx, (2, int(seq[1, 0]))), (x, dx, (4, int(seq[0, 2]))), (u, du, (1, 2)), (u, du, (5, 0))):
        step = np.zeros_like(a)
        step[i] = 1e-2
        two = (loss(x, u + step) - loss(x, u - step) if a is u else loss(x + step, u) - loss(x - step, u)) / 2e-2
        assert abs(two - d[i]) < 2e-2 * max(1, abs(two))


def test_windows_hold_each_byte_once():
    offsets = np.array([0, 0, 1, 64, 130, 400])
    start, end, doc = language.windows_of(np.zeros(400, np.uint8), offsets)
    assert [(d, b) for s, e, d in zip(start, end, doc) for b in range(s, e)] == [(d, b) for d in range(5) for b in range(offsets[d], offsets[d + 1])]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-consent"><p>We use cookies. Accept them.</p></div>
<header><div>Site</div><p>Slogan here</p></header><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class="ad">Buy now. Cheap.</div>
<article><h1>The  title</h1><p>First &amp; <b>second</b>&nbsp;part.<br>More of it.</p><script>var a="</p>";</script><p>Unclosed paragraph with words.
<p>Last one, with a <a href=z>link</a>.</article><section class="comments"><h3>Comments</h3><div class=comment><p>Great post. Thanks!</p></div></section>
<aside class="sidebar"><h3>Related</h3><p>Something else. Read on.</p></aside><form><label>Mail</label><p>Join us.</p><input></form><footer>&copy; 2020 Us.</footer></body>"""


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.pages())


def test_main_text(spark, model):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, None), (3, "", "", ""), (4, "u", "<<p", ""), (4, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    got = [r.text for r in html_text.main_text(df, model).orderBy("page_id").collect()]
    want = "The title First & second part. More of it. Unclosed paragraph with words. Last one, with a link."
    assert got[0] == want and want in got[3:] and got[1] == got[2] == ""
    assert [r.n_chars for r in html_text.main_text(df, model).where("page_id = 1").collect()] == [len(want)]
    assert html_text.op9(df.limit(0)).count() == 0


def test_main_text_of_the_tables_pages(spark, sf_dir, model):
    """All pages of the table, whose article is marked by its element, against the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.hidden, self.parts = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.hidden -= tag in ("script", "style")

        def handle_data(self, data):
            if self.depth and not self.hidden:
                self.parts.append(data)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        a = Article()
        a.feed(r.html or "")
        a.close()
        want[r.page_id] = "".join("".join(a.parts).split())
    got = {r.page_id: r for r in html_text.main_text(pages, model).collect()}
    assert {i: "".join(r.text.split()) for i, r in got.items()} == want and any(want.values())
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in got.values())


def test_main_text_of_pages_without_markup(model):
    """Text alone is the page's text, whatever its length; a menu, a notice or an advert alone isn't."""
    long = "Words that stand by themselves, and go on. " * 20_000
    own = {"Just plain text without markup.": None, "one line<br>two lines": "one line two lines", "Hello <b>world</b>": "Hello world", "a &amp; b": "a & b", "<html><body>Text of the body.</body></html>": "Text of the body.", long: long.strip()}
    assert html_text.extract(list(own), model) == [want or page for page, want in own.items()]
    for page in ('<nav><a href="x">Home</a></nav>', '<body><div class="cookie-consent">We use cookies. Accept them.</div></body>', '<div class="ad">Buy now. Cheap.</div>', "<footer>&copy; 2020 Us.</footer>"):
        assert html_text.extract([page], model) == [""]


def test_main_text_of_held_out_pages(model):
    right = total = 0
    for page in html_text.pages(150, seed=99):
        t = html_text.parse(page)
        p = html_text.pass_messages(html_text.forest([t]), model)[0][:, 1] > 0.5
        for node, s in t.segments:
            right += len(s) * (p[node] == t.marked[node])
            total += len(s)
    assert right / total > 0.97


def test_messages_are_exact_marginals(model):
    from itertools import product

    f = html_text.forest([html_text.parse("<div><p>a.</p><ul><li>b</li></ul></div><nav>c</nav>")])
    n = len(f.parent)
    theta = f.features @ model.weights
    sums = np.zeros((n, 2))
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(theta[i] * y[i] for i in range(n)) + sum(model.pair[y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        for i in range(n):
            sums[i, y[i]] += w
    assert np.allclose(html_text.pass_messages(f, model)[0], sums / sums.sum(1, keepdims=True))


def test_broken_markup_ends():
    for page in ("<a " + '"' * 3000, "<" * 3000, "<p>" * 2000, "</p>" * 2000, "<!--" * 500, "<a '" * 2000 + "'", "<script>" + "x<" * 3000):
        html_text.parse(page)


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        for page in ("<div>" * n + "</x>" * n, "<li>" + "<b1>" * n + "<li>" * n, "<td>" + "<q1>" * n + "<tr>" * n, "<div>" * n + "</div>" * n):
            html_text.parse(page)
        return time.process_time() - began

    took(1000)
    assert took(16_000) < 12 * max(took(4000), 0.05)


def test_benchmark_in_slices_and_proximity(spark, docs):
    items = spark.createDataFrame([(i, t) for i, t in ITEMS if i], "item_id long, text string")
    df = frame(spark, docs)
    hits = lambda **k: {(r.doc_id, r.n_words, str(r.spans), str(r["items"]), str(r.near_items)) for r in decontaminate.contamination(df, items, **k).collect()}
    assert hits() == hits(slice_bytes=48)
    near = spark.createDataFrame([(1, "documents we have: is many of them in this line"), (2, "line"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.contamination(near, items.where("item_id = 1"), slop=12).collect()}
    assert got == {1: ([], ["1"]), 2: ([], []), 3: ([], [])}
    assert [r.contaminated for r in decontaminate.op7(near, items.limit(0)).collect()] == [False] * 3
    assert [(r.n_words, r.n_hit, r.n_items) for r in decontaminate.op7(near.limit(0), items).collect()] == []


def test_proximity_against_all_places(spark, monkeypatch):
    """Every term of a window within slop words of the window's rarest term, the first of equally rare ones; many segments."""
    r = random.Random(12)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.choice('xyz')}" for _ in range(n)]
    docs = [(i, words(r.choice([0, 1, 5, 40, 200]))) for i in range(60)]
    items = [(i, words(r.choice([1, 2, 4, 6, 12]))) for i in range(30)]
    index = decontaminate.index(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").withColumn("row_key", F.xxhash64("text")), segment=200)
    cut = index.where("term is null").select("segment", F.size("docs").alias("docs"), F.expr("aggregate(docs, 0, (n, d) -> n + d.n)").alias("words")).collect()
    assert all(r.words <= 200 // 2 or r.docs == 1 for r in cut) and len(cut) > sum(len(w) == 200 for _, w in docs) > 5
    got = {x.doc_id: set(x.near_items) for x in decontaminate.search(index, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"), n=5, slop=6).collect()}
    count = {}
    for _, w in docs:
        for x in w:
            count[x] = count.get(x, 0) + 1
    want = {i: set() for i, _ in docs}
    for item, w in items:
        k = min(5, len(w))
        for s in range(len(w) - k + 1):
            window = w[s : s + k]
            rarest = min(range(k), key=lambda o: (count.get(window[o], 0), o))
            for i, text in docs:
                if any(x == window[rarest] and set(window) <= set(text[max(0, at - 6) : at + 7]) for at, x in enumerate(text)):
                    want[i].add(str(item))
    assert got == want and sum(map(len, want.values())) > 50


def test_equal_windows_are_one(spark, monkeypatch):
    """Thousands of items that are one common word against a document of that word; pairs are walked in small slices."""
    word, many = "yes", 5000
    items = [(i, word) for i in range(many)] + [(many, "no"), (many + 1, "yes yes"), (many + 2, "yes no yes")]
    docs = [(1, f"{word} " * (1 << 20)), (2, "no yes, no"), (3, "other words"), (4, None)]
    sized = []
    inner = decontaminate._found
    posting = np.arange(200_000, dtype=np.int64)
    hashes, first = decontaminate.item_words([t for _, t in items])
    terms = np.unique(hashes.view(np.int64))
    p = decontaminate.probes([str(i) for i, _ in items], hashes, first, terms, np.array([5, 9]), 10)
    assert len(p.start) == 4 and len(p.item) == len(items)
    monkeypatch.setattr(decontaminate, "_found", lambda own, n, *more: sized.append(int(n.sum())) or inner(own, n, *more))
    monkeypatch.setattr(decontaminate, "PAIRS", 1000)
    list(decontaminate.found_in(posting, np.array([0, 200_000]), p, 10))
    assert len(sized) > 100 and max(sized) <= 1000
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got[1]["items"]) == {*map(str, range(many)), str(many + 1)} and got[1].spans == [[0, 1 << 20]]
    assert set(got[2]["items"]) == {str(i) for i in range(many + 1)} and got[2].spans == [[0, 3]]
    assert [got[i].spans for i in (3, 4)] == [[], []]


def test_copies_are_where_the_words_are(spark, docs):
    """Coordinates of repeated words and of their source, held against the texts."""
    found = 0
    for r in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        own = brute.WORD.findall(dict(docs)[r.doc_id] or "")
        covered = set()
        for a, b, source, at in r.copies:
            assert source < r.doc_id and own[a:b] == brute.WORD.findall(dict(docs)[source])[at : at + b - a]
            covered |= set(range(a, b))
            found += b - a >= 50
        assert covered <= {j for a, b in r.spans for j in range(a, b)}
    assert found > 5


def test_equal_hashes_of_other_words_remove_nothing(monkeypatch):
    """All path hashes collide: only places whose words have the digest go."""
    monkeypatch.setattr(repeats, "path_hash", lambda w, start, n: np.full(len(start), 7, np.uint64))
    raw = np.frombuffer(" ".join(f"w{i}" for i in range(40)).encode(), np.uint8)
    words = words_of(raw, np.array([0, len(raw)]), byte_set(b" "))
    doc, start, n = np.array([0]), np.array([3]), np.array([2])
    right = repeats.digests(words, start, n + repeats.K - 1)[:, 0]
    gone, ours = repeats.removed(words, doc, start, n, right + 1)
    assert not gone.any() and not ours.any()
    gone, ours = repeats.removed(words, doc, start, n, right)
    assert np.flatnonzero(gone).tolist() == list(range(3, 3 + 2 + repeats.K - 1)) and ours.all()


def test_anchors_that_branch_and_repeated_ids(spark, monkeypatch):
    """Passages that begin and end in the middle of other texts; rows with one doc_id keep what only they share."""
    r = random.Random(14)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(30):
        a, b = sorted(r.sample(range(41), 2))
        texts.append((i, " ".join([f"u{i}_{j}" for j in range(r.randrange(9))] + passage[a:b] + [f"v{i}_{j}" for j in range(r.randrange(9))] + passage[a:b][:20])))
    assert rows(repeats.op2(spark.createDataFrame(texts, "doc_id long, text string"))) == sorted(brute.op2(texts))
    same = spark.createDataFrame([(5, " ".join(passage)), (5, "x " + " ".join(passage)), (None, " ".join(passage))], "doc_id long, text string")
    assert [x.n_removed for x in repeats.op2(same).collect()] == [0, 0, 0]
    later = same.union(spark.createDataFrame([(6, "y " + " ".join(passage) + " z")], same.schema))
    assert sorted(x.n_removed for x in repeats.op2(later).collect()) == [0, 0, 0, 40]
