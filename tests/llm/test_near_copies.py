"""Near copies of the pipeline against all pairs, and groups too large for all pairs."""

import random

import corpus_pipeline
from sightstream.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_groups(texts):
    """Pairs at 0.8 or more, and the smallest index of each text's component."""
    sets, at, pairs = [shingles(t) for t in texts], list(range(len(texts))), []
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                pairs.append((j, i))
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = [new if x == old else x for x in at]
    return pairs, at


def changed(r, words, n):
    out = list(words)
    for p in r.sample(range(len(out)), n):
        out[p] = f"w{r.randrange(10**9)}"
    return out


def stay(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}


def test_near_copies_with_changed_words_go(spark):
    """Recall and precision against all pairs; under op5's 4 bits most of these pairs stayed."""
    r = random.Random(3)
    texts = ["", None, "One two", "one  TWO", "one two three"]
    for _ in range(150):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 500))]
        texts += [" ".join(base), " ".join(changed(r, base, max(1, len(base) * r.randrange(3, 40) // 1000)))]
    pairs, at = brute_groups(texts)
    assert len(pairs) > 80
    assert any(at[i] == i for i in range(6, len(texts), 2))
    assert stay(spark, texts) == set(at)


def test_recall_near_the_border(spark):
    """Pairs of a similarity from 0.8 to 0.85 alone: what the index misses of them."""
    r = random.Random(7)
    texts = []
    for _ in range(400):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(100, 400))]
        texts += [" ".join(base), " ".join(changed(r, base, max(1, round(len(base) * r.uniform(0.018, 0.023)))))]
    sets = [shingles(t) for t in texts]
    near = [i for i in range(0, 800, 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) <= 0.85]
    got = stay(spark, texts)
    assert len(near) > 60 and {i for i in range(0, 800, 2)} <= got
    assert sum(i + 1 not in got for i in near) >= 0.95 * len(near)


def test_fingerprints_of_sets():
    """Bits that over half of the hashes have, for sets of any size."""
    rng = random.Random(2)
    sets = [near_copies.np.unique(near_copies.np.array([rng.getrandbits(64) for _ in range(n)], near_copies.np.uint64)) for n in (1, 0, 2, 3, 254, 255, 256, 700)]
    got = near_copies.fingerprints_of(sets)
    for s, fps in zip(sets, got, strict=True):
        for j, fp in enumerate(fps.tolist()):
            h = near_copies.mix(s ^ near_copies._SEEDS[j]).tolist()
            assert fp == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_repeated_rows_and_a_full_filter(spark, monkeypatch):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A b c d e f  g", "y"), (3, "other words", "z"), (3, "still other words", "z"), (None, None, None), (4, "", None), (5, "h i j", "v"), (5, "h i j", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _word string")
    got = lambda: sorted((str(r.doc_id), str(r.text)) for r in near_copies.one_of_each(df).collect())
    want = [("1", "a b c d e f g"), ("3", "other words"), ("3", "still other words"), ("4", ""), ("5", "h i j")]
    assert got() == want
    monkeypatch.setattr(near_copies, "FILTER", 64)
    assert got() == want
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_runs_of_the_index_cross_batches(spark):
    rows = spark.createDataFrame([((k << 16) + n, 10 * k + i) for k in range(50) for i, n in enumerate([10, 12, 13, 40][: k % 5])], "kn long, node long")
    got = {(r.key, r.node) for r in near_copies.met(rows).where("chunk = 0").collect()}
    assert got == {(k, 10 * k + i) for k in range(50) for i in ([], [], [0, 1], [0, 1, 2], [0, 1, 2])[k % 5]}


def test_chunks_of_a_key_meet_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SPLIT", 3)
    rows = spark.createDataFrame([((5 << 16) + 10, i) for i in range(8)] + [((9 << 16) + 10, i) for i in range(2)], "kn long, node long").repartition(3)
    met = near_copies.met(rows).collect()
    assert sorted(r.chunk for r in met if r.key == 5) == [0, 0, 0, 1, 1, 1, 2, 2]
    units = {r.node: set(r.units) for r in near_copies.units_of(spark.createDataFrame(met, "key long, chunk long, node long")).collect()}
    chunk = {r.node: r.chunk for r in met if r.key == 5}
    assert all(len(units[a] & units[b]) >= 1 for a in range(8) for b in range(8))
    assert all(len(units[i]) == 3 + (i < 2) for i in range(8)) and set(chunk.values()) == {0, 1, 2}


def test_a_large_group_is_found_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SPLIT", 16)
    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)] + [" ".join(changed(r, base, 3)) for _ in range(120)] + [" ".join(f"v{r.randrange(999)}" for _ in range(50)) for _ in range(20)]
    _, at = brute_groups(texts)
    assert stay(spark, texts) == set(at) == {0, *range(121, 141)}
