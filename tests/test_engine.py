"""Small cases with known results, and properties, of the engine's operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sightstream.functions import audio as S
from sightstream.functions import text as T
from sightstream.operators import audio as A
from sightstream.operators import classify as C
from sightstream.operators import export as X
from sightstream.operators import layout as L
from sightstream.operators import memory as M
from sightstream.operators import storage as Q
from sightstream.operators import transcript as R
from sightstream.operators import windows as W
from sightstream.plans import transcript as plans
from sightstream.sources import asr
from sightstream.sources.files import wav_files

SAMPLE = "session_id long, seq long, t long, display_id long, text string, role string, x double, y double, w double, h double"


def samples(spark, rows):
    return spark.createDataFrame([(1, i, t, d, text, role, x, y, 10.0, 10.0) for i, (t, d, text, role, x, y) in enumerate(rows)], SAMPLE)


def one(spark, **columns):
    return spark.range(1).select(**{}) if not columns else spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_text(spark):
    r = one(spark, n=T.normalize(F.lit("  Limited\n time  OFFER ")), t=T.trimmed(F.lit(" \n a b \t")), w=T.normalized_words(F.lit("Él, don't — 3 x")), c=T.word_count(F.lit(" a  b\n")), clock=T.clock(F.lit(61.239)), p=T.percent(F.lit(0.456)))
    assert (r.n, r.t, r.w, r.c, r.clock, r.p) == ("limited time offer", "a b", ["el", "don", "t", "3", "x"], 2, "01:01.24", "46%")
    r = one(spark, a=T.timestamp_seconds(F.lit("01:02:03,500")), b=T.timestamp_seconds(F.lit("1:2")), c=T.timestamp_seconds(F.lit("x:y:z")), d=T.has_text(F.lit(" \n")), e=T.text_hash(F.lit("A")) == T.text_hash(F.lit(" a ")))
    assert (r.a, r.b, r.c, r.d, r.e) == (3723.5, None, None, False, True)
    r = one(spark, a=T.device_label(F.lit("Mic"), F.lit("ACME")), b=T.device_label(F.lit("ACME Mic"), F.lit("ACME")), c=T.device_label(F.lit("Mic"), F.lit("")))
    assert list(r) == ["Mic - ACME", "ACME Mic", "Mic"]


def test_duplicate_boxes_are_a_fold(spark):
    # the second lies over the first, the third over the second only: the second goes, so that the third stays
    rows = [(1, 0, 1, "A b", 0.0, 0.0, 100.0, 20.0, 0.9), (1, 1, 1, "a  B", 25.0, 0.0, 100.0, 20.0, 0.8), (1, 2, 1, "a b", 50.0, 0.0, 100.0, 20.0, 0.7), (1, 3, 1, " ", 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, obs_idx int, display_id long, text string, x double, y double, w double, h double, confidence double")
    assert sorted(r.obs_idx for r in L.drop_duplicate_boxes(df).collect()) == [0, 2]


def test_lines_blocks_regions(spark):
    rows = [(1, i, 1, t, x, y, 100.0, 20.0, 1.0) for i, (t, x, y) in enumerate([("right", 200.0, 2.0), ("left", 0.0, 0.0), ("next", 0.0, 30.0), ("far", 0.0, 500.0)])]
    df = spark.createDataFrame(rows, "doc_id long, obs_idx int, display_id long, text string, x double, y double, w double, h double, confidence double")
    lines, blocks, regions, digests = L.build(df)
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["left right", "next", "far"]
    assert [r.text for r in blocks.orderBy("block_no").collect()] == ["left right\nnext", "far"]
    assert [(r.x, r.y, r.w, r.h) for r in blocks.orderBy("block_no").collect()] == [(0.0, 0.0, 300.0, 50.0), (0.0, 500.0, 100.0, 20.0)]
    assert regions.count() == 2 and digests.count() == 1


@pytest.mark.parametrize(
    ("text", "x", "y", "w", "h", "role"),
    [
        ("Sponsored", 0.4, 0.4, 0.2, 0.05, "ad"), ("let x = {", 0.4, 0.4, 0.2, 0.05, "codeOrLog"), ("$ 12.50", 0.4, 0.4, 0.2, 0.05, "priceOrNumber"), ("Sign in", 0.4, 0.4, 0.2, 0.05, "buttonLike"), ("Learn more", 0.4, 0.4, 0.9, 0.05, "linkLike"),
        ("https://a.b", 0.4, 0.4, 0.2, 0.05, "linkLike"), ("Inbox", 0.1, 0.4, 0.2, 0.05, "navigation"), ("Date", 0.4, 0.2, 0.2, 0.05, "formLabel"), ("Enter your city", 0.4, 0.4, 0.2, 0.05, "inputPlaceholder"), ("Owner", 0.4, 0.2, 0.2, 0.05, "tableHeader"),
        ("word " * 20, 0.4, 0.4, 0.2, 0.05, "paragraph"), ("it is so, is it not then?", 0.3, 0.4, 0.4, 0.05, "chatMessage"), ("Big News", 0.4, 0.1, 0.2, 0.05, "heading"), ("on 3/4 we all went home", 0.4, 0.5, 0.1, 0.05, "metadata"), ("some four lower words", 0.4, 0.5, 0.1, 0.05, "tableCell"),
        ("one two three four five six seven eight nine", 0.4, 0.5, 0.1, 0.05, "unknown"), ("  ", 0.4, 0.4, 0.2, 0.05, "unknown"),
    ],
)
def test_roles(spark, text, x, y, w, h, role):
    df = spark.createDataFrame([(1, 1, 0, "the first", 0.0, 0.0, 0.1, 0.1), (1, 1, 1, text, x, y, w, h)], "doc_id long, display_id long, block_no long, text string, x double, y double, w double, h double")
    assert C.classify(df, F.lit(1.0), F.lit(1.0)).where("block_no = 1").first().role == role


def test_encounters(spark):
    rows = [(100, 1, "Limited time offer", "ad", 0.0, 1.0), (101, 1, " limited   time OFFER ", "ad", 0.0, 2.0), (100, 2, "Submit", "buttonLike", 0.0, 0.0), (101, 1, "Submit", "buttonLike", 0.0, 0.0), (162, 1, "Submit", "x", 0.0, 0.0), (222, 1, "Submit", "x", 0.0, 0.0), (300, 1, "a", "x", 0.0, 0.0)]
    got = {(r.display_id, r.text, r.run): r.seen_count for r in W.encounters(samples(spark, rows), ["session_id"]).collect()}
    assert got == {(1, "Limited time offer", 0): 2, (2, "Submit", 0): 1, (1, "Submit", 0): 1, (1, "Submit", 1): 2}
    s = W.ingest_summary(samples(spark, rows)).first()
    assert (s.total, s.new, s.updated, s.pruned) == (6, 4, 2, 1)


@pytest.mark.parametrize(("times", "want"), [([1000, 1059], []), ([2000, 2060], [(2000, 2060)]), ([3000, 3060, 3119, 3120], [(3000, 3060), (3060, 3120)]), ([0, 200, 230, 260], [(0, 200), (200, 260)])])
def test_windows(spark, times, want):
    df = samples(spark, [(t, 1, "xy", "x", 0.0, 0.0) for t in times])
    assert [(r.started_at, r.ended_at) for r in W.windows(df).orderBy("window_no").collect()] == want


def test_segments(spark):
    rows = [(0, 1, "Article body alpha", "paragraph", 0.0, 100.0), (1, 1, "Article body bravo", "paragraph", 0.0, 150.0), (2, 1, "Home", "navigation", 0.0, 0.0), (3, 2, "Editor pane code", "codeOrLog", 0.0, 0.0), (60, 1, "Home", "navigation", 0.0, 0.0)]
    segs = W.segments(W.sealed_encounters(samples(spark, rows)))
    got = {(r.display_id, r.role): (r.text, r.lines, r.sightings) for r in segs.collect()}
    assert got == {(1, "paragraph"): ("Article body alpha Article body bravo", 2, 2), (1, "navigation"): ("Home", 1, 2), (2, "codeOrLog"): ("Editor pane code", 1, 1)}
    assert "### Segments\n- d1 role=navigation lines=1 sightings=2 repeatedUI=false" in W.analysis(segs).first().summary_markdown
    often = [(t, 1, "Home", "navigation", 0.0, 0.0) for t in range(61)] + [(5, 1, "text of it", "paragraph", 0.0, 0.0), (30, 1, "text of it", "paragraph", 0.0, 0.0)]
    assert {r.role: r.repeated_ui for r in W.segments(W.sealed_encounters(samples(spark, often))).collect()} == {"navigation": True, "paragraph": False}
    doc = X.segment_document(segs).first()
    assert (doc.displays, doc.encounters) == (2, 4)


def test_window_longer_than_time_to_live_loses_encounters(spark):
    rows = [(0, 1, "early", "x", 0.0, 0.0), (100, 1, "late one", "x", 0.0, 0.0)]
    assert [r.text for r in W.sealed_encounters(samples(spark, rows)).collect()] == ["late one"]


def test_snapshots(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, "a", "l"), (1, 1, 1, 1, "a", "l"), (1, 1, 2, 2, None, None), (1, 1, 3, 3, None, None), (2, 1, 4, 4, "a", "l"), (1, 1, 5, 900, "a", "l")], "session_id long, display_id long, seq long, t long, text_hash string, layout_hash string")
    assert sorted(r.seq for r in M.changed(df, ["session_id"], ["t", "seq"]).collect()) == [0, 2, 4, 5]
    assert sorted(r.seq for r in M.first_of_each(df, ["t", "seq"]).collect()) == [0, 2]
    runs = M.document_runs(df)
    assert {r.seq: r.document_seq for r in runs.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert sorted(r.seq for r in M.cached_documents(runs).collect()) == [4, 5]
    assert sorted(r.seq for r in M.not_stored(df, df.where("seq = 0")).collect()) == [2, 3]


def test_voice(spark):
    tone = [0.0] * 16000 + [math.sin(2 * math.pi * 440 * i / 16000) for i in range(16000)] + [0.0] * 16000
    df = spark.createDataFrame([("a", tone, 16000.0, 1), ("b", [0.0] * 100, 16000.0, 1), ("c", [], 16000.0, 1), ("d", [0.1, 0.2], 16000.0, 2)], "source string, samples array<float>, sample_rate double, channels int")
    got = {r.source: r for r in A.voice(df).collect()}
    assert 1.17 < len(got["a"].trimmed) / 16000 < 1.43
    assert [got[k].error for k in "abcd"] == [None, "no voice", "no samples", "not mono"]


def test_signals(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)).cast("float") for x in v))
    r = one(spark, d=S.downmix(arr(1, 3, 5, 7), F.lit(2)), up=S.resample(arr(0, 1), F.lit(1.0), F.lit(2.0)), e=S.resample(arr(), F.lit(1.0), F.lit(2.0)), q=S.quantize(arr(-2, -1, 0, 0.5, 2)), c=S.correlation(arr(1, 2), arr(-2, -4, 9)), z=S.correlation(arr(0), arr(1)), i=S.interleave(F.array(arr(1, 2), arr(3, 4))))
    assert (r.d, r.up, r.e, r.q, r.z, r.i) == ([2.0, 6.0], [0.0, 0.5, 1.0, 1.0], [], [-32768, -32768, 0, 16384, 32767], 0.0, [1.0, 3.0, 2.0, 4.0])
    assert math.isclose(r.c, 1.0)


def test_chunks_overlap_and_the_tail_waits(spark):
    r = random.Random(1)
    sizes = [r.choice([0, 2, 6, 50, 128]) for _ in range(40)]
    rows, n = [], 0
    for i, k in enumerate(sizes):
        rows.append((i, "m", [float(v) for v in range(n, n + k)], 10.0, 2))
        n += k
    df = spark.createDataFrame(rows, "packet_id long, source string, samples array<float>, sample_rate double, channels int")
    got = A.chunks(A.checked(df).where("error is null"), 5.0, 1.0).orderBy("seq").collect()
    count = (n // 2 - 50) // 40 + 1
    assert [x.seq for x in got] == list(range(count))
    assert all(x.samples == [float(v) for v in range(x.seq * 80, x.seq * 80 + 100)] and x.start_frame == x.seq * 40 for x in got)
    with pytest.raises(ValueError):
        A.chunks(df, 1.0, 1.0)


def test_wav_round_trip(spark, tmp_path):
    df = spark.range(1).select(S.wav_bytes(S.quantize(F.array(*(F.lit(x) for x in (0.0, 0.5, -1.0)))), F.lit(16000.0)).alias("b"))
    (tmp_path / "x.wav").write_bytes(df.first().b)
    r = wav_files(spark, str(tmp_path)).first()
    assert (r.sample_rate, r.channels) == (16000.0, 1)
    assert [round(x, 3) for x in r.samples] == [0.0, 0.5, -1.0]


ASR = '{"result":{"language":"en"},"transcription":[{"timestamps":{"from":"00:00:00,000","to":"00:00:02,500"},"offsets":{"from":0,"to":2500},"text":" Hello world."},{"timestamps":{"from":"00:00:02,500","to":"00:00:05,000"},"text":" This is a smoke test."}]}'


def test_recognised_speech(spark):
    r = one(spark, a=asr.parse(F.lit(ASR)), b=asr.parse(F.lit("no json")))
    assert (r.a.language, r.a.text, len(r.a.segments), r.a.duration, r.b) == ("en", "Hello world. This is a smoke test.", 2, 5.0, None)


@pytest.mark.parametrize(("a", "b", "want"), [("", "hello", "hello"), ("hello world", "world again", "hello world again"), ("same", "same", "same"), ("hello", "other", "hello ther")])
def test_append(spark, a, b, want):
    from sightstream.streaming.processors import append_deduplicated

    assert one(spark, x=R.append_deduplicated(F.lit(a), F.lit(b))).x == want == append_deduplicated(a, b)


CHUNK = "session_id long, source string, seq long, chunk_id string, start_time double, duration double, language string, text string"


def test_duplicates(spark):
    rows = [(1, "computer", 1, "computer_001", 5.0, 5.0, None, "The deadline is tomorrow morning."), (1, "microphone", 1, "microphone_001", 5.05, 5.0, None, "the deadline is tomorrow morning"), (1, "computer", 2, "computer_002", 60.0, 5.0, None, "Completely different topic about lunch."),
            (2, "computer", 3, "computer_003", 5.0, 5.0, None, "Thanks."), (2, "microphone", 3, "microphone_003", 5.05, 5.0, None, "Thanks.")]
    df = spark.createDataFrame(rows, CHUNK)
    got = R.duplicates(df).collect()
    assert [(r.primary_id, r.duplicate_id) for r in got] == [("computer_001", "microphone_001")]
    assert got[0].confidence >= 0.50 and "text_jaccard" in got[0].signals
    s = R.scored(R.candidates(df)).where("session_id = 2").first()
    assert s.confidence < 0.50 and "filler_penalty" in s.signals
    assert R.first_annotation(df, R.duplicates(df)).where("duplicate_of is not null").count() == 1


def taken_in(rows):
    """Plain ingestion of (session, source, seq, id, start, duration): pairs of a chunk with those in the other source's window."""
    windows, out = {}, []
    for session, source, seq, name, start, duration, *_ in sorted(rows, key=lambda c: (c[4] + c[5], c[2], c[1], c[3])):
        own = windows.setdefault((session, source), [])
        own.append((name, start, duration))
        windows[session, source] = [c for c in own if c[1] + c[2] >= start + duration - 30][-20:]
        other = "microphone" if source == "computer" else "computer"
        for n, s, d in windows.get((session, other), []):
            if duration + d > max(start + duration, s + d) - min(start, s) or abs(start - s) < 0.5:
                out.append((session, name, n))
    return out


def test_candidates_are_those_of_the_window(spark, monkeypatch):
    """Sparse and dense sessions (more than 20 chunks in 30 s), chunks without length, long ones, a silent source."""
    monkeypatch.setattr(R, "BLOCK_SECONDS", 7.0)
    r = random.Random(2)
    rows = []
    for i in range(600):
        session = i % 3
        start = round(r.random() * (200, 20, 2000)[session], 2)
        rows.append((session, r.choice(["computer", "microphone"]), i, f"c{i:03d}", start, r.choice([0.0, 0.2, 5.0, 45.0]), None, "x"))
    rows += [(3, "microphone", 0, "m", 0.0, 1.0, None, "x")] + [(3, "computer", i, f"k{i}", 0.5, 0.1 * i, None, "x") for i in range(1, 60)]
    got = [(p.session_id, p.new_chunk_id, p.old_chunk_id) for p in R.candidates(spark.createDataFrame(rows, CHUNK)).collect()]
    want = taken_in(rows)
    assert sorted(got) == sorted(want) and len(want) > 1000
    most = {}
    for s, new, _ in got:
        most[s, new] = most.get((s, new), 0) + 1
    assert max(most.values()) == 20


def test_first_annotation_is_the_first_that_is_found(spark):
    rows = [(1, "computer", 1, "z", 0.0, 5.0, "en", "the very same words here"), (1, "computer", 2, "a", 0.0, 5.0, "en", "the very same words here"), (1, "microphone", 3, "m", 0.1, 5.0, "en", "the very same words here")]
    df = spark.createDataFrame(rows, CHUNK)
    assert [r.duplicate_of for r in R.first_annotation(df, R.duplicates(df)).where("chunk_id = 'm'").collect()] == ["z"]


def test_sound_counts_in_the_score(spark):
    chunk = CHUNK + ", samples array<double>, sample_rate double"
    rows = [(1, "computer", 1, "a", 0.0, 5.0, "en", "some four words here", [1.0, -1.0], 8.0), (1, "microphone", 2, "b", 0.1, 5.0, "en", "others of another kind", [0.5, -0.5], 8.0), (2, "computer", 1, "a", 0.0, 5.0, "en", "some four words here", [1.0, -1.0], 8.0), (2, "microphone", 2, "b", 0.1, 5.0, "en", "others of another kind", [0.5, -0.5], 9.0), (3, "computer", 1, "a", 0.0, 5.0, "en", "x y z", None, 8.0), (3, "microphone", 1, "b", 0.0, 5.0, "en", "x y w", [], 8.0)]
    got = R.duplicates(spark.createDataFrame(rows, chunk), pcm=True).collect()
    assert [(r.session_id, r.signals) for r in got] == [(1, ["time_overlap", "duration_match", "language_match", "pcm_correlation"])]


def test_running_text_in_any_order_and_with_blanks(spark):
    r = random.Random(6)
    words = ["ab", "AB", "ba", "Straße", "İx", "c", " "]
    rows = [(s, i, " ".join(r.choice(words) for _ in range(r.randint(0, 9))), r.choice([None, "en", "de"])) for s in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id long, seq long, text string, language string").orderBy(F.rand(1))
    want = {}
    for s, _, t, language in rows:
        t = t.strip(R.WHITE)
        text, n, last = want.get(s, ("", 0, None))
        if t:
            k = next((k for k in range(min(len(text), len(t), 160), 0, -1) if text[-k:].lower() == t[:k].lower()), 0)
            rest = t[k:].strip(R.WHITE) if text else t
            want[s] = (f"{text} {rest}" if text and rest else text or rest, n + 1, language or last)
    got = {x.session_id: (x.text, x.chunks, x.language) for x in R.running_state(df, ["session_id"]).collect()}
    assert got == want
    sums = {x.session_id: (x.characters, x.chunks, x.language) for x in R.running_sums(df, ["session_id"]).collect()}
    assert sums == {s: (len(t), n, la) for s, (t, n, la) in want.items()}


def test_samples_of_windows(spark):
    """Each sample in the window that it is sealed in, against a plain scan; gaps, equal times, a given start."""
    r = random.Random(8)
    rows, t = [], {s: 0 for s in range(4)}
    for i in range(800):
        s = r.randrange(4)
        t[s] += r.choice([0, 0, 1, 5, 20, 61, 400])
        rows.append((s, i, t[s], 1, "x", "x", 0.0, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, SAMPLE)
    for start in (None, 50):
        want = []
        for s in range(4):
            own = sorted((x[2], x[1]) for x in rows if x[0] == s)
            anchor, number, held = own[0][0] if start is None else start, 0, []
            for at, seq in own:
                held.append(seq)
                if at - anchor >= 60:
                    number += 1
                    want += [(s, q, number, anchor, at) for q in held]
                    anchor, held = at, []
        got = [(x.session_id, x.seq, x.window_no, x.started_at, x.ended_at) for x in W.assign(df, start=None if start is None else F.lit(start)).collect()]
        assert sorted(got) == sorted(want)


def test_split_and_pack(spark):
    r = random.Random(3)
    texts = ["\n".join("ab" * r.randint(0, 30) for _ in range(r.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for row in df.select("text", X.split_oversized(F.col("text"), F.lit(25)).alias("parts")).collect():
        assert all(0 < len(p) <= 25 for p in row.parts)
        assert "".join(row.parts).replace("\n", "") == row.text.replace("\n", "")


def test_chunks_hold_all_blocks(spark, sf_dir):
    from sightstream.plans.text import as_lines, observations

    b = L.blocks(as_lines(observations(spark, sf_dir).where("doc_id < 20")))
    got = X.chunks(L.regions(b), b, 300).collect()
    assert all(r.character_count <= 300 for r in got)
    text = {}
    for r in sorted(got, key=lambda r: int(r.alias[1:])):
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
    for r in b.collect():
        assert all(line[:200].replace("\n", "") in text[r.doc_id].replace("\n", "") for line in r.text.split("\n"))


def test_store(spark, tmp_path):
    store = Q.Store(spark, str(tmp_path / "t"), "id bigint, session string, seq bigint, t bigint, note string", ["session", "seq"], {"note": "none"})
    rows = lambda *r: spark.createDataFrame(list(r), "session string, seq bigint, t bigint, note string")
    assert store.append(rows(("a", 1, 5, "x"), ("a", 1, 6, "y"), ("b", 1, 7, None)), ["t"]).rejected.count() == 1
    assert store.append(rows(("a", 1, 9, "z"), ("c", 1, 8, "q")), ["t"]).rejected.count() == 1
    got = sorted((r.id, r.session, r.t, r.note) for r in store.read().collect())
    assert sorted(x[0] for x in got) == [1, 2, 3] and {x[1:] for x in got} == {("a", 5, "x"), ("b", 7, "none"), ("c", 8, "q")}
    store.delete_older("t", F.lit(7))
    assert sorted(r.t for r in store.read().collect()) == [7, 8]
    store.clear()
    assert store.read().count() == 0
    good, bad = Q.save_texts(spark.createDataFrame([(1, " a "), (2, " \n"), (3, None)], "i long, text string"))
    assert [(r.text, r.character_count) for r in good.collect()] == [("a", 1)] and bad.count() == 2


def test_browser(spark, sf_dir):
    assert plans.union_sources(spark, sf_dir).count() == 100
