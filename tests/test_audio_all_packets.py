"""The five queries over signals work on all packets, held against plain Python."""


import numpy as np

from sightstream.plans import all_queries


def run(spark, sf_dir, name):
    return all_queries()[name][0](spark, sf_dir).collect()


def quantized(v):
    x = max(-1.0, min(1.0, v))
    y = x * 32768 if x < 0 else x * 32767
    return int(np.floor(abs(y) + 0.5)) * (-1 if y < 0 else 1)


def test_every_packet_has_its_rows(spark, sf_dir):
    packets = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert any(i % 5 for i in packets)
    pcm = {i: [quantized(v) for v in s] for i, s in packets.items()}
    assert {r.packet_id: r.pcm for r in run(spark, sf_dir, "pcm_quantize")} == {i: ",".join(map(str, p)) for i, p in pcm.items()}
    wav = run(spark, sf_dir, "wav_files")
    assert {r.packet_id: r.n_bytes for r in wav} == {i: 44 + 2 * len(s) for i, s in packets.items()}
    got = {(r.packet_id, r.frame): r.sample for r in run(spark, sf_dir, "pcm_decode")}
    want = {(i, k): float(np.float32(v / 32767)) for i, p in pcm.items() for k, v in enumerate(p)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    got = {(r.packet_id, r.i): r.sample for r in run(spark, sf_dir, "interleave")}
    assert got == {(i, (k % 32) * 2 + k // 32): v for i, s in packets.items() for k, v in enumerate(s)}
    got = {(r.packet_id, r.frame): r.sample for r in run(spark, sf_dir, "resample_linear")}
    want = {}
    for i, s in packets.items():
        for f in range(round(len(s) * 0.8)):
            lo = min(int(f * 1.25), len(s) - 1)
            want[i, f] = s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (f * 1.25 - lo)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
