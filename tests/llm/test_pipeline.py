"""The pipeline against plain versions of its stages; what stays when the subpackage is gone."""

import hashlib
import math
import re
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from sightstream.llm import language
from sightstream.llm.queries import tokenizer_file
from tests.llm import brute
from tests.llm.test_near_copies import brute_groups

ROOT = Path(__file__).resolve().parents[2]


def poisson_copies(docs):
    """docs: (doc_id, text, source) -> doc_ids, each as often as it is drawn."""
    size = {}
    for _, t, s in docs:
        size[s or ""] = size.get(s or "", 0) + len(t or "")
    weight = {s: math.floor(math.sqrt(n) * 1000) for s, n in size.items()}
    out = []
    for i, _, s in docs:
        s = s or ""
        rate = sum(size.values()) * weight[s] / sum(weight.values()) / size[s] if size[s] and weight[s] else 0.0
        parts = max(1, math.ceil(rate / 16))
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"42:{i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u and k < 101:
                k += 1
                p *= rate / parts / k
                c += p
                out.append(i)
    return out


def test_pipeline_against_plain_stages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    net = language.learn(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in table if r.lang is not None], "doc_id long, text string, lang string"))
    rows = {}
    for r in table:
        raw = (r.text or "").encode()
        if any(c.isalpha() for c in r.text or ""):
            p = language.pooled(net, language.np.frombuffer(raw, "u1"), language.np.array([0, len(raw)]))[0]
            if p.max() >= corpus_pipeline.SURE:
                rows[r.doc_id] = r
    ids = sorted(rows)
    _, at = brute_groups([rows[i].text for i in ids])
    rows = {ids[k]: rows[ids[k]] for k in sorted(set(at))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {x[0]: rows[x[0]] for x in brute.op7([(i, r.text) for i, r in rows.items()], items) if not x[5]}
    copies = poisson_copies([(i, r.text, r.source) for i, r in rows.items()])
    want = brute.op1([(i, rows[i].text) for i in copies], tokenizer_file())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(want)
    assert 0 < len(rows) < len(table)


def test_stages_give_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (3, "", "en", None, 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
        assert stage(spark, odd, sf_dir).count() <= 8
    kept = corpus_pipeline.near_duplicates(spark, odd.union(odd), sf_dir).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "None"), ("1", "a b c")]


def test_the_rest_works_without_the_subpackage(tmp_path):
    """corpus_pipeline.py stays in one copy and goes with the folders in the other."""
    for name, gone in (("r", ("llm",)), ("s", ("llm", "corpus_pipeline.py"))):
        shutil.copytree(ROOT, tmp_path / name, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
        code = """
import __spark_entry__ as e
assert len(e.queries()) > 90 and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.queries()["doc_hash"](spark, "/root/testdata/sf0.001").count() == 200
"""
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / name, check=True, timeout=180)
    outside = [p for p in (ROOT / "sightstream").rglob("*.py") if "llm" not in p.parts and re.search(r"sightstream\.llm|from sightstream import llm", p.read_text())]
    assert outside == []
