import os
import shutil
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparselens.llm import cotrain, decontam
from test_simhash import brute_components, brute_print

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_against_brute_force(spark, small):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, small).cache()
        seen.append((name, before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    labels, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    quality, near, leaks, mixed, tokens = seen
    assert ids(quality[2]) == ids(cotrain.score_quality(quality[1], labels).where("kept"))
    rows = sorted((r["doc_id"], brute_print(r["text"])) for r in near[1].collect())
    assert ids(near[2]) == sorted({c for c in brute_components(rows)})
    bad = {r["doc_id"] for r in decontam.find_leaks(leaks[1], bench).collect()}
    assert ids(leaks[2]) == [d for d in ids(leaks[1]) if d not in bad]
    assert set(ids(mixed[2])) <= set(ids(mixed[1]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d, t in sorted((r["doc_id"], r["text"]) for r in tokens[1].collect()):
        code = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((d, start, len(code), zlib.crc32(np.array(code, "<u4").tobytes())))
        start += len(code)
    assert sorted(tuple(r) for r in tokens[2].collect()) == want


def test_the_rest_imports_without_this_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sparselens"), tmp_path / "sparselens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"],
                           cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.stdout.split()[1] == "False" and int(found.stdout.split()[0]) > 100
