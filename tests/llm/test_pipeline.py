"""The pipeline's stages, one after the other, against brute force."""

import re

import corpus_pipeline
from test_models_and_packing import check_packing
from test_ngram_join import brute

from quillon.llm import secrets

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], DIR).cache())
    assert all(f.columns == columns for f in frames[:-1])
    start, spoken, single, apart, clean = ([tuple(r) for r in f.collect()] for f in frames[:-1])
    assert set(spoken) <= set(start) and len(spoken) >= 0.99 * len(start)

    best = {}
    for r in spoken:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        best[key] = max(best.get(key, r), r, key=lambda x: (len(x[1] or ""), -x[0]))
    assert sorted(single) == sorted(best.values())

    component = {i: c for i, n, c in brute([r[:2] for r in single], 5, 80, 100) if n}
    assert sorted(apart) == sorted(r for r in single if component.get(r[0], r[0]) == r[0])
    assert len(apart) < len(single)

    owners = {}
    for r in apart:
        for *_, h in secrets.candidates(r[1]):
            owners.setdefault(h, set()).add(r[3])
    want = []
    for r in apart:
        text, at, out = r[1], 0, ""
        for s, e, _, h in secrets.candidates(text):
            if len(owners[h]) < secrets.EXAMPLE_OWNERS and e > at:
                if s >= at:
                    out += text[at:s] + "[SECRET]"
                at = e
        out += text[at:]
        want.append((r[0], out, *r[2:4], len(out)))
    assert sorted(clean) == sorted(want) and any("[SECRET]" in r[1] for r in clean)

    check_packing(frames[-1].collect(), [r[:2] for r in clean], 1024, 1.03)


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(corpus_pipeline.run(spark, DIR).select(columns).collect()) == sorted(docs.select(columns).collect())


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
