"""The pipeline's stages on a small corpus, each against a plain version of what it promises."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrain.llm import secret_scan

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = np.random.default_rng(12)
    vocabulary = ["".join(r.choice(list("abcdeilnorst"), int(r.integers(2, 9)))) for _ in range(800)]
    plain = [" ".join(r.choice(vocabulary, int(r.integers(60, 200)))) + "." for _ in range(120)]
    junk = [" ".join(w + "!!" if i % 2 else w.upper() + "$$$" for i, w in enumerate(r.choice(vocabulary, 90))) for _ in range(60)]
    texts = plain + junk + plain[:10] + [t + " extra tail" for t in plain[10:20]] + [plain[20] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, ""]
    docs = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 120), 0) for i in range(180)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert all(out[n].columns == columns for n in list(out)[:-1])

    kept = {r.doc_id for r in out["quality"].collect()}
    assert len(kept & set(range(120))) >= 117 and not kept & set(range(120, 180))

    def shingles(t):
        w = WORDS.findall((t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    before = {r.doc_id: shingles(r.text) for r in out["quality"].collect()}
    after = {r.doc_id for r in out["near_duplicates"].collect()}
    linked = lambda a, b: before[a] and 100 * len(before[a] & before[b]) >= 80 * len(before[a] | before[b])
    assert not [(a, b) for a in after for b in after if a < b and linked(a, b)]
    assert all(any(linked(a, b) and b < a for b in before) for a in set(before) - after)

    cleaned = out["secrets"].collect()
    assert {r.doc_id for r in cleaned} == after and not any(secret_scan.base_spans(r.text or "") for r in cleaned)

    sizes, taken, times = Counter(), Counter(), Counter()
    for r in cleaned:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    for r in out["mixture"].collect():
        taken[r.source] += len(WORDS.findall(r.text or ""))
        times[r.doc_id] += 1
    assert max(times.values()) <= 2 and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 200 * len(sizes)
    assert all(taken[s] <= 2 * n for s, n in sizes.items())

    texts = {r.doc_id: r.text for r in out["mixture"].collect()}
    for r in out["tokens"].collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert out["tokens"].count() == out["mixture"].count()
    assert corpus_pipeline.run(spark, corpus).agg(F.sum("n_tokens")).first() == out["tokens"].agg(F.sum("n_tokens")).first()
