"""The pipeline's stages, each on what the one before kept, against brute force on the smallest tables."""

import os
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_fingerprint, words_of

from wayfinder.llm import language_id, line_quality, mixing
from wayfinder.llm.common import stored

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def test_stages_keep_the_rows_they_should(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").limit(150)
    odd = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "12 34"))
    docs = stored(docs.unionByName(odd).unionByName(docs.limit(2)), "fixture")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "simhash_dedup", "source_mixing", "piece_encoding"]
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stored(stage(spark, docs, DIR), name)
        got = Counter(r.doc_id for r in out.collect())
        if name == "language_id":
            model = language_id.train(docs)
            said = [(r.doc_id, model.predict(r.text)) for r in rows]
            want = Counter(i for i, (lang, score) in said if lang != "und" and score >= 0.4)
            assert 0 < sum(want.values()) < len(rows)
        elif name == "quality_rules":
            field = line_quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
            want = Counter(r.doc_id for r in rows if field.judge((r.text or "").encode())[-1])
            assert 0 < sum(want.values()) < len(rows)
        elif name == "simhash_dedup":
            first = {}
            for r, c in zip(rows, brute_classes([brute_fingerprint(r.text) for r in rows])):
                first[c] = min(first.get(c, r.doc_id), r.doc_id)
            want = Counter(first.values())
            assert 0 < sum(want.values()) < len(rows)
        elif name == "source_mixing":
            taken = {r.doc_id: r.taken for r in mixing.summary(docs).collect()}
            want = Counter({r.doc_id: taken[r.doc_id] // len(words_of(r.text)) for r in rows if taken[r.doc_id]})
        else:
            want = Counter(r.doc_id for r in rows)
            assert out.columns == ["doc_id", "source", "ids", "begins", "ends", "decoded_sha256"]
        assert got == want, name
        if name != "piece_encoding":
            assert out.columns == docs.columns
        docs = out
