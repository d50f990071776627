"""The pipeline's stages against plain Python."""

import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import toxicity
from tests.llm.test_corpus_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.toPandas()
        seen[name] = (before, after)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and set(after.doc_id) <= set(before.doc_id)
    before, after = seen["toxicity"]
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    clean = set(labels[labels.toxic == 0].doc_id)
    assert len(clean & set(after.doc_id)) >= 0.95 * len(clean & set(before.doc_id))
    before, after = seen["exact dedup"]
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in before.itertuples():
        best[key(r.text)] = min(best.get(key(r.text), (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(after.doc_id) == sorted(i for _, i in best.values())
    before, after = seen["MinHash near-dedup"]
    want = brute_components(dict(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert sorted(after.doc_id) == sorted(i for i, (_, c) in want.items() if i == c)
    before, after = seen["mixing sources to target weights"]
    words = lambda d: d.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))).sum()
    assert abs(words(after) - words(before)) < 0.1 * words(before) and after.doc_id.value_counts().max() <= 3
    before, after = seen["BPE encoding and decoding"]
    assert sorted(after.doc_id) == sorted(before.doc_id)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in after.itertuples())


def test_empty_documents_and_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    odd = docs.unionByName(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 30, "en", None, 1), (3, "x", None, "s", 1), (3, "x", None, "s", 1)], docs.schema))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs, SF).count() == 0
        odd.write.parquet(f"{tmp_path}/{k}")
        odd = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), SF)
    assert odd.count() > 0
    assert toxicity.learnable(F.col("doc_id")) is not None
