import hashlib
from collections import Counter

import corpus_pipeline as pipeline
from lorespark.llm.classifier import classify
from lorespark.llm.jaccard import jaccard_components, jaccard_representatives
from tests.llm.test_decontaminate import squeeze
from tests.llm.test_jaccard import brute
from tests.llm.test_scans import base


def test_one_document_of_each_group(spark, odd_docs, odd_texts, sf):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        kept = Counter(r.doc_id for r in jaccard_representatives(docs).collect())
        groups = [tuple(r) for r in jaccard_components(docs).collect()]
        want = {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}
        assert set(kept) == want
    again = docs.unionByName(docs.limit(50))
    assert Counter(r.doc_id for r in jaccard_representatives(again).collect()) == kept


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = docs.collect()
    seen = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "bpe":
            assert seen[-1].columns == docs.columns
    good, single, clean, redacted, ids = seen[1:]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in brute([(r.doc_id, r.text) for r in good.collect()])}
    items = [squeeze(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in squeeze(r.text) for r in clean.collect() for i in items)
    held = {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    assert held and len(held) < 0.2 * single.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in redacted.collect():
        assert base(r.text) == [] and r.n_chars == len(r.text) and (r.text == texts[r.doc_id] or "[SECRET]" in r.text)
    left = {r.doc_id: r.text for r in redacted.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in ids.collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in left.items()}
    assert len(left) < len(whole)


def test_run_matches_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count()
            docs = out if name != "bpe" else docs
