import numpy as np
from pyspark.sql import functions as F

from lorespark.llm import classifier
from lorespark.llm.classifier import NEIGHBOURS, TRIGRAMS, _unit, classify, features, votes, weigh


def test_held_out_accuracy(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert np.mean([a for a, b in held if b]) > 0.97


def test_held_out_labels_are_not_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in classify(docs, x).collect())
    assert score(labels) == score(other)


def test_votes_match_brute_force():
    r = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, r.integers(97, 105, 4))) for _ in range(r.integers(1, 40))).encode() for _ in range(60)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, idf = features(data, offs), np.ones(TRIGRAMS, np.float32)
    axes = r.normal(size=(x.shape[1], 8)).astype(np.float32)
    model = {"idf": idf, "axes": axes, "vectors": _unit(weigh(x[:40], idf) @ axes), "labels": r.integers(0, 2, 40).astype(np.float32), "prior": 0.5}
    own = _unit(weigh(x, idf) @ axes)
    for i, got in enumerate(votes(x, model)):
        near = sorted(((float(own[i] @ v), y) for v, y in zip(model["vectors"], model["labels"], strict=True)), reverse=True)[:NEIGHBOURS]
        weights = [max(s, 0) ** 4 for s, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)
        assert abs(got - want) < 1e-4


def test_trigrams_keep_apart_in_a_long_text():
    r = np.random.default_rng(1)
    data = r.integers(97, 123, 4000).astype(np.uint8)
    filled = np.count_nonzero(features(data, np.array([0, len(data)]))[0, :TRIGRAMS])
    assert TRIGRAMS == 2048 and filled > 1024


def test_chunks_change_no_features(monkeypatch):
    texts = [b"abc", b"", b"the same words again and again", b"x" * 50, b"abcabd " * 9] * 3
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    monkeypatch.setattr(classifier, "ROWS", 2)
    parts = list(classifier._chunks(offs))
    assert [k for i, j in parts for k in range(i, j)] == list(range(len(texts))) and max(j - i for i, j in parts) == 2
    got = np.concatenate([features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in parts])
    assert np.array_equal(got, features(data, offs))


def test_odd_inputs(spark, odd_docs, no_docs, clashing):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 40)] + [(1, 1, 1), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert classify(odd_docs, labels).count() == odd_docs.count()
    assert classify(no_docs, labels).collect() == []
    assert {r.score for r in classify(odd_docs, none).collect()} == {0.5}
    assert classify(clashing, labels).count() == odd_docs.count()
