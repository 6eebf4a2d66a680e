"""Themes: the rule by hand over few facts, and what must hold of many."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import retrieval, themes
from lorespark.streaming import processors as streams

SCHEMA = "id long, project string, embedding array<double>"


def test_clusters_are_stable_and_whole():
    r = np.random.default_rng(4)
    centres = np.eye(6)[:3]
    x = np.concatenate([c + r.normal(scale=0.05, size=(20, 6)) for c in centres])
    for seed in range(5):
        label = themes.cosine_kmeans(x, 3, seed)
        assert len(label) == 60 and set(label) <= {0, 1, 2}
        # no vector is nearer to another cluster's mean
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        means = np.array([x[label == c].mean(axis=0) if (label == c).any() else np.zeros(6) for c in range(3)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        assert ((unit @ means.T).round(9).max(axis=1) <= (unit @ means.T)[np.arange(60), label].round(9) + 1e-9).all()
    assert themes.cosine_kmeans(x[:2], 5).tolist() == [0, 1]


def by_hand(rows):
    """The stated rule, one group after the other."""
    groups = defaultdict(list)
    for row in sorted(rows):
        groups[row[1]].append(row)
    loose = groups.pop(None, [])
    out = {}
    if loose:
        with_vector = [r for r in loose if r[2] is not None]
        if len(with_vector) >= 3:
            label = themes.cosine_kmeans(np.array([r[2] for r in with_vector]), max(1, min(-(-len(loose) // 5), 5)))
            for r, c in zip(with_vector, label, strict=True):
                groups[f"misc:cluster{c}"].append(r)
            groups["misc:cluster0"] += [r for r in loose if r[2] is None]
        else:
            groups["misc"] = loose
    small = {}
    for name, own in groups.items():
        own = sorted(own)
        with_vector = [r for r in own if r[2] is not None]
        if len(own) > themes.MOST and len(with_vector) >= 4:
            label = themes.cosine_kmeans(np.array([r[2] for r in with_vector]), -(-len(own) // 10))
            out |= {r[0]: f"{name}:split{c}" for r, c in zip(with_vector, label, strict=True)}
            out |= {r[0]: f"{name}:split0" for r in own if r[2] is None}
        elif len(own) < themes.LEAST:
            small[name] = own
        else:
            out |= {r[0]: name for r in own}
    vector = {r[0]: r[2] for r in rows}
    means = {}
    for name in sorted(set(out.values())):
        own = [vector[i] for i, t in out.items() if t == name and vector[i] is not None]
        if len(own) >= themes.LEAST:
            means[name] = np.mean(own, axis=0)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for name, own in small.items():
        into = name
        if own[0][2] is not None and means:
            near, best = max(((round(float(unit(own[0][2]) @ unit(m)), 9), n) for n, m in means.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            into = best if near > themes.NEAR else name
        out |= {r[0]: into for r in own}
    return out


def test_themes_follow_the_rule(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(160):
        project = None if i % 6 == 0 else f"p{i % 31}" if i % 6 == 1 else f"q{i % 4}"
        vector = None if i % 17 == 3 else (np.eye(8)[i % 4] + r.normal(scale=0.4, size=8)).round(6).tolist()
        rows.append((i, project, vector))
    got = {x.id: x.theme for x in themes.themes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == by_hand(rows)
    sizes = Counter(got.values())
    assert len(got) == 160 and any(":split" in t for t in sizes) and any(":cluster" in t for t in sizes)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, None, [0.0, 0.0]), (2, "a", None), (3, "a", [1.0, 0.0])]])
def test_few_facts(spark, rows):
    assert {x.id: x.theme for x in themes.themes(spark.createDataFrame(rows, SCHEMA)).collect()} == by_hand(rows)


def test_large_themes_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(themes, "CELL", 40)
    r = np.random.default_rng(5)
    rows = [(i, "one", [1.0, 0.0, 0.0] if i % 3 == 0 else r.normal(size=3).round(5).tolist()) for i in range(500)]
    own = spark.createDataFrame(rows, SCHEMA).select("id", F.col("project").alias("theme"), "embedding")
    cells = themes._cells(own)
    assert max(c for _, c in cells.groupBy("theme").count().collect()) <= 64 and cells.count() == 500
    assert len({x.id for x in themes.themes(spark.createDataFrame(rows, SCHEMA)).collect()}) == 500


def test_passages_by_hand(spark):
    texts = ["Thing thingthing and THING", "x" * 400 + "thing" + "y" * 400 + "thing", "none", "", None, "thing " * 9]
    found = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", retrieval.passages(F.col("text"), "thing").alias("p")).collect()
    for row in found:
        text, want, at = texts[row.id], [], 0
        while text and len(want) < 5 and (hit := text.lower().find("thing", at)) >= 0:
            want.append(text[max(0, hit - 250) : hit + 255])
            at = hit + 5
        assert (row.p or []) == want


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    held = streams.VersionedTable(spark, str(tmp_path / "t"), "thread_id long, messages long, last_position long, awaiting_reply boolean", "thread_id")
    rows = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 1, True), (2, 0, False)], "thread_id long, position long, sent boolean")
    once = streams.thread_update(held.read(), rows)
    again = streams.thread_update(once, rows)
    want = {(1, 2, 1, False), (2, 1, 0, True)}
    assert {tuple(r) for r in once.collect()} == want and {tuple(r) for r in again.collect()} == want


def test_centroids_in_blocks_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, f"p{i % 40}" if i < 160 else f"s{i}", (np.eye(8)[i % 8] + r.normal(scale=0.3, size=8)).round(6).tolist()) for i in range(200)]
    facts = spark.createDataFrame(rows, SCHEMA)
    want = {x.id: x.theme for x in themes.themes(facts).collect()}
    monkeypatch.setattr(themes, "CENTROIDS", 7)
    assert {x.id: x.theme for x in themes.themes(facts).collect()} == want == by_hand(rows)
