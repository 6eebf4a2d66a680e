"""The term index and the vector index: what plans read, updates, odd input, bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph, postings, vectors
from lorespark.operators.postings import TermIndex
from lorespark.operators.vectors import VectorIndex

ITEMS = "id long, title string, body string, project string"
ROWS = [(1, "A red fox", "the fox ran over the hill", "x"), (2, "Hill", "a hill with no animals", "y"), (3, None, None, None), (4, "", "", "x"), (5, "Foxes", "many FOXES and a fox", "y"), (6, "none", "the the the", "x")]


@pytest.fixture
def index(spark, tmp_path):
    return TermIndex(spark, f"{tmp_path}/terms", ["title", "body"], ["project"], buckets=4).add(spark.createDataFrame(ROWS, ITEMS))


def by_hand(rows, query, bonuses):
    docs = {i: ((t or "").lower(), (b or "").lower()) for i, t, b, _ in rows}
    tokens = {i: " ".join(d).split() for i, d in docs.items()}
    average = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for i, own in tokens.items():
        score = 0.0
        for t in query.lower().split():
            tf = own.count(t)
            score += tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / average))
            score += sum(more for field, more in bonuses.items() if t in docs[i][("title", "body").index(field)])
        if score > 0:
            out[i] = round(score, 9)
    return out


@pytest.mark.parametrize("query", ["fox hill", "fox fox", "o", "nothing", "THE", "he animals"])
def test_keyword_search_by_hand(index, query):
    bonuses = {"title": 3.0, "body": 1.0}
    got = index.keyword_search(query, 10, bonuses).collect()
    assert {r.id: round(r.score, 9) for r in got} == by_hand(ROWS, query, bonuses)
    assert [r.id for r in got] == [i for i, _ in sorted(by_hand(ROWS, query, bonuses).items(), key=lambda x: (-x[1], x[0]))]


def test_searches_without_terms(index):
    assert index.keyword_search("  ", 5, {"title": 3.0}).collect() == []
    assert index.full_text_search("", 5).collect() == []


def test_plans_read_the_terms_folders_only(index):
    plan = index.full_text_search("fox hill", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan
    assert index.postings(["fox"]).select("bucket").distinct().count() == 1


def test_documents_that_change(spark, index, tmp_path):
    index.add(spark.createDataFrame([(2, "Cat", "a cat now", "z"), (7, "New", "another fox", "z")], ITEMS))
    rows = [r for r in ROWS if r[0] != 2] + [(2, "Cat", "a cat now", "z"), (7, "New", "another fox", "z")]
    for query in ("fox hill", "cat", "a"):
        assert {r.id: round(r.score, 9) for r in index.keyword_search(query, 10, {"title": 3.0}).collect()} == by_hand(rows, query, {"title": 3.0})
    assert {r.term: r.documents for r in index.frequencies(["hill", "fox"]).collect()} == {"hill": 1, "fox": 3}
    small = index.compact(f"{tmp_path}/compact")
    assert {r.id: round(r.score, 9) for r in small.keyword_search("hill fox", 10, {"title": 3.0}).collect()} == by_hand(rows, "hill fox", {"title": 3.0})
    assert small._read("postings").filter("id = 2 AND term = 'hill'").isEmpty()
    again = TermIndex(spark, index.path, index.fields, index.kept, buckets=4)
    assert again.add(spark.createDataFrame([(8, "x", "x", "x")], ITEMS)).generation == 3


def test_an_index_of_letters(spark, tmp_path):
    index = TermIndex(spark, f"{tmp_path}/letters", ["body"], ["project"], postings.letters).add(spark.createDataFrame([(1, "", "Fox, fox-hill!", "x"), (2, "", "fox", "y"), (3, "", None, "y")], ITEMS))
    assert [r.id for r in index.full_text_search("fox hill", 5).collect()] == [1]
    assert {r.id for r in index.full_text_search("fox", 5).collect()} == {1, 2}
    assert index.full_text_strategy("fox", 5, F.col("project") == "y", "2024-01-01 00:00:00", "project", 0).count() == 1


def clusters(spark, n=600, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 8))
    rows = [(i, f"p{i % 2}", [float(v) for v in centres[i % 12] + 0.1 * r.normal(size=8)]) for i in range(n)]
    return rows, spark.createDataFrame(rows + [(9001, "p0", None), (9002, "p0", [0.0] * 8)], "id long, project string, embedding array<double>")


def test_exact_search_reads_few_lists(spark, tmp_path):
    rows, table = clusters(spark)
    index = VectorIndex(spark, f"{tmp_path}/vectors").build(table, lists=12)
    x = vectors.unit([e for *_, e in rows])
    for q in (0, 7):
        want = np.lexsort((np.arange(len(x)), -(x @ x[q]).round(12)))[:10]
        assert [r.id for r in index.nearest(rows[q][2], 10).collect()] == want.tolist()
        assert [r.id for r in index.search(rows[q][2], 10, 1).collect()] == want.tolist()  # one list holds a cluster
    assert index.search(rows[0][2], 590, 1).count() == 590  # further lists, until there are enough
    near = index.within(rows[0][2], 0.9)
    assert {r.id for r in near.collect()} == set(np.flatnonzero(x @ x[0] >= 0.9).tolist())
    assert "PartitionFilters: [list" in near._jdf.queryExecution().executedPlan().toString()
    read = near.select(F.input_file_name().alias("f")).distinct().count()
    assert read < index.lists().select(F.input_file_name().alias("f")).distinct().count()


def test_many_queries_and_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows, table = clusters(spark)
    index = VectorIndex(spark, f"{tmp_path}/vectors").build(table, lists=12)
    x, asked = vectors.unit([e for *_, e in rows]), table.filter("id % 20 = 0")
    exact = index.nearest_many(asked, 5)
    want = {(q, int(i)) for q in range(0, len(rows), 20) for i in np.lexsort((np.arange(len(x)), -(x @ x[q]).round(12)))[:5]}
    assert {(r.query, r.id) for r in exact.collect()} == want
    got = vectors.recall(index.search_many(asked, 5, 1), exact).first()
    assert got.queries == 30 and got.recall >= 0.9


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "id long, project string, embedding array<double>")
    assert vectors.alike(none, 0.5).collect() == []


@pytest.mark.parametrize("threshold", [-0.5, 0.5, 0.95])
def test_pivots_leave_out_no_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rows, table = clusters(spark, 300)
    got = {(r.a, r.b, r.score) for r in vectors.alike(table, threshold).collect()}
    assert got == {(r.a, r.b, r.score) for r in graph.related(table.filter("id < 9000"), threshold).collect()}
    own = table.select("id", F.col("project").alias("p"), "embedding")
    compared = vectors.block_pairs(vectors.pivot_blocks(own), threshold).agg(F.sum("n")).first()[0]
    every = 2 * 150 * 149 // 2
    assert len(got) <= compared <= every
    assert threshold < 0.9 or compared < 0.5 * every


def test_scratch_is_forgotten_and_indexes_are_built_again(spark, monkeypatch):
    from pathlib import Path

    from lorespark import session

    monkeypatch.setattr(session, "_SCRATCH", set())
    items = lambda: spark.createDataFrame(ROWS, ITEMS)
    first = postings.shared_index(spark, "own", items, ["title"], [])
    assert postings.shared_index(spark, "own", items, ["title"], []) is first and Path(first.path.removeprefix("file:")).exists()
    assert session.forget_scratch(spark) == 1 and not Path(first.path.removeprefix("file:")).exists()
    again = postings.shared_index(spark, "own", items, ["title"], [])
    assert again is not first and again.keyword_search("hill", 5, {"title": 3.0}).count() == 1
    session.forget_scratch(spark)


def test_documents_are_dealt_by_count(spark, tmp_path, monkeypatch):
    """Terms were moved one by one to be counted; a document's are counted where it is now."""
    from lorespark import session

    monkeypatch.setattr(session, "DEALT", 500)
    tasks = []

    def seen(rows, count, *by):
        out = session.dealt(rows, count, *by)
        tasks.append((by, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(postings, "dealt", seen)
    rows = [(10 * n + r[0], *r[1:]) for n in range(5) for r in ROWS]
    index = TermIndex(spark, f"{tmp_path}/dealt", ["title", "body"], ["project"], buckets=4).add(spark.createDataFrame(rows, ITEMS))
    assert tasks == [(("id",), 15)]
    got = index.keyword_search("fox hill", 100, {"title": 3.0, "body": 1.0}).collect()
    assert {r.id: round(r.score, 9) for r in got} == by_hand(rows, "fox hill", {"title": 3.0, "body": 1.0})
