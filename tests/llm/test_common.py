"""What holds for all operators: repeated rows, settled inputs, shared folders."""

from collections import Counter

import numpy as np
import pytest
import zstandard

from lorespark.llm import bpe, common, jaccard, packed
from lorespark.llm.align import align_tokenizers
from lorespark.llm.bpe import bpe_round_trip
from lorespark.llm.chat import format_conversations
from lorespark.llm.classifier import classify
from lorespark.llm.decontaminate import find_leaks
from lorespark.llm.html_text import extract_text
from lorespark.llm.jaccard import jaccard_components
from lorespark.llm.quality_rules import quality_rules
from lorespark.llm.repeats import remove_repeats
from lorespark.llm.secrets import find_secrets
from lorespark.llm.sharding import assign_shards
from lorespark.llm.token_counts import token_counts
from lorespark.llm.trie import conversation_trie
from tests.llm.test_repeats import brute as repeats_by_hand

OF_TEXT = {
    "op1": lambda docs, sf: jaccard_components(docs),
    "op2": lambda docs, sf: token_counts(docs),
    "op7": lambda docs, sf: find_secrets(docs),
    "op8": lambda docs, sf: bpe_round_trip(docs),
    "op10": lambda docs, sf: find_leaks(docs, docs.sparkSession.read.parquet(f"{sf}/benchmark.parquet")),
}


def rows(df):
    return Counter(str(sorted(r.asDict(True).items())) for r in df.collect())


@pytest.mark.parametrize("name", OF_TEXT)
def test_rows_given_twice_come_out_twice(spark, sf, odd_docs, name):
    once = rows(OF_TEXT[name](odd_docs, sf))
    assert rows(OF_TEXT[name](odd_docs.unionByName(odd_docs), sf)) == Counter({k: 2 * n for k, n in once.items()})


def test_rows_given_twice_to_the_others(spark, sf, odd_docs):
    """Results that depend on how often a text occurs are alike for alike rows."""
    twice = odd_docs.unionByName(odd_docs)
    given = Counter(r.doc_id for r in twice.collect())
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for out in (classify(twice, labels), quality_rules(twice), assign_shards(twice, limit=4096)):
        found = rows(out)
        assert all(n % 2 == 0 for n in found.values())
        assert Counter(r.doc_id for r in out.collect()) == given
    own = [(r.doc_id, r.text) for r in twice.collect()]
    want = Counter((d, *x) for (d, _), x in zip(own, repeats_by_hand([t for _, t in own], 400), strict=True))
    assert Counter(tuple(r) for r in remove_repeats(twice).collect()) == want
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows(extract_text(pages.unionByName(pages))) == Counter({k: 2 * n for k, n in rows(extract_text(pages)).items()})


def test_inputs_that_come_out_of_a_shuffle(spark, odd_docs):
    """The rows of a shuffle are written before they are numbered."""
    mixed = odd_docs.repartition(3)
    assert common.settled(mixed, "x") is not mixed
    for run in (jaccard_components, bpe_round_trip, remove_repeats):
        assert rows(run(mixed)) == rows(run(odd_docs))


def test_tables_are_forgotten(spark, odd_docs):
    common.forget_all(spark)
    remove_repeats(odd_docs).count()
    assert common.forget_all(spark) >= 1 and common.forget_all(spark) == 0


def test_only_own_tables_are_deleted(spark, tmp_path):
    path = str(tmp_path / "lorespark-input")
    spark.range(3).write.parquet(path)
    common.forget(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3
    own = common.materialize(spark.range(3), "own")
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in own.inputFiles()}
    common.forget(own)
    assert not __import__("os").path.exists("/" + folder.lstrip("/"))


class _Cluster:
    """A session of a cluster that names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    conf = {}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf(dict):
        def get(self, key, other=None):
            return other

    session = _Cluster()
    session.conf = Conf()
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session)


def test_packed_numbers_come_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        a = np.sort(r.integers(0, 2**63, n, dtype=np.uint64))
        assert (packed.unascending(packed.ascending(a)) == a).all() and (packed.unplanes(packed.planes(a)) == a).all()
        b = r.random(n) < 0.3
        assert (packed.unbits(packed.bits(b), n) == b).all()
    assert packed.unframe(packed.frame(b"", b"ab", b"c")) == [b"", b"ab", b"c"]
    cuts = list(packed.range_cuts(a >> np.uint64(8), 56, 5))
    assert cuts[0][1] == 0 and cuts[-1][2] == len(a) and all(x[2] == y[1] for x, y in zip(cuts, cuts[1:], strict=False))


def test_ranges_in_parts_give_the_same(monkeypatch):
    """A range that is worked on in parts sends back what it would as a whole."""
    from lorespark.llm import repeats

    r, ranges = np.random.default_rng(5), 3
    batches, own = [], []
    for number in range(4):
        h = np.unique(r.integers(0, 400, 150).astype(np.uint64) * np.uint64((1 << 56) // 400))
        uses = r.integers(1, 3, len(h))
        own += [(number, k, packed.frame(packed.ascending(h[a:b]), packed.planes(uses[a:b]))) for k, a, b in packed.range_cuts(h, 56, ranges)]
    batches = [packed.moves(sorted(own, key=lambda x: x[1]))]

    def answers(run):
        out = {}
        for row in sorted((tuple(x.values()) for b in run(iter(batches)) for x in b.to_pylist()), key=lambda x: x[:2]):
            n, mask, *more = packed.unframe(row[2])
            mask = packed.unbits(mask, int.from_bytes(n, "little")).tolist()
            tokens = packed.unascending(more[0]).tolist() if more else []
            totals = packed.unplanes(more[1]).tolist() if more else []
            a, b, c = out.setdefault((row[0], row[1] // packed.PARTS), ([], [], []))
            a.extend(mask), b.extend(tokens), c.extend(totals)
        return out

    want = answers(jaccard._count(ranges))
    monkeypatch.setattr(packed, "SOLVE_BYTES", 100)
    assert answers(jaccard._count(ranges)) == want and any(any(m) for m, *_ in want.values())

    own = []
    for number in range(4):
        h = np.unique(r.integers(0, 300, 120).astype(np.uint64) * np.uint64((1 << 64) // 300))
        low, many = r.integers(0, 2, len(h)), r.random(len(h)) < 0.1
        own += [(number, k, packed.frame(packed.ascending(h[a:b]), packed.planes(low[a:b]), packed.bits(many[a:b]))) for k, a, b in packed.range_cuts(h, 64, ranges)]
    batches = [packed.moves(sorted(own, key=lambda x: x[1]))]
    found = answers(repeats._common(ranges))
    monkeypatch.setattr(packed, "SOLVE_BYTES", 1 << 26)
    assert answers(repeats._common(ranges)) == found and any(any(m) for m, *_ in found.values())


def test_a_shingle_that_all_documents_have_travels_once_a_batch(spark):
    """Ranges get entries by batch, not by document."""
    docs = spark.createDataFrame([(i, "the same five words here") for i in range(5000)], "doc_id long, text string").coalesce(1)
    dealt = docs.select("doc_id", "text").mapInArrow(jaccard._deal(4, 5, __import__("pyarrow").int64()), packed.MOVE).collect()
    (own,) = [r for r in dealt if r.range >= 0]
    tokens, uses = packed.unframe(own.payload)
    assert len(packed.unascending(tokens)) == 1 and packed.unplanes(uses).tolist() == [5000]


def test_words_that_a_bucket_forgot_are_encoded_again(monkeypatch):
    import public_tokenizers as p

    words = [f"word{i}".encode() for i in range(300)] * 2
    batch = bpe._rows([(0, 0, bpe._planes(np.array([len(w) for w in words])), zstandard.compress(b"".join(words)))])
    args = p.path(bpe.RANKS), p.PATTERN
    want = [b.to_pylist() for b in bpe._encode(iter([batch]), *args)]
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 5000)
    assert [b.to_pylist() for b in bpe._encode(iter([batch]), *args)] == want


def test_long_segments_are_not_cached(spark):
    long = ["x" * n for n in (64, 65, 1000, 20_000)] + ["ab" * 400 + " " + "cd" * 400]
    docs = spark.createDataFrame(list(enumerate(long * 2)), "doc_id long, text string").coalesce(1)
    import public_tokenizers as p
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(long * 2)}


@pytest.mark.parametrize("given", ["nulls and empty texts", "a partition of them", "no rows"])
def test_texts_that_hold_nothing(spark, sf, given):
    """Tables, and single partitions of a table, of only null and empty texts."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    nothing = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0)] if given != "no rows" else [], schema)
    docs = nothing.unionByName(spark.createDataFrame([(3, "some words that are here " * 20, "en", "s", 500)], schema)) if given == "a partition of them" else nothing
    ids = sorted(r.doc_id for r in docs.collect())
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    others = {"op3": remove_repeats(docs), "op4": classify(docs, labels), "op5": assign_shards(docs), "op9": quality_rules(docs), "op11": align_tokenizers(docs)[0]}
    for name, out in {**{k: f(docs, sf) for k, f in OF_TEXT.items()}, **others}.items():
        assert sorted(r.doc_id for r in out.collect()) == ids, name
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    assert sorted(r.page_id for r in extract_text(pages).collect()) == ids
    convs = docs.selectExpr("doc_id AS conv_id", "0 AS turn", "lang AS role", "text")
    assert sorted(r.conv_id for r in format_conversations(convs).collect()) == ids
    assert (conversation_trie(convs).count() > 0) == bool(ids)


def test_the_pipeline_on_texts_that_hold_nothing(spark, sf, tmp_path):
    from lorespark.llm import pipeline

    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() <= 2


def test_scores_whatever_the_order_of_repeated_rows(spark, sf):
    from pyspark.sql import functions as F

    from lorespark.llm.classifier import fit

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id").crossJoin(spark.range(10).select(F.col("id").alias("copy")))
    ways = [fit(docs.coalesce(1).sortWithinPartitions(o), labels, sample=20) for o in (F.asc("doc_id"), F.desc("doc_id"))]
    assert len(ways[0]["labels"]) == 20
    assert all(np.array_equal(ways[0][k], ways[1][k]) for k in ("labels", "vectors", "axes"))
