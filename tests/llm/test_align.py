import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorespark.llm.align import Pair, align_tokenizers, byte_level_letters, op11_align_tokenizers, segments, shared_cuts


def brute(rows):
    """Whole texts by the libraries, offsets as Python sets."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = byte_level_letters()
    found, counts = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            own_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            own_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in own_a) == b"".join(x for _, x in own_b) == (" " + text).encode():
                ends = [dict(zip(np.cumsum([len(x) for _, x in own]).tolist(), range(1, len(own) + 1), strict=True)) for own in (own_a, own_b)]
                i = j = 0
                for cut in sorted(ends[0].keys() & ends[1].keys()):
                    k, m = ends[0][cut], ends[1][cut]
                    groups.append(([x for x, _ in own_a[i:k]], [x for x, _ in own_b[j:m]]))
                    i, j = k, m
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        found.append((doc, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for doc, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), digest, said))
    return out, counts


def test_documents_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, counts = brute(rows)
    assert Counter(map(tuple, op11_align_tokenizers(spark, sf).collect())) == Counter(x[:-1] for x in want)
    _, links = align_tokenizers(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {(r.a_id, r.b_id): r.n for r in links.collect()} == dict(counts)


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_texts(spark, odd_docs, no_docs, clashing, parts):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want, _ = brute(rows)
    assert Counter(map(tuple, align_tokenizers(odd_docs.coalesce(parts), keep=True)[0].collect())) == Counter(want)
    assert Counter(map(tuple, align_tokenizers(clashing)[0].collect())) == Counter(x[:-1] for x in want)
    assert align_tokenizers(no_docs)[0].collect() == []


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, align_tokenizers(docs)[0].collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]
    assert align_tokenizers(docs)[1].collect() == []


PAIR = None


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab's 1é\n\t 　\x1c\x85▁<>|.!😀\0")))
def test_segments_are_encoded_as_in_the_text(text):
    global PAIR
    PAIR = PAIR or Pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    parts = segments(" " + text)
    assert "".join(parts) == " " + text
    sizes = np.array([len(p.encode()) for p in parts])
    a, b = (PAIR.flat(f, w, parts, sizes) for f, w in ((PAIR.ids_a, PAIR.words_a), (PAIR.ids_b, PAIR.words_b)))
    assert a[1].tolist() == PAIR.a.encode(" " + text, add_special_tokens=False).ids
    assert b[1].tolist() == PAIR.b.encode(text) or "▁" in text or not text
    assert a[0].tolist() == [len(x) for x in PAIR.ids_a(parts)] and b[0].tolist() == [len(x) for x in PAIR.ids_b(parts)]


@given(st.lists(st.integers(1, 300), min_size=1), st.lists(st.integers(1, 300), min_size=1))
def test_shared_cuts(a, b):
    end = max(*a, *b)
    a, b = np.unique([*a, end]), np.unique([*b, end])
    cuts, rank_a, rank_b = shared_cuts(a, b)
    assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert [a[i - 1] for i in rank_a] == [b[i - 1] for i in rank_b] == cuts.tolist()


def test_tasks_that_take_several_partitions(spark, sf, monkeypatch):
    """Fewer files than partitions: the partitions of a task are numbered apart."""
    from lorespark.llm import common

    monkeypatch.setattr(common, "FILES_A_CORE", 0.5)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(16)
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, align_tokenizers(docs)[0].collect())) == Counter(x[:-1] for x in want)
