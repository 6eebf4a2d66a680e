import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorespark.llm import repeats
from lorespark.llm.repeats import byte_anchors, remove_repeats


def passages(texts):
    """The longest runs of 51 words and more that also stand in another text of the list."""
    seen = defaultdict(set)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for n, w in enumerate(words):
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])].add(n)
    out = []
    for w in words:
        hit = [i for i in range(len(w) - 50) if len(seen[tuple(w[i : i + 51])]) > 1]
        out.append(sum(not k or i > hit[k - 1] + 51 for k, i in enumerate(hit)))
    return out


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for x in raw:
        for i in range(len(x) - window + 1):
            seen[hashlib.md5(x[i : i + window]).digest()] += 1
    out = []
    for x, n in zip(raw, passages(texts), strict=True):
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - window + 1):
            if seen[hashlib.md5(x[i : i + window]).digest()] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        left = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(x) else 0
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), n))
    return out


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, line = make(120), "the same line again and again. " * 20
    out = [None, "", "a" * 399, "a" * 400, "a" * 401, "b" * 1500, "ab" * 700, line, make(300)]
    out += [make(r.randint(0, 100)) + passage[r.randint(0, 60) : r.randint(300, 700)] + make(r.randint(0, 100)) for _ in range(40)]
    out += [make(30) + line[r.randint(0, 99) :] + make(30) for _ in range(6)]
    near = make(400)
    for _ in range(8):
        cut = r.randint(0, len(near))
        out.append(near[:cut] + "X" + near[cut:])
    return [*out, out[8], out[20], out[20]]


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_matches_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BLOCK", 16)
    rows = texts()
    docs = spark.createDataFrame([(None if i == 4 else i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in remove_repeats(docs).collect())
    want = Counter((None if i == 4 else i, *x) for i, x in enumerate(brute(rows, 400)))
    assert got == want


def test_equal_rows_that_share_a_passage(spark):
    rows = texts()
    shared = next(t for t in rows if t and len(t) > 1000)
    own = [(None, shared)] * 6 + [(7, shared)] * 3 + [(8, "x" * 300 + shared[:600]), (9, "y" * 700)] + [(5, rows[8] + shared)] * 4
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
    want = Counter((i, *x) for (i, _), x in zip(own, brute([t for _, t in own], 400), strict=True))
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == want
    # one id or none for all copies
    for same in (None, 1):
        own = [(same, shared)] * 5 + [(2, "x" * 300 + shared[:600])]
        want = Counter((i, *x) for (i, _), x in zip(own, brute([t for _, t in own], 400), strict=True))
        got = Counter(tuple(r) for r in remove_repeats(spark.createDataFrame(own, "doc_id long, text string")).collect())
        assert got == want


def test_documents(spark, sf, no_docs, clashing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], 400), strict=True))
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == want
    assert remove_repeats(no_docs).collect() == []
    assert remove_repeats(clashing).count() == clashing.count()


def test_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "x" * 500), (2, "unique"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs, keep=True).collect()}
    assert bytes(got[1].kept) == b"" and bytes(got[2].kept) == b"unique" and got[1].removed[0].end == 500


def test_long_texts_are_taken_in_parts(monkeypatch):
    r = np.random.default_rng(1)
    data = r.integers(97, 123, 6000).astype(np.uint8)
    whole = byte_anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << 11) - 1))
    parts = byte_anchors(data, np.array([0, len(data)]))
    cover = lambda a: sorted((p, s) for p, s0, s1 in zip(*a[2:], strict=True) for s in range(s0, s1 + 1))
    assert cover(whole)[0] and len(cover(parts)) == len(data) - 399
