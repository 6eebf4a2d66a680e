import random
import re
from collections import Counter

import pytest

from lorespark.llm import jaccard
from lorespark.llm.graph import components
from lorespark.llm.jaccard import jaccard_components


def brute(rows):
    sets = []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if common and 100 * common >= 80 * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=12, members=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(40)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([6, 30, 120]))] + passage * (g % 3 == 0)
        for _ in range(members):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own).upper() if r.random() < 0.2 else "  ".join(own))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 300])
def test_matches_brute_force(spark, monkeypatch, odd_texts, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    texts = near_copies(block) + odd_texts
    rows = [(None if i == 11 else i + 100, t) for i, t in enumerate(texts)] + [(105, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, jaccard_components(docs).collect())) == brute(rows)


def test_documents(spark, sf, no_docs, clashing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(map(tuple, jaccard_components(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_components(no_docs).collect() == []
    assert jaccard_components(clashing).count() == clashing.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
