import random

import numpy as np

from lorespark.llm import decontaminate
from lorespark.llm.decontaminate import BUDGET, LEAST, PIECE, align, find_leaks





def squeeze(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).strip(" ").encode()


def distance(piece, text):
    """Fewest edits between the piece and any part of the text: the whole table, a row
    of it at a time."""
    own, step = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    prev = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(piece, 1):
        new = np.concatenate([[i], np.minimum(prev[1:] + 1, prev[:-1] + (own != c))])
        prev = np.minimum.accumulate(new - step) + step
    return int(prev.min())


def stands(item, text):
    """Whether a short item stands in a text with its outer words whole."""
    import re

    word = rb"[0-9A-Za-z\x80-\xff]"
    if not re.search(word, item):
        return bool(item) and b" " + item + b" " in b" " + text + b" "
    ends = (re.match(word, item), re.match(word, item[::-1]))
    # punctuation outside the outer words is part of the item, what stands around it is free
    before, after = (rb"(?<!" + word + rb")" if ends[0] else rb""), (rb"(?!" + word + rb")" if ends[1] else rb"")
    return bool(re.search(before + re.escape(item) + after, text))


def brute(docs, items):
    out = {}
    for d, t in docs:
        own, found = squeeze(t), set()
        for i, b in items:
            b = squeeze(b)
            if len(b) < LEAST:
                if stands(b, own):
                    found.add(i)
                continue
            last = max(0, len(b) - PIECE)
            for at in [*range(0, last, PIECE // 2), last]:
                piece = b[at : at + PIECE]
                if distance(piece, own) <= len(piece) * BUDGET // 100:
                    found.add(i)
        out[d] = found
    return out


def cases(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghié") for _ in range(r.randint(2, 7)))
    make = lambda n: " ".join(word() for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([8, 9, 20, 40, 60, 3])] + [(6, None), (7, ""), (8, "the " * 30), (9, "Zorro"), (10, "two  Words"), (11, items_of_one := "zorro"), (12, " "), (13, "??"), (14, "who is it?"), (15, "(b)")]
    docs = [(0, None), (1, ""), (2, make(50)), (3, "the " * 200), (4, items[5][1]), (5, f"x{items_of_one} zorros"), (6, "x zorro"), (7, "two\nwords" + make(9)), (8, "so two\twords"), (9, "(Zorro), he said"), (10, "\u201czorro\u201d"), (11, "a two words. b"), (12, "why?? no (b) ??"), (13, "who is it, asks who is it?"), (14, "xwho is it?")]
    for i, b in items[:5]:
        for edits in (0, 2, 5, 9, 14, 25):
            own = list(b)
            for _ in range(edits):
                k = r.randrange(len(own))
                own[k : k + 1] = r.choice([[], ["x"], [own[k], "y"]])
            own = "".join(own)
            docs.append((len(docs), make(r.randint(0, 12)) + " " + (own.upper() if edits == 2 else own.replace(" ", " \n ")) + " " + make(r.randint(0, 12))))
        docs.append((len(docs), make(4) + " " + b[: len(b) // 2]))
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = cases()
    want = brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {r.doc_id: {x.item_id for x in r.leaks} for r in find_leaks(d, b).collect()}
        assert got == want and sum(map(bool, want.values())) > 10


def test_stretches_of_common_grams_equal_brute_force(monkeypatch):
    r = random.Random(8)
    phrase = "answer the following question as well as you can: "
    items = [phrase + "".join(r.choice("abcdef ") for _ in range(r.randint(20, 200))) for _ in range(16)] + ["-" * 150, "ab" * 90]
    texts = ["", phrase * 40, "-" * 700, "ab" * 300, "x" * 50]
    for b in items:
        own = list(b)
        for _ in range(r.randint(0, 20)):
            own[r.randrange(len(own))] = r.choice("xyz-")
        texts.append(phrase * r.randint(0, 30) + "".join(own) + phrase * r.randint(0, 9))
    raw = [squeeze(t) for t in texts]
    want = {(d, i) for d, x in brute(enumerate(texts), list(enumerate(items))).items() for i in x}
    block = decontaminate.Pieces([(i, squeeze(b)) for i, b in enumerate(items)])
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    assert len(want) > 10
    for most in (1 << 20, 3000, 50):
        monkeypatch.setattr(decontaminate, "HITS", most)
        assert {x[:2] for x in decontaminate.leaks(data, offs, block)} == want


def test_many_common_pieces_need_bounded_memory():
    r = np.random.default_rng(3)
    phrase = b"answer the following question as well as you can: "
    items = [(i, phrase + bytes(r.integers(97, 123, 78).astype(np.uint8))) for i in range(4_000)]
    block = decontaminate.Pieces(items)
    text = np.frombuffer(phrase * 40 + items[77][1] + phrase * 40, np.uint8)
    assert [x[1] for x in decontaminate.leaks(text, np.array([0, len(text)]), block)] == [77]
    at, k = block.shared(text, np.array([0, len(text)]))
    assert block.counts[k].sum() > 10_000_000 and max(len(p) for p, *_ in block.hits(at, k)) < 2 * decontaminate.HITS


def test_ids_of_any_type_and_passes(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(f"item-{i}" if i != 3 else None, t) for i, t in items], "item_id string, text string")
    want = {d: {f"item-{i}" if i != 3 else None for i in x} for d, x in brute(docs, items).items()}
    for size in (decontaminate.PASS_BYTES, 300):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        assert {r.doc_id: {x.item_id for x in r.leaks} for r in find_leaks(d, b).collect()} == want


def test_align():
    row = lambda x: np.frombuffer(x, np.uint8)[None].astype(np.int16)
    assert align(row(b"hello world"), row(b"xxhello wurldyyyy"), 3)[0][0] == 1
    assert align(row(b"helloworld"), row(b"xxhello worldyyyy"), 3)[0][0] == 1
    assert align(row(b"hello"), row(b"zzzzzzzzz"), 3)[0][0] > 3
    r = random.Random(2)
    for _ in range(50):
        a = bytes(r.choice(b"abc") for _ in range(12))
        b = bytes(r.choice(b"abc") for _ in range(12 + 25))
        assert align(row(a), row(b"z" * 12 + b + b"z" * 24), 20)[0][0] == distance(a, b)


def test_odd_inputs(spark, sf, odd_docs, no_docs, clashing):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert find_leaks(no_docs, b).collect() == []
    assert not any(r.leaks for r in find_leaks(odd_docs, b.limit(0)).collect())
    assert find_leaks(clashing, b).count() == odd_docs.count()


def test_documents_that_hold_items(spark, sf):
    docs, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, squeeze(r.text)) for r in b.collect()]
    texts = {r.doc_id: squeeze(r.text) for r in docs.collect()}
    for r in find_leaks(docs, b).collect():
        assert {i for i, t in items if t in texts[r.doc_id]} <= {x.item_id for x in r.leaks}
