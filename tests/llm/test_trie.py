import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lorespark.llm import trie
from lorespark.llm.trie import OP13_SQL, conversation_trie, op13_conversation_trie

CONVS = "conv_id long, turn long, role string, text string"


def brute(sequences):
    """Rows of the trie of {conv_id: turns}."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
        ends = ",".join(map(str, sorted(c for c in members[node] if len(sequences[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def turns(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for *_, r, t in sorted(v)] for k, v in out.items()}


def rebuilt(own):
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: head[c]] + own[c][head[c] :] for c in own}


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", None), (3, None, None, "hi"),
    (3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, 7, "user", "hi"), (4, 7, "assistant", "yes"), (4, 7, "assistant", "no"), (5, 0, "user", "other"),
    (None, 0, "user", "hi"), (6, 0, "", ""), (7, 0, None, None), (12, 3, "user", "long " * 9000), (13, 3, "user", "long " * 9000), (-4, 0, "user", "hi"),
]


def test_documents_by_brute_force_and_sql(spark, sf):
    got = op13_conversation_trie(spark, sf)
    found = Counter(map(tuple, got.collect()))
    assert found == brute(rebuilt(turns([(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert found == Counter(con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP13_SQL})").fetchall())


def test_odd_conversations(spark):
    convs = spark.createDataFrame(ODD, CONVS)
    want = brute(turns(ODD))
    assert Counter(map(tuple, conversation_trie(convs).collect())) == want
    assert Counter(map(tuple, conversation_trie(convs.selectExpr("*", "1 AS depth", "2 AS key", "3 AS node")).collect())) == want


def test_no_conversations(spark):
    assert conversation_trie(spark.createDataFrame([], CONVS)).collect() == []


def test_deep_copies_and_blocks_of_ids(spark, monkeypatch):
    """Levels past a band of depths, a group of copies, ids of several blocks, turnless ones."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2, 40) for t in range(17)] + [(40, 17, "user", "end")]
    rows += [(c, 0, "user", "short") for c in range(50, 75)]
    assert Counter(map(tuple, conversation_trie(spark.createDataFrame(rows, CONVS)).collect())) == brute(turns(rows))
    from pyspark.sql import functions as F

    got = conversation_trie(spark.createDataFrame(rows, CONVS), F.lit(5), F.lit(99).cast("long"))
    assert Counter(map(tuple, got.collect())) == brute({c: t[5:] for c, t in turns(rows).items()})


@pytest.mark.parametrize("depth", [1, 15, 16, 31, 32, 1000])
def test_bands_agree(spark, depth):
    from pyspark.sql import functions as F

    assert spark.range(1).select(trie._band(F.lit(depth))).first()[0] == trie._band(depth)
