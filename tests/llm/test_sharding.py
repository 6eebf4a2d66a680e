import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lorespark.llm import sharding
from lorespark.llm.sharding import assign_shards


def brute(rows, limit):
    """Split buckets one by one."""
    items = []
    for d, t in rows:
        h = int(hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:15], 16)
        items.append((format(h, "060b"), d, len((t or "").encode())))
    out, todo = [], [("", items)]
    while todo:
        bits, own = todo.pop()
        size = sum(n for *_, n in own)
        if size <= limit or len({h for h, *_ in own}) == 1:
            out += [(d, n, bits, len(bits), size, len(own), size > limit) for _, d, n in own]
            continue
        halves = defaultdict(list)
        for x in own:
            halves[x[0][len(bits)]].append(x)
        todo += [(bits + b, x) for b, x in halves.items()]
    return Counter(out)


@pytest.mark.parametrize("limit", [1, 300, 20_000, 10**9])
def test_matches_splitting(spark, odd_docs, limit):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(map(tuple, assign_shards(odd_docs, limit=limit).collect())) == brute(rows, limit)


def test_sql_and_plan(spark, sf, no_docs, clashing, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = assign_shards(docs, limit=20_000)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = sharding.OP5_SQL.replace(str(sharding.QUERY_LIMIT), "20000")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert assign_shards(no_docs).collect() == []
    assert assign_shards(clashing).count() == odd_docs.count()
