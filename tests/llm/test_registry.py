from collections import Counter

import duckdb
import pytest

from lorespark.llm.registry import ORACLES, QUERIES

EXPECTED = {
    "op1_": ["doc_id", "n_shingles", "component_id"],
    "op2_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op3_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_": ["doc_id", "held_out", "score", "predicted"],
    "op6_": ["page_id", "url", "text", "n_chars"],
    "op7_": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op13_": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


def test_columns_and_rows(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet").count(), spark.read.parquet(f"{sf}/pages.parquet").count()
    convs = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    for name, query in QUERIES.items():
        if name == "pipeline":
            continue
        got = query(spark, sf)
        assert set(EXPECTED.get(name.split("_")[0] + "_", [])) <= set(got.columns)
        if name.startswith("op13_"):
            assert got.count() > convs
            continue
        assert got.count() == (pages if name.startswith("op6_") else convs + 1 if name.startswith("op12_") else docs)
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
