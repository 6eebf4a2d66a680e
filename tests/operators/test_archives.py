"""Folders of many small files, packed."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorespark import session
from lorespark.plans import CATALOG
from lorespark.sources import files

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query", ["file_folder", "session_messages"])
def test_documents_take_no_file_each(spark, query):
    """Folders of 1,000 documents, and of 200 sessions, wrote a file and a commit for each."""
    before = set(session._SCRATCH)
    assert CATALOG[query].plan(spark, SF).count() > 100
    (path,) = set(session._SCRATCH) - before
    assert sum(p.is_file() for p in Path(path.removeprefix("file:")).rglob("*")) < 50


def test_archives_hold_every_file_whole(spark, tmp_path):
    names = [f"notes/{'long' * 40}/{i}/Ä.txt" for i in range(300)]
    want = {"/" + n: (f"text {i} é " * (1 if i % 7 else 400)).encode() if i % 11 else b"" for i, n in enumerate(names)}
    rows = spark.createDataFrame([(n, want["/" + n].decode() or None) for n in names], "path string, content string").repartition(3)
    files.write_archives(rows, f"{tmp_path}/packed", 2_000)
    assert spark.read.parquet(f"{tmp_path}/packed").count() > 50
    got = files.archived_files(spark, f"{tmp_path}/packed").collect()
    assert len(got) == 300 and {r.path: bytes(r.content) for r in got} == want


def test_archived_texts_are_those_of_a_folder(spark, tmp_path):
    texts = {"a/n.md": "---\ntitle: Plan: one\nkind: memo\n---\nbody text here", "a/r.txt": "nine char", ".hidden/h.md": "hidden text here", "b/.dot.md": "hidden text here", "node_modules/x/p.json": '{"of": "a package"}', "b/c/x.bin": "not a text's name", "b/NO": "no extension"}
    for name, text in texts.items():
        (tmp_path / "plain" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "plain" / name).write_text(text)
    files.write_archives(spark.createDataFrame(list(texts.items()), "path string, content string"), f"{tmp_path}/packed")
    kept = ["name", "extension", "content", "meta"]
    want = files.text_files(spark, f"{tmp_path}/plain").select(kept).collect()
    assert sorted(map(str, want)) == sorted(map(str, files.archived_text_files(spark, f"{tmp_path}/packed").select(kept).collect()))
    assert [r.name for r in want] == ["n.md"]


def test_archived_logs_go_on_in_the_next_archive(spark, tmp_path):
    line = lambda i: f'{{"timestamp":"{i}","message":{{"role":"user","content":"m{i}"}}}}\n'
    rows = spark.range(0, 500, 1, 2).select(F.concat(F.when(F.col("id") % 250 < 240, "s1").otherwise("agent-2"), F.lit(".jsonl")).alias("path"), F.udf(line)("id").alias("content"))
    files.write_archives(rows.unionByName(spark.createDataFrame([("s1.jsonl", "not json\n")], rows.schema)), f"{tmp_path}/packed", 3_000)
    got = files.archived_session_logs(spark, f"{tmp_path}/packed").collect()
    assert sorted(int(r.at) for r in got) == [i for i in range(500) if i % 250 < 240] and {r.session_id for r in got} == {"s1"}
