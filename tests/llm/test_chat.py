import hashlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm.chat import INST, MARKED, OP12_SQL, Template, format_conversations, op12_chat_format, read_back, render_samples

CONVS = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "system", "be <<SYS>> kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<\\s> <s>"), (1, 3, "assistant", ""),
    (2, None, None, None), (2, 1, "user", ""), (2, 1, "assistant", "tie b"), (2, 1, "assistant", "tie a"), (2, 1, "assistant", "tie a"),
    (3, 0, "tool</s>", "x\ny 😀"), (4, 5, "assistant", "only"), (None, 0, "user", "no conversation"), (5, 0, "user", "word " * 20000), (5, 1, "assistant", "01"),
]


def turns(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for _, _, r, t in sorted(v)] for k, v in out.items()}


def digests(conv, messages):
    said = "".join(f"{r}\n{t}\n" for r, t in messages)
    learned = "".join(t for r, t in messages if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return conv, len(messages), sha(said), len(learned), sha(learned)


@pytest.mark.parametrize("template", [INST, MARKED], ids=lambda t: t.name)
def test_odd_conversations(spark, template):
    convs = spark.createDataFrame(ODD, CONVS)
    got = [tuple(r)[:5] for r in read_back(format_conversations(convs, template), template).collect()]
    assert Counter(got) == Counter(digests(k, v) for k, v in turns(ODD).items())
    clashing = convs.selectExpr("*", "1 AS sample", "2 AS loss")
    assert sorted(tuple(r)[:5] for r in read_back(format_conversations(clashing, template), template).collect()) == sorted(got)


def test_documents_by_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = op12_chat_format(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP12_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD)
    got = read_back(format_conversations(spark.createDataFrame(ODD, CONVS)))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP12_SQL}) WHERE conv_id > 0").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_no_conversations(spark):
    assert format_conversations(spark.createDataFrame([], CONVS)).collect() == []


TEXTS = st.text(st.sampled_from("ab <>[]/\\s|INSTY\n0")) | st.sampled_from([*INST.controls, *MARKED.controls, "<\\s>", "[\\\\INST]", "</s></s>", "<<s>SYS>>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | TEXTS, TEXTS)))
def test_round_trip_and_spans(messages):
    for template in (INST, MARKED):
        given_ = [(template.escape(r), template.escape(t)) for r, t in messages]
        for text in (x for m in given_ for x in m):
            assert not any(c in text for c in template.controls)
        (sample,) = render_samples(template.render, given_, frozenset(["assistant"]))
        assert [(template.unescape(r), template.unescape(t)) for r, t in template.read(sample.text)] == messages
        assert [template.unescape(sample.text[a:b]) for a, b in sample.loss] == [t for r, t in messages if r == "assistant"]
        assert "".join(sample.text[a:b] for *_, a, b in sample.turns) == sample.text


def forgetful(messages):
    """Former answers lose what stands before the bar; the last text keeps it; an end mark follows."""
    own = [(r, t if k == len(messages) - 1 or r != "assistant" else t.rpartition("|")[2]) for k, (r, t) in enumerate(messages)]
    return "".join(f"[{r}]{t}\n" for r, t in own) + "#"


def test_templates_that_rewrite_history(spark):
    rows = [(7, 0, "user", "q"), (7, 1, "assistant", "thinking|answer"), (7, 2, "user", "and"), (7, 3, "assistant", "more|done"), (8, 0, "user", "q"), (8, 1, "assistant", "plain")]
    template = Template("forgetful", ("[",), forgetful, lambda text: [])
    out = format_conversations(spark.createDataFrame(rows, CONVS), template).orderBy("conv_id", "sample").collect()
    assert [(r.conv_id, r.sample, r.n_samples) for r in out] == [(7, 0, 2), (7, 1, 2), (8, 0, 1)]
    assert [[r.text[x.begin : x.end] for x in r.loss] for r in out] == [["thinking|answer"], ["more|done"], ["plain"]]
    assert out[0].text == "[user]q\n[assistant]thinking|answer\n#"
    assert out[1].text == "[user]q\n[assistant]answer\n[user]and\n[assistant]more|done\n#"


def test_a_template_that_changes_texts_trains_the_whole_turn():
    (sample,) = render_samples(lambda m: "".join(f"<{t.upper()}>" for _, t in m), [("assistant", "abc")], frozenset(["assistant"]))
    assert [sample.text[a:b] for a, b in sample.loss] == ["ABC"]
