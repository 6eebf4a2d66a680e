import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    None, "", " ", "  ", "\n", "\n\n", " a", "a ", "a  b", "a\n b", "a \nb", "\n  a", "▁x ▁ y", "a\x00b", "<s> </s> <|endoftext|>",
    "ﬁne Ångström　x", "😀😀 é́ e", "don't we'll I'd  x've", "tab\tand\r\nline\r\r\n", "###  ### 12345 12a", " x y", "word",
    "AKIAABCDEFGHIJKL AKIA", "password: hunter22 token='abcdefgh' TOKEN=short", "api_key=0123456789abcdef0123456789abcdef", "ſecret: abcdefghij",
]


@pytest.fixture(scope="session")
def odd_texts():
    r = random.Random(7)
    words = [("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))) for _ in range(40)]
    long = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 30, 300)]
    lines = ["\n".join(r.choice(["x y z", "", " ", "a b c d e f g h", "x y z "]) for _ in range(30)) for _ in range(6)]
    return ODD + long + lines + [long[1], long[1], "x" * 5000, "ab " * 4000, "\n".join(["one two three four five six seven eight nine"] * 3)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Nulls in every column, empty, odd and repeated texts, a null id."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(odd_texts)]
    rows += [rows[3], (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with further columns of awkward names."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *(F.lit(1).alias(c) for c in ("score", "spans", "batch", "n_tokens", "component_id", "fp", "shard", "kept")))
