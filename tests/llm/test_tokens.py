import base64
import hashlib

import numpy as np
import public_tokenizers as P
import sentencepiece
import tiktoken

from lorespark.llm.bpe import bpe_round_trip
from lorespark.llm.token_counts import token_counts


def key(r):
    return tuple((v is not None, v) for v in r)


def test_token_counts_match_the_library(spark, odd_docs, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = [(r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect()]
        got = token_counts(docs).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_token_counts_empty_and_clashing(no_docs, clashing, odd_docs):
    assert token_counts(no_docs).collect() == []
    assert sorted(token_counts(clashing).collect(), key=key) == sorted(token_counts(odd_docs).collect(), key=key)


def test_bpe_matches_the_library_and_decodes(spark, odd_docs, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = []
        for r in docs.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [tuple(r) for r in bpe_round_trip(docs).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_bpe_keeps_ids_and_bytes(spark, odd_docs, no_docs, clashing):
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in bpe_round_trip(odd_docs, keep=True).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id] and len(r.ids) == r.n_tokens
    assert bpe_round_trip(no_docs).collect() == []
    assert bpe_round_trip(clashing).count() == odd_docs.count()
