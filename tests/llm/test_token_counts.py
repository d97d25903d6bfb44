import helpers as H
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def _want(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbé'sS 0,.!<|endoftext|>startoftext\n\t\r\x0b\x0c\x1c  ́ßΣς日😀‍-_")), max_size=60))
def test_cut_at_white_space_is_exact(text):
    assert sum(T.n_pieces([w.decode() for w in text.encode().split()], PATH)) == _want(text)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in T.token_counts(docs, PATH).collect()}
    for r in docs.limit(60).collect():
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens) == (len(r.text.encode()), _want(r.text))
        assert got[r.doc_id].over_limit == (got[r.doc_id].n_tokens > 2048)


def test_list_is_emptied(spark, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    monkeypatch.setattr(T, "AT_ONCE", 10)
    texts = ["alpha beta gamma delta", "alpha epsilon zeta", "beta alpha alpha"]
    assert [r.n_tokens for r in T.token_counts(H.docs(spark, texts), PATH).orderBy("doc_id").collect()] == [_want(t) for t in texts]


def test_odd_rows(spark):
    rows = H.odd_rows(spark)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in T.token_counts(rows, PATH).collect())
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), _want(r.text)) for r in rows.collect())
    assert T.token_counts(rows.limit(0), PATH).collect() == []
    assert T.token_counts(H.docs(spark, ["a"], extra=True), PATH).count() == 1
