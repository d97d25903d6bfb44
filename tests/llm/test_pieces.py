import helpers as H
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The library as a unigram model over the same scores, the runs of spaces apart, whose scores leave its single precision no room."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.score < -1e8:
            p.score = -60_000
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def _brute(v, text):
    """The best path, by a plain search; of equal ones that with the longest last piece, and so on."""
    chars = P.characters(" " + text)
    if not text:
        return []
    best, back = [0] + [None] * len(chars), [None] * (len(chars) + 1)
    start, n, score, ids = v.edges(chars, np.full(len(chars), len(chars)))
    for s, k, w, i in sorted(zip(start.tolist(), n.tolist(), score.tolist(), ids.tolist(), strict=True)):
        if best[s] is not None and (best[s + k] is None or best[s] + w > best[s + k]):
            best[s + k], back[s + k] = best[s] + w, (s, i)
    at, out = len(chars), []
    while at:
        s, i = back[at]
        out.append((i, chars[s]))
        at = s
    return v.spelt(np.array([i for i, _ in out[::-1]]), np.array([c for _, c in out[::-1]])).tolist()


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinorst  \nTh.,é日😀\t▁")), max_size=80))
def test_both_ways_against_plain_search(text):
    v = P.vocabulary(PATH)
    want = _brute(v, text)
    assert P.Encoder(v)([text.encode()])[0].tolist() == want
    assert P.Encoder(v, giant=0, chunk=16)([text.encode()])[0].tolist() == want
    assert P.decode(v, np.array(want, dtype=np.int64)) == text.encode().replace("▁".encode(), b" ")


def test_against_library(library, spark, sf_dir):
    v = P.vocabulary(PATH)
    lines = [x for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for x in r.text.split("\n") if x and "  " not in x and all(c.isalnum() or c in " .," for c in x)][:1500]
    for line, ids in zip(lines, P.Encoder(v)([x.encode() for x in lines]), strict=True):
        assert library.encode(line) == ids.tolist()


@pytest.mark.parametrize("chunk", [16, 100, 512])
def test_giant(chunk):
    v = P.vocabulary(PATH)
    for text in ("theretherethe" * 900, "the rest of it\n" * 700, "a" * 3000, "日本" * 500):
        a, b = P.Encoder(v, giant=10, chunk=chunk)([text.encode()])[0], P.Encoder(v, giant=1 << 30)([text.encode()])[0]
        assert a.tolist() == b.tolist() and P.decode(v, a) == text.encode()


def test_scan_is_the_product_from_the_left():
    rng = np.random.default_rng(0)
    m = rng.integers(-50, 0, (9, 4, 4))
    got, now = P.scan(m), m[0]
    for i in range(1, 9):
        now = P.product(now, m[i])
        assert (got[i] == now).all()


def test_tables(spark):
    rows = H.odd_rows(spark)
    got = P.round_trip(rows, PATH).collect()
    assert len(got) == 9 and all(r.round_trip for r in got if r.doc_id != 6)
    enc = P.encode(rows.where("doc_id <> 6"), PATH)
    back = sorted((r.doc_id, r.text) for r in P.decoded(enc, PATH).collect())
    assert back == sorted((r.doc_id, r.text or "") for r in rows.where("doc_id <> 6").collect())
    assert P.round_trip(rows.limit(0), PATH).collect() == []
    assert P.round_trip(H.docs(spark, ["a b"], extra=True), PATH).first().round_trip


def test_model_type_decides(spark, sf_dir):
    """With the model as given, a BPE one, ids are the library's own."""
    import zlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    texts += ["", " ", "a  b   c\n\n d", "x▁ y", "▁ ", "日本 😀\t\r\n", "theretherethe" * 900, "a" * 3000, "of the rest " * 9000]
    want = [sp.encode(t) for t in texts]
    assert [x.tolist() for x in P.encoder(P.vocabulary(PATH))([t.encode() for t in texts])] == want
    got = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in P.round_trip(H.docs(spark, texts), PATH).collect()}
    assert got == {i: (len(w), zlib.crc32(np.array(w, dtype="<i4").tobytes())) for i, w in enumerate(want)}
