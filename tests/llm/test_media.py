import hashlib
import io
import wave
import zlib

import helpers as H
import numpy as np

from strandloom.llm import media as M


def test_lossless(spark):
    rows = H.odd_rows(spark)
    got = {(r.doc_id, r.n_bytes): r for r in M.media_digests(rows).collect()}
    for r in rows.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id, len(raw)]
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, len(padded), "NONE", None))
            w.writeframes(padded)
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())


def test_peaks_against_plain_transform():
    rng = np.random.default_rng(0)
    for n in (64, 1023, 1024, 1025, 5000, (M.BLOCK + 3) * M.STEP):
        x = (128 + 60 * np.sin(np.arange(n) * 0.3) + rng.normal(0, 9, n)).clip(0, 255).astype(np.uint8)
        frames = max(1, -(-(n - M.FRAME) // M.STEP) + 1)
        want = []
        for t in range(frames):
            f = np.full(M.FRAME, 128.0)
            own = x[t * M.STEP : t * M.STEP + M.FRAME]
            f[: len(own)] = own
            want.append(int(np.argmax(np.abs(np.fft.rfft((f - 128) * np.hanning(M.FRAME)))[1:]) + 1))
        got = M.peaks(x)
        assert len(got) == frames and (got == want).mean() > 0.999


def test_pairs():
    times, pairs = M.fingerprint(np.array([3, 5, 7]))
    assert times.tolist() == [0, 0, 1] and pairs.tolist() == [3 << 14 | 5 << 4 | 1, 3 << 14 | 7 << 4 | 2, 5 << 14 | 7 << 4 | 1]


def test_equal_texts_and_empty(spark):
    a, b = M.media_digests(H.docs(spark, ["same " * 900] * 2, extra=True)).drop("doc_id").collect()
    assert a == b
    assert M.media_digests(H.docs(spark, ["a"]).limit(0)).collect() == []


def test_short_texts_have_pairs(spark):
    """Texts of any length have pairs, and short ones that differ have different features (but for a single byte, whose spectrum is flat and has no peak)."""
    texts = ["", "a", "a short text", "another short text", "one more of these", "the quick brown fox jumps over the lazy dog", "x" * 200, "lorem ipsum " * 20, "dolor sit amet " * 30]
    features = [r.feature for r in M.media_digests(H.docs(spark, texts)).orderBy("doc_id").collect()]
    assert all(int(f.split(":")[2]) > 0 for f in features)
    assert len(set(features[2:])) == len(texts) - 2
