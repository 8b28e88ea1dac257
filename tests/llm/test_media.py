import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from hitwatch.llm import common, media


def test_checksums_of_odd_documents(spark, odd_docs, no_docs):
    rows = media.digests(media.store(odd_docs), common.scratch(spark, "test-media")).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    seen = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        wav = media.to_wav(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert seen.setdefault(padded, r["feature"]) == r["feature"]
    assert media.digests(media.store(no_docs), common.scratch(spark, "test-media")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wav_is_lossless(n):
    raw = bytes(i * 7 % 256 for i in range(n))
    assert media.from_wav(media.to_wav(raw)) == (media.RATE, raw)


@pytest.mark.parametrize("data", [b"", b"RIFF0000WAVE", media.to_wav(b"abc" * 50)[:100]])
def test_damaged_wav(data):
    with pytest.raises(ValueError, match="WAV"):
        media.from_wav(data)


def test_wav_is_read_by_the_standard_library(tmp_path):
    import io
    import wave

    with wave.open(io.BytesIO(media.to_wav(bytes(range(128))))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(999)) == (1, 1, media.RATE, bytes(range(128)))


def test_polyphase_equals_upsampling_filtering_and_decimating():
    x = np.random.default_rng(0).normal(size=500).astype("f4")
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    taps = media.phases().T.ravel()
    full = np.convolve(up, taps)
    got = media.resample(x)
    want = full[media.UP * (media.TAPS - 1 - media.TAPS // 2) :][:: media.DOWN][: len(got)]
    assert len(got) == -(-len(x) * media.UP // media.DOWN) and np.allclose(got, want, atol=1e-4)


def test_tone_lands_in_its_mel_band():
    t = np.arange(16_000) / media.RATE
    peaks = [media.log_mel(media.resample(np.sin(2 * np.pi * f * t).astype("f4")))[0].sum(0).argmax() for f in (200, 800, 2500, 5000)]
    assert peaks == sorted(set(peaks))


def test_hysteresis():
    quiet, step = 0, media.STEPS
    e = np.array([quiet] * 10 + [step, 3 * step, step, quiet] + [step, step, quiet] + [quiet] * 5)
    assert media.segments(e).tolist() == [[10, 13]]
    assert len(media.segments(np.zeros(5))) == 0


def test_long_signals_are_processed_in_blocks(monkeypatch):
    x = np.random.default_rng(1).normal(size=30_000).astype("f4")
    whole = media.log_mel(x)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    assert all((a == b).all() for a, b in zip(whole, media.log_mel(x), strict=True))


def test_tensors_have_a_fixed_shape_and_spans(spark, odd_docs):
    folder = common.scratch(spark, "test-media")
    files = media.write_features(media.store(odd_docs), folder, group_rows=5, file_bytes=100_000)
    assert files.agg({"n_rows": "sum"}).first()[0] == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in files.filter("n_rows > 0").collect():
        read = pq.read_table(f"{folder.removeprefix('file://')}/{r['file']}").combine_chunks()
        kind = read.schema.field("tensors").type.value_type
        assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [media.FRAMES, media.MELS]
        for batch in read.to_batches():
            for i, doc_id in enumerate(batch.column("id").to_pylist()):
                one = media.features(media.to_wav(media.pad((texts[doc_id] or "").encode())))
                assert (batch.column("tensors").slice(i, 1).flatten().to_numpy_ndarray() == one["tensors"]).all()
                spans = [(t["start_ms"], t["end_ms"]) for t in batch.column("spans")[i].as_py()]
                assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == batch.column("n_frames")[i].as_py() * 10
