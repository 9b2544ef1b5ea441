import numpy as np

from palimpsest.functions import blake3, mel


def test_blake3_published_vectors():
    """Inputs of the published test vectors: bytes 0, 1, ..., 250 repeated."""
    data = bytes(i % 251 for i in range(5000))
    assert blake3.digest(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digest(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert blake3.digest(data[:1]) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert len({blake3.digest(data[:n]) for n in (1023, 1024, 1025, 2048, 2049, 3073, 4097)}) == 7


def test_filterbank_covers_its_range():
    bank = mel.filterbank(129, 16_000, 10)
    assert bank.shape == (10, 129) and (bank >= 0).all() and (bank.max(axis=1) > 0.5).all()
    assert np.all(np.diff(bank.argmax(axis=1)) > 0)
    assert np.allclose(mel.to_hz(mel.to_mel(440.0)), 440.0)


def test_tone_falls_into_its_filter():
    x = np.sin(2 * np.pi * 3000 * np.arange(4096) / 16_000)
    e = mel.log_mel(x, frame=512, hop=256, filters=20)
    top = np.linspace(mel.to_mel(0), mel.to_mel(8000), 22)[1:-1]
    assert abs(int(e.mean(axis=0).argmax()) - int(np.abs(top - mel.to_mel(3000)).argmin())) <= 1
