"""Mel filter banks over power spectra."""

from __future__ import annotations

import numpy as np


def to_mel(hz: np.ndarray | float) -> np.ndarray:
    return 1127.0 * np.log1p(np.asarray(hz, float) / 700.0)


def to_hz(mel: np.ndarray | float) -> np.ndarray:
    return 700.0 * np.expm1(np.asarray(mel, float) / 1127.0)


def filterbank(bins: int, rate: int, filters: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """filters x bins triangles, equally spaced in mel, each rising from its left neighbour's top to its own."""
    edges = np.linspace(to_mel(low), to_mel(high or rate / 2), filters + 2)
    at = to_mel(np.arange(bins) * rate / (2 * (bins - 1)))
    rise = (at[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - at[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0, None)


def log_mel(samples: np.ndarray, rate: int = 16_000, frame: int = 32, hop: int = 16, filters: int = 8, emphasis: float = 0.97, floor: float = 1e-6) -> np.ndarray:
    """Pre-emphasis, Hann frames, power spectrum, mel energies, logarithm: frames x filters. A short signal is padded."""
    x = np.append(samples[:1], samples[1:] - emphasis * samples[:-1]).astype(float)
    x = np.pad(x, (0, max(0, frame - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame))
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.log(np.maximum(power @ filterbank(frame // 2 + 1, rate, filters).T, floor))
