"""Half precision: round to nearest even in 16 bits, subnormals to zero."""

from __future__ import annotations

import numpy as np


def encoded(values: np.ndarray) -> np.ndarray:
    """The 16 bits of each float32; what would be subnormal is a zero of its sign."""
    bits = np.asarray(values, np.float32).astype(np.float16).view(np.uint16)
    return np.where((bits & 0x7C00) == 0, bits & 0x8000, bits).astype(np.uint16)


def decoded(bits: np.ndarray) -> np.ndarray:
    """Exact, but that subnormals are zeros."""
    bits = np.asarray(bits, np.uint16)
    return np.where((bits & 0x7C00) == 0, bits & 0x8000, bits).astype(np.uint16).view(np.float16).astype(np.float32)
