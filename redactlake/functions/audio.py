"""Samples of sound as bytes and numbers."""

from __future__ import annotations

import numpy as np


def to_pcm(samples) -> bytes:
    """16-bit little-endian bytes of samples cut to [-1, 1]; halves round up."""
    s = np.clip(np.nan_to_num(np.asarray(samples, np.float64)), -1, 1)
    return np.floor(np.where(s < 0, s * 32768, s * 32767) + 0.5).astype("<i2").tobytes()


def from_pcm(raw: bytes) -> np.ndarray:
    """Samples of 16-bit little-endian bytes; an odd last byte is left out."""
    v = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32)
    return np.where(v < 0, v / np.float32(32768), v / np.float32(32767)).astype(np.float32)
