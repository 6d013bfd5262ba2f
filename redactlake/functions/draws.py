"""The draws of numpy's default_rng(seed) for many seeds at once, a row for each seed."""

from __future__ import annotations

import numpy as np

_WORD, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)
_TIMES_HIGH, _TIMES_LOW = np.uint64(2549297995355413924), np.uint64(4865540595714422341)


def _hashed(value: np.ndarray, constant: int, times: int) -> tuple[np.ndarray, int]:
    after = constant * times & 0xFFFFFFFF
    value = (value ^ np.uint32(constant)) * np.uint32(after)
    return value ^ value >> np.uint32(16), after


def _entropy(seeds: np.ndarray) -> list[np.ndarray]:
    """Eight words of 32 bits for each seed, as a SeedSequence makes them."""
    if (seeds < 0).any():
        raise ValueError("expected non-negative integer")
    seeds, constant, pool = seeds.astype(np.uint64), 0x43B0D7E5, []
    for word in ((seeds & _WORD).astype(np.uint32), (seeds >> _32).astype(np.uint32), *[np.zeros(len(seeds), np.uint32)] * 2):
        word, constant = _hashed(word, constant, 0x931E8875)
        pool.append(word)
    for source in range(4):
        for target in range(4):
            if source != target:
                word, constant = _hashed(pool[source], constant, 0x931E8875)
                mixed = pool[target] * np.uint32(0xCA01F9DD) - word * np.uint32(0x4973F715)
                pool[target] = mixed ^ mixed >> np.uint32(16)
    constant, out = 0x8B51F9DD, []
    for k in range(8):
        word, constant = _hashed(pool[k % 4], constant, 0x58F38DED)
        out.append(word)
    return out


def _stepped(high, low, by_high, by_low):
    """(high, low) times the multiplier, and (by_high, by_low) added, modulo 2^128."""
    a, b = low & _WORD, low >> _32
    c, d = _TIMES_LOW & _WORD, _TIMES_LOW >> _32
    p = b * c + (a * c >> _32)
    q = a * d + (p & _WORD)
    high = high * _TIMES_LOW + low * _TIMES_HIGH + b * d + (p >> _32) + (q >> _32)
    low = low * _TIMES_LOW + by_low
    return high + by_high + (low < by_low), low


def _seeded(seeds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Halves of the state and of the increment that PCG64 starts with."""
    words = [w.astype(np.uint64) for w in _entropy(seeds)]
    high, low, inc_high, inc_low = (words[k] | words[k + 1] << _32 for k in range(0, 8, 2))
    inc_high, inc_low = inc_high << np.uint64(1) | inc_low >> np.uint64(63), inc_low << np.uint64(1) | np.uint64(1)
    low = low + inc_low
    high = high + inc_high + (low < inc_low)
    return *_stepped(high, low, inc_high, inc_low), inc_high, inc_low


def integers(seeds: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """default_rng(seed).integers(lows, highs), and which rows a generator would have drawn anew in, so that they are not these."""
    high, low, inc_high, inc_low = _seeded(seeds)
    words = np.empty((len(seeds), len(lows) + len(lows) % 2), np.uint64)
    for k in range(0, len(lows), 2):
        high, low = _stepped(high, low, inc_high, inc_low)
        both, turn = high ^ low, high >> np.uint64(58)
        both = both >> turn | both << (-turn & np.uint64(63))
        words[:, k], words[:, k + 1] = both & _WORD, both >> _32
    span = (highs - lows).astype(np.uint64)
    scaled = words[:, : len(lows)] * span
    return lows + (scaled >> _32).astype(np.int64), ((scaled & _WORD) < span).any(1)


def noise(seeds: np.ndarray, size: int) -> np.ndarray:
    """default_rng(seed).integers(0, 256, size), for an even size: of each 64 bits drawn, the highest byte of both halves; it stands 4 bytes after the last."""
    out, generator = np.empty((len(seeds), size // 2)), np.random.Generator(np.random.PCG64(0))
    state = generator.bit_generator.state
    for row, high, low, inc_high, inc_low in zip(out, *(x.tolist() for x in _seeded(seeds)), strict=True):
        state["state"] = {"state": high << 64 | low, "inc": inc_high << 64 | inc_low}
        generator.bit_generator.state = state
        generator.random(out=row)  # the upper 53 bits of 64, as a fraction
    out *= 2.0**40
    return out.astype(np.int64).view(np.uint8)[:, ::4]
