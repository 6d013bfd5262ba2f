"""Bounded statistics of whole texts, as inputs of a quality score."""

from __future__ import annotations

import numpy as np

from ._batch import LOWER, U64, chunks, mix, repeated, segsum, shingles, windows, words

_CLASS = {
    "upper": np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "digit": np.isin(np.arange(256), list(b"0123456789")),
    "symbol": np.isin(np.arange(256), list(b"#*$%&|<>@^~_{}[]\\=+")),
    "exclaim": np.isin(np.arange(256), list(b"!?")),
    "stop": np.isin(np.arange(256), list(b".,;:")),
    "high": np.arange(256) >= 0x80,
    "pipe": np.arange(256) == ord("|"),
    "line": np.arange(256) == ord("\n"),
}
NAMES = ("log_words", "word_length", "longest_word", *_CLASS, "distinct", "repeat_pairs", "repeat_fives", "short_words", "words_by_line")


def statistics(column) -> np.ndarray:
    """NAMES of every text, a row each; all are finite, and 0 without words."""
    parts = []
    for _, _, buf, offs in chunks(column):
        start, ln, h, wb = words(LOWER[buf], offs)
        n = np.diff(wb)
        one = np.maximum(n, 1).astype(float)
        size = np.maximum(np.diff(offs), 1).astype(float)
        doc = np.repeat(np.arange(len(n)), n)
        longest = np.zeros(len(n))
        full = np.flatnonzero(n)
        if len(full):
            longest[full] = np.maximum.reduceat(ln, wb[:-1][full])
        distinct = _distinct(h, doc, len(n)) / one
        cols = [np.log1p(n), segsum(ln, wb) / one, np.log1p(longest)]
        cols += [segsum(is_[buf], offs) / size for is_ in _CLASS.values()]
        cols.append(distinct)
        for k in (2, 5):
            at, d = windows(wb, k)
            if len(at):
                again = repeated(mix(shingles(h, k)[at] + d.astype(U64) * U64(0x9E3779B97F4A7C15)))
                cols.append(np.bincount(d[again], minlength=len(n)) / one)
            else:
                cols.append(np.zeros(len(n)))
        cols.append(segsum(ln <= 3, wb) / one)
        cols.append(np.log1p(n / (1.0 + segsum(_CLASS["line"][buf], offs))))
        parts.append(np.stack(cols, axis=1).astype(np.float64))
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    a, d = h[order], doc[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)
