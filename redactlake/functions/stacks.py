"""The measures of pixels.py over many rectangles of a stack of images at once.

A stack is frames x height x width pixels, each the four bytes of a colour as one number. Sums are of
whole numbers, divided once, so each measure is what pixels.py gives, but for its rounding of thirds.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import pixels as K

COLOURS, PAINT, WHITE = np.uint32(0xFFFFFF), np.uint32(0xFF000000), np.uint32(0xFFFFFFFF)


def pixel(r, g, b):
    """Opaque pixels of these colours."""
    return (PAINT | np.asarray(r, np.uint32) | np.asarray(g, np.uint32) << np.uint32(8) | np.asarray(b, np.uint32) << np.uint32(16)).astype(np.uint32)


def colours(pixels: np.ndarray):
    return [(pixels >> np.uint32(shift) & np.uint32(255)).astype(np.int64) for shift in (0, 8, 16)]


class Boxes(NamedTuple):
    """Rectangles within images: the frame each is in, and its bounds."""

    frame: np.ndarray
    left: np.ndarray
    top: np.ndarray
    right: np.ndarray
    bottom: np.ndarray

    @property
    def width(self):
        return self.right - self.left

    @property
    def height(self):
        return self.bottom - self.top

    @property
    def real(self):
        return (self.right > self.left) & (self.bottom > self.top)

    def at(self, which) -> Boxes:
        return Boxes(*(v[which] for v in self))


def clamped(shape, frame, x, y, w, h) -> Boxes:
    """Rectangles of whole numbers within the images; those of which nothing is inside are not real."""
    return Boxes(frame, np.maximum(x, 0), np.maximum(y, 0), np.minimum(x + w, shape[2]), np.minimum(y + h, shape[1]))


def _numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For `counts` places of each owner in turn: the owner, and the place's number there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Places:
    """Places of a grid in each rectangle, as places in the flat stack, rectangle after rectangle."""

    def __init__(self, shape, b: Boxes, step: int, shifted: bool = False):
        """Every step-th column of every step-th row; shifted: further by one column from row to row, as on the lattice."""
        owner, row = _numbered(np.where(b.real, -(-b.height // step), 0))
        shift = row % step if shifted else np.zeros_like(row)
        across = np.maximum(0, -(-(b.width[owner] - shift) // step))
        first = ((b.frame * shape[1] + b.top)[owner] + step * row) * shape[2] + b.left[owner] + shift
        line, column = _numbered(across)
        self.at, self.owner = first[line] + step * column, owner[line]
        self.counts = np.bincount(self.owner, minlength=len(b.frame))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Whole values summed by rectangle."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        ends = np.cumsum(self.counts)
        return total[ends] - total[ends - self.counts]

    def means(self, values: np.ndarray) -> np.ndarray:
        """0 where a rectangle has no place."""
        return self.sums(values) / np.maximum(self.counts, 1)


def lattice(shape, b: Boxes) -> Places:
    return Places(shape, b, 3, True)


def black_share(img, b: Boxes) -> np.ndarray:
    p = lattice(img.shape, b)
    r, g, c = colours(img.reshape(-1)[p.at])
    return p.means((r < K.BLACK) & (g < K.BLACK) & (c < K.BLACK))


def _distances(a, b, p: Places):
    return [np.abs(x - y) for x, y in zip(colours(a.reshape(-1)[p.at]), colours(b.reshape(-1)[p.at]), strict=True)]


def difference(a, b, boxes: Boxes) -> np.ndarray:
    p = lattice(a.shape, boxes)
    return p.means(sum(_distances(a, b, p))) / 765


def changed_share(a, b, boxes: Boxes, least=K.CHANGED) -> np.ndarray:
    p = lattice(a.shape, boxes)
    return p.means(np.maximum.reduce(_distances(a, b, p)) >= least)


def variance(img, b: Boxes) -> np.ndarray:
    p = lattice(img.shape, b)
    s, n = sum(colours(img.reshape(-1)[p.at])), np.maximum(p.counts, 1)
    return (n * p.sums(s * s) - p.sums(s) ** 2) / (9 * n * n)


def _steps(flat, at, by: int, width: int):
    """Differences of the colours' sums between the neighbours `by` places off, on the row and on the column."""
    left, right, above, below = (sum(colours(flat[at + k])) for k in (-by, by, -by * width, by * width))
    return np.abs(right - left) + np.abs(below - above)


def gradient(img, b: Boxes) -> np.ndarray:
    p = Places(img.shape, Boxes(b.frame, b.left + 2, b.top + 2, b.right - 2, b.bottom - 2), 2)
    return p.sums(_steps(img.reshape(-1), p.at, 2, img.shape[2])) / 3


def inside(shape, b: Boxes) -> Places:
    """Places of the lattice that have all their neighbours in the rectangle."""
    return lattice(shape, Boxes(b.frame, b.left + 1, b.top + 1, b.right - 1, b.bottom - 1))


def edge_sum(img, b: Boxes) -> tuple[np.ndarray, np.ndarray]:
    p = inside(img.shape, b)
    return p.sums(_steps(img.reshape(-1), p.at, 1, img.shape[2])), p.counts


def _runs(v: np.ndarray, axis: int, side: int) -> np.ndarray:
    """Sums of `side` neighbours along an axis, from sums of 1, 2, 4 and so on."""
    cut = lambda a, first, n: a[(slice(None),) * axis + (slice(first, first + n),)]
    n, out, done, size = v.shape[axis] - side + 1, None, 0, 1
    while True:
        if side & size:
            part = cut(v, done, n)
            out, done = part if out is None else out + part, done + size
        if size * 2 > side:
            return out
        length = v.shape[axis] - size
        v, size = cut(v, 0, length) + cut(v, size, length), size * 2


def _enough(side: int):
    """A kind of numbers that holds the sum of a square of bytes."""
    return np.uint16 if side**2 * 256 <= 1 << 16 else np.uint32 if side**2 * 256 <= 1 << 32 else np.uint64


def _bytes(pixels: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4).astype(kind)


def _alike(b: Boxes, most: int) -> list[np.ndarray]:
    """Which rectangles to take together: some of like sizes."""
    order = np.lexsort((b.height, b.width // 4))
    return [order[k : k + most] for k in range(0, len(order), most)]


def _reach(b: Boxes, by: int) -> list[np.ndarray]:
    """Rows and columns of each rectangle and `by` more on either side, as many as the largest needs."""
    return [first[:, None] + np.arange(-by, n.max() + by) for first, n in ((b.top, b.height), (b.left, b.width))]


def _crops(img, b: Boxes, rows, columns) -> np.ndarray:
    return img.reshape(-1)[((b.frame[:, None] * img.shape[1] + rows) * img.shape[2])[:, :, None] + columns[:, None, :]]


def sharpened_edge_sum(img, b: Boxes, radius=K.UNSHARP_RADIUS, together: int = 128) -> np.ndarray:
    """Sums of edge_sum() for each rectangle after the unsharp mask, which leaves the image's rim as it is: the only pixels of a rectangle beyond the mask's."""
    (_, height, width), side, total = img.shape, 2 * radius + 1, np.zeros(len(b.frame), np.int64)
    extent = lambda at, n: np.minimum(at + radius + 1, n) - np.maximum(at - radius, 0)
    for which in _alike(b, together):
        some = b.at(which)
        rows, columns = _reach(some, radius)
        ys, xs = np.clip(rows, 0, height - 1), np.clip(columns, 0, width - 1)
        crops = _crops(img, some, ys, xs) * ((rows == ys)[:, :, None] & (columns == xs)[:, None, :])
        around = _runs(_runs(_bytes(crops, _enough(side)), 2, side), 1, side)
        p = inside(img.shape, some)
        y, x = p.at // width % height, p.at % width
        own = (p.owner * around.shape[1] + y - some.top[p.owner]) * around.shape[2] + x - some.left[p.owner]

        def sums(down, across):
            v, u = y + down, x + across  # noqa: B023
            was = _bytes(img.reshape(-1)[p.at + down * width + across], np.float64)[:, :3]  # noqa: B023
            mean = around.reshape(-1, 4)[own + down * around.shape[2] + across, :3] / (extent(v, height) * extent(u, width))[:, None]  # noqa: B023
            out = np.clip(np.rint(was + (was - mean)), 0, 255)
            rim = (u == 0) | (u == width - 1) | (v == 0) | (v == height - 1)
            return np.where(rim, was.sum(1), out.sum(1)).astype(np.int64)

        total[which] = p.sums(np.abs(sums(0, 1) - sums(0, -1)) + np.abs(sums(1, 0) - sums(-1, 0)))
    return total


def attacks(original, shipped, b: Boxes):
    """Which rectangles too much is left of, the share of the edges that is left and the share that sharpening brings back."""
    total, n = edge_sum(original, b)
    some = np.flatnonzero((total > 0) & (total >= 3 * K.LEAST_EDGES * n))
    left = edge_sum(shipped, b.at(some))[0] / total[some]
    hit = left >= K.RESIDUAL
    some, left = some[hit], left[hit]
    return some, left, sharpened_edge_sum(shipped, b.at(some)) / total[some]


def painted(img, b: Boxes, value) -> None:
    """Fills the rectangles, in place."""
    for frame, left, top, right, bottom in zip(*(v.tolist() for v in b.at(b.real)), strict=True):
        img[frame, top:bottom, left:right] = value


def blurred(img, b: Boxes, radius: int, together: int = 64) -> None:
    """Blurs the rectangles, of which no two overlap, in place: what is outside them plays no part. Those of like sizes are taken together."""
    b, side, flat = b.at(b.real), 2 * radius + 1, img.reshape(-1)
    kind = _enough(side)
    for which in _alike(b, together):
        some = b.at(which)
        rows, columns = _reach(some, radius)
        v = _crops(img, some, np.clip(rows, some.top[:, None], some.bottom[:, None] - 1), np.clip(columns, some.left[:, None], some.right[:, None] - 1))
        v = ((_runs(_runs(_bytes(v, kind), 2, side), 1, side) + kind(side**2 // 2)) // kind(side**2)).astype(np.uint8)  # a mean over an odd number of bytes is never halfway
        rows, columns = (a[:, radius : a.shape[1] - radius] for a in (rows, columns))
        own = (rows < some.bottom[:, None])[:, :, None] & (columns < some.right[:, None])[:, None, :]
        at = (((some.frame[:, None] * img.shape[1] + rows) * img.shape[2])[:, :, None] + columns[:, None, :])[own]
        flat[at] = v[own].view(np.uint32)[:, 0] & COLOURS | flat[at] & ~COLOURS


LEAKED, REDACTED, SKIPPED = 0, 1, 2


def verdicts(original, redacted, known, destroyed, frame, x, y, w, h) -> np.ndarray:
    """LEAKED, REDACTED or SKIPPED for each rectangle; known: whether there is an original to hold it against."""
    b = clamped(redacted.shape, frame, x, y, w, h)
    out = np.where(b.real, LEAKED, SKIPPED)
    black = black_share(redacted, b)
    flat = np.where(known, variance(original, b) < K.FLAT, variance(redacted, b) < K.PLAIN)
    out[b.real & (flat | (black > 0.5))] = REDACTED
    rest = np.flatnonzero((out == LEAKED) & known & destroyed)
    inset = np.maximum(1, np.floor(np.minimum(w, h)[rest] * 0.08 + 0.5).astype(np.int64))
    inner = clamped(redacted.shape, frame[rest], x[rest] + inset, y[rest] + inset, w[rest] - inset * 2, h[rest] - inset * 2)
    inner = Boxes(*(np.where(inner.real, i, v) for i, v in zip(inner, b.at(rest), strict=True)))
    out[rest[black_share(redacted, inner) >= K.OPAQUE_SHARE]] = REDACTED
    rest = np.flatnonzero((out == LEAKED) & known & ~destroyed)
    some = b.at(rest)
    e0, e1 = gradient(original, some), gradient(redacted, some)
    soft = (e0 > 800) & (e1 < np.maximum(e0 * 0.45, 120)) | (changed_share(original, redacted, some) > 0.1)
    out[rest[soft | (difference(original, redacted, some) > K.DIFFERENT)]] = REDACTED
    return out
