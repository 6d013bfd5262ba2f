"""Images as arrays of height x width x 4 bytes: regions read, attacked, blurred, searched and packed."""

from __future__ import annotations

import math

import numpy as np

# Thresholds of the checks.
BLACK, CHANGED, OPAQUE_SHARE, FLAT, PLAIN, DIFFERENT = 30, 8, 0.9, 40.0, 400.0, 0.12
UNSHARP_RADIUS, RESIDUAL, LEAST_EDGES = 3, 0.35, 8.0


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


def clamped(img: np.ndarray, x, y, w, h):
    """left, top, right, bottom of a rectangle within the image, or None."""
    left, top = max(0, half_up(x)), max(0, half_up(y))
    right, bottom = min(img.shape[1], half_up(x + w)), min(img.shape[0], half_up(y + h))
    return (left, top, right, bottom) if right > left and bottom > top else None


def lattice(height: int, width: int) -> np.ndarray:
    """Which columns count in every third row of a rectangle: every third one, shifted by one from row to row."""
    return (np.arange(width) - np.arange(-(-height // 3))[:, None]) % 3 == 0


def on_lattice(img: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """Colours of the lattice's pixels within a box; nothing outside it is touched."""
    left, top, right, bottom = box
    return img[top:bottom:3, left:right, :3][lattice(bottom - top, right - left)]


def grey(img: np.ndarray) -> np.ndarray:
    return (img[..., 0].astype(np.float64) + img[..., 1] + img[..., 2]) / 3


def brightness(img: np.ndarray) -> np.ndarray:
    """Three times the grey: whole, so that sums are exact and a value that meets a threshold is not rounded past it."""
    return img[..., 0].astype(np.int64) + img[..., 1] + img[..., 2]


def black_share(img, x, y, w, h, inset=0) -> float:
    box = clamped(img, x + inset, y + inset, w - inset * 2, h - inset * 2) or clamped(img, x, y, w, h)
    return 0.0 if box is None else float((on_lattice(img, box) < BLACK).all(-1).mean())


def difference(a, b, x, y, w, h) -> float:
    """Mean difference of colours, 0 to 1."""
    box = clamped(a, x, y, w, h)
    return 0.0 if box is None else float(np.abs(on_lattice(a, box).astype(int) - on_lattice(b, box)).sum(-1).mean() / 765)


def changed_share(a, b, x, y, w, h, least=CHANGED) -> float:
    box = clamped(a, x, y, w, h)
    return 0.0 if box is None else float((np.abs(on_lattice(a, box).astype(int) - on_lattice(b, box)) >= least).any(-1).mean())


def variance(img, x, y, w, h) -> float:
    box = clamped(img, x, y, w, h)
    if box is None:
        return 0.0
    v = brightness(on_lattice(img, box))
    n, total, squares = v.size, int(v.sum()), int((v * v).sum())
    return (n * squares - total * total) / (9 * n * n)


def gradient(img, x, y, w, h) -> float:
    """Summed differences over two pixels in both directions, at every second pixel inside."""
    box = clamped(img, x, y, w, h)
    if box is None or box[2] - box[0] < 5 or box[3] - box[1] < 5:
        return 0.0
    left, top, right, bottom = box
    g = brightness(img[top:bottom, left:right])
    return float((np.abs(g[2:-2:2, 4::2] - g[2:-2:2, :-4:2]) + np.abs(g[4::2, 2:-2:2] - g[:-4:2, 2:-2:2])).sum() / 3)


def edge_sum(img, x, y, w, h) -> tuple[int, int]:
    """Sum of both neighbours' differences of brightness on the lattice inside a rectangle, and how many there are."""
    left, top = max(0, math.floor(x)), max(0, math.floor(y))
    right, bottom = min(img.shape[1], math.ceil(x + w)), min(img.shape[0], math.ceil(y + h))
    if right - left < 3 or bottom - top < 3:
        return 0, 0
    g = brightness(img[top:bottom, left:right])
    both = (np.abs(g[1:-1:3, 2:] - g[1:-1:3, :-2]) + np.abs(g[2::3, 1:-1] - g[:-2:3, 1:-1]))[lattice(bottom - top - 2, right - left - 2)]
    return int(both.sum()), both.size


def edges(img, x, y, w, h) -> float:
    """Mean of both neighbours' differences of grey on the lattice inside a rectangle."""
    total, n = edge_sum(img, x, y, w, h)
    return total / (3 * n) if n else 0.0


def near(n: int, first: int, last: int, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the r neighbours on both sides of places first to last begin and end, within 0 to n."""
    at = np.arange(first, last)
    return np.maximum(at - r, 0), np.minimum(at + r + 1, n)


def sharpened(img, x, y, w, h, radius=UNSHARP_RADIUS, amount=1.0) -> np.ndarray:
    """Unsharp mask within a rectangle: each pixel moves away from the mean around it."""
    out, r = img.copy(), max(1, half_up(radius))
    height, width = img.shape[:2]
    left, top = max(1, math.floor(x)), max(1, math.floor(y))
    right, bottom = min(width - 1, math.ceil(x + w)), min(height - 1, math.ceil(y + h))
    if right <= left or bottom <= top:
        return out
    (y0, y1), (x0, x1) = near(height, top, bottom, r), near(width, left, right, r)
    s = np.zeros((y1[-1] - y0[0] + 1, x1[-1] - x0[0] + 1, 3))
    s[1:, 1:] = img[y0[0] : y1[-1], x0[0] : x1[-1], :3].cumsum(0, np.float64).cumsum(1)
    rows = s[y1 - y0[0]] - s[y0 - y0[0]]
    mean = (rows[:, x1 - x0[0]] - rows[:, x0 - x0[0]]) / ((y1 - y0)[:, None] * (x1 - x0))[..., None]
    own = img[top:bottom, left:right, :3].astype(np.float64)
    out[top:bottom, left:right, :3] = np.clip(np.rint(own + amount * (own - mean)), 0, 255)
    return out


def attacks(original, shipped, regions) -> list[tuple[int, float, float]]:
    """place, share of the edges that is left and share that sharpening brings back, of the regions of which too much is left."""
    out = []
    for i, (x, y, w, h) in enumerate(regions):
        total, n = edge_sum(original, x, y, w, h)
        if total == 0 or total < 3 * LEAST_EDGES * n:
            continue
        left = edge_sum(shipped, x, y, w, h)[0] / total
        if left >= RESIDUAL:
            out.append((i, left, edge_sum(sharpened(shipped, x, y, w, h), x, y, w, h)[0] / total))
    return out


def verdict(original, redacted, kind_tier: str, destroyed: bool, x, y, w, h) -> str:
    """'skipped', 'redacted' or 'leaked' for one region of a frame."""
    if clamped(redacted, x, y, w, h) is None:
        return "skipped"
    black = black_share(redacted, x, y, w, h)
    if original is None:
        return "redacted" if black > 0.5 or variance(redacted, x, y, w, h) < PLAIN else "leaked"
    if variance(original, x, y, w, h) < FLAT or black > 0.5:
        return "redacted"
    if destroyed:
        inset = max(1, half_up(min(w, h) * 0.08))
        return "redacted" if black_share(redacted, x, y, w, h, inset) >= OPAQUE_SHARE else "leaked"
    if difference(original, redacted, x, y, w, h) > DIFFERENT:
        return "redacted"
    e0, e1 = gradient(original, x, y, w, h), gradient(redacted, x, y, w, h)
    soft = (e0 > 800 and e1 < max(e0 * 0.45, 120)) or changed_share(original, redacted, x, y, w, h) > 0.1
    return "redacted" if soft else "leaked"


def blurred(img: np.ndarray, radius: int) -> np.ndarray:
    """Box blur of the colours along rows, then columns; the edge goes on outside."""
    out, v = img.copy(), img[..., :3].astype(np.int64)
    side = 2 * radius + 1
    for axis in (1, 0):
        n = v.shape[axis]
        s = v.take(np.clip(np.arange(-radius, n + radius), 0, n - 1), axis).cumsum(axis)
        ends, starts = ((slice(None),) * axis + (x,) for x in (slice(2 * radius, None), slice(n - 1)))
        v = s[ends].copy()
        v[(slice(None),) * axis + (slice(1, None),)] -= s[starts]
    out[..., :3] = np.rint(v / side**2)  # a sum of bytes over an odd number is never halfway
    return out


def is_skin(img: np.ndarray) -> np.ndarray:
    r, g, b = (img[..., i].astype(np.float64) for i in range(3))
    total = np.maximum(r + g + b, 1)
    nr, ng, nb = r / total, g / total, b / total
    cb, cr = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    levels = (r > 95) & (g > 40) & (b > 20) & (r > g) & (r > b) & (np.abs(r - g) > 15) & (r - b > 15)
    shares = (nr > 0.28) & (nr < 0.55) & (ng > 0.18) & (ng < 0.42) & (nb > 0.08) & (nb < 0.32) & (nr > nb)
    return (r + g + b > 0) & (levels | shares | ((cb >= 77) & (cb <= 135) & (cr >= 130) & (cr <= 177)))


def merged(boxes: list[tuple]) -> list[tuple]:
    """One pass of greedy unions: a box takes in the later ones that touch what it has become."""
    out, used = [], set()
    for i, box in enumerate(boxes):
        if i in used:
            continue
        for j in range(i + 1, len(boxes)):
            o = boxes[j]
            if j not in used and box[0] <= o[0] + o[2] and o[0] <= box[0] + box[2] and box[1] <= o[1] + o[3] and o[1] <= box[1] + box[3]:
                x, y = min(box[0], o[0]), min(box[1], o[1])
                box = (x, y, max(box[0] + box[2], o[0] + o[2]) - x, max(box[1] + box[3], o[1] + o[3]) - y, max(box[4], o[4]))
                used.add(j)
        out.append(box)
    return out


def skin_faces(img: np.ndarray, step: int = 4) -> list[tuple]:
    """x, y, width, height, confidence of patches of skin that may be faces: connected points of a grid, large and square enough, then merged."""
    mask = is_skin(img[::step, ::step])
    width = mask.shape[1] + 1
    left = bytearray(np.pad(mask, ((1, 1), (0, 1))).tobytes())  # rows of one cell more, which is never set: a neighbour outside is one that is not set
    out = []
    for first in np.flatnonzero(np.frombuffer(bytes(left), np.uint8)).tolist():
        if not left[first]:
            continue
        left[first], cells = 0, [first]
        for at in cells:
            for other in (at - width, at + width, at - 1, at + 1):
                if left[other]:
                    left[other] = 0
                    cells.append(other)
        if len(cells) < math.ceil(200 / step**2):
            continue
        ys, xs = [(c // width - 1) * step for c in cells], [c % width * step for c in cells]
        w, h = max(xs) - min(xs), max(ys) - min(ys)
        if w > 12 and h > 12 and 0.5 < w / h < 2:
            out.append((min(xs), min(ys), w, h, min(0.9, len(cells) * step**2 / 28_800)))
    return merged(out)


def readable(img: np.ndarray) -> bool:
    """Not all of one colour."""
    return bool(img.size >= 4 and (img[..., :3] != img.reshape(-1, img.shape[-1])[0, :3]).any())


# --- boxes, ordered by area and confidence -------------------------------------------------
def by_area(boxes):
    return sorted(boxes, key=lambda b: (-b[2] * b[3], -b[4]))


def covers(box, kept, share) -> bool:
    """Whether a kept box and this one overlap by `share` of the smaller of them; an empty box is covered."""
    if box[2] * box[3] <= 0:
        return True
    for k in kept:
        if k[2] * k[3] <= 0:
            continue
        w, h = min(box[0] + box[2], k[0] + k[2]) - max(box[0], k[0]), min(box[1] + box[3], k[1] + k[3]) - max(box[1], k[1])
        if max(w, 0) * max(h, 0) / min(box[2] * box[3], k[2] * k[3]) >= share:
            return True
    return False


def merged_faces(model, skin, most=16, share=0.3) -> list[tuple]:
    """The model's boxes and the skin boxes that none of them covers, at most so many."""
    out, added = list(model), 0
    for box in by_area(skin):
        if added < most and not covers(box, out, share):
            out.append(box)
            added += 1
    return by_area(out)


def face_probes(width, height, proposals, known, most=8, side=192, share=0.5) -> list[tuple]:
    """Padded windows around proposals that nothing covers, large first."""
    out, probed = [], []
    for b in by_area(proposals):
        if len(out) >= most:
            break
        if covers(b, known, share) or covers(b, probed, share) or max(b[2], b[3]) > side:
            continue
        want = min(side, max(b[2], b[3]) * 2)
        px, py = max(0, (want - b[2]) / 2), max(0, (want - b[3]) / 2)
        w, h = min(width, half_up(b[2] + px * 2)), min(height, half_up(b[3] + py * 2))
        if w <= 0 or h <= 0:
            continue
        x, y = min(max(0, half_up(b[0] - px)), max(0, width - w)), min(max(0, half_up(b[1] - py)), max(0, height - h))
        out.append((x, y, w, h))
        probed.append((x, y, w, h, b[4]))
    return out


def face_tiles(width, height, target=320, most=16, overlap=0.25, whole=False) -> list[tuple]:
    """Overlapping tiles no larger than need be: the cheapest grid that meets the target, else the one of the smallest tiles; none where that gains too little."""
    width, height = max(0, math.floor(width)), max(0, math.floor(height))
    if whole or width <= 0 or height <= 0 or max(width, height) <= target:
        return []
    side_of = lambda c, r: max(min(width, math.ceil(width / c * (1 + overlap))), min(height, math.ceil(height / r * (1 + overlap))))
    grids = [(c, r) for c in range(1, most + 1) for r in range(1, most // c + 1)]
    best, at, least, cheap = math.inf, (1, 1), math.inf, None
    for c, r in grids:
        side = side_of(c, r)
        if side < best or (side == best and c * r < at[0] * at[1]):
            best, at = side, (c, r)
        if side <= target and (c * r < least or (c * r == least and side < best)):
            least, cheap = c * r, (c, r)
    if best * 2 > max(width, height):
        return []
    cols, rows = cheap or at
    tw, th = min(width, math.ceil(width / cols * (1 + overlap))), min(height, math.ceil(height / rows * (1 + overlap)))
    place = lambda i, n, full, size: 0 if n == 1 else half_up(i * (full - size) / (n - 1))
    tiles = [(place(c, cols, width, tw), place(r, rows, height, th)) for r in range(rows) for c in range(cols)]
    return list(dict.fromkeys((x, y, min(tw, width - x), min(th, height - y)) for x, y in tiles))


def crop_layout(regions, most=24, width=4096, height=2048, tallest=128, gutter=4, gap=8) -> list[tuple]:
    """place, x, y, width, height of region crops on shelves of one sheet, scaled to the tallest allowed."""
    out, x, y, shelf = [], 0, 0, 0
    for i, r in enumerate(regions):
        if len(out) >= most:
            break
        if not (r[2] > 0 and r[3] > 0):
            continue
        sw, sh = max(1, half_up(r[2])), max(1, half_up(r[3]))
        scale = min(1, tallest / sh)
        dw, dh = max(1, half_up(sw * scale)), max(1, half_up(sh * scale))
        if x + dw > width:
            x, y, shelf = 0, y + shelf + gap, 0
        if y + dh > height:
            break
        out.append((i, x, y, dw, dh))
        x, shelf = x + dw + gutter, max(shelf, dh)
    return out


def opaque(img: np.ndarray, regions) -> np.ndarray:
    """img with every region painted black."""
    out = img.copy()
    for x, y, w, h in regions:
        box = clamped(img, x, y, w, h)
        if box:
            out[box[1] : box[3], box[0] : box[2], :3] = 0
    return out
