"""Pixel functions against plain loops over their definitions."""

import math

import numpy as np
import pytest

from redactlake import catalog
from redactlake.functions import audio as A
from redactlake.functions import draws as D
from redactlake.functions import pixels as K
from redactlake.plans import frames as FR

CASES = [(i, n, r) for i in range(24) for n, r in enumerate(FR.regions(i))]


def lattice(left, top, right, bottom):
    row = 0
    for y in range(top, bottom, 3):
        for x in range(left + row % 3, right, 3):
            yield y, x
        row += 1


def test_measures_on_the_lattice():
    for i, _, r in CASES:
        a, b = FR.drawn(i).astype(int), FR.shipped(i).astype(int)
        box = K.clamped(a, *r)
        if box is None:
            assert K.black_share(b, *r) == K.difference(a, b, *r) == K.variance(a, *r) == 0
            continue
        at = list(lattice(*box))
        black = [all(b[y, x, c] < 30 for c in range(3)) for y, x in at]
        diff = [sum(abs(a[y, x, c] - b[y, x, c]) for c in range(3)) / 765 for y, x in at]
        changed = [any(abs(a[y, x, c] - b[y, x, c]) >= 8 for c in range(3)) for y, x in at]
        greys = [sum(a[y, x, :3]) / 3 for y, x in at]
        mean = sum(greys) / len(greys)
        assert math.isclose(K.black_share(FR.shipped(i), *r), sum(black) / len(at), abs_tol=1e-9)
        assert math.isclose(K.difference(FR.drawn(i), FR.shipped(i), *r), sum(diff) / len(at), abs_tol=1e-9)
        assert math.isclose(K.changed_share(FR.drawn(i), FR.shipped(i), *r), sum(changed) / len(at), abs_tol=1e-9)
        assert math.isclose(K.variance(FR.drawn(i), *r), sum((g - mean) ** 2 for g in greys) / len(at), abs_tol=1e-6)


def test_gradients_and_edges():
    for i, _, (x, y, w, h) in CASES:
        img = FR.drawn(i)
        g = lambda yy, xx: sum(int(v) for v in img[yy, xx, :3]) / 3  # noqa: E731, B023
        box, total = K.clamped(img, x, y, w, h), 0.0
        if box:
            for yy in range(box[1] + 2, box[3] - 2, 2):
                for xx in range(box[0] + 2, box[2] - 2, 2):
                    total += abs(g(yy, xx + 2) - g(yy, xx - 2)) + abs(g(yy + 2, xx) - g(yy - 2, xx))
        assert math.isclose(K.gradient(img, x, y, w, h), total, abs_tol=1e-6)
        left, top, right, bottom = max(0, math.floor(x)), max(0, math.floor(y)), min(FR.WIDTH, math.ceil(x + w)), min(FR.HEIGHT, math.ceil(y + h))
        own = [abs(g(yy, xx + 1) - g(yy, xx - 1)) + abs(g(yy + 1, xx) - g(yy - 1, xx)) for yy, xx in lattice(left + 1, top + 1, right - 1, bottom - 1)] if right - left >= 3 and bottom - top >= 3 else []
        assert math.isclose(K.edges(img, x, y, w, h), sum(own) / len(own) if own else 0.0, abs_tol=1e-6)


def test_blur_and_sharpening():
    img = FR.drawn(2)
    out = K.blurred(img, 3)
    pad = np.pad(img[..., 0].astype(float), 3, mode="edge")
    for y, x in ((0, 0), (10, 20), (47, 63), (5, 62)):
        assert abs(int(out[y, x, 0]) - pad[y : y + 7, x : x + 7].mean()) <= 0.51
    sharp = K.sharpened(img, 5, 5, 20, 20)
    assert (sharp[:5] == img[:5]).all()
    for y, x in ((5, 5), (12, 17), (24, 24)):
        near = img[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4, 1].astype(float)
        assert abs(int(sharp[y, x, 1]) - min(255, max(0, 2 * float(img[y, x, 1]) - near.mean()))) <= 0.51


def test_attacks_tell_weak_blurs_from_paint():
    img, box = FR.drawn(9), (10.0, 10.0, 30.0, 20.0)
    weak, part = img.copy(), img[10:30, 10:40]
    weak[10:30, 10:40] = K.blurred(part, 1)
    assert K.attacks(img, weak, [box]) and not K.attacks(img, K.opaque(img, [box]), [box])
    assert K.verdict(img, K.opaque(img, [box]), "opaque", True, *box) == "redacted" and K.verdict(img, img, "blur", False, *box) == "leaked"
    assert K.verdict(img, img, "blur", False, 500, 500, 5, 5) == "skipped"


def test_skin_patches_are_found():
    img = np.zeros((48, 64, 4), np.uint8)
    img[8:32, 12:36, :3] = 220, 170, 140
    assert [b[:4] for b in K.skin_faces(img)] == [(12, 8, 20, 20)] and K.skin_faces(FR.drawn(0) * 0) == []
    assert K.readable(img) and not K.readable(img * 0)


def test_greedy_unions_are_one_pass():
    # the second touches the first only through the third, which comes too late for it
    boxes = [(0, 0, 10, 10, 0.1), (30, 0, 10, 10, 0.2), (10, 0, 20, 10, 0.3)]
    assert K.merged(boxes) == [(0, 0, 30, 10, 0.3), (30, 0, 10, 10, 0.2)]
    assert K.merged_faces([(0, 0, 10, 10, 0.5)], [(1, 1, 8, 8, 0.9), (50, 50, 9, 9, 0.2)]) == [(0, 0, 10, 10, 0.5), (50, 50, 9, 9, 0.2)]


@pytest.mark.parametrize("size", [(300, 200), (1440, 900), (2600, 1700), (400, 3000)])
def test_tiles_cover_the_frame(size):
    w, h = size
    tiles = K.face_tiles(w, h)
    if max(w, h) <= 320:
        assert tiles == []
        return
    assert len(tiles) <= 16
    seen = np.zeros((h, w), bool)
    for x, y, tw, th in tiles:
        assert 0 <= x and x + tw <= w and 0 <= y and y + th <= h
        seen[y : y + th, x : x + tw] = True
    assert seen.all() or not tiles


def test_crops_do_not_overlap():
    for i in range(20):
        slots = K.crop_layout([b[:4] for k in range(6) for b in FR.boxes(i + k)])
        assert len(slots) <= 24
        sheet = np.zeros((2048, 4096), bool)
        for _, x, y, w, h in slots:
            assert not sheet[y : y + h, x : x + w].any()
            sheet[y : y + h, x : x + w] = True


def test_samples_come_back():
    s = np.linspace(-1.2, 1.2, 999)
    assert np.abs(A.from_pcm(A.to_pcm(s)) - np.clip(s, -1, 1)).max() < 4e-5 and A.to_pcm([0.5]) == b"\x00\x40" and len(A.from_pcm(b"\1\2\3")) == 1


#: Queries of frames, by the findings on their time.
TIMED = ["agg29_attacked_frames", "mth36_sharpened", "mth38_attacks", "mth40_difference", "mth41_gradient", "mth42_changed_share", "mth44_verify_regions", "mth45_blurred", "udf06_process_frame", "udf13_verify_shipped"]


@pytest.mark.parametrize("name", TIMED)
def test_a_frame_is_drawn_once_for_all_its_regions(name):
    for made in (FR.drawn, FR.regions, FR.shipped):
        made.cache_clear()
    for i in range(24):
        FR.ROWS[name](i)
    assert all(made.cache_info().misses <= 24 for made in (FR.drawn, FR.regions, FR.shipped))


@pytest.mark.parametrize("name", TIMED)
def test_frames_of_one_file_are_dealt_to_all_cores(spark, name):
    frames = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert frames.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_regions_are_those_of_single_draws():
    for i in [*range(200), 899_999]:
        rng = np.random.default_rng(i + 7)
        assert list(FR.regions(i)) == [tuple(float(rng.integers(*span)) for span in ((-4, 50), (-4, 36), (1, 30), (1, 24))) for _ in range(1 + i % 4)]


def test_measures_read_their_box_alone():
    class Watched(np.ndarray):
        """An image that takes slices only, so that nothing is worked out beyond a box."""

        def astype(self, *args, **kwargs):
            assert self.shape[0] <= 12 and self.shape[1] <= 20 or self.ndim < 3, self.shape
            return super().astype(*args, **kwargs)

    img, box = FR.drawn(2).view(Watched), (10, 10, 20, 12)
    assert K.gradient(img, *box) > 0 and K.edges(img, *box) > 0 and K.variance(img, *box) > 0
    assert K.difference(img, FR.drawn(6), *box) > 0 and K.changed_share(img, FR.drawn(6), *box) > 0


def test_blur_and_sharpening_of_whole_frames():
    """Every pixel against exact fractions, at the edges too."""
    for i in (1, 2, 3, 9):
        img = FR.drawn(i)
        for radius in (1, 6):
            pad, side = np.pad(img[..., 1].astype(int), radius, mode="edge"), 2 * radius + 1
            total = sum(pad[y : y + FR.HEIGHT, x : x + FR.WIDTH] for y in range(side) for x in range(side))
            assert (K.blurred(img, radius)[..., 1] == (2 * total + side**2) // (2 * side**2)).all()
        out = K.sharpened(img, -3.0, 2.5, 90.0, 40.2)
        for y in range(2, 43):
            for x in range(1, 63):
                around = img[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4, 2].astype(float)
                assert abs(int(out[y, x, 2]) - min(255, max(0, 2 * float(img[y, x, 2]) - around.mean()))) <= 0.51
        assert (out[:2] == img[:2]).all() and (out[43:] == img[43:]).all() and (out[:, 0] == img[:, 0]).all() and (out[..., 3] == 255).all()


#: Queries that take frames in stacks.
STACKS = ["mth38_attacks", "mth40_difference", "mth41_gradient", "mth42_changed_share", "mth44_verify_regions", "udf06_process_frame"]


@pytest.mark.parametrize("name", STACKS)
def test_stacked_frames_give_the_rows_of_single_ones(name):
    """Every kind of frame, numbers of 64 bits, one whose regions a generator draws anew, and values that meet a threshold."""
    ids = [*range(240), 899_999, 2**33 + 6, 28_812_348, 256_142, 641_962, 291_298, 584_222, 223_339, 3, 3]
    single = [(i, *r) for i in ids for r in FR.ROWS[name](i)]
    for made in (FR.drawn, FR.shipped):
        made.cache_clear()
    stack = FR.Stack(ids)
    frame, *columns = FR.STACKED[name](stack)
    assert list(zip(stack.ids[frame].tolist(), *(c.tolist() for c in columns), strict=True)) == single
    assert FR.drawn.cache_info().misses == FR.shipped.cache_info().misses == 0


@pytest.mark.parametrize("name", STACKS)
def test_queries_of_stacks_have_a_row_for_each_of_single_frames(spark, name):
    ids = [r.c_custkey for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey").collect()]
    assert sorted(map(tuple, catalog.queries()[name](spark, "/root/testdata/sf0.001").collect())) == sorted((i, *r) for i in ids for r in FR.ROWS[name](i))


def test_draws_of_many_seeds_are_those_of_generators():
    seeds, lows, highs = np.array([*range(50), 2**32 - 1, 2**32, 2**40 + 3]), np.array([-4, 1, 0]), np.array([50, 30, 9])
    assert (D.integers(seeds, lows, highs)[0] == [np.random.default_rng(i).integers(lows, highs) for i in seeds.tolist()]).all()
    assert (D.noise(seeds, 600) == [np.random.default_rng(i).integers(0, 256, 600) for i in seeds.tolist()]).all()
    assert D.integers(np.array([28_812_355]), FR._LOW, FR._HIGH)[1].all()
    with pytest.raises(ValueError):
        D.noise(np.array([-1]), 2)


def test_what_meets_a_threshold_is_not_rounded_past_it():
    for i, n in ((256_142, 0), (641_962, 0), (754_166, 2), (612_462, 0)):
        assert [left for at, left, _ in K.attacks(FR.drawn(i), FR.shipped(i), FR.regions(i)) if at == n] == [K.RESIDUAL]
    assert K.variance(FR.drawn(291_298), *FR.regions(291_298)[1]) == K.PLAIN
