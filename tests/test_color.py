"""Colour scalars against published vectors and hand-made cases."""

import math

import numpy as np
import pytest
from chromaloom.functions import color
from chromaloom.operators import nearest
from pyspark.sql import functions as F

# Published CIEDE2000 test pairs (Sharma, Wu and Dalal 2005): two Lab triples and their difference.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, 2.8361, -74.0200, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, -1.1848, -84.8006, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, -0.9009, -85.5211, 50.0, 0.0, -82.7485, 1.0000),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669),
    (50.0, 2.4900, -0.0010, 50.0, -2.4900, 0.0009, 7.1792),
    (50.0, 2.4900, -0.0010, 50.0, -2.4900, 0.0011, 7.2195),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 61.0, -5.0, 29.0, 22.8977),
    (50.0, 2.5, 0.0, 56.0, -27.0, -3.0, 31.9030),
    (50.0, 2.5, 0.0, 58.0, 24.0, 15.0, 19.4535),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (63.0109, -31.0961, -5.8663, 62.8187, -29.7946, -4.0864, 1.2630),
    (61.2901, 3.7196, -5.3901, 61.4292, 2.2480, -4.9620, 1.8731),
    (35.0831, -44.1164, 3.7933, 35.0232, -40.0716, 1.5901, 1.8645),
    (22.7233, 20.0904, -46.6940, 23.0331, 14.9730, -42.5619, 2.0373),
    (36.4612, 47.8580, 18.3852, 36.2715, 50.5065, 21.2231, 1.4146),
    (90.8027, -2.0831, 1.4410, 91.1528, -1.6435, 0.0447, 1.4441),
    (90.9257, -0.5406, -0.9208, 88.6381, -0.8985, -0.7239, 1.5381),
    (6.7747, -0.2908, -2.4247, 5.8714, -0.0985, -2.2286, 0.6377),
    (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_ciede2000_pairs(spark):
    df = spark.createDataFrame(PAIRS, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    one, two = [F.col(c) for c in ("l1", "a1", "b1")], [F.col(c) for c in ("l2", "a2", "b2")]
    for r in df.select("want", color.ciede2000(one, two).alias("d"), color.ciede2000(two, one).alias("e"), color.ciede2000(one, one).alias("z")).collect():
        assert abs(r.d - r.want) < 1e-4 and abs(r.d - r.e) < 1e-9 and r.z == 0


def test_oklab_ends_and_adjust(spark):
    df = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (200, 30, 90)], "r int, g int, b int")
    lab = df.select(*color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))).collect()
    assert tuple(lab[0]) == (0, 0, 0)
    assert all(abs(x - y) < 1e-6 for x, y in zip(lab[1], (1, 0, 0), strict=True))
    own = [F.lit(x) for x in lab[2]]

    def moved(hue, lightness, chroma):
        return spark.range(1).select(*color.adjust_oklab(*own, F.lit(hue), F.lit(lightness), F.lit(chroma))).first()

    same = moved(0.0, 0.0, 1.0)
    assert all(abs(x - y) < 1e-12 for x, y in zip(same, lab[2], strict=True))
    turned = moved(90.0, 0.0, 1.0)
    assert abs(turned[0] - lab[2][0]) < 1e-12 and abs(math.hypot(*turned[1:]) - math.hypot(*lab[2][1:])) < 1e-12
    assert moved(0.0, 9.0, 1.0)[0] == 1 and moved(0.0, -9.0, 1.0)[0] == 0
    assert abs(math.hypot(*moved(0.0, 0.0, 2.0)[1:]) - 2 * math.hypot(*lab[2][1:])) < 1e-12


def test_tone_filters(spark):
    df = spark.createDataFrame([(128, 128, 128), (255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    args = [F.col(c) for c in "rgb"]
    rows = df.select(color.bw_hard(*args).alias("h"), color.bw_soft(*args).alias("s"), color.bw_warm(*args).alias("w"), color.apply_filter(F.lit("sepia"), *args).alias("n")).collect()
    assert all(x.h.r == x.h.g == x.h.b and x.s.r == x.s.g == x.s.b and x.w.r >= x.w.g >= x.w.b and x.n is None for x in rows)
    assert rows[1].h.r == rows[1].s.r == rows[1].w.r == 255 and rows[2].h.r == 0


@pytest.mark.parametrize(("text", "want"), [("#0aFf10", (10, 255, 16)), ("#12345", None), ("red", None), (None, None), ("#gg0000", None)])
def test_hex(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(color.hex_to_rgb(F.col("t"))).first()[0]
    assert (got and tuple(got)) == want


def test_names(spark):
    cases = [("N", 0.5, 0.0, "Black"), (None, 9.0, 3.0, "White"), ("YR", 3.0, 6.0, "Dark moderate brown"), ("YR", 7.0, 12.0, "Light vivid orange yellow"), ("R", 5.0, 1.0, "Near-neutral red"), ("X", 1.0, 9.0, "Very dark strong gray")]
    df = spark.createDataFrame(cases, "f string, v double, c double, want string")
    assert all(r.got == r.want for r in df.select("want", color.color_bucket_name(F.col("f"), F.col("v"), F.col("c")).alias("got")).collect())
    df = spark.createDataFrame([("7.5YR 5/6", "YR"), ("N5", None), (" 10B 2/1", "B"), (None, None)], "n string, want string")
    assert all(r.got == r.want for r in df.select("want", color.hue_family(F.col("n")).alias("got")).collect())


def _lab(rng, n):
    return np.stack([rng.uniform(0, 100, n), rng.uniform(-110, 110, n), rng.uniform(-110, 110, n)], axis=1)


@pytest.mark.parametrize(("metric", "distance"), [("squared", nearest.squared), ("ciede2000", nearest.ciede2000)])
def test_chip_trees_find_what_all_pairs_find(metric, distance):
    """Ties by index, equal chips, colours that are chips, grays, tiny and large palettes."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 64, 700):
        points = np.round(_lab(rng, n), 0 if n > 100 else 3)
        points[: n // 4] = points[n // 4 : 2 * (n // 4)]
        index = rng.permutation(n) * 3
        colors = np.concatenate([_lab(rng, 120), points[:40], points[:20] * [1, 0, 0], points[:20] / 50])
        want = [min((round(float(d), 12), int(i)) for d, i in zip(distance(np.repeat(c[None], n, axis=0), points), index, strict=True))[1] for c in colors]
        tree = nearest.ChipTree(index, points, metric)
        assert tree.nearest(colors).tolist() == want
    assert tree.nearest(np.zeros((0, 3))).tolist() == []


def test_a_tree_of_chips_looks_at_few():
    rng = np.random.default_rng(2)
    for metric, share in (("squared", 0.05), ("ciede2000", 0.3)):
        tree, seen = nearest.ChipTree(np.arange(2000), _lab(rng, 2000), metric), []
        whole = tree.distance
        tree.distance = lambda a, b: (seen.append(len(a)), whole(a, b))[1]  # noqa: B023
        tree.nearest(_lab(rng, 300))
        assert sum(seen) < share * 300 * 2000


def test_bound_of_ciede2000():
    rng = np.random.default_rng(3)
    one, two = _lab(rng, 40_000), _lab(rng, 40_000)
    two[:20_000] = one[:20_000] + rng.normal(0, 4, (20_000, 3))
    bound = nearest._ciede2000_bound(np.abs(one - two), one, np.hypot(two[:, 1], two[:, 2]))
    true = nearest.ciede2000(one, two)
    own = (two[:, 0] >= 0) & (two[:, 0] <= 100)
    assert (bound <= true + 1e-9)[own].all() and (bound / np.maximum(true, 1e-9)).max() > 0.5


def test_both_ways_to_ciede2000_agree(spark):
    rng = np.random.default_rng(4)
    one, two = _lab(rng, 500), _lab(rng, 500)
    one[:5, 1:] = 0
    rows = spark.createDataFrame(np.hstack([one, two]).tolist(), "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    got = np.array([r[0] for r in rows.select(color.ciede2000([F.col(c) for c in ("l1", "a1", "b1")], [F.col(c) for c in ("l2", "a2", "b2")])).collect()])
    assert np.allclose(got, nearest.ciede2000(one, two), atol=1e-10)
