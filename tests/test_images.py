"""Image files, pixels, cells and payloads."""

import struct
import zlib

import numpy as np
import pytest
from chromaloom.operators import dither, grid, nearest, regions, shapes
from chromaloom.operators import palette as pal
from chromaloom.sources import images
from pyspark.sql import functions as F


def png(path, pixels):
    """Write an RGB array as a PNG file."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images(spark, tmp_path):
    own = np.random.default_rng(1).integers(0, 256, (5, 7, 3), np.uint8)
    png(tmp_path / "a.png", own)
    (tmp_path / "b.png").write_bytes(b"no image")
    got = images.to_pixels(images.read_images(spark, str(tmp_path))).collect()
    assert len(got) == 35 and all((r.r, r.g, r.b) == tuple(own[r.y, r.x]) for r in got)


def test_written_images_are_read_back(spark, tmp_path):
    """Gray, colour and transparent images of several sizes, one of a single pixel; a second run writes the same files."""
    rng = np.random.default_rng(3)
    own = {f"i{k}": rng.integers(0, 256, (h, w, n), np.uint8) for k, (h, w, n) in enumerate([(5, 7, 3), (1, 1, 3), (70, 3, 3), (4, 6, 1), (9, 2, 4)])}
    rows = spark.createDataFrame([(k, *a.shape, bytearray(a.tobytes())) for k, a in own.items()], "image_id string, height int, width int, channels int, data binary")
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        assert {r.file for r in images.write_images(rows, path).collect()} == {f"{path}/{k}.png" for k in own}
    found = images.to_pixels(images.read_images(spark, path)).withColumn("image_id", F.regexp_extract("image_id", "(i[0-9])[.]png", 1)).collect()
    assert len(found) == sum(a.shape[0] * a.shape[1] for a in own.values())
    for r in found:
        bgr = own[r.image_id][r.y, r.x]
        assert (r.b, r.g, r.r) == (tuple(map(int, bgr[:3])) if len(bgr) > 1 else (int(bgr[0]),) * 3)
    assert images.write_images(rows.limit(0), path).count() == 0


def solid(spark, w=8, h=8, rgb=(10, 120, 240)):
    return spark.createDataFrame([(1, x, y, *rgb) for x in range(w) for y in range(h)], "image_id int, x int, y int, r int, g int, b int")


def test_cells_and_payload(spark):
    grids = spark.createDataFrame([(1, 8, 8, 3, 2)], "image_id int, width int, height int, cells_x int, cells_y int")
    cells = grid.cell_means(solid(spark), grids)
    assert {tuple(r)[3:] for r in cells.collect()} == {(10, 120, 240)} and cells.count() == 6
    sent = grid.encode_cells(cells)
    good, bad = grid.decode_cells(sent)
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, cells.collect())) and bad.count() == 0
    for text in ("AAAA", "%%%", None):
        good, bad = grid.decode_cells(spark.createDataFrame([(1, text, 3, 2)], "image_id int, cells_b64 string, cells_x int, cells_y int"))
        assert good.count() == 0 and bad.count() == 1


def test_crop(spark):
    sizes = spark.createDataFrame([(1, 20, 20)], "image_id int, width int, height int")
    rects = spark.createDataFrame([(1, 5, 6, 10, 12), (1, 0, 0, 9, 20), (2, 0, 0, 10, 10), (1, None, 0, 10, 10)], "image_id int, x int, y int, w int, h int")
    out, bad = grid.crop(solid(spark, 20, 20), rects, sizes)
    assert bad.count() == 3 and out.count() == 120 and out.agg(F.min("x"), F.max("y")).first() == (0, 11)


@pytest.fixture(scope="module")
def chips(spark):
    rows = [(i, *c) for i, c in enumerate([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 0, 255), (128, 128, 128)])]
    return pal.with_oklab(spark.createDataFrame(rows, "chip_idx int, r int, g int, b int")).cache()


def test_snap_dispatch_and_errors(spark, chips):
    cells = spark.createDataFrame([(1, 0, 0, 250, 5, 5), (1, 1, 0, 3, 3, 3)], "image_id int, cx int, cy int, r int, g int, b int")
    for metric in ("oklab", "ciede2000"):
        assert {(r.cx, r.chip_idx) for r in pal.snap(cells, chips, metric).collect()} == {(0, 2), (1, 0)}
    with pytest.raises(ValueError):
        pal.snap(cells, chips, "other")
    with pytest.raises(ValueError):
        dither.map_cells(cells, chips, "other")
    with pytest.raises(ValueError):
        pal.snap(cells, chips.limit(0))


def test_ky_first_pick_is_nearest_and_mean_tends_to_target():
    rng = np.random.default_rng(3)
    lab, target = rng.random((9, 3)), rng.random((20, 3))
    one = dither.ky_candidates(target, lab, 1)[:, 0]
    assert (one == ((target[:, None] - lab[None]) ** 2).sum(2).argmin(1)).all()
    near = [np.linalg.norm(lab[dither.ky_candidates(target, lab, n)].mean(1) - target, axis=1).mean() for n in (1, 4, 16)]
    assert near[0] > near[1] > near[2]
    lights = lab[dither.ky_candidates(target, lab, 8), 0]
    assert (np.diff(lights, axis=1) >= 0).all()


def test_threshold_has_each_value_256_times(spark):
    grid_ = spark.range(256).select(F.col("id").alias("x")).crossJoin(spark.range(256).select(F.col("id").alias("y")))
    counts = grid_.groupBy(dither.threshold(F.col("x"), F.col("y")).alias("v")).count().collect()
    assert len(counts) == 256 and {r["count"] for r in counts} == {256}


def test_diffusion_by_hand():
    lab = np.array([[0.0, 0, 0], [1.0, 0, 0]])
    grid_ = np.full((2, 2, 3), 0.0)
    grid_[..., 0] = 0.4
    # first cell: 0, error .4; right .4 + .175 = .575 -> 1, error -.425; below: .4 + .125 - .0797 = .445 -> 0; last: .4 + .025 - .1328 + .195 = .487 -> 0
    assert dither.diffused(grid_, lab).tolist() == [[0, 1], [0, 0]]
    gray = np.zeros((16, 16, 3))
    gray[..., 0] = 0.5
    assert abs(dither.diffused(gray, lab).mean() - 0.5) < 0.05


def scanned(target, lab):
    """Error diffusion cell by cell, in scan order."""
    h, w, _ = target.shape
    work, out = np.zeros((h + 1, w + 2, 3)), np.empty((h, w), np.int64)
    work[:h, 1 : w + 1] = target
    for y in range(h):
        for x in range(1, w + 1):
            out[y, x - 1] = best = ((lab - work[y, x]) ** 2).sum(axis=1).argmin()
            error = (work[y, x] - lab[best]) / 16.0
            work[y, x + 1] += 7 * error
            work[y + 1, x - 1 : x + 2] += np.array([[3.0], [5.0], [1.0]]) * error
    return out


@pytest.mark.parametrize("cells", [dither.TABLE_CELLS, 40])
def test_diffusion_by_fronts_is_that_of_a_scan(monkeypatch, cells):
    monkeypatch.setattr(dither, "TABLE_CELLS", cells)  # few cells: fronts in blocks
    rng = np.random.default_rng(9)
    for h, w in ((1, 1), (1, 8), (8, 1), (2, 1), (1, 2), (2, 2), (3, 40), (40, 3), (24, 25), (31, 17)):
        target, lab = rng.random((h, w, 3)), rng.random((9, 3))
        assert (dither.diffused(target, lab) == scanned(target, lab)).all()
    flat = np.full((6, 7, 3), 0.5)
    assert (dither.diffused(flat, np.full((4, 3), 0.5)) == 0).all()  # ties: the first chip


def test_diffusion_keeps_the_mean_over_a_ramp():
    lab = np.array([[0.0, 0, 0], [1.0, 0, 0]])
    ramp = np.zeros((64, 64, 3))
    ramp[..., 0] = np.linspace(0, 1, 64)
    done = dither.diffused(ramp, lab)
    assert abs(done.mean() - 0.5) < 0.02 and done[:, :8].mean() < 0.15 and done[:, -8:].mean() > 0.85


def brute_medoids(d, w, k):
    import itertools

    return min((w * d[:, list(c)].min(1)).sum() for c in itertools.combinations(range(d.shape[1]), k))


def test_medoids():
    x = np.array([[0, 0], [0, 1], [1, 0], [50, 50], [50, 51], [51, 50], [99, 0], [99, 1], [98, 0]], float)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert dither.medoids(lambda s: d[s], np.ones(9), 3, 9).tolist() == [0, 3, 6]
    line = np.array([0, 1, 2, 100, 101], float)
    d = np.abs(line[:, None] - line[None])
    got = dither.medoids(lambda s: d[s], np.ones(5), 2, 5)
    assert d[:, got].min(1).sum() == brute_medoids(d, np.ones(5), 2)


def test_medoids_in_blocks(monkeypatch):
    """Points taken in blocks give what all of them at once give; no single exchange is better."""
    rng = np.random.default_rng(3)
    d, w = rng.random((60, 12)), rng.integers(1, 9, 60).astype(float)
    whole = {k: dither.medoids(lambda s: d[s], w, k, 12) for k in (1, 2, 5, 11)}
    monkeypatch.setattr(dither, "TABLE_CELLS", 100)
    for k, got in whole.items():
        assert dither.medoids(lambda s: d[s], w, k, 12).tolist() == got.tolist() and len(set(got.tolist())) == k
        cost = (w * d[:, got].min(1)).sum()
        for i in range(k):
            for c in set(range(12)) - set(got.tolist()):
                assert (w * d[:, [*np.delete(got, i), c]].min(1)).sum() >= cost - 1e-9


def test_the_stored_tile_is_the_rule_s(spark):
    tile = np.frombuffer(dither.blue_noise_tile(), np.uint8).reshape(dither.TILE, dither.TILE)
    assert (tile == dither.blue_noise()).all() and set(np.bincount(tile.ravel())) == {256}
    at = [(0, 0), (3, 200), (255, 255), (256, 511), (-1, -2), (1000, 77)]
    got = spark.createDataFrame(at, "x int, y int").select(dither.threshold(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in got] == [int(tile[y % 256, x % 256]) for x, y in at]


def test_blue_noise():
    tile = dither.blue_noise(32)
    assert sorted(np.unique(tile, return_counts=True)[1]) == [4] * 256
    power = np.abs(np.fft.fft2(tile - tile.mean())) ** 2
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(32), np.fft.fftfreq(32)))
    assert power[(f > 0) & (f < 0.1)].mean() < 0.1 * power[f > 0.3].mean()


@pytest.mark.parametrize("mode", ["recurs", "normconv"])
def test_edge_preserving_flatten(spark, mode):
    rng = np.random.default_rng(0)
    image = np.zeros((20, 30, 3))
    image[:, 15:] = 0.8
    noisy = np.clip(image + rng.normal(0, 0.02, image.shape), 0, 1)
    out = regions.domain_filtered(noisy, 20, 0.4, mode)
    assert np.abs(out - image)[:, 2:-2].mean() < 0.5 * np.abs(noisy - image)[:, 2:-2].mean() and (out[:, 15] - out[:, 14]).min() > 0.5
    assert np.allclose(regions.domain_filtered(np.full((5, 7, 3), 0.3), 20, 0.4, mode), 0.3)
    pix = spark.createDataFrame([(1, x, y, 9, 9, 9) for x in range(4) for y in range(3)], "image_id int, x int, y int, r int, g int, b int")
    assert sorted(map(tuple, regions.flatten_edges(pix, mode=mode).collect())) == sorted(map(tuple, pix.collect()))
    with pytest.raises(ValueError, match="unknown filter"):
        regions.flatten_edges(pix, mode="other")


def test_drawings_without_cells_are_read_as_none(spark):
    docs = spark.createDataFrame([(1, None), (2, "<svg></svg>"), (3, '<svg><rect x="0" y="0" fill="none"/><ellipse cx="0.5" cy="0.5" fill="none"/></svg>')], "image_id int, svg string")
    assert shapes.read_pixelate(docs).count() == 0 and shapes.read_circulate(docs).count() == 0


def test_texture_keeps_chips_and_zero_is_no_op(spark):
    rng = np.random.default_rng(2)
    rows = [(1, x, y, int(rng.integers(0, 20) > 17) + 3) for x in range(12) for y in range(9)]
    cells = spark.createDataFrame(rows, "image_id int, cx int, cy int, chip_idx int")
    assert sorted(map(tuple, dither.texture(cells, 0.0).collect())) == sorted(rows)
    got = dither.texture(cells, 1.0).collect()
    assert len(got) == len(rows) and {r.chip_idx for r in got} <= {3, 4} and sorted(map(tuple, got)) != sorted(rows)


def brute_texture(rows, strength):
    paint, out = {(i, x, y): c for i, x, y, c in rows if c is not None}, []
    around = lambda i, x, y, reach: [paint.get((i, x + dx, y + dy)) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dx or dy]
    for i, x, y, c in rows:
        t = int(dither.blue_noise_tile()[y % 256 * 256 + x % 256])
        if c is not None and t / 255.0 < strength * (around(i, x, y, 1).count(c) / 8.0) ** 3:
            others = [o for o in around(i, x, y, 2) if o not in (None, c)]
            c = max(others, key=others.count) if others else c
        out.append((i, x, y, c))
    return out


def test_texture_by_tiles(spark, monkeypatch):
    """Tiles meet without a seam, whatever is missing; cells are shuffled once."""
    rng = np.random.default_rng(5)
    rows = [(i, x, y, [None, -1, 2, 3][rng.integers(4)] if rng.random() < 0.3 else 5) for i in (1, 2) for x in range(-3, 40) for y in range(21) if rng.random() < 0.95]
    cells = spark.createDataFrame(rows, "image_id int, cx int, cy int, chip_idx int")
    monkeypatch.setattr(regions, "TILE", 16)
    for strength in (0.4, 1.0):
        done = dither.texture(cells, strength)
        assert sorted(map(str, map(tuple, done.collect()))) == sorted(map(str, brute_texture(rows, strength)))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def flood(paint):
    """Brute-force facets: first pixel of each 4-connected area."""
    h, w = paint.shape
    out = np.full((h, w), -1)
    for s in range(h * w):
        todo = [divmod(s, w)]
        if out[todo[0]] >= 0:
            continue
        while todo:
            y, x = todo.pop()
            if 0 <= y < h and 0 <= x < w and out[y, x] < 0 and paint[y, x] == paint[divmod(s, w)]:
                out[y, x] = s
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def test_facets_and_merges():
    rng = np.random.default_rng(5)
    paint = rng.integers(0, 3, (17, 23))
    assert (regions.labelled(paint) == flood(paint)).all()
    lab = np.array([[0.2, 0, 0], [0.3, 0.1, 0], [0.9, 0, 0.1]])
    for radius in (0.0, 1.5):
        done = regions.merged(paint, lab, 12, radius)
        _, area = np.unique(regions.labelled(done), return_counts=True)
        assert set(np.unique(done)) <= {0, 1, 2} and (len(area) == 1 or area.min() >= 12)
    dark = np.zeros((9, 9), int)
    dark[4, 4] = 2
    assert (regions.merged(dark, lab, 5) == 0).all() and (regions.merged(dark, lab, 1) == dark).all()


def test_regions_in_one_pass_are_those_of_all_steps(spark):
    from chromaloom.plans.inputs import palette, pixels

    sf = "/root/testdata/sf0.001"
    pix, chips = pixels(spark, sf), palette(spark, sf)
    kept = dither.select_paints(pix, chips, 4)
    steps = regions.regions(regions.merge_facets(dither.snap_kept(pix, kept, chips).select("image_id", "x", "y", "chip_idx"), chips, 12, 1.0))
    got = regions.painted_regions(pix, kept, chips, 12, 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps.collect())) and got.count() > 1
    assert regions.painted_regions(pix, kept.limit(0), chips, 12).count() == 0


def test_arcs(spark):
    """Two regions side by side and an island: arcs from junction to junction, and a loop; every edge is in one arc."""
    grid_ = np.zeros((6, 8), int)
    grid_[:, 4:] = 1
    grid_[2:4, 1:3] = 2
    pix = spark.createDataFrame([(1, x, y, int(grid_[y, x])) for y in range(6) for x in range(8)], "image_id int, x int, y int, facet_id long")
    edges = regions.boundary_edges(pix)
    got = regions.arcs(edges).toPandas().sort_values(["arc_id", "seq"])
    lines = {k: list(zip(g.x, g.y, strict=True)) for k, g in got.groupby("arc_id")}
    sides = {k: (g.a.iloc[0], g.b.iloc[0]) for k, g in got.groupby("arc_id")}
    assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for l in lines.values() for p, q in zip(l, l[1:]))
    assert sum(len(l) - 1 for l in lines.values()) == edges.count() and sorted(sides.values()).count((0, 2)) == 1
    loop = next(l for k, l in lines.items() if sides[k] == (0, 2))
    assert loop[0] == loop[-1] == (1, 2) and len(loop) == 9
    middle = next(l for k, l in lines.items() if sides[k] == (0, 1))
    assert middle == [(4, y) for y in range(7)]
    ends = {(r.x, r.y) for r in regions.junctions(edges).collect()}
    assert {p for k, l in lines.items() if sides[k] != (0, 2) for p in (l[0], l[-1])} == ends


def test_edge_distance():
    rng = np.random.default_rng(6)
    labels = regions.labelled(np.kron(rng.integers(0, 2, (3, 4)), np.ones((5, 6), int)))
    h, w = labels.shape
    want = np.empty((h, w))
    for y in range(h):
        for x in range(w):
            other = [(j - y) ** 2 + (i - x) ** 2 for j in range(h) for i in range(w) if labels[j, i] != labels[y, x]]
            want[y, x] = min([*other, min(x + 1, w - x, y + 1, h - y) ** 2]) ** 0.5
    assert np.allclose(regions.edge_distance(labels), want)


def areas(rng, h, w, block, paints):
    return np.kron(rng.integers(0, paints, (-(-h // block), -(-w // block))), np.ones((block, block), int))[:h, :w]


def test_distances_of_random_areas():
    rng = np.random.default_rng(12)
    for _ in range(25):
        h, w, block, paints = (int(v) for v in rng.integers(1, 13, 4))
        labels = regions.labelled(areas(rng, h, w, block, 1 + paints % 4))
        edge = regions.facet_edges(labels)
        y, x = np.indices((h, w)).reshape(2, -1)
        gap = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
        other = np.where(labels.ravel()[:, None] != labels.ravel(), gap, 10**6).min(axis=1)
        out = np.minimum(np.minimum(x + 1, w - x), np.minimum(y + 1, h - y)) ** 2
        assert np.allclose(regions.edge_distance(labels).ravel() ** 2, np.minimum(other, out))
        assert (regions.boundary_distance(edge).ravel() == gap[:, edge.ravel()].min(axis=1)).all()
    assert regions.boundary_distance(np.zeros((4, 5), bool)).min() > 81
    assert regions.edge_distance(np.zeros((301, 201), int)).max() == 101


@pytest.fixture(scope="module")
def mosaic(spark):
    """Two images over many tiles of seven pixels: one spiral, and areas of all sizes."""
    rng = np.random.default_rng(21)
    spiral = np.zeros((33, 40), int)
    for k in range(0, 16, 4):
        spiral[k : 33 - k, k : 40 - k] = 1
        spiral[k + 2 : 31 - k, k + 2 : 38 - k] = 0
        spiral[k + 2 : k + 4, 5 + k] = 1
    images_ = {1: spiral, 2: areas(rng, 29, 25, 3, 3), 5: np.zeros((1, 1), int)}
    rows = [(i, x, y, int(p[y, x])) for i, p in images_.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return images_, spark.createDataFrame(rows, "image_id int, x int, y int, chip_idx int").cache()


def test_facets_over_tiles(spark, mosaic, monkeypatch):
    images_, pix = mosaic
    whole = sorted(map(tuple, regions.facets(pix).collect()))
    monkeypatch.setattr(regions, "TILE", 7)
    got = regions.facets(pix).collect()
    assert sorted(map(tuple, got)) == whole
    for i, paint in images_.items():
        found = np.full(paint.shape, -1)
        for r in got:
            if r.image_id == i:
                found[r.y, r.x] = r.facet_id
        assert (found == flood(paint)).all()
    assert regions.facets(pix.limit(0)).count() == 0


def test_tiles_change_nothing(spark, mosaic, monkeypatch):
    """Neighbours, edges, widths and wide pixels of images in one tile and in many, against brute force."""
    images_, pix = mosaic
    own = regions.facets(pix).cache()
    every = lambda: [sorted(map(tuple, d.collect())) for d in (regions.facet_adjacency(own), regions.boundary_edges(own), regions.wide_pixels(own, 1.5), regions.wide_pixels(own, 3.0), regions.has_width(own, 2.0))]
    whole = every()
    for i, paint in images_.items():
        labels = flood(paint)
        edge = regions.facet_edges(labels)
        near = {(int(x), int(y)) for y, x in np.argwhere(~edge)}
        assert {(r[1], r[2]) for r in whole[2] if r[0] == i} == {p for p in near if all((p[0] + a, p[1] + b) in near for a in (-1, 0, 1) for b in (-1, 0, 1))}
        pairs = {(int(min(a, b)), int(max(a, b))) for u, v in ((labels[1:], labels[:-1]), (labels[:, 1:], labels[:, :-1])) for a, b in zip(u.ravel(), v.ravel(), strict=True) if a != b}
        assert {r[1:] for r in whole[0] if r[0] == i} == pairs
    monkeypatch.setattr(regions, "TILE", 7)
    assert every() == whole


def test_l0_keeps_edges_and_flattens():
    rng = np.random.default_rng(8)
    step = np.zeros((24, 32, 3))
    step[:, 16:] = 0.8
    noisy = np.clip(step + rng.normal(0, 0.02, step.shape), 0, 1)
    out = regions.smoothed(noisy, 0.01)
    assert out[:, 2:14].std() < noisy[:, 2:14].std() / 3 and (out[:, 20:28].mean() - out[:, 4:12].mean()) > 0.7
    assert np.allclose(regions.smoothed(np.full((8, 8, 3), 0.3), 0.01), 0.3)


def test_document(spark):
    cells = spark.createDataFrame([(1, 0, 0, "#000000"), (1, 1, 0, "#ffffff")], "image_id int, cx int, cy int, hex string")
    dims = spark.createDataFrame([(1, 2, 1)], "image_id int, cells_x int, cells_y int")
    rows = shapes.pixelate_shapes(cells, dims)
    assert rows.count() == 2 + 3 + 2
    svg = shapes.to_documents(rows, dims).first().svg
    assert svg.startswith("<svg ") and svg.index("#000000") < svg.index("#ffffff") < svg.index("<path") and svg.endswith("</svg>")


def test_unique_names(spark):
    chips = spark.createDataFrame([(0, 0.5, 0.0, 0.0), (1, 0.5, 0.0, 0.0), (2, 0.9, 0.0, 0.0)], "chip_idx int, ok_l double, ok_a double, ok_b double")
    names = spark.createDataFrame([(7, 0.5, 0.0, 0.0), (8, 0.6, 0.0, 0.0), (9, 0.5, 0.0, 0.0)], "name_idx int, ok_l double, ok_a double, ok_b double")
    assert sorted(map(tuple, pal.assign_names(chips, names).collect())) == [(0, 7), (1, 9), (2, 8)]
    with pytest.raises(Exception, match="more chips than names"):
        pal.assign_names(chips, names.limit(2)).collect()


def test_a_thousand_equal_chips_take_few_jobs(spark):
    chips = spark.range(1000).select(F.col("id").cast("int").alias("chip_idx"), *(F.lit(0.5).alias(c) for c in ("ok_l", "ok_a", "ok_b")))
    names = spark.range(1200).select(F.col("id").cast("int").alias("name_idx"), (F.col("id") % 7 / 7).alias("ok_l"), *(F.lit(0.5).alias(c) for c in ("ok_a", "ok_b")))
    spark.sparkContext.setJobGroup("equal chips", "equal chips")
    got = {r.chip_idx: r.name_idx for r in pal.assign_names(chips, names).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("equal chips"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    order = sorted(range(1200), key=lambda i: (round((i % 7 / 7 - 0.5) ** 2, 12), i))
    assert got == dict(enumerate(order[:1000])) and jobs < 20


@pytest.mark.parametrize("batch", [1, 7, 2048])
def test_names_in_rounds_are_those_taken_in_turn(spark, monkeypatch, batch):
    monkeypatch.setattr(pal, "NAME_BATCH", batch if batch > 1 else 30)
    rng = np.random.default_rng(4)
    lab, free = np.round(rng.random((80, 3)), 1), np.round(rng.random((90, 3)), 1)  # many ties
    chips = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(lab)], "chip_idx int, ok_l double, ok_a double, ok_b double")
    names = spark.createDataFrame([(1000 - i, *map(float, v)) for i, v in enumerate(free)], "name_idx int, ok_l double, ok_a double, ok_b double")
    order, taken, want = np.argsort([1000 - i for i in range(90)]), set(), []
    for i, v in enumerate(lab):
        best = min((round(float(((free[j] - v) ** 2).sum()), 12), 1000 - j) for j in order if 1000 - j not in taken)
        taken.add(best[1])
        want.append((i, best[1]))
    assert sorted(map(tuple, pal.assign_names(chips, names).collect())) == want


def test_work_size(spark):
    small = spark.createDataFrame([(1, x, y, 10 * x, y, 0) for x in range(6) for y in range(4)], "image_id int, x int, y int, r int, g int, b int")
    assert sorted(map(tuple, grid.to_work_size(small, 1).collect())) == sorted(map(tuple, small.collect()))
    wide = spark.range(600 * 2).select(F.lit(1).alias("image_id"), (F.col("id") % 600).cast("int").alias("x"), F.floor(F.col("id") / 600).cast("int").alias("y"), F.lit(7).alias("r"), F.lit(8).alias("g"), F.lit(9).alias("b"))
    got = grid.to_work_size(wide, 0.0001).toPandas()
    assert got.x.max() == 255 and set(got.r) == {7} and not got.duplicated(["x", "y"]).any()


def test_images_over_the_cap_are_refused():
    import pandas as pd

    with pytest.raises(ValueError, match="pixels"):
        regions._grid(pd.DataFrame({"x": [0, 5000], "y": [0, 5000], "c": [1, 1]}), "c")


def test_names_and_families_of_all_parts(spark):
    from chromaloom.plans import catalogue

    sf = "/root/testdata/sf0.01"
    keys = {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    assert {r.chip_idx for r in catalogue.QUERIES["c13_hue_family"](spark, sf).collect()} == keys and len(keys) > 64
    got = catalogue.QUERIES["d9_assign_names"](spark, sf).toPandas()
    assert set(got.chip_idx) == set(got.name_idx) == keys and len(got) == len(keys)
    assert (got.chip_idx // 64 == got.palette_id).all() and (got.name_idx // 64 == got.palette_id).all()


def test_names_by_palette(spark):
    names = spark.createDataFrame([(p, i, 0.1 * ((i * 7 + p) % 11), 0.0, 0.0) for p in range(3) for i in range(9)], "p int, name_idx int, ok_l double, ok_a double, ok_b double")
    chips = spark.createDataFrame([(p, i, 0.1 * ((i * 3 + p) % 5), 0.0, 0.0) for p in range(3) for i in range(5)], "p int, chip_idx int, ok_l double, ok_a double, ok_b double")
    got = sorted(map(tuple, pal.assign_names_by(chips, names, "p").collect()))
    want = [(p, *r) for p in range(3) for r in sorted(map(tuple, pal.assign_names(chips.filter(f"p = {p}").drop("p"), names.filter(f"p = {p}").drop("p")).collect()))]
    assert got == want


def brute_kmeans(rows, k, rounds=15):
    """rows: (count, whole-number place) in the order of their colours."""
    gap = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c, strict=True))
    centres = [max(rows, key=lambda r: r[0])[1]]  # max and min keep the first of equals
    while len(centres) < k:
        far = max(rows, key=lambda r: min(gap(r[1], c) for c in centres))[1]
        if far in centres:
            break
        centres.append(far)
    for _ in range(rounds):
        parts = [[] for _ in centres]
        for n, p in rows:
            parts[min(range(len(centres)), key=lambda i: (gap(p, centres[i]), i))].append((n, p))
        moved = [tuple((2 * sum(n * p[c] for n, p in part) + sum(n for n, _ in part)) // (2 * sum(n for n, _ in part)) for c in range(3)) if part else centres[i] for i, part in enumerate(parts)]
        if moved == centres:
            break
        centres = moved
    return centres


def test_kmeans_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(7)
    rgb = np.repeat(rng.integers(0, 256, (90, 3)), rng.integers(1, 9, 90), axis=0)
    pix = spark.createDataFrame([(1, i, 0, *map(int, c)) for i, c in enumerate(rgb)], "image_id int, x int, y int, r int, g int, b int")
    counts = dither._with_lab(pix.groupBy("r", "g", "b").count(), 1.0).orderBy("r", "g", "b").collect()
    rows = [(r["count"], (int(np.floor(r["__l"] * 1e6 + 0.5)), *(int(np.floor(r[c] * 1e6 + 0.5)) + dither.SHIFT for c in ("__a", "__b")))) for r in counts]
    for k in (1, 5):
        want = [(i, c[0] / 1e6, (c[1] - dither.SHIFT) / 1e6, (c[2] - dither.SHIFT) / 1e6) for i, c in enumerate(brute_kmeans(rows, k))]
        for parts in (1, 23):
            assert sorted(map(tuple, dither.kmeans_colors(pix.repartition(parts), k).collect())) == want
    assert dither.kmeans_colors(pix.limit(3), 9).count() <= 3 and dither.kmeans_colors(pix.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        dither.kmeans_colors(pix, 0)


def test_nearest_of_many_centres(spark):
    """A thousand centres are told apart in vectors, exactly and by the first of equal ones; colours are stored once."""
    rng = np.random.default_rng(1)
    places, centres = rng.integers(0, 4_000_000, (3000, 3)), rng.integers(0, 4_000_000, (1024, 3))
    centres[900] = centres[7]
    places[0] = centres[7]
    d = ((places[:, None] - centres[None]) ** 2).sum(2)
    colors = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(places)], "k int, l long, a long, bb long")
    centres = [tuple(map(int, c)) for c in centres]
    got = colors.select("k", dither._to_centres(centres, "min").alias("d"), dither._to_centres(centres, "argmin").alias("i")).orderBy("k").collect()
    assert [(r.d, r.i) for r in got] == list(zip(d.min(1).tolist(), d.argmin(1).tolist(), strict=True)) and got[0].i == 7


def test_small_palettes_and_images_at_once(spark, monkeypatch):
    """The table of a small palette and the tree agree, ties included; so do channels smoothed together and by themselves."""
    rng = np.random.default_rng(4)
    chips, index, own = np.round(rng.random((64, 3)), 1), rng.permutation(64), np.round(rng.random((3000, 3)), 2)
    image = rng.random((25, 24, 3)).astype(np.float32)
    assert nearest.FEW >= 64 and regions.SMALL >= 600
    at_once = nearest.ChipTree(index, chips).nearest(own), regions.smoothed(image, 0.013)
    monkeypatch.setattr(nearest, "FEW", 0)
    monkeypatch.setattr(regions, "SMALL", 0)
    assert (at_once[0] == nearest.ChipTree(index, chips).nearest(own)).all() and (at_once[1] == regions.smoothed(image, 0.013)).all()
