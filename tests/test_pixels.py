"""Pixel operators against brute force on drawn pictures."""

import math

import pytest
from pyspark.sql import functions as F

from veldspar.operators import pixels
from veldspar.plans import catalog


def disc(cx, cy, r):
    return {(x, y) for x in range(math.floor(cx - r), math.ceil(cx + r) + 1) for y in range(math.floor(cy - r), math.ceil(cy + r) + 1) if math.hypot(x - cx, y - cy) <= r}


def marked(spark, shapes):
    """shapes: (image, cluster, positions); a later shape leaves earlier ones' pixels alone."""
    seen, rows = set(), []
    for image, cluster, cells in shapes:
        for x, y in cells:
            if (image, x, y) not in seen:
                seen.add((image, x, y))
                rows.append((image, x, y, cluster))
    return spark.createDataFrame(rows, "image long, x int, y int, cluster int").repartition(5)


def thick_curve(width=120, half=1):
    return {(x, round(40 + 12 * math.sin(x / 15)) + k) for x in range(width) for k in range(-half, half + 1)}


def test_chamfer_by_brute_force(spark):
    shapes = {1: thick_curve() | disc(30, 51, 6), 2: disc(10, 10, 8), 3: {(5, 5)}}
    got = {(r.image, r.x, r.y): r.distance for r in pixels.chamfer(pixels.components(marked(spark, [(i, 1, c) for i, c in shapes.items()]))).collect()}
    for i, cells in shapes.items():
        rim = {(x + dx, y + dy) for x, y in cells for dx in (-1, 0, 1) for dy in (-1, 0, 1)} - cells
        for x, y in cells:
            assert got[i, x, y] == min(3 * max(abs(x - a), abs(y - b)) + min(abs(x - a), abs(y - b)) for a, b in rim)
    assert len(got) == sum(map(len, shapes.values()))


def test_depth_beyond_the_bound_raises(spark):
    parts = pixels.components(marked(spark, [(1, 1, disc(10, 10, 8))]))
    with pytest.raises(RuntimeError):
        pixels.chamfer(parts, most_rounds=2)


def test_planted_markers_are_found_within_a_pixel(spark):
    at = lambda x: 40 + 12 * math.sin(x / 15)
    planted = [(20, at(20)), (55, at(55)), (95, at(95))]
    cells = set(thick_curve())
    for x, y in planted:
        cells |= disc(x, y, 6)
    parts = pixels.components(marked(spark, [(7, 1, cells), (8, 1, thick_curve())]))
    thickness = spark.createDataFrame([(7, 3.0), (8, 3.0)], "image long, thickness double")
    found = pixels.markers(pixels.chamfer(parts), thickness)
    rows = sorted(found.collect(), key=lambda r: r.cx)
    assert [r.image for r in rows] == [7, 7, 7]
    assert all(math.hypot(r.cx - x, r.cy - y) <= 1 for r, (x, y) in zip(rows, planted, strict=True))
    body = {(r.x, r.y) for r in pixels.marker_bodies(parts, found).collect()}
    assert body == {(x, y) for x, y in cells if any(math.hypot(x - r.cx, y - r.cy) <= r.reach for r in rows)}


def ring_cells(cx, cy, r, stroke=2, gaps=()):
    return {(x, y) for x, y in disc(cx, cy, r + stroke) if abs(math.hypot(x - cx, y - cy) - r) <= stroke / 2 and not any(a <= math.degrees(math.atan2(y - cy, x - cx)) % 360 < b for a, b in gaps)}


@pytest.mark.parametrize("angle", [201.5, 357.0])
def test_ring_and_notch(spark, angle):
    a = math.radians(angle)
    notch = {p for d in range(38, 50) for p in disc(60 + d * math.cos(a), 60 + d * math.sin(a), 2)}
    dots = {p for k in range(12) for p in disc(60 + 39 * math.cos(k * 0.5 + a + 0.6), 60 + 39 * math.sin(k * 0.5 + a + 0.6), 1) if abs((k * 0.5 + 0.6 + math.pi) % (2 * math.pi) - math.pi) > 0.3}
    frame = {(x, y) for x in range(120) for y in range(120) if x in (0, 119) or y in (0, 119)}
    square_only, sparse = frame, ring_cells(60, 60, 50, gaps=[(0, 170)])
    parts = pixels.components(marked(spark, [(1, 1, ring_cells(60, 60, 50) | notch), (1, 2, dots), (2, 1, square_only), (3, 1, sparse), (4, 1, disc(60, 60, 50)), (5, 1, ring_cells(60, 60, 12))]))
    sizes = spark.createDataFrame([(i, 120, 120) for i in range(1, 6)], "image long, w int, h int")
    found = {r.image: r for r in pixels.rings(parts, sizes).collect()}
    assert set(found) == {1}  # a frame, an arc, a filled disc and a small ring are none
    r = found[1]
    assert abs(r.cx - 60) <= 1 and abs(r.cy - 60) <= 1 and abs(r.radius - 51) <= 1.5 and r.covered == 1.0
    (n,) = pixels.ring_notches(parts, pixels.rings(parts, sizes)).collect()
    assert abs((n.angle - angle + 180) % 360 - 180) < 3


def test_a_plain_ring_has_no_notch(spark):
    parts = pixels.components(marked(spark, [(1, 1, ring_cells(60, 60, 50))]))
    sizes = spark.createDataFrame([(1, 120, 120)], "image long, w int, h int")
    assert pixels.ring_notches(parts, pixels.rings(parts, sizes)).count() == 0


def boxes_of(spark, rows):
    return spark.createDataFrame(rows, "image long, component long, x0 int, x1 int, y0 int, y1 int, is_round boolean").repartition(4)


def random_boxes(n=300, seed=5):
    rows, state = [], seed
    for i in range(n):
        picks = []
        for _ in range(5):
            state = (state * 1103515245 + 12345) % 2**31
            picks.append(state >> 8)
        x, y, w, h = picks[0] % 400, picks[1] % 300, 2 + picks[2] % 20, 3 + picks[3] % 18
        rows.append((1 + i % 2, i, x, x + w - 1, y, y + h - 1, picks[4] % 3 == 0))
    return rows


def runs_by_hand(rows, vertical):
    box = {(r[0], r[1]): (r[4], r[5], r[2], r[3]) if vertical else tuple(r[2:6]) for r in rows}
    head = {k: k for k in box}

    def top(k):
        while head[k] != k:
            k = head[k]
        return k

    for a, (ax0, ax1, ay0, ay1) in box.items():
        for b, (bx0, _, by0, by1) in box.items():
            h, g = ay1 - ay0 + 1, by1 - by0 + 1
            if a[0] == b[0] and (ax0, a[1]) < (bx0, b[1]) and bx0 - ax1 <= 1.3 * max(h, g) and abs(ay0 + ay1 - by0 - by1) / 2 <= 0.4 * max(h, g) and max(h, g) <= 1.67 * min(h, g):
                lo, hi = sorted((top(a), top(b)))
                head[hi] = lo
    dots = {(r[0], r[1]): r[6] for r in rows}
    groups = {}
    for k in box:
        groups.setdefault(top(k), []).append(k)
    return {(k[0], k[1], t[1]) for t, g in groups.items() if len(g) >= 2 and not all(dots[k] for k in g) for k in g}


@pytest.mark.parametrize("vertical", [False, True])
def test_text_runs_by_brute_force(spark, vertical):
    rows = random_boxes()
    got = {tuple(r) for r in pixels.text_runs(boxes_of(spark, rows), vertical).select("image", "component", "run").collect()}
    assert got == runs_by_hand(rows, vertical) and got


def test_a_slanted_word_is_one_run(spark):
    rows = [(1, i, i * 9, i * 9 + 6, 20 + i, 29 + i, False) for i in range(30)]  # drifts by its own height three times
    assert {r.run for r in pixels.text_runs(boxes_of(spark, rows)).collect()} == {0}


def test_aligned_boxes_by_brute_force(spark):
    rows = random_boxes(200, 11)
    expected = set()
    for image in (1, 2):
        order = sorted((r for r in rows if r[0] == image), key=lambda r: ((r[4] + r[5]) / 2, r[1]))
        groups = []
        for r in order:
            centre, h = (r[4] + r[5]) / 2, r[5] - r[4] + 1
            if groups:
                first, last = groups[-1][0], groups[-1][-1]
                f = first[5] - first[4] + 1
                if centre - (last[4] + last[5]) / 2 <= max(2.5, 0.25 * f) and max(h, f) <= 1.43 * min(h, f):
                    groups[-1].append(r)
                    continue
            groups.append([r])
        expected |= {(image, r[1], n) for n, g in enumerate(groups) if len(g) >= 3 and not all(q[6] for q in g) for r in g}
    got = {tuple(r) for r in pixels.aligned_boxes(boxes_of(spark, rows)).select("image", "component", "row").collect()}
    assert got == expected and got


def test_faint_lines_join_what_they_touch(spark):
    dark, pale = [(x, 5) for x in range(4)], [(x, 5) for x in range(4, 30)]
    colours = {(x, y): (255, 255, 255) for x in range(40) for y in range(20)}
    colours |= {k: (0, 0, 0) for k in dark} | {k: (230, 230, 230) for k in pale} | {(35, 15): (230, 230, 230), (20, 10): (245, 245, 245)}
    px = spark.createDataFrame([(1, x, y, *c) for (x, y), c in colours.items()], "image long, x int, y int, r int, g int, b int")
    bg = pixels.background(px)
    pale_found = pixels.faint(px, bg)
    assert {(r.x, r.y) for r in pale_found.collect()} == set(pale) | {(35, 15)}
    fg = pixels.foreground(px, bg).select("image", "x", "y", F.lit(0).alias("cluster"))
    assert {(r.x, r.y) for r in fg.collect()} == set(dark)
    assert {(r.x, r.y) for r in pixels.absorbed_faint(fg, pale_found).collect()} == set(dark) | set(pale)


def test_vertical_bands_are_turned_horizontal_ones(spark):
    cells = {(x, y) for x in range(60) for y in range(60) if x in (10, 11, 40) or (y == 30 and x < 20)}
    m = marked(spark, [(1, 1, cells)])
    assert {tuple(r) for r in pixels.line_bands(m, vertical=True).collect()} == {(1, 10, 11), (1, 40, 40)}
    turned = m.withColumns({"x": F.col("y"), "y": F.col("x")})
    assert {tuple(r) for r in pixels.line_bands(turned).collect()} == {(1, 10, 11), (1, 40, 40)}


def test_components_across_tiles(spark):
    """A snake through many tiles, a diagonal over their corners, separate blobs and repeated rows, against a walk."""
    snake = {(x, 100 * k) for k in range(8) for x in range(-300, 700)} | {(699 if k % 2 == 0 else -300, y) for k in range(7) for y in range(100 * k, 100 * k + 100)}
    diagonal = {(k, 511 - k) for k in range(512)} - {(256, 255)}
    shapes = [(1, 1, snake), (1, 2, {(x, y + 50) for x, y in disc(256, 256, 9)}), (2, 1, diagonal), (3, 1, {(255, 255), (256, 256), (256, 900), (257, 901), (0, -1), (0, 0)})]
    pixel = marked(spark, shapes)
    rows = pixels.components(pixel.union(pixel.filter("image = 3"))).collect()
    got = {(r.image, r.cluster, r.x, r.y): r.component for r in rows}
    left, want = set(got), {}
    while left:
        first = left.pop()
        todo, group = [first], [first]
        while todo:
            i, c, x, y = todo.pop()
            for near in [(i, c, x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
                if near in left:
                    left.remove(near)
                    todo.append(near)
                    group.append(near)
        want |= dict.fromkeys(group, min(y * (1 << 20) + x for _, _, x, y in group))
    assert got == want
    assert len(rows) == pixel.count() + 6


def test_pixels_are_not_broadcast(spark):
    """Tables of pixels are small as files; none may be collected for a broadcast."""
    found = pixels.chamfer(pixels.components(marked(spark, [(1, 1, disc(10, 10, 8))])).withColumn("more", F.lit(1)))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def broadcasts(df):
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_rings_and_notches_are_not_broadcast(spark):
    parts = pixels.components(marked(spark, [(1, 1, ring_cells(60, 60, 50)), (1, 2, disc(60, 60, 3))]))
    found = pixels.rings(parts, spark.createDataFrame([(1, 120, 120)], "image long, w int, h int"))
    assert not broadcasts(found) and not broadcasts(pixels.ring_notches(parts, found))


def test_text_runs_are_not_broadcast(spark):
    written = pixels._written(boxes_of(spark, random_boxes()), "boxes")
    assert not broadcasts(pixels.near_pairs(written.withColumnRenamed("component", "p"))) and not broadcasts(pixels.text_runs(written))


def test_markers_and_bodies_are_not_broadcast(spark):
    parts = pixels.components(marked(spark, [(7, 1, thick_curve() | disc(55, 34, 6)), (8, 1, thick_curve())]))
    found = pixels.markers(pixels.chamfer(parts), parts.select("image").distinct().withColumn("thickness", F.lit(3.0)))
    assert found.count() == 1
    assert not broadcasts(found) and not broadcasts(pixels.marker_bodies(parts, found))
    assert not broadcasts(catalog.queries()["px18_markers"](spark, "/root/testdata/sf0.001"))
