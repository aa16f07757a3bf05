import math
import random
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import images, masks, pixels


def table(spark, grids):
    rows = [(i, y, [float(v) for v in line]) for i, g in enumerate(grids) for y, line in enumerate(g)]
    return spark.createDataFrame(rows, "image_id int, y int, px array<double>")


def grids_of(lines, n, column="px"):
    out = [{} for _ in range(n)]
    for r in lines.collect():
        out[r.image_id][r.y] = list(r[column])
    return [[g[y] for y in sorted(g)] for g in out]


def random_grids(seed, shapes, most=255):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, most + 1, s).tolist() for s in shapes]


SHAPES = [(9, 12), (1, 1), (1, 7), (6, 1), (40, 33), (3, 2)]


def convolved(grid, weights, border):
    r, h, w = len(weights) // 2, len(grid), len(grid[0])

    def at(i, n):
        if border == "replicate":
            return min(max(i, 0), n - 1)
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    along = [[sum(weights[k + r] * row[at(x + k, w)] for k in range(-r, r + 1)) for x in range(w)] for row in grid]
    return [[math.floor(round(sum(weights[k + r] * along[at(y + k, h)][x] for k in range(-r, r + 1)), 6) + 0.5) for x in range(w)] for y in range(h)]


@pytest.mark.parametrize("border", ["replicate", "reflect"])
@pytest.mark.parametrize("side", [3, 31])
def test_smoothing_equals_two_loops(spark, border, side):
    grids = random_grids(side, SHAPES)
    weights = pixels.gaussian(side)
    assert abs(sum(weights) - 1) < 1e-12 and weights == weights[::-1]
    got = grids_of(pixels.smoothed(table(spark, grids), weights, getattr(pixels, border), "s"), len(grids), "s")
    assert got == [convolved(g, weights, border) for g in grids]


def test_adaptive_threshold_equals_two_loops(spark):
    grids = random_grids(5, SHAPES)
    means = [convolved(g, pixels.gaussian(31), "replicate") for g in grids]
    want = [[[255.0 if v - m > -8 else 0.0 for v, m in zip(a, b)] for a, b in zip(g, n)] for g, n in zip(grids, means)]
    assert grids_of(pixels.adaptive(table(spark, grids)), len(grids)) == want


def otsu_plainly(grid):
    values = [v for row in grid for v in row]
    best, found = 0.0, 0
    for t in range(256):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        if low and high:
            between = round(len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2, 6)
            if between > best:
                best, found = between, t
    return found


def test_otsu_equals_trying_all_thresholds(spark):
    grids = [*random_grids(6, SHAPES), *random_grids(7, [(8, 8)] * 10, 5), [[7, 7], [7, 7]], [[0, 255]]]
    lines = table(spark, grids)
    assert {r.image_id: r.threshold for r in pixels.otsu(lines).collect()} == {i: otsu_plainly(g) for i, g in enumerate(grids)}
    assert grids_of(pixels.otsu_lines(lines), len(grids)) == [[[255.0 if v > otsu_plainly(g) else 0.0 for v in row] for row in g] for g in grids]
    assert pixels.otsu(lines.limit(0)).count() == 0


def test_lines_of_arrays(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], "x"), (2, [], "x"), (3, None, "x")], "image_id int, px array<double>, y string")
    assert sorted(map(tuple, pixels.lines_of(rows, "px", 2).collect())) == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])]


def mask_of(spark, grids):
    return masks.masked(table(spark, grids), F.transform("px", lambda v: v > 0))


def filled(lines, grids):
    out = [[[0] * len(row) for row in g] for g in grids]
    for r in lines.collect():
        for q in r.runs:
            assert 0 <= q.a < q.b
            for x in range(q.a, q.b):
                out[r.image_id][r.y][x] = 1
        assert all(p.b < q.a for p, q in zip(r.runs, r.runs[1:]))
    return out


def plainly(grid, kernel, grow):
    r, h, w = len(kernel) // 2, len(grid), len(grid[0])
    near = lambda y, x: [grid[y + d][x + e] for d in range(-r, r + 1) for e in range(-kernel[d + r], kernel[d + r] + 1) if 0 <= y + d < h and 0 <= x + e < w]
    return [[int(any(near(y, x)) if grow else all(near(y, x))) for x in range(w)] for y in range(h)]


def test_morphology_equals_plain_loops(spark):
    random.seed(8)
    shapes = [(12, 14), (1, 1), (1, 9), (7, 1), (20, 20)] * 2
    grids = [[[int(random.random() < p) for _ in range(w)] for _ in range(h)] for (h, w), p in zip(shapes, [0.5, 1, 0.6, 0.6, 0.85, 0.2, 0, 0.9, 0.9, 0.97])]
    for side in (3, 7):
        kernel = masks.ellipse(side)
        steps = {
            "dilated": (lambda m: masks.dilated(m, kernel), [True]), "eroded": (lambda m: masks.eroded(m, kernel), [False]),
            "opened": (lambda m: masks.opened(m, kernel), [False, True]), "closed": (lambda m: masks.closed(m, kernel, 2), [True, True, False, False]),
        }
        for name, (run, how) in steps.items():
            want = grids
            for grow in how:
                want = [plainly(g, kernel, grow) for g in want]
            assert filled(run(mask_of(spark, grids)), grids) == want, (name, side)


def test_morphology_is_one_shuffle(spark):
    chain = masks.closed(masks.opened(mask_of(spark, [[[1]]]), [0, 1, 0]), [0, 1, 0], 2)
    assert chain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_glare_is_bright_colourless_and_above_its_surroundings(spark):
    dark, shine, label = np.full((60, 60), 40.0), np.full((60, 60), 40.0), np.full((60, 60), 255.0)
    shine[20:32, 20:32] = 255
    grids = [dark.tolist(), shine.tolist(), label.tolist(), shine.tolist(), shine.tolist()]
    lines = table(spark, grids).withColumn("value", F.transform("px", lambda v: v.cast("int")))
    lines = lines.withColumn("saturation", F.transform("px", lambda v: F.when(F.col("image_id") == 3, 200).otherwise(0)))
    lines = lines.withColumn("value", F.transform("value", lambda v: F.when((v == 255) & (F.col("image_id") == 4) & (F.col("y") % 4 > 0), 100).otherwise(v)))
    got = {r.image_id: r.glare for r in masks.glare(lines).collect()}
    background = convolved(shine.tolist(), pixels.gaussian(91, 15.0), "reflect")
    mask = shine >= 250
    for grow in [False, True, True, True, False, False]:
        mask = np.array(plainly(mask.astype(int).tolist(), masks.ellipse(7), grow)) > 0
    want = (mask & (shine - np.array(background) >= 18)).mean() * 100
    assert got[0] == got[2] == got[3] == got[4] == 0 and abs(got[1] - want) < 1e-9 and 2 < want < 5
    stats = spark.createDataFrame([(1, 100.0, 50.0, 90.0, 5.0, 600, 600)], "image_id int, brightness double, contrast double, sharpness double, dark double, width int, height int")
    assert images.capture_quality(stats.join(masks.glare(lines), "image_id")).first().score == 100.0


def flooded(grid):
    h, w = len(grid), len(grid[0])
    seen, found = set(), []
    for y in range(h):
        for x in range(w):
            if grid[y][x] and (y, x) not in seen:
                todo, own = deque([(y, x)]), []
                seen.add((y, x))
                while todo:
                    b, a = todo.popleft()
                    own.append((b, a))
                    for p, q in ((b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                        if 0 <= p < h and 0 <= q < w and grid[p][q] and (p, q) not in seen:
                            seen.add((p, q))
                            todo.append((p, q))
                found.append(own)
    return found


def spiral(n):
    grid = [[0] * n for _ in range(n)]
    y, x, dy, dx = 0, 0, 0, 1
    grid[0][0] = 1
    for _ in range(n * n):
        for _ in range(2):
            p, q, r, s = y + dy, x + dx, y + 2 * dy, x + 2 * dx
            if 0 <= p < n and 0 <= q < n and not (0 <= r < n and 0 <= s < n and grid[r][s]) and not grid[p][q]:
                break
            dy, dx = dx, -dy
        else:
            break
        y, x = p, q
        grid[y][x] = 1
    return grid


def test_regions_equal_flood_fill(spark):
    random.seed(9)
    grids = [[[int(random.random() < p) for _ in range(w)] for _ in range(h)] for h, w, p in ((20, 20, 0.4), (25, 18, 0.5), (5, 5, 0), (1, 9, 0.5), (30, 30, 0.3))] + [spiral(31), [[1, 0, 1, 0, 1], [0, 1, 0, 1, 0]]]
    got = masks.regions(mask_of(spark, grids)).collect()
    for i, grid in enumerate(grids):
        want = Counter()
        for own in flooded(grid):
            ys, xs = [p[0] for p in own], [p[1] for p in own]
            corners = (min((x + y, y, x) for y, x in own)[1:], min((y - x, y, x) for y, x in own)[1:], max((x + y, y, x) for y, x in own)[1:], max((y - x, y, x) for y, x in own)[1:])
            want[len(own), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, corners] += 1
        have = Counter((r.area, r.x, r.y, r.width, r.height, tuple((c.y, c.x) for c in r.corners)) for r in got if r.image_id == i)
        assert have == want, i


def test_boundaries_have_three_outcomes(spark):
    whole = np.zeros((40, 50), int)
    whole[2:39, 1:49] = 1
    small = np.zeros((40, 50), int)
    small[5:20, 5:30] = 1
    sparse = (np.indices((40, 50)).sum(0) % 2).tolist()
    grids = [whole.tolist(), small.tolist(), np.zeros((40, 50), int).tolist(), sparse]
    sizes = spark.createDataFrame([(0, 50, 40, None, None), (1, 50, 40, 90.0, 0.5), (2, 400, 300, 13.0, None), (3, 400, 300, 1.0, 0.001), (4, 400, 300, None, 0.01)], "image_id int, image_width int, image_height int, contrast double, edge_density double")
    got = {r.image_id: r for r in masks.boundaries(masks.regions(mask_of(spark, grids)), sizes).collect()}
    assert [got[i].detection_mode for i in range(5)] == ["OUTER_RECTANGLE", "UNKNOWN", "FULL_IMAGE_LABEL", "UNKNOWN", "FULL_IMAGE_LABEL"]
    share = 37 * 48 / 2000
    score = 0.65 + 0.20 + 0.15 * (1 - (2 / 40) / 0.12)
    assert got[0].area_ratio == round(share * 100, 2) and got[0].confidence == round(score * 100, 2) and [(c.x, c.y) for c in got[0].corners] == [(1, 2), (48, 2), (48, 38), (1, 38)]
    assert (got[1].candidates, got[1].corners, got[2].confidence, got[3].reason) == (1, None, 88.0, masks.REASONS["UNKNOWN"])


@pytest.mark.parametrize("turn", [0.0, 1.5, -2.25])
def test_turn_of_drawn_lines_is_found(spark, turn):
    t = math.tan(math.radians(turn))
    level = [(0, x, round(y0 + x * t)) for y0 in (40, 90, 140, 200) for x in range(200)]
    upright = [(0, round(x0 - y * t), y) for x0 in (60, 120) for y in range(230)]
    noise = random.Random(1)
    points = level + upright + [(0, noise.randrange(200), noise.randrange(240)) for _ in range(200)] + [(1, x, 5) for x in range(200)]
    found = pixels.peaks(pixels.votes(spark.createDataFrame(points, "image_id int, x int, y int").distinct()), 120)
    got = {r.image_id: r for r in pixels.skew(found).collect()}
    assert abs(got[0].turn - turn) <= 0.26 and got[0].turned == (abs(got[0].turn) >= 0.5) and got[0].lines >= 5
    assert got[1].turn == 0 and not got[1].turned


def test_edges(spark):
    assert sorted(map(tuple, pixels.edges(table(spark, [[[0, 0, 9], [0, 0, 9], [9, 9, 9]]]), 9).collect())) == [(0, 0, 1), (0, 1, 0), (0, 1, 1)]
