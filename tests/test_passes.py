import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import projective
from tagloom.functions.similarity import may_reach, ratio
from tagloom.operators import merging, passes
from tagloom.plans import recognition

POINT = "array<struct<x:double,y:double>>"


def points(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def solved(source, target):
    """The eight equations, solved by elimination."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(rows, right), 1).reshape(3, 3)


def test_homography_solves_the_equations(spark):
    random.seed(1)
    shake = lambda: random.uniform(-80, 80)
    square = [(0, 0), (700, 0), (700, 500), (0, 500)]
    quads = [([(x + shake(), y + shake()) for x, y in square], [(x + shake(), y + shake()) for x, y in square]) for _ in range(60)] + [(square, square)]
    rows = spark.createDataFrame([(i, points(*a), points(*b)) for i, (a, b) in enumerate(quads)], f"i int, a {POINT}, b {POINT}")
    m = rows.withColumn("m", projective.homography(F.col("a"), F.col("b"))).select("i", "m", projective.mapped(F.col("a"), F.col("m")).alias("there"), projective.mapped(F.col("b"), projective.inverse(F.col("m"))).alias("back"))
    for r in m.collect():
        a, b = quads[r.i]
        assert np.allclose(np.array(r.m).reshape(3, 3) / r.m[8], solved(a, b), atol=1e-9)
        assert np.allclose([(p.x, p.y) for p in r.there], b, atol=1e-6) and np.allclose([(p.x, p.y) for p in r.back], a, atol=1e-6)


def test_no_homography_of_points_on_a_line_or_too_few(spark):
    quads = [(points((0, 0), (1, 0), (2, 0), (3, 0)),), (points((0, 0), (1, 0)),), (None,)]
    rows = spark.createDataFrame(quads, f"q {POINT}")
    unit = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    assert [r[0] for r in rows.select(projective.homography(F.col("q"), unit)).collect()] == [None] * 3


def test_straightened_sizes_and_bounds(spark):
    rows = spark.createDataFrame(
        [(0, points((300, 400), (0, 0), (300, 0), (0, 400))), (1, points((0, 0), (199, 0), (199, 900), (0, 900))), (2, points((0, 0), (5000, 0), (5000, 4000), (0, 4000))), (3, points((0, 0), (90, 0), (90, 900), (0, 900)))], f"i int, q {POINT}"
    )
    got = {r.i: (r.a and (r.a.width, r.a.height), r.b and (r.b.width, r.b.height)) for r in rows.select("i", projective.straightened_for_reading(F.col("q")).alias("a"), projective.straightened_for_scan(F.col("q")).alias("b")).collect()}
    assert got == {0: ((300, 400), (300, 400)), 1: (None, (199, 900)), 2: ((5000, 4000), (2200, 3300)), 3: (None, None)}


IMAGES = f"image_id long, width long, height long, corners {POINT}"


def images(spark):
    askew = points((40, 30), (930, 60), (960, 1300), (20, 1350))
    return spark.createDataFrame([(1, 1000, 1400, askew), (2, 640, 480, None), (3, 1000, 1400, points((0, 0), (60, 0), (60, 60), (0, 60))), (4, 2, 2, None)], IMAGES)


def test_passes_in_order(spark):
    made = passes.passes(images(spark)).orderBy("image_id", "pass_no").collect()
    of = {i: [r.source for r in made if r.image_id == i] for i in (1, 2, 3, 4)}
    assert of[1][:4] == [*passes.STRAIGHTENED, "original"] and len(of[1]) == 3 + 8 + 8 + 18 + 3 and of[1][-1] == "rotation_270"
    assert of[2] == of[3] == of[1][3:] and len(set(of[4])) == len(of[4])


@pytest.mark.parametrize("image", [1, 2])
def test_boxes_come_back_from_every_pass(spark, image):
    random.seed(image)
    w, h = (1000, 1400) if image == 1 else (640, 480)
    boxes = []
    for i in range(30):
        x, y = random.uniform(0, w - 60), random.uniform(0, h - 30)
        boxes.append((i, points((x, y), (x + 50, y + 3), (x + 49, y + 20), (x - 1 if x > 1 else x, y + 18))))
    made = passes.passes(images(spark).where(f"image_id = {image}"))
    seen = spark.createDataFrame(boxes, f"det_idx int, box {POINT}").crossJoin(made).select("image_id", "source", "det_idx", passes.to_pass(F.col("box"), F.col("mapping")).alias("box"))
    back = passes.in_image(seen, made).collect()
    own = dict(boxes)
    assert len(back) == 30 * made.count()
    for r in back:
        assert np.allclose([(p.x, p.y) for p in r.box], [(p["x"], p["y"]) for p in own[r.det_idx]], atol=1e-6), r.source
    kept = {r.source: r.box for r in passes.in_image(seen, made, corrected=False).collect() if r.coord_space == passes.CORRECTED and r.det_idx == 0}
    assert set(kept) == (set(passes.STRAIGHTENED) if image == 1 else set())
    assert all(abs(b[0].x - own[0][0]["x"]) > 1e-3 for b in kept.values())


def test_all_passes_read_like_one(spark):
    words = ["Net Weight", "Sea Salt", "Best Before", "Batch 12", "Made in India", "Ingredients"]
    lines = [(1, "original", i, t, 0.5 + i / 100, points((60, 100 * i + 60), (400, 100 * i + 60), (400, 100 * i + 90), (60, 100 * i + 90))) for i, t in enumerate(words)]
    found = spark.createDataFrame(lines, recognition.DETECTIONS)
    made = passes.passes(images(spark).where("image_id = 1"))
    everywhere = found.drop("source").crossJoin(made.drop("image_id")).select("image_id", "source", "det_idx", "text", "confidence", passes.to_pass(F.col("box"), F.col("mapping")).alias("box"))
    odd = spark.createDataFrame([(1, "elsewhere", 9, "Extra line", 0.9, points((60, 900), (90, 900), (90, 920), (60, 920))), (1, "original", 10, "unsure", 0.1, None), (1, "original", 11, None, 0.9, None), (99, "original", 1, "no image", 0.9, None)], recognition.DETECTIONS)
    read, texts = recognition.texts(images(spark), recognition.Given(everywhere.unionByName(odd)))
    assert [r.text for r in read.orderBy("position").collect()] == words
    assert [(r.image_id, r.text) for r in texts.collect()] == [(1, "\n".join(words))]
    whole = passes.read(everywhere.unionByName(odd), images(spark))
    assert [r.text for r in whole.orderBy("position").collect()] == [*words, "Extra line"]
    assert {r.source for r in whole.collect()} == {"perspective_original", "elsewhere"}
    assert passes.read(everywhere.limit(0), images(spark)).count() == 0


def close_to(text):
    out = list(text)
    for _ in range(random.randint(0, 3)):
        out[random.randrange(len(out))] = random.choice("abcdefgh1 ")
    return "".join(out)


def some_detections(n, side):
    random.seed(n)
    base = ["net weight 100", "mrp 50 rupees", "best before june", "batch 12ab", "a", "!!", ""]
    rows = []
    for i in range(n):
        x, y = random.choice([10.0, 14.0, 300.0, 330.0]) + random.randint(0, 5), random.choice([10.0, 20.0, 200.0, 215.0, 400.0]) + random.randint(0, 6)
        text = random.choice(base)
        rows.append((i % 5, i, close_to(text) if text else text, random.choice([0.2, 0.4, 0.4, 0.9]), x, y, random.choice([40.0, 120.0]), random.choice([0.0, 5.0, 20.0, 60.0])))
    return rows, side


DETECTION = "image_id long, det_idx int, text string, confidence double, x double, y double, w double, h double"


def merged_plainly(rows, side):
    letters = lambda t: "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")

    def alike(a, b):
        p, q = letters(a), letters(b)
        return SequenceMatcher(None, p, q).ratio() if p and q else 0.0

    def iou(a, b):
        ax, ay, aw, ah = a[4:]
        bx, by, bw, bh = b[4:]
        wide, high = max(0, min(ax + aw, bx + bw) - max(ax, bx)), max(0, min(ay + ah, by + bh) - max(ay, by))
        union = aw * ah + bw * bh - wide * high
        return wide * high / union if union > 0 else 0.0

    kept = []
    for row in sorted(rows, key=lambda r: (-r[3], r[1])):
        for other in kept:
            gap = ((row[4] + row[6] / 2 - other[4] - other[6] / 2) ** 2 + (row[5] + row[7] / 2 - other[5] - other[7] / 2) ** 2) ** 0.5
            near, s = gap <= side * 0.035, alike(row[2], other[2])
            if s >= 0.84 and (iou(row, other) >= 0.2 or near) or near and s >= 0.68:
                break
        else:
            kept.append(row)
    return kept


def ordered_plainly(rows):
    lines = []
    for row in sorted(rows, key=lambda r: r[5] + r[7] / 2):
        y, best = row[5] + row[7] / 2, None
        for line in lines:
            gap = abs(y - line["y"])
            if gap <= max(10, max(row[7], 8) * 0.6) and (best is None or gap < abs(y - best["y"])):
                best = line
        if best is None:
            lines.append({"y": y, "rows": [row]})
        else:
            best["rows"].append(row)
            best["y"] = best["y"] * 0.7 + y * 0.3
    return [r for line in sorted(lines, key=lambda x: x["y"]) for r in sorted(line["rows"], key=lambda r: r[4] + r[6] / 2)]


@pytest.mark.parametrize("n,side", [(40, 1000.0), (120, 400.0), (300, 100.0)])
def test_merging_and_order_equal_a_plain_statement(spark, n, side):
    rows, side = some_detections(n, side)
    found = spark.createDataFrame(rows, DETECTION)
    both = merging.merged_in_order(found, side).collect()
    apart = merging.reading_order(merging.merge_readings(found, side)).collect()
    for image in range(5):
        want = merged_plainly([r for r in rows if r[0] == image], side)
        assert sorted(r.det_idx for r in apart if r.image_id == image) == sorted(r[1] for r in want)
        # the order of what is on one height or in one column is that of arrival: by confidence, as merging leaves it
        assert [r.det_idx for r in sorted(both, key=lambda r: r.position) if r.image_id == image] == [r[1] for r in ordered_plainly(want)]


def test_ratio_is_that_of_matching_blocks_and_pruning_loses_none():
    random.seed(3)
    for _ in range(4000):
        a, b = ("".join(random.choices("abcd1", k=random.randint(0, 14))) for _ in range(2))
        exact = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert abs(ratio(a, b) - exact) < 1e-12 if a and b else True
        for least in (0.68, 0.84):
            assert may_reach(len(a), len(b), least) or exact < least
