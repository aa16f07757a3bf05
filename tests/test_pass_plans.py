import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tagloom.operators import passes
from tests.test_passes import images, points


def joins_over_passes(plan):
    """The joins that have exploded passes below them, as lines of the plan."""
    above, found = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth]
        if "Generate" in line and "rotation_90" in line:
            found += [x for _, x in above if x.startswith("Join")]
        above.append((depth, line.lstrip(" :+-")))
    return found


@pytest.mark.parametrize("name", ["pass_boxes", "read_in_passes"])
def test_passes_are_never_broadcast(spark, name):
    """Their size is estimated as that of one row for each image, so a join has them after it or is told not to broadcast."""
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "rotation_90" in plan and all("strategy=merge" in j for j in joins_over_passes(plan))


def test_passes_found_by_name_are_those_made(spark):
    box = points((10, 10), (60, 12), (60, 30), (11, 31))
    made = passes.passes(images(spark))
    names = [r.source for r in made.select("source").distinct().collect()] + ["elsewhere", None]
    rows = [(i, n, k, "Net Weight", 0.9, box, "kept") for i in (1, 2, 3, 4, 99, None) for k, n in enumerate(names)]
    found = spark.createDataFrame(rows, "image_id long, source string, det_idx int, text string, confidence double, box array<struct<x:double,y:double>>, width string")
    for corrected in (True, False):
        want = {(r.image_id, r.det_idx): r for r in passes.in_image(found, made, corrected).collect()}
        # one image for each row, so that nothing is merged
        alone = found.withColumn("own", F.col("image_id") * 100 + F.col("det_idx")).where("image_id < 99")
        big = images(spark).crossJoin(spark.range(100)).select((F.col("image_id") * 100 + F.col("id")).alias("image_id"), "width", "height", "corners")
        got = passes.read(alone.drop("image_id").withColumnRenamed("own", "image_id"), big, corrected).collect()
        assert len(got) == 4 * len(names)
        for r in got:
            w = want[r.image_id // 100, r.image_id % 100]
            assert (r.coord_space, r.source, r.width, [tuple(p) for p in r.box]) == (w.coord_space, w.source, w.width, [tuple(p) for p in w.box])
