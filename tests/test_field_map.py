import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from tagloom.functions import dialect, geometry
from tagloom.operators import field_scores

SIDE = 1400.0
TEXTS = ["MRP: Rs. 50", "Net Weight: 250 g", "net wieght", "Manufactured By: Foods", "Marketed By", "Sea Salt", "SEA SALT", "EXP 12/03/2027", "12.50", "", "  ", "care@example.com", "ﬁne Batch No 12", None]


@pytest.mark.parametrize("name", ["field_map_exact", "field_map"])
def test_texts_are_scored_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(field_scores.PATTERNS["customer_care"][0]) == 1


def test_field_map_is_the_ranking_of_all_candidates(spark):
    random.seed(4)
    rows = [(random.choice([1, 2, 3, None]), i, random.choice(TEXTS), random.choice([0.0, 100.0, 168.0, 400.0, -50.0]) + random.choice([0.0, 1 / 3]), float(random.randrange(0, 1400, 42)), random.choice([0.0, 40.0, 333.0])) for i in range(160)]
    rows += [(4, 1, "Sea Salt", 0.0, 0.0, 0.0)] + [(5, 1, "MRP", 5.0, 0.0, 0.0)] * 2 + [(5, 2, "12.50", 5.0, 60.0, 0.0)]
    found = spark.createDataFrame(rows, "image_id long, det_idx int, text string, x double, y double, w double").withColumn("h", F.lit(24.0))
    found = found.withColumn("box", F.when(F.coalesce("det_idx", F.lit(0)) % 11 != 5, geometry.upright_box(*map(F.col, "xywh"))))
    for fuzzy in (False, True):
        scored = field_scores.scored(found, fuzzy)
        direct = field_scores.direct_candidates(scored).select("image_id", "det_idx", "text", F.explode("candidates").alias("c")).selectExpr("image_id", "det_idx", "text", "c.field", "c.score", "'heading_or_direct' AS kind", "0 AS k")
        value = field_scores.value_candidates(scored, SIDE).selectExpr("image_id", "det_idx", "text", "field", "score", "'value' AS kind", "1 AS k")
        name = scored.where("name_score > 0").selectExpr("image_id", "det_idx", "text", "'product_name' AS field", "name_score AS score", "'product_name' AS kind", "2 AS k")
        order = Window.partitionBy("image_id", "field").orderBy(F.desc("score"), "k", "det_idx")
        want = direct.unionByName(value).unionByName(name).select("image_id", "field", F.row_number().over(order).alias("rank"), "kind", "det_idx", "text", "score")
        got = field_scores.field_map(found, SIDE, fuzzy)
        known = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert got.dtypes == want.dtypes and len(got.columns) == 7
        assert known(got) == known(want) and got.count() > 500


def test_quick_rounding_equals_the_exact_one(spark):
    random.seed(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.00005, 0.12345, 0.123449999999, 0.12345000001, 0.2500499999999, 1e300, -1e9, 123456.00005, -0.00004]
    held = odd + [random.uniform(-2, 2) for _ in range(3000)] + [k / 20000 + e for k in range(-2000, 2000) for e in (0, 1e-9, -1e-9, 1e-12, 4e-8)]
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in held], "x double").select(
        "x", *[dialect.quickly(x, d, F.round(x, d)).alias(f"r{d}") for d in (3, 4)], F.round(x, 3).alias("e3"), F.round(x, 4).alias("e4"), dialect.quickly(x, 4, dialect.steady(x, 4)).alias("s"), dialect.steady(x, 4).alias("es")
    )
    for r in rows.collect():
        assert repr((r.r3, r.r4, r.s)) == repr((r.e3, r.e4, r.es)), r.x
