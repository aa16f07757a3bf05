import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import geometry
from tagloom.functions.similarity import ratio
from tagloom.operators import compliance, confidence, extraction, field_scores, images, line_classification, merging
from tagloom.plans import packages
from tagloom.sources import labels as source
from tagloom.sources.rules import RULES, Rule

DEMO = dict(
    product_name="Example Biscuits", mrp="₹50", net_quantity="100 g", manufacturer="Example Foods Pvt Ltd", manufacturer_address="Kolkata, India", manufacture_date="08/2026",
    best_before_use_by="Best Before 6 Months", consumer_care_phone="1800123456",
    text="EXAMPLE BISCUITS\nNET WEIGHT 100 g\nMRP ₹50 INCLUSIVE OF ALL TAXES\nMANUFACTURED BY EXAMPLE FOODS PVT LTD\nKOLKATA INDIA\nMFD 08/2026\nBEST BEFORE 6 MONTHS\nCONSUMER CARE 1800123456",
)


def test_demo_package(spark):
    row = compliance.with_status(compliance.with_checks(spark.createDataFrame([DEMO]))).first()
    assert (row.overall_status, row.total_checks, row.passed, row.failed, row.review, row.not_applicable) == ("NON_COMPLIANT", 21, 9, 7, 3, 2)
    of = lambda s: [c.rule_id for c in row.checks if c.status == s]
    assert of("FAIL") == ["quantity_unit", "dimensions", "unit_sale_price", "number_of_items", "promotional_group", "declaration_legibility", "declaration_language"]
    assert of("REVIEW") == ["packing_date", "registration", "quantity_accuracy"] and of("NOT_APPLICABLE") == ["country_of_origin", "wholesale_package"]


def test_all_fields_give_review_and_own_rules_can_comply(spark):
    full = {r.key: "x" for r in RULES} | {"text": None, "package_type": "retail", "imported": True}
    row = compliance.with_status(compliance.with_checks(spark.createDataFrame([full], ", ".join(f"{k} {'boolean' if k == 'imported' else 'string'}" for k in full)))).first()
    assert (row.overall_status, row.passed, row.review, row.not_applicable) == ("REVIEW", 18, 2, 1)
    one = [Rule("a", "A", "", "HIGH", "", None, ("x y", " "))]
    found = compliance.with_status(compliance.with_checks(spark.createDataFrame([("X  Y",), ("z",), (None,)], "text string"), rules=one)).select("overall_status", F.get("checks", 0).getField("message")).collect()
    assert [tuple(r) for r in found] == [("COMPLIANT", "A detected in label text."), ("NON_COMPLIANT", "A was not detected."), ("NON_COMPLIANT", "A was not detected.")]
    assert compliance.with_checks(spark.createDataFrame([], "text string")).count() == 0


def extracted(spark, *texts):
    rows = extraction.extract(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    return [tuple(r[f] for f in extraction.FIELDS) for r in rows]


def test_extraction_by_heading_and_next_lines(spark):
    found = extracted(
        spark,
        "Nutrition Facts\nSUNFLOWER SEEDS\nMRP:\n(399/-)\nNet Weight:\n250GM\nPacked & Marketed By:\nHindvedic Wellness Private Limited\nAddress:\nC-2, F.F, Okhla Industrial Area,\nPhase-1, Delhi - 110020",
        "Green Tea\nMRP Rs. 50.50\nNet Qty 1 kg\nMfd. By Leaf Co.,\nx\nPlot 3, Nagar\nCustomer Care 1",
        "MRP 1999\n1999\nRs 75",
        None, "", " \n ",
        "Oil\nAddress\nMarketed By\nGood Oils\nEmail: a@b.c\nstreet 5 - 560001",
    )
    assert found[0] == ("SUNFLOWER SEEDS", "₹399", "250 G", "Hindvedic Wellness Private Limited", "C-2, F.F, Okhla Industrial Area, Phase-1, Delhi - 110020")
    assert found[1] == ("Green Tea", "₹50.50", "1 KG", "Leaf Co", "Plot 3, Nagar")
    assert found[2][1] == "₹75"
    assert found[3] == found[4] == found[5] == (None,) * 5
    assert found[6][3] == "Good Oils" and found[6][4] == "Marketed By street 5 - 560001"  # "market" is an address word, also inside others


def test_line_classification_and_missing(spark):
    labels = spark.createDataFrame([(1, "MRP\nRs 5\nNet Wt. 5 g\nMfd 08-Jan-2026"), (2, None)], "id int, text string")
    found = {(r.id, r.field): r for r in line_classification.classify_lines(labels, "id").collect()}
    assert found[1, "mrp"].text == "MRP" and found[1, "mrp"].context_score == 0.85 and found[1, "mrp"].semantic_score == 1.0
    assert found[1, "net_quantity"].pattern_score == 1.0 and found[1, "manufacturing_date"].score >= 0.85
    assert not [k for k in found if k[0] == 2]
    missing = line_classification.missing_declarations(labels, line_classification.classify_lines(labels, "id"), "id", F.col("id") == 2).collect()
    assert len([r for r in missing if r.id == 2]) == 8 and {r.field for r in missing if r.id == 1} == {"product_name", "manufacturer", "address", "consumer_care"}


def test_fuzzy_keywords_and_ratio(spark):
    assert ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5 and ratio("", "a") == 0
    rows = spark.createDataFrame([(1, "INGREDIENTZ"), (2, "Ingredients"), (3, None), (4, "???")], "det_idx int, text string")
    found = {r.det_idx: r for r in field_scores.direct_candidates(field_scores.scored(rows)).collect()}
    assert found[1].best_field == "ingredients" and found[2].best_field == "ingredients" and found[1].field_score < found[2].field_score
    assert 3 not in found and found[4].best_field == "unknown" and found[4].field_score == 0


def test_nearby_equals_all_pairs(spark):
    random.seed(1)
    points = [(i % 3, i, random.random() * 900, random.random() * 900) for i in range(150)] + [(0, 900, 5.0, 5.0), (0, 901, 5.0, 5.0)]
    box = geometry.upright_box(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0))
    rows = spark.createDataFrame(points, "image_id int, det_idx int, x double, y double").withColumn("box", box)
    found = {(r.image_id, r.det_idx, r.other_idx) for r in field_scores.nearby(rows, F.lit(1000.0)).collect()}
    assert found == {(a[0], a[1], b[1]) for a in points for b in points if a[0] == b[0] and a[1] != b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 120}


def test_boxes(spark):
    box = geometry.upright_box(F.lit(10), F.lit(20), F.lit(30), F.lit(40))
    other = geometry.upright_box(F.lit(25), F.lit(20), F.lit(30), F.lit(40))
    shuffled = F.array(*[F.get(box, i) for i in (2, 0, 3, 1)])
    row = spark.range(1).select(
        geometry.area(box).alias("area"), geometry.overlap(box, other).alias("iou"), geometry.overlap(box, F.slice(box, 1, 1)).alias("flat"), geometry.ordered_corners(shuffled).alias("o"), box.alias("b"),
        geometry.area(F.array().cast("array<struct<x:double,y:double>>")).alias("none"), geometry.expanded(box, 0.5, F.lit(50.0), F.lit(200.0)).alias("e"), geometry.evidence_label(F.lit(" abc "), F.lit(0.914)).alias("l"),
    ).first()
    assert row.area == 1200 and abs(row.iou - 600 / 1800) < 1e-12 and row.flat == 0 and row.none == 0 and row.o == row.b and row.l == "abc (91%)"
    assert (row.e[0].x, row.e[2].x, row.e[2].y) == (2.5, 47.5, 70.0)


def test_confidence_of_sparse_candidates(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.8, [0.9, 0.5]), (2, None, None, [0.6, 0.55]), (3, 2.0, -1.0, None)], "i int, ocr_confidence double, score double, alternatives array<double>")
    found = {r.i: r.confidence for r in confidence.field_confidence(rows).collect()}
    assert found[1].components.consistency == 0.3935 and found[1].components.ambiguity_penalty == 0 and found[2].components.ambiguity_penalty == 0.2
    assert found[2].score == 0 and found[2].level == "VERY LOW" and found[3].components.ocr == 1 and found[3].components.semantic == 0
    assert abs(found[1].score - (0.27 + 0.2 + 0.05 * 0.39347)) < 1e-4


def test_statistics_of_no_confidence(spark):
    rows = spark.createDataFrame([(1, None), (1, "x"), (2, "0.9")], "image_id int, confidence string")
    found = {r.image_id: r for r in confidence.recognition_quality(rows, "image_id").collect()}
    assert found[1].score == 0 and found[1].detection_count == 2 and found[2].score == 0.935
    none = confidence.summarised(spark.createDataFrame([(1, None)], "k int, confidence_score double"), "k").first()
    assert none.field_count == 0 and none.overall_score == 0 and none.level == "VERY LOW"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, t, c, float(x), float(y), 60.0, 20.0, "s") for i, (t, c, x, y) in enumerate(rows)], "image_id int, det_idx int, text string, confidence double, x double, y double, w double, h double, source string")


def test_merging_and_reading_order(spark):
    rows = boxes(spark, [("MRP Rs 50", 0.5, 10, 10), ("MRP Rs 5O", 0.9, 12, 11), ("MRP Rs 50", 0.8, 500, 400), ("Tea", 0.9, 200, 12), ("zz", 0.05, 1, 1), ("..", 0.9, 900, 900), ("Oil", 0.7, 10, 60)])
    kept = merging.merge_readings(merging.kept_detections(rows), 1000.0)
    assert sorted(r.det_idx for r in kept.collect()) == [1, 2, 3, 6]
    ordered = [r.text for r in merging.reading_order(kept).orderBy("position").collect()]
    assert ordered == ["MRPRs 5O", "Tea", "Oil", "MRPRs 50"]
    assert packages.text_of_images(rows, 1000.0).first().text == "MRPRs 5O\nTea\nOil\nMRPRs 50"
    assert packages.text_of_images(boxes(spark, [("x", 0.9, 0, 0)]).limit(0), 1000.0).count() == 0


def test_views_and_gaps(spark):
    views = spark.createDataFrame([(1, 2, "Tea!\nMRP 5"), (1, 1, "TEA\n\n--\nNew"), (2, 1, None)], "package_id int, view int, text string")
    assert [(r.package_id, r.text) for r in merging.merge_views(views).collect()] == [(1, "TEA\nNew\nMRP 5")]
    have = spark.createDataFrame([(1, None, "Not found", "x", "", None), (2, "n", "m", "q", "f", "a")], "id int, product_name string, mrp string, net_quantity string, manufacturer string, address string")
    more = spark.createDataFrame([(1, {" Product ": "P", "name": "N", "Retail_Price": "", "packed by": "M", "weight": "W"})], "id int, fields map<string,string>")
    found = {r.id: tuple(r)[1:] for r in merging.fill_gaps(have, more, "id").collect()}
    assert found == {1: ("P", "Not found", "x", "M", None), 2: ("n", "m", "q", "f", "a")}
    done = {r.id: (r.found, r.percentage, r.missing) for r in merging.completeness(have).collect()}
    assert done == {1: (1, 20.0, ["product_name", "mrp", "manufacturer", "address"]), 2: (5, 100.0, [])}


def test_image_statistics_of_arrays_and_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (6, 5)).astype(float)
    edged = np.pad(grey, 1, mode="reflect")
    laplacian = edged[:-2, 1:-1] + edged[2:, 1:-1] + edged[1:-1, :-2] + edged[1:-1, 2:] - 4 * grey
    row = spark.createDataFrame([(grey.ravel().tolist(),)], "px array<double>").select(*[c.alias(n) for n, c in images.grey_statistics(F.col("px"), 5, 6).items()]).first()
    assert abs(row.brightness - grey.mean()) < 1e-9 and abs(row.contrast - grey.std()) < 1e-9 and abs(row.sharpness - laplacian.var()) < 1e-6
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "a.png").write_bytes(_png(grey.astype(np.uint8)))
    (tmp_path / "p1" / "broken.png").write_bytes(b"no image")
    from tagloom.sources.images import package_views, read_images

    loaded = read_images(spark, str(tmp_path))
    found = images.capture_quality(images.image_statistics(loaded)).first()
    assert abs(found.brightness - grey.mean()) < 1.0 and found.status in ("GOOD", "ACCEPTABLE", "POOR") and "Move closer to the product." in found.suggestions
    assert [(r.package_id, r.view) for r in package_views(loaded).collect()] == [("p1", "a.png")]


def _png(grey):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = grey.shape
    rows = b"".join(b"\0" + bytes(r) for r in np.repeat(grey[..., None], 3, axis=2).reshape(h, -1))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_rules_from_json(spark, tmp_path):
    import json

    import pytest

    from tagloom.sources.rules import read_rules, rule_table

    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": {"b": {"field": "f", "name": "B", "required": True, "severity": "HIGH", "detection_patterns": ["x"]}, "a": {"name": "A"}}}))
    assert [(r.rule_id, r.key, r.severity, r.required) for r in read_rules(spark, str(path))] == [("b", "f", "HIGH", True), ("a", "a", "MEDIUM", False)]
    path.write_text("{")
    with pytest.raises(ValueError, match="no rules"):
        read_rules(spark, str(path))
    assert rule_table(spark).count() == 21


def test_plan_has_no_shuffle(spark):
    plan = packages.checked_labels(spark.createDataFrame([(1, "x")], "label_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_whole_package_plan(spark):
    views = spark.createDataFrame([(1, 1, "Tea\nMRP: 5", 0.9), (1, 2, "Net Weight: 5 g", 0.7)], "package_id long, view int, text string, confidence double")
    checked, fields = packages.checked_packages(views)
    assert checked.first().mrp == "₹5" and checked.first().net_quantity == "5 G" and fields.count() >= 2
    assert source.IMAGE_WIDTH < source.IMAGE_HEIGHT
