import datetime
import json

from tagloom.plans.packages import checked_labels
from tagloom.sources import history
from tagloom.streaming import labels as streaming


def test_history_and_exports(spark, tmp_path):
    path = f"{tmp_path}/history"
    history.create_history(spark, path)
    assert history.read_history(spark, path).count() == 0
    results = checked_labels(spark.createDataFrame([(1, "Tea\nMRP: ₹5")], "label_id long, text string"))
    history.save_scans(results, path, "2026-01-01T00:00:00")
    history.save_scans(results, path, "2026-01-02T00:00:00")
    history.create_history(spark, path)
    found = history.read_history(spark, path).collect()
    assert [r.scanned_at for r in found] == ["2026-01-02T00:00:00", "2026-01-01T00:00:00"] and found[0].mrp == "₹5" and found[0].id > found[1].id > 0
    history.save_scans(results, path, "2026-01-03T00:00:00", batch="b-7")
    history.save_scans(results, path, "2026-01-03T00:00:00", batch="b-7")  # a retry
    assert history.read_history(spark, path).count() == 3 and history.read_history(spark, path).first().scanned_at == "2026-01-03T00:00:00"
    document = json.loads(history.export_json(results).first().value)
    assert document["product_data"]["mrp"] == "₹5" and document["product_data"]["address"] is None and len(document["compliance"]["checks"]) == 21
    history.export_text(results, f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text").count() == 2
    assert history.shown_fields(results).first().address == "Not found"


def test_stream_into_history(spark, tmp_path):
    day = datetime.datetime(2026, 1, 1, 12)
    rows = [(1, "Tea\nMRP: 5", day), (1, "Tea\nMRP: 5", day + datetime.timedelta(minutes=5)), (2, "Oil", day + datetime.timedelta(minutes=20))]
    spark.createDataFrame(rows, streaming.SCHEMA).write.parquet(f"{tmp_path}/in")
    checked = streaming.checked_once(streaming.read_labels(spark, f"{tmp_path}/in"))
    query = streaming.run_into_history(checked, f"{tmp_path}/history", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    assert history.read_history(spark, f"{tmp_path}/history").count() == 2
    query = streaming.run_into_history(checked, f"{tmp_path}/history", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    assert history.read_history(spark, f"{tmp_path}/history").count() == 2  # nothing is processed twice
    table = checked_labels(spark.createDataFrame(rows, streaming.SCHEMA))
    assert [(r.start, r.n) for r in streaming.statuses_by_window(table).orderBy("start").collect()] == [(day, 2), (day + datetime.timedelta(minutes=20), 1)]


def test_numbers_without_a_single_task(spark):
    rows = spark.createDataFrame([(i * 37 % 1009, "x") for i in range(1000)] + [(None, "x")], "k long, t string").repartition(7)
    found = history.numbered(rows, "k").collect()
    assert [r.id for r in sorted(found, key=lambda r: (r.k is not None, r.k or 0))] == list(range(1, 1002))
    assert history.numbered(rows.where("false"), "k").count() == 0
