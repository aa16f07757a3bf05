import datetime
import random
import shutil
import threading

import numpy as np
import pytest

from tagloom.operators.merging import merge_views
from tagloom.sources import committed, history
from tagloom.streaming import labels as streaming
from tagloom.streaming import scans as camera
from tagloom.streaming import views as packages
from tests.test_operators import _png


def rows(spark, values, parts=3):
    return spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)


def test_ids_have_no_gaps_and_a_name_counts_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert committed.read(spark, path, "v long").count() == 0
    assert committed.append(rows(spark, range(10)), path, "a") and not committed.append(rows(spark, range(99)), path, "a")
    assert committed.append(rows(spark, []), path, "none") and committed.append(rows(spark, range(10, 17)), path)
    found = committed.read(spark, path, "v long").collect()
    assert sorted(r.id for r in found) == list(range(1, 18)) and sorted(r.v for r in found) == list(range(17))
    assert {r.v < 10 for r in found if r.id <= 10} == {True}
    assert sorted(map(tuple, committed.read(spark, path, "v long").collect())) == sorted(map(tuple, found))


def test_what_was_not_committed_is_not_read(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    committed.append(rows(spark, [1, 2]), path, "a")

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(committed, "_create_alone", lost)
        with pytest.raises(RuntimeError):
            committed.append(rows(spark, [3, 4]), path, "b")
    assert committed.read(spark, path, "v long").count() == 2
    assert committed.append(rows(spark, [3, 4]), path, "b")
    assert sorted(r.v for r in committed.read(spark, path, "v long").collect()) == [1, 2, 3, 4]


def test_writers_at_once_lose_and_double_nothing(spark, tmp_path):
    path, added, failed = f"{tmp_path}/t", [], []

    def write(k):
        try:
            for i in range(3):
                committed.append(rows(spark, range(100 * k + 10 * i, 100 * k + 10 * i + 5), 2), path, f"{k}-{i}")
            added.append(committed.append(rows(spark, [999], 1), path, "shared"))
        except Exception as e:  # noqa: BLE001  told below
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    found = committed.read(spark, path, "v long").collect()
    assert not failed and sorted(added) == [False, False, False, True]
    assert sorted(r.id for r in found) == list(range(1, 62)) and len({r.v for r in found}) == 61
    assert [r.number for r in committed.commits(spark, path).orderBy("number").collect()] == list(range(1, 14))


def test_stream_with_a_new_checkpoint_keeps_stored_rows(spark, tmp_path):
    day = datetime.datetime(2026, 1, 1, 12)
    source, table, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "history", "checkpoint"))
    spark.createDataFrame([(1, "Tea\nMRP: 5", day)], streaming.SCHEMA).write.mode("append").parquet(source)
    streaming.run_into_history(streaming.checked_once(streaming.read_labels(spark, source)), table, checkpoint).awaitTermination(120)
    shutil.move(checkpoint, f"{checkpoint}-away")
    spark.createDataFrame([(2, "Oil", day)], streaming.SCHEMA).write.mode("overwrite").parquet(source)
    streaming.run_into_history(streaming.checked_once(streaming.read_labels(spark, source)), table, checkpoint).awaitTermination(120)
    assert [(r.id, r.mrp) for r in history.read_history(spark, table).collect()] == [(2, None), (1, "₹5")]


def drawn(width, height, dark=False):
    grey = np.full((height, width), 30, np.uint8)
    if not dark:
        grey[6 : height - 6, 7 : width - 7] = 225
        for y in range(40, height - 40, 30):
            grey[y : y + 3, 40 : width - 40] = 60
    return _png(grey)


def test_camera_two_drops_and_a_restart(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", f"{tmp_path}/scans", f"{tmp_path}/checkpoint"
    folder.mkdir()
    (folder / "a.png").write_bytes(drawn(220, 160))
    (folder / "b.png").write_bytes(drawn(130, 110, dark=True))
    (folder / "broken.png").write_bytes(b"no image")
    run = lambda: camera.run_scans(camera.read_camera(spark, str(folder), most=3), table, checkpoint).awaitTermination(300)
    run()
    (folder / "c.png").write_bytes(drawn(60, 50))
    run()
    run()
    found = {r.image_id.rsplit("/", 1)[1]: r for r in camera.read_scans(spark, table).collect()}
    assert sorted(found) == ["a.png", "b.png", "c.png"] and sorted(r.id for r in found.values()) == [1, 2, 3]
    assert len({r.batch for r in found.values()}) >= 2
    a, b, c = (found[n] for n in ("a.png", "b.png", "c.png"))
    assert (a.detection_mode, a.perspective_applied, a.processing_mode, a.deskew_angle) == ("OUTER_RECTANGLE", True, "OUTER_PACKAGE_CORRECTED", 0.0)
    assert (b.detection_mode, b.label_detected, b.processing_mode) == ("UNKNOWN", False, "FULL_IMAGE_PRESERVED") and "Image is too dark." in b.warnings
    assert c.quality_status and "Image resolution is low. Move closer to the package." in c.warnings


def test_views_in_any_order_give_merged_views(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", packages.PROVIDER)
    random.seed(4)
    day = datetime.datetime(2026, 1, 1, 12)
    views = [(p, v, "\n".join(random.choices(["Tea", "TEA!", "MRP 5", "Net 5 g", "--", "Made in India", "Batch 7"], k=4)), day + datetime.timedelta(seconds=v)) for p in range(6) for v in range(4)] + [(9, 0, None, day)]
    random.shuffle(views)
    want = {r.package_id: r.text for r in merge_views(spark.createDataFrame(views, packages.SCHEMA)).collect()}
    got, closed = {}, {}

    def note(batch, number):
        for r in batch.collect():
            (closed if r.closed else got)[r.package_id] = r.text

    def drop(part):
        spark.createDataFrame(part, packages.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(packages.SCHEMA).parquet(f"{tmp_path}/in")
        merged = packages.merged_as_they_come(stream)
        merged.writeStream.foreachBatch(note).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(300)

    for i in range(3):
        drop(views[i::3])
    assert got == want and not closed
    drop([(77, 1, "Later", day + datetime.timedelta(days=1))])
    assert closed == want
    drop([(0, 5, "Anew", day + datetime.timedelta(days=1))])
    assert got[0] == "Anew"
