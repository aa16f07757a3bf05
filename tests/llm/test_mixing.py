import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing
from tests.llm.common import ODD, frame


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest, w = total - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        goal = {s: 2 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if goal[s] > 2 * sizes[s]} - capped
        if not over:
            return goal
        capped |= over


def test_targets_totals_and_bounds(spark):
    rows = [(d, " ".join(["w"] * (d * 37 % 90)), None, ["b", "a", "é", None, "tiny", "😀"][min(5, d % 9)]) for d in range(900)]
    docs = frame(spark, rows)
    found = mixing.mixture(docs).collect()
    assert sorted(r.doc_id for r in found) == list(range(900))
    sizes, taken = {}, {}
    for d, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goals = expected_targets(sizes)
    for r in found:
        assert r.target == pytest.approx(goals[r.source], rel=1e-12) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert r.words == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1]))
        taken[r.source] = taken.get(r.source, 0) + r.words * r.copies
    assert sum(goals.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, goal in goals.items():
        least = min(r.words for r in found if r.source == s and r.words)
        assert abs(taken[s] - goal) <= max(10, least / 2)
    again = mixing.mixture(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in found)


def test_pivot_keeps_the_sum_and_settles_one():
    for u in (0.0, 0.3, 0.9):
        p, q = mixing.pivot((0.4, 30), (0.7, 11), u)
        assert p * 30 + q * 11 == pytest.approx(0.4 * 30 + 0.7 * 11) and (p in (0, 1) or q in (0, 1))


def test_rounded_keeps_the_sum_and_the_expectation():
    chance = random.Random(5)
    for _ in range(300):
        words = np.array(sorted((chance.choice([1, 2, 7, chance.randrange(1, 400)]) for _ in range(chance.randrange(1, 40))), reverse=True))
        parts = np.array([chance.uniform(0.01, 0.99) for _ in words]) if chance.random() < 0.5 else np.full(len(words), chance.uniform(0.01, 0.99))
        u = np.array([chance.random() for _ in words])
        out = mixing.rounded(words, parts, u, False)
        assert words @ out == pytest.approx(words @ parts, abs=1e-5) and sum(p not in (0, 1) for p in out) <= 1
        out = mixing.rounded(words, parts, u, True)
        assert all(p in (0, 1) for p in out) and abs(words @ (out - parts)) <= words[0] / 2
    words, parts = np.array([9, 7, 4, 4, 1]), np.array([0.3, 0.6, 0.5, 0.2, 0.7])
    draws = [mixing.rounded(words, parts, np.array([chance.random() for _ in words]), False) for _ in range(20_000)]
    assert np.mean(draws, axis=0) == pytest.approx(parts, abs=0.015)


def test_a_huge_document_and_one_that_stands_alone():
    for u in (0.0, 0.5, 0.99):
        words = np.array([10_000, *[50] * 100])
        out = mixing.rounded(words, np.full(101, 0.6), np.full(101, u), True)
        assert abs(words @ out - 9_000) == 1_000
        alone = [mixing.rounded(np.array([8]), np.array([p]), np.array([u]), last).tolist() for p, last in ((0.6, True), (0.4, True), (0.4, False))]
        assert alone == [[1.0], [0.0], [0.4]]


def test_sources_of_a_table_come_near_their_targets(spark):
    found = mixing.query(spark, "/root/testdata/sf0.001")
    worst = found.join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source"), "doc_id")
    worst = worst.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()
    for r in worst:
        assert abs(r.taken - r.target) <= max(r.least / 2, 0.02 * r.target)


def test_odd_rows(spark):
    found = mixing.mixture(frame(spark, ODD)).collect()
    assert len(found) == len(ODD) and all(r.source is None for r in found)
    assert all(r.copies == 0 for r in found if r.words == 0)
    assert mixing.mixture(frame(spark, [])).count() == 0
    assert mixing.mixture(frame(spark, [(1, ""), (2, None)])).count() == 2


def test_stage_repeats_rows(spark):
    docs = frame(spark, [(i, "a b c " * (i + 1), "en", f"s{i % 2}") for i in range(40)])
    out = mixing.taken(spark, docs, "")
    copies = {r.doc_id: r.copies for r in mixing.mixture(docs).collect()}
    counted = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counted == {d: n for d, n in copies.items() if n} and out.columns == docs.columns
