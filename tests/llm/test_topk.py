import math
import random

from pyspark.sql import functions as F

from tagloom.llm import exact_topk


def brute(rows, k=5):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in whole.items() if c != q and len(b) == len(a))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) * (1 + i % 7) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2001, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, [1.0] * 8), (2050, [0.0] * 8), (2100, [1.0, 2.0]), (2101, [3.0, 1.0])]
    monkeypatch.setattr(exact_topk, "BUCKET", 64)
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, norm string")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]  # as 32-bit numbers
    found = exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (3, [2.0])], schema)
    assert [tuple(r) for r in exact_topk.top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, 131072)]
    assert exact_topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0


def test_allowed_range_holds_all_close_vectors():
    random.seed(2)
    for _ in range(3000):
        a, b = ([random.gauss(0, 1) for _ in range(3)] for _ in range(2))
        a, b = ([x / math.sqrt(sum(y * y for y in v)) for x in v] for v in (a, b))
        cosine = sum(x * y for x, y in zip(a, b, strict=True))
        low, high = exact_topk.allowed(a[0], cosine)
        assert low <= b[0] <= high


def test_first_round_is_never_empty_and_spares_products(spark):
    """At the default size of buckets: the longest vectors give a score to beat, by which most of the other products are spared."""
    import numpy as np

    rng = np.random.default_rng(5)
    directions = rng.normal(size=(9000, 8))
    lengths = np.where(np.arange(9000) < 4096, 10.0, 0.5)[:, None]
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(directions)]
    rows = [(i, [x * float(lengths[i, 0]) for x in v]) for i, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = exact_topk.integer_vectors(vectors)
    order = ("dims", F.desc("norm"), "vec_id")
    buckets = own.repartitionByRange(1, *order).sortWithinPartitions(*order).mapInArrow(exact_topk._packed(exact_topk.BUCKET), exact_topk._BLOCKS)
    first = exact_topk.first_buckets(buckets).collect()
    assert buckets.count() == 3 and max(r.longest for r in first) == max(r.longest for r in buckets.collect())
    whole = {r.vec_id: np.array(r.v) for r in own.collect()}
    ids = np.array(sorted(whole))
    matrix = np.stack([whole[i] for i in ids])
    queries = ids[ids % 50 == 0][:20]
    fifth = np.array([sorted((int(whole[q] @ whole[c]) for c in ids[:4096] if c != q), reverse=True)[4] for q in queries], float)
    short = ids >= 4096
    found = exact_topk._best(queries, np.stack([whole[q] for q in queries]), fifth, ids[short], matrix[short], 5)
    assert not found  # against the long ones no short vector is multiplied out or kept
    got = exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0).where("query_id < 1000").collect()
    for q in queries:
        best = sorted((-int(whole[q] @ whole[c]), int(c)) for c in ids if c != q)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(i + 1, c, -v) for i, (v, c) in enumerate(best)]
