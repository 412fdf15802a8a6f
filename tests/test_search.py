import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions import vectors as V
from pointlake.operators import search as S
from pointlake.types import InvalidArgument, Metric, ZeroVectorNotAllowed, normalized

SCHEMA = "id string, vector array<float>"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in pairs], SCHEMA)


def loop(a, b, metric):
    """One dimension after the other, in float32."""
    f = np.float32
    s = d = na = nb = f(0)
    for x, y in zip(map(f, a), map(f, b)):
        s, d, na, nb = f(s + f(f(x - y) * f(x - y))), f(d + f(x * y)), f(na + f(x * x)), f(nb + f(y * y))
    if metric is Metric.L2_SQUARED:
        return s
    if metric is Metric.L2:
        return f(np.sqrt(s))
    if metric is Metric.INNER_PRODUCT:
        return f(-d + f(0))
    den = f(f(np.sqrt(na)) * f(np.sqrt(nb)))
    return f(1) if den == 0 else f(f(1) - f(d / den))


@pytest.mark.parametrize("a, b, metric, want", [
    ([0, 0], [3, 4], "l2", 5), ([0, 0], [3, 4], "l2Squared", 25), ([1.5, -2, 0.25], [1.5, -2, 0.25], "l2", 0), ([1, 0], [1, 0], "innerProduct", -1),
    ([1, 0], [-1, 0], "innerProduct", 1), ([1, 0], [1, 0], "cosine", 0), ([1, 0], [0, 1], "cosine", 1), ([0, 0], [1, 1], "cosine", 1), ([0, 0], [0, 0], "cosine", 1),
    ([2, 0], [4, 0], "cosine", 0), ([], [], "l2", 0), ([], [], "innerProduct", 0), ([], [], "cosine", 1),
])
def test_metric_fixtures(spark, a, b, metric, want):
    df = rows_of(spark, [("a", a)])
    assert S.score(df, [float(x) for x in b], metric).first()["distance"] == pytest.approx(want, abs=1e-6)


def test_negative_zero_and_unequal_lengths(spark):
    df = rows_of(spark, [("a", [1, 0]), ("b", [1, 2, 3]), ("c", None)])
    d = {r["id"]: r["distance"] for r in S.score(df, [0.0, 1.0], "innerProduct").collect()}
    assert math.copysign(1, d["a"]) == 1 and d["b"] is None and d["c"] is None


@pytest.mark.parametrize("metric", list(Metric))
def test_kernels_are_bit_equal(spark, metric):
    rng = np.random.default_rng(42)
    m = rng.uniform(-1, 1, (60, 16)).astype(np.float32)
    m[3] = 0
    q = m[7]
    df = rows_of(spark, [(f"r{i:02d}", v) for i, v in enumerate(m.tolist())])
    got = {r["id"]: np.float32(r["distance"]) for r in S.score(df, q.tolist(), metric).collect()}
    arrow = S.sequential_distances(m, q, metric)
    for i in range(len(m)):
        want = loop(m[i], q, metric)
        assert got[f"r{i:02d}"] == want == arrow[i]
    for k in (1, 3, 60, 100):
        a, b = S.topk(df, q.tolist(), k, metric).collect(), S.arrow_topk(df, q.tolist(), k, metric).collect()
        full = sorted(((float(loop(m[i], q, metric)), f"r{i:02d}") for i in range(len(m))))[:k]
        assert [(r["distance"], r["id"]) for r in a] == [(r["distance"], r["id"]) for r in b] == full


def test_ties_nan_and_empty(spark):
    df = rows_of(spark, [("b", [1, 0]), ("a", [1, 0]), ("n", [float("nan"), 0]), ("c", [1, 0])])
    assert [r["id"] for r in S.topk(df, [1.0, 0.0], 2, "l2").collect()] == ["a", "b"]
    assert [r["id"] for r in S.topk(df, [1.0, 0.0], 9, "l2").collect()] == ["a", "b", "c", "n"]
    assert S.topk(df.limit(0), [1.0, 0.0], 2, "l2").count() == 0
    for bad in (0, -1):
        with pytest.raises(InvalidArgument):
            S.topk(df, [1.0, 0.0], bad, "l2")


def test_normalized(spark):
    v = [3.0, 4.0]
    assert normalized(v) == [np.float32(0.6), np.float32(0.8)]
    df = rows_of(spark, [("a", v)])
    assert df.select(V.normalized(F.col("vector"))).first()[0] == normalized(v)
    with pytest.raises(ZeroVectorNotAllowed):
        normalized([0.0, 0.0])
    with pytest.raises(ZeroVectorNotAllowed):
        normalized([1e-30, 0.0])  # the square is 0 in float32
    with pytest.raises(Exception, match="norm 0"):
        rows_of(spark, [("z", [0, 0])]).select(V.normalized(F.col("vector"))).collect()


def test_merge_and_batches(spark):
    part = lambda *p: spark.createDataFrame(list(p), "id string, distance double")
    assert [r["id"] for r in S.merge_topk([part(("b", 1.0)), part(("a", 1.0))], 5).collect()] == ["a", "b"]
    merged = S.merge_topk([part(("a", 2.0)), part(("a", 1.5), ("b", 3.0))], 5).collect()
    assert [(r["id"], r["distance"]) for r in merged] == [("a", 1.5), ("b", 3.0)]
    assert S.merge_topk([part(("a", 2.0))], 0).count() == 0
    rng = random.Random(7)
    pts = rows_of(spark, [(f"p{i:02d}", [rng.uniform(-1, 1) for _ in range(8)]) for i in range(50)])
    q = pts.limit(5).select(F.col("id").alias("qid"), "vector")
    whole = S.batch_topk(pts, q, 3, "cosine").collect()
    blocks = S.batch_topk(pts, q, 3, "cosine", block_bytes=100).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blocks)) and len(whole) == 15
    assert all(r["id"] == r["qid"] for r in whole if r["rank"] == 1)


def test_get_by_ids(spark):
    df = rows_of(spark, [("a", [1]), ("b", [2])])
    assert [(r["ord"], r["id"]) for r in S.get_by_ids(df, ["b", "x", "a", "b"]).collect()] == [(0, "b"), (2, "a"), (3, "b")]


def test_nfc_and_ids(spark):
    df = spark.createDataFrame([("réponse",), ("r\xe9ponse",), ("Å1",), ("Å1",), (None,), ("abc",), ("",)], "id string")
    assert [r[0] for r in df.select(V.nfc(F.col("id"))).collect()] == ["r\xe9ponse", "r\xe9ponse", "\xc51", "\xc51", None, "abc", ""]
    assert [r[0] for r in spark.createDataFrame([("a" * 512,), ("a" * 513,), ("é" * 257,), ("",), (None,)], "id string").select(V.valid_id(F.col("id"))).collect()] == [True, False, False, False, False]
    assert spark.range(1).select(V.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926


def test_usable_points(spark):
    schema = "collection string, id string, vector array<float>, loaded_at timestamp"
    nan, inf = float("nan"), float("inf")
    import datetime as dt

    t = lambda d: dt.datetime(2025, 1, d)
    pts = spark.createDataFrame([("c", "ok", [1.0, 2.0], t(1)), ("c", "ok", [1.0, 2.0], t(2)), ("c", "null", None, t(1)), ("c", "empty", [], t(1)), ("c", "long", [1.0, 2.0, 3.0], t(1)), ("c", "zero", [0.0, 0.0], t(1)),
                                 ("c", "nan", [nan, 1.0], t(1)), ("c", "inf", [inf, 1.0], t(1)), ("c", "hole", [None, 1.0], t(1)), ("x", "unknown", [1.0, 2.0], t(1)), ("c", None, [1.0, 2.0], t(1)), ("c", "again", [5.0, 6.0], None), ("c", "again", None, t(9))], schema)
    cfg = spark.createDataFrame([("c", 2, "l2")], "name string, dimension int, metric string")
    assert sorted((r["id"], r["vector"]) for r in S.usable_points(pts, cfg).collect()) == [("again", [5.0, 6.0]), ("ok", [1.0, 2.0])]


@pytest.mark.parametrize("metric", list(Metric))
def test_many_queries_are_bit_equal(metric):
    rng = np.random.default_rng(8)
    m, q = rng.normal(size=(2500, 9)).astype(np.float32), rng.normal(size=(40, 9)).astype(np.float32)
    m[5], q[3], m[7, 0], m[8, 1] = 0, 0, np.nan, np.inf
    got = S.pairwise(m, q, metric)
    for i in (0, 3, 39):
        assert np.array_equal(got[i], S.sequential_distances(m, q[i], metric), equal_nan=True)


def test_nearest_keeps_ties_and_nan_in_order():
    n = S.Nearest(1, 3)
    n.add(np.array([[2, np.nan, 1, 1, np.inf]], dtype=np.float32), ["e", "n", "d", "c", "i"])
    n.add(np.array([[1, 5, 1]], dtype=np.float32), ["b", "x", "a"])
    assert [i for _, i in n.best[0]] == ["a", "b", "c"]
    m = S.Nearest(1, 4)
    m.add(np.array([[np.nan, np.inf, 3]], dtype=np.float32), ["n", "i", "x"])
    assert [i for _, i in m.best[0]] == ["x", "i", "n"]


def test_collection_knn(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4)).astype(np.float32)
    pts = spark.createDataFrame([(c, f"p{i:02d}", v, None) for c in ("a", "b") for i, v in enumerate(x.tolist())], "collection string, id string, vector array<float>, loaded_at timestamp")
    cfg = spark.createDataFrame([("a", 4, "l2"), ("b", 4, "cosine"), ("none", 4, "l2")], "name string, dimension int, metric string")
    whole = sorted(map(tuple, S.collection_knn(pts, cfg, 5, F.expr("id in ('p03', 'p50')")).collect()))
    assert len(whole) == 20 and whole == sorted(map(tuple, S.collection_knn(pts, cfg, 5, F.expr("id in ('p03', 'p50')"), block_bytes=1).collect()))
    want = S.topk(pts.where("collection = 'b'"), x[50].tolist(), 5, "cosine").collect()
    assert [(r["id"], r["distance"]) for r in want] == [(w[2], w[3]) for w in sorted(whole, key=lambda w: w[4]) if w[0] == "b" and w[1] == "p50"]
    assert S.collection_knn(pts, cfg, 5, F.lit(False)).count() == 0
