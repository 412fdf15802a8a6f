import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointlake import session
from pointlake.operators import changes as C
from pointlake.operators import compaction as P
from pointlake.types import Corrupted, InvalidArgument

CH = "id string, order struct<a: bigint>, op string, value string"
STAMP = "map<string, struct<kind: string, b: boolean, i: bigint, d: double, s: string, ss: array<string>>>"
WAL = f"db_id string, collection string, wal_epoch bigint, seq bigint, ord int, op string, id string, vector array<float>, payload {STAMP}, segment_id bigint, row_count bigint"
SEG = f"db_id string, collection string, segment_id bigint, row_count bigint, ids array<string>, vectors array<float>, payloads array<{STAMP}>, tombstones array<string>"
MAN = "db_id string, collection string, format_version int, generation bigint, segment_ids array<bigint>, wal_epoch bigint"


def stamp(n):
    return {"stamp": {"kind": "int", "b": None, "i": n, "d": None, "s": None, "ss": None}}


def apply(spark, rows, base=None, span=3):
    df = spark.createDataFrame(rows, CH)
    b = spark.createDataFrame(base, CH) if base is not None else None
    return {r["id"]: r["value"] for r in C.apply_changes(b, df, ("id",), F.floor(F.col("order.a") / span)).collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.booleans()), max_size=25), st.integers(0, 99))
def test_equals_a_walk_through_the_log(spark, ops, seed):
    state, rows = {}, []
    for i, (k, up) in enumerate(ops):
        rows.append((k, (i,), "upsert" if up else "delete", f"v{i}" if up else None))
        state.pop(k, None)
        if up:
            state[k] = f"v{i}"
    rows += random.Random(seed).choices(rows, k=5) if rows else []
    random.Random(seed).shuffle(rows)
    assert apply(spark, rows) == state


def test_defined_cases(spark):
    assert apply(spark, []) == {}
    assert apply(spark, [("a", (1,), "upsert", None)]) == {"a": None}
    assert apply(spark, [(None, (1,), "upsert", "x"), ("a", None, "upsert", "x"), ("b", (1,), None, "x"), ("c", (1,), "seal", "x")]) == {}
    assert apply(spark, [("a", (1,), "delete", None), ("a", (1,), "upsert", "x")]) == {"a": "x"}
    assert apply(spark, [("b", (5,), "delete", None), ("z", (5,), "delete", None)], base=[("a", (0,), "upsert", "old"), ("b", (0,), "upsert", "old")]) == {"a": "old"}


def test_hot_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.struct(F.col("id").alias("a")).alias("order"), F.lit("upsert").alias("op"), F.col("id").cast("string").alias("value"))
    got = C.apply_changes(None, rows, ("id",), F.floor(F.col("order.a") / 500)).where("id = 'hot'").first()
    assert got["value"] == "19998"


def store(spark):
    e, d = "é", "é"
    manifests = spark.createDataFrame([
        ("db", "c", 1, 1, [1], 0), ("db", "c", 1, 3, [2, 1, 3, 3], 2), ("db", "c", 1, 3, [2, 1, 3, 3], 2), ("db", "c", 1, 2, [1, 2], 1), ("db", "c", 9, 4, [7], 3), (None, "c", 1, 9, [7], 3), ("db", "no list", 1, 1, None, 0)], MAN)
    segments = spark.createDataFrame([
        ("db", "c", 2, 2, ["a", "b"], [1.0, 1.0, 2.0, 2.0], [stamp(20), stamp(21)], []),
        ("db", "c", 1, 2, ["a", e], [3.0, 3.0, 4.0, 4.0], [stamp(10), stamp(11)], ["b"]),
        ("db", "c", 1, 2, ["a", e], [3.0, 3.0, 4.0, 4.0], [stamp(10), stamp(11)], ["b"]),
        ("db", "c", 3, 0, [], [], [], ["a"]),
        ("db", "c", 3, 5, ["x"], [1.0, 1.0], [stamp(99)], []),  # unfinished
        ("db", "c", 7, 1, ["orphan"], [1.0, 1.0], [stamp(70)], [])], SEG)
    wal = spark.createDataFrame([
        ("db", "c", 2, 5, 0, "upsert", "old", [0.0, 0.0], stamp(50), None, None), ("db", "c", 2, 6, 0, "seal", None, None, None, 3, 0), ("db", "c", 2, 7, 1, "upsert", d, [9.0, 9.0], stamp(71), None, None),
        ("db", "c", 2, 7, 0, "delete", e, None, None, None, None), ("db", "c", 2, 8, 0, "seal", None, None, None, 44, 0), ("db", "c", 2, 9, 0, "upsert", "new", [5.0, 5.0], stamp(90), None, None),
        ("db", "c", 2, 9, 0, "upsert", "new", [5.0, 5.0], stamp(90), None, None), ("db", "only log", 0, 1, None, "upsert", "k", [1.0, 1.0], stamp(1), None, None), ("db", "c", 2, 10, 0, "checkpoint", None, None, None, None, None), ("db", "c", 2, None, 0, "upsert", "lost", [1.0, 1.0], stamp(2), None, None)], WAL)
    return wal, segments, manifests, e


def test_live_points_of_a_store(spark):
    wal, segments, manifests, e = store(spark)
    live = {(r["collection"], r["id"]): (r["payload"]["stamp"]["i"], r["vector"]) for r in C.live_points(wal, segments, manifests).collect()}
    # 2 comes before 1 in the list, so b is gone; segment 3 deletes a; the seal of 44 was never published
    assert live == {("c", e): (71, [9.0, 9.0]), ("c", "new"): (90, [5.0, 5.0]), ("only log", "k"): (1, [1.0, 1.0])}
    assert {(r["collection"], r["n"]) for r in C.count_with_tombstones(wal, segments, manifests).collect()} == {("c", 3), ("only log", 1)}
    assert C.live_points(wal.limit(0), segments.limit(0), manifests.limit(0)).count() == 0
    clash = wal.withColumns({"value": F.lit(1), "order": F.lit(2), "start": F.lit(3), "pos": F.lit(4)})
    assert C.live_points(clash, segments.withColumns({"values": F.lit(1), "pos": F.lit(1), "value": F.lit(0)}), manifests).count() == 3


def test_compaction(spark, tmp_path):
    _, segments, manifests, e = store(spark)
    out = P.compact_segments(segments, manifests, str(tmp_path / "out"))
    assert [(r["id"], r["segment_id"], r["vector"], r["payload"]["stamp"]["i"]) for r in out.collect()] == [(e, 1, [4.0, 4.0], 11)]
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1 and not (tmp_path / "out.parts").exists()
    assert P.compact_segments(segments.limit(0), manifests.limit(0), str(tmp_path / "none")).count() == 0


def test_compaction_sees_a_lost_segment(spark, tmp_path, monkeypatch):
    _, segments, manifests, _ = store(spark)
    true = P.rows_at
    monkeypatch.setattr(P, "rows_at", lambda s, keep: true(s.where("segment_id <> 1"), keep))
    with pytest.raises(Corrupted):
        P.compact_segments(segments, manifests, str(tmp_path / "out"))
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("limit", ["BROADCAST_ROWS", "BROADCAST_BYTES"])
def test_without_broadcasts_the_rows_are_the_same(spark, tmp_path, monkeypatch, limit):
    wal, segments, manifests, _ = store(spark)
    live, packed = C.live_points(wal, segments, manifests), P.surviving_rows(segments, manifests)
    monkeypatch.setattr(session, limit, -1)
    shuffled = C.live_points(wal, segments, manifests)
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, live.collect())) and live.count() == 3
    assert sorted(map(str, P.surviving_rows(segments, manifests).collect())) == sorted(map(str, packed.collect()))
    assert {r["n"] for r in C.count_with_tombstones(wal, segments, manifests).collect()} == {3, 1}


def test_segments_listed_twice_in_a_file(spark, tmp_path):
    wal, segments, manifests, _ = store(spark)
    segments.unionByName(segments).write.parquet(str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    assert P.surviving_rows(again, manifests).count() == P.surviving_rows(segments, manifests).count() == 1
    assert C.live_points(wal, again, manifests).count() == 3


def test_hits_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(("hot" if i % 3 == 0 else f"k{rng.randrange(40)}"), i, rng.choice(["upsert", "delete", "gone"])) for i in range(3000)]
    want, last = {}, {}
    for k, i, op in rows:
        want[k] = want.get(k, 0) + (op == "delete" and last.get(k) == "upsert")
        last[k] = op
    df = spark.createDataFrame(rows, "id string, order long, op string").repartition(7)
    for span in (4, 1024):
        assert {r["id"]: (r["hits"], r["last"]) for r in C.hits(df, ("id",), F.col("order"), span).collect()} == {k: (want[k], last[k]) for k in want}


def test_equal_orders_have_one_result(spark):
    rows = [("a", 1, "upsert", v) for v in ([1.0], [2.0], [3.0])]
    got = {str(C.compose(spark.createDataFrame(p, "id string, order long, op string, value array<double>").repartition(n), ("id",)).collect()) for p in itertools.permutations(rows) for n in (1, 3)}
    assert len(got) == 1


def test_pack_files_of_differing_columns(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    spark.range(5).write.parquet(a)
    spark.range(5).withColumn("extra", F.lit("x")).write.parquet(b)
    for i, order in enumerate(([a, b], [b, a])):
        packed = P.pack_files(spark, order, str(tmp_path / f"out{i}"))
        out = spark.read.parquet(packed.path)
        assert packed.rows == 10 and set(out.columns) == {"id", "extra"} and out.where("extra = 'x'").count() == 5
    spark.range(5).select(F.col("id").cast("string").alias("id")).write.parquet(c)
    with pytest.raises(InvalidArgument):
        P.pack_files(spark, [a, c], str(tmp_path / "out"))
    with pytest.raises(InvalidArgument):
        P.pack_files(spark, [], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and not (tmp_path / "out.staged").exists()


def test_pack_ten_thousand_files(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i in range(10_000):
        pq.write_table(pa.table({"id": [i], "t": ["x" * (i % 50)]}), tmp_path / "many" / f"{i}.parquet")
    packed = P.pack_files(spark, [str(tmp_path / "many")], str(tmp_path / "packed"))
    assert packed.rows == packed.files_before == 10_000 and packed.files_after <= 6
    assert spark.read.parquet(packed.path).agg(F.sum("id")).first()[0] == 10_000 * 9_999 // 2


def test_pack_files(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "packed")
    df = spark.range(1000).select("id", F.create_map(F.lit("k"), "id").alias("m"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 300)).alias("text"))
    df.unionByName(df.limit(5)).repartition(40).write.parquet(src)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    packed = P.pack_files(spark, [src], out, target_bytes=1 << 20)
    assert packed.rows == 1005 and packed.files_before == 40 and packed.files_after <= 6
    assert P.checksum(spark.read.parquet(src)) == P.checksum(spark.read.parquet(out)) and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_verify_segments(spark):
    import zlib

    import numpy as np

    v, ids = [1.0, -2.5], ["a", "réponse"]
    good = (zlib.crc32(np.array(v, dtype="<f4").tobytes()), zlib.crc32("\0".join(ids).encode()))
    cols = "db_id string, collection string, segment_id bigint, row_count bigint, ids array<string>, vectors array<float>, payloads array<int>, tombstones array<string>, vectors_crc32 bigint, ids_crc32 bigint, tombstones_crc32 bigint"
    df = spark.createDataFrame([("d", "c", 1, 2, ids, v, [1, 2], [], *good, 0), ("d", "c", 2, 3, ids, v, [1, 2], ["x"], 5, 6, zlib.crc32(b"x")), ("d", "c", 3, None, None, None, None, None, None, None, None), ("d", "c", 4, 0, [], [], [], [], 0, 0, 0), ("d", "c", 5, 1, ["a"], [None], [1], [], 0, 1, 0)], cols)
    got = {r[2]: tuple(r)[3:] for r in C.verify_segments(df).collect()}
    assert got == {1: (True,) * 4, 2: (False, False, True, False), 3: (False,) * 4, 4: (True,) * 4, 5: (True, False, True, False)}
