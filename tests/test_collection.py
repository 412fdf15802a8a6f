import json
import threading

import pytest
from pyspark.sql import functions as F

from pointlake.functions.filters import Eq
from pointlake.plans.collection import Collection, apart, remove_unlisted_segments, repaired_next_segment_id
from pointlake.plans.database import Database
from pointlake.sources.commitlog import Marker, replay_start
from pointlake.sources.files import Layout, SyncStats
from pointlake.types import (
    BackendUnavailable, BalancedPolicy, Closed, CollectionConfig, CollectionExists, CollectionNotFound, Corrupted, DatabaseConfig, DimensionMismatch,
    HNSWParams, InvalidArgument, InvalidCollectionName, InvalidPointId, Metric, Point, SearchRequest, StorageFailure, ZeroVectorNotAllowed,
)


def config(**kw):
    return CollectionConfig(**{"name": "c", "dimension": 2, "metric": Metric.L2} | kw)


def at(spark, path, **kw):
    return Collection(spark, kw.pop("config", config()), Layout(path), **{"durability": "strict"} | kw)


def p(i, *v, **payload):
    return Point(i, [float(x) for x in v], payload)


def ids(c, *v, k=10, **kw):
    return [s.id for s in c.search(SearchRequest([float(x) for x in v], k, **kw))]


def test_upsert_get_delete_count(spark):
    c = Collection(spark, config())
    assert c.count() == 0 and c.get(["a"]) == [] and c.get([]) == []
    c.upsert([])
    c.upsert([p("a", 1, 1, lang="en"), p("b", 2, 2), p("a", 3, 3, lang="de", n=1, d=1.0, t=["x"], z=None, ok=True)])
    assert c.count() == 2
    (a,) = c.get(["a"], with_vector=True)
    assert a.vector == [3, 3] and a.payload == {"lang": "de", "n": 1, "d": 1.0, "t": ["x"], "z": None, "ok": True} and type(a.payload["n"]) is int
    assert [(x.id, x.vector) for x in c.get(["b", "missing", "a", "b"])] == [("b", []), ("a", []), ("b", [])]
    c.delete(["a", "a", "unknown"])
    assert c.count() == 1 and c.count(include_tombstones=True) == 2
    c.upsert([p("a", 9, 9)])
    assert c.count() == 2 and c.count(include_tombstones=True) == 3
    c.upsert([p("é", 0, 0)])
    assert [x.id for x in c.get(["é"])] == ["é"]
    c.checkpoint()
    c.seal()


def test_validation_is_all_or_nothing(spark):
    c = Collection(spark, config(normalize_vectors=True, metric=Metric.COSINE))
    for bad, error in (([p("a", 1, 1), p("", 1, 1)], InvalidPointId), ([p("a", 1, 1), p("b", 1)], DimensionMismatch), ([p("a", 1, 1), p("z", 0, 0)], ZeroVectorNotAllowed), ([p("x" * 513, 1, 1)], InvalidPointId)):
        with pytest.raises(error):
            c.upsert(bad)
    with pytest.raises(InvalidPointId):
        c.delete([""])
    assert c.count() == 0
    for kw, error in ((dict(name=""), InvalidCollectionName), (dict(name="x" * 129), InvalidCollectionName), (dict(name=".."), InvalidCollectionName), (dict(name="a/b"), InvalidCollectionName), (dict(dimension=0), InvalidArgument), (dict(index="hnsw", hnsw=HNSWParams()), InvalidArgument)):
        with pytest.raises(error):
            Collection(spark, config(**kw))
    assert HNSWParams().max_m0 == 32


def test_search(spark):
    c = Collection(spark, config())
    assert c.search(SearchRequest([0.0, 0.0], 3)) == []
    with pytest.raises(DimensionMismatch):
        c.search(SearchRequest([0.0], 0))
    with pytest.raises(InvalidArgument):
        c.search(SearchRequest([0.0, 0.0], 0))
    c.upsert([p("origin", 0, 0, lang="en"), p("far", 10, 0, lang="de"), p("near", 1, 0)])
    assert [(s.id, s.distance) for s in c.search(SearchRequest([0.0, 0.0], 2))] == [("origin", 0), ("near", 1)]
    assert ids(c, 0, 0, k=50) == ["origin", "near", "far"]
    s = c.search(SearchRequest([0.0, 0.0], 1, with_payload=False, with_vector=True))[0]
    assert s.payload is None and s.vector == [0, 0]
    assert c.search(SearchRequest([0.0, 0.0], 1))[0].payload == {"lang": "en"} and c.search(SearchRequest([0.0, 0.0], 1, with_payload=False))[0].vector is None
    with pytest.warns(UserWarning):
        assert len(ids(c, 0, 0, filter=Eq("lang", "de"))) == 3
    assert ids(c, 0, 0, filter=Eq("lang", "de"), apply_filter=True) == ["far"]
    n = Collection(spark, config(metric=Metric.COSINE, normalize_vectors=True))
    assert n.search(SearchRequest([0.0, 0.0], 1)) == []  # empty comes before normalising
    n.upsert([p("same", 2, 0), p("ortho", 0, 3)])
    assert [(s.id, s.distance) for s in n.search(SearchRequest([4.0, 0.0], 2))] == [("same", 0), ("ortho", 1)]
    assert n.get(["same"], with_vector=True)[0].vector == [1, 0]
    with pytest.raises(ZeroVectorNotAllowed):
        n.search(SearchRequest([0.0, 0.0], 1))


def test_frames(spark):
    c = Collection(spark, config())
    df = spark.createDataFrame([("a", [1.0, 1.0], 0), ("a", [2.0, 2.0], 1), ("b", [3.0, 3.0], 0)], "id string, vector array<float>, ord int")
    c.upsert(df.withColumn("extra", F.lit(1)))
    assert c.get(["a"], with_vector=True)[0].vector == [2, 2] and c.count() == 2
    with pytest.raises(InvalidArgument, match="unique"):
        c.upsert(df.drop("ord"))
    with pytest.raises(InvalidArgument, match="dimensions"):
        c.upsert(df.withColumn("vector", F.array(F.lit(1.0))))
    with pytest.raises(InvalidPointId):
        c.upsert(df.withColumn("id", F.lit(None).cast("string")))
    c.upsert(df.limit(0))
    assert c.count() == 2


def test_reopen_seal_and_recovery(spark, tmp_path):
    c = at(spark, tmp_path)
    c.upsert([p("a", 1, 0), p("b", 2, 0)])
    c.delete(["b"])
    c = at(spark, tmp_path)
    assert c.count() == 1 and c.count(include_tombstones=True) == 2  # the log was replayed
    c.seal()
    assert (c.generation, c.segment_ids, c.wal_epoch, c.next_segment_id) == (1, [1], 1, 2) and c.log.markers == []
    c.upsert([p("a", 9, 0), p("d", 4, 0)])
    c.seal()
    c.delete(["a"])
    c.seal()
    c.seal()  # nothing to do
    assert c.segment_ids == [1, 2, 3] and ids(c, 0, 0) == ["d"] and c.count(include_tombstones=True) == 3
    meta = json.loads((tmp_path / "collections/c/segments/3/SEGMENT_META.json").read_text())
    assert meta["rowCount"] == 0 and meta["tombstoneCount"] == 1
    c = at(spark, tmp_path)
    assert ids(c, 0, 0) == ["d"] and c.count(include_tombstones=True) == 1  # the counter isn't kept
    c.upsert([p("a", 7, 0)])
    assert ids(c, 0, 0) == ["d", "a"]
    c.delete(["nobody"])
    c.compact()
    assert len(c.segment_ids) == 1 and ids(at(spark, tmp_path), 0, 0) == ["d", "a"]


def test_deletes_of_unknown_ids_seal_nothing(spark, tmp_path):
    c = at(spark, tmp_path)
    c.delete(["x"])
    c.checkpoint()
    assert c.segment_ids == [] and c.log.markers[-1].kind == "checkpoint"


def test_auto_seal(spark, tmp_path):
    c = at(spark, tmp_path, max_points=2)
    for i, v in enumerate("abcde"):
        c.upsert([p(v, i, 0)])
    assert len(c.segment_ids) >= 2 and ids(c, 0, 0, k=3) == ["a", "b", "c"]
    assert at(spark, tmp_path).count() == 5
    b = at(spark, tmp_path / "bytes", max_bytes=8)
    b.upsert([p("a", 1, 0)])
    assert b.segment_ids == [1]


def test_crashes(spark, tmp_path):
    c = at(spark, tmp_path)
    c.upsert([p("a", 1, 0)])
    c.seal()
    c.upsert([p("b", 2, 0)])
    base = tmp_path / "collections/c"
    # an orphan, leftovers, a torn batch
    (base / "segments/99").mkdir()
    (base / "segments/notes").mkdir()
    (base / "segments/1/x.tmp").write_text("x")
    (base / "COLL_META.json.tmp").write_text("x")
    (base / "log/00000000000000000009.parquet").write_text("torn")
    c = at(spark, tmp_path)
    assert ids(c, 0, 0) == ["a", "b"] and not (base / "segments/99").exists() and (base / "segments/notes").exists() and not (base / "COLL_META.json.tmp").exists()
    assert not (base / "log/00000000000000000009.parquet").exists() and c.next_segment_id == 2
    # a seal whose segment was published, but the log not yet reclaimed; and one that never was
    c.log.mark(50, "seal", 1)
    assert at(spark, tmp_path)._after == 3 - 1 and ids(at(spark, tmp_path), 0, 0) == ["a"]
    c.log.mark(51, "seal", 77)
    d = at(spark, tmp_path)
    d.upsert([p("z", 5, 0)])
    assert ids(at(spark, tmp_path), 0, 0) == ["a", "z"]
    # damage is never passed over
    marker = base / "log" / f"{d.log.markers[-1].seq:020d}.parquet"
    data = bytearray(marker.read_bytes())
    data[len(data) // 2] ^= 1
    marker.write_bytes(bytes(data))
    (marker.parent / f".{marker.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Corrupted):
        at(spark, tmp_path)
    marker.unlink()
    with pytest.raises(Corrupted):
        at(spark, tmp_path)


def test_damaged_segments_and_manifests(spark, tmp_path):
    def fresh(name):
        c = at(spark, tmp_path / name)
        c.upsert([p("a", 1, 0)])
        c.seal()
        return tmp_path / name / "collections/c"

    base = fresh("data")
    f = next((base / "segments/1").glob("*.parquet"))
    data = bytearray(f.read_bytes())
    data[10] ^= 1
    at(spark, tmp_path / "data").verify()
    f.write_bytes(bytes(data))
    (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Corrupted):
        at(spark, tmp_path / "data").verify()
    f.write_bytes(bytes(data[:-1]))  # sizes are looked at on opening
    with pytest.raises(Corrupted):
        at(spark, tmp_path / "data")
    for name, path, change in (("gone", "segments/1/SEGMENT_META.json", None), ("json", "MANIFEST.json", "{"), ("version", "MANIFEST.json", {"formatVersion": 2}), ("id", "segments/1/SEGMENT_META.json", {"segmentId": 8}), ("dim", "segments/1/SEGMENT_META.json", {"dimension": 3})):
        target = fresh(name) / path
        if change is None:
            target.unlink()
        else:
            target.write_text(change if isinstance(change, str) else json.dumps(json.loads(target.read_text()) | change))
        with pytest.raises(Corrupted):
            at(spark, tmp_path / name)


def test_helpers(spark, tmp_path):
    m = [Marker(1, "changes"), Marker(2, "seal", segment_id=1), Marker(3, "changes"), Marker(4, "seal", segment_id=9), Marker(5, "checkpoint")]
    assert [replay_start(m, s) for s in (set(), {1}, {9}, {1, 9})] == [0, 2, 4, 4] and replay_start([], {1}) == 0
    assert repaired_next_segment_id(1, []) == 1 and repaired_next_segment_id(2, [5, 3]) == 6 and repaired_next_segment_id(9, [5]) == 9
    for n in ("1", "2", "x", "10"):
        (tmp_path / n).mkdir()
    assert remove_unlisted_segments(tmp_path, {2}) == [1, 10] and remove_unlisted_segments(tmp_path / "missing", set()) == []


@pytest.mark.parametrize("durability, syncs", [("strict", 3), ("balanced", 1), ("relaxed", 0)])
def test_sync_policies(spark, tmp_path, durability, syncs):
    stats = SyncStats()
    c = at(spark, tmp_path, durability=durability, stats=stats, policy=BalancedPolicy(3, 1 << 30, 3600))
    for i in range(3):
        c.upsert([p(f"p{i}", i, 0)])
    assert (stats.syncs > 0) == (syncs > 0) and (durability != "strict" or stats.syncs == 3)
    before = stats.syncs
    c.prepare_for_close(sync=True)
    assert stats.syncs > before
    with pytest.raises(Closed):
        c.upsert([p("x", 0, 0)])
    assert c.count() == 3  # reads go on


def test_balanced_timer(spark, tmp_path):
    stats = SyncStats()
    c = at(spark, tmp_path, durability="balanced", stats=stats, policy=BalancedPolicy(1000, 1 << 30, 0.05))
    c.upsert([p("a", 0, 0)])
    threading.Event().wait(0.4)
    assert stats.syncs >= 1 and c.log._timer is None


def test_failed_sync_blocks_changes(spark, tmp_path):
    stats = SyncStats()
    c = at(spark, tmp_path, stats=stats)
    c.upsert([p("a", 1, 0)])
    stats.fail_next = OSError("disk")
    with pytest.raises(StorageFailure):
        c.upsert([p("b", 2, 0)])
    with pytest.raises(StorageFailure):
        c.delete(["a"])
    assert ids(c, 0, 0) == ["a"] and ids(at(spark, tmp_path), 0, 0) == ["a"]
    c.upsert([])  # nothing is no change
    c.checkpoint()
    c.upsert([p("b", 2, 0)])
    assert ids(c, 0, 0) == ["a", "b"]


def test_database(spark, tmp_path):
    db = Database.open(spark, str(tmp_path / "db"), DatabaseConfig(durability="strict", mutable_segment_max_points=7))
    db.create_collection(config(name="b"))
    c = db.create_collection(config(name="a", metric=Metric.COSINE, normalize_vectors=True))
    c.upsert([p("x", 3, 4)])
    with pytest.raises(CollectionExists):
        db.create_collection(config(name="a"))
    with pytest.raises(CollectionNotFound):
        db.collection("z")
    assert db.list_collections() == ["a", "b"] and db.storage_path == (tmp_path / "db").resolve()
    db.checkpoint()
    db.drop_collection("b")
    with pytest.raises(CollectionNotFound):
        db.drop_collection("b")
    db.close()
    for call in (db.close, db.list_collections, db.checkpoint):
        with pytest.raises(Closed):
            call()
    db = Database.open(spark, str(tmp_path / "db"), DatabaseConfig(durability="relaxed"))
    assert db.config.durability == "strict" and db.config.mutable_segment_max_points == 7 and db.list_collections() == ["a"]
    assert db.collection("a").config == config(name="a", metric=Metric.COSINE, normalize_vectors=True) and db.collection("a").get(["x"], True)[0].vector == pytest.approx([0.6, 0.8])
    # what a crashed drop left doesn't come back
    left = tmp_path / "db/collections/b/segments/4"
    left.mkdir(parents=True)
    assert db.create_collection(config(name="b")).count() == 0 and not left.exists()
    with pytest.raises(BackendUnavailable):
        Database.open(spark, str(tmp_path / "db"), DatabaseConfig(compute="mlx"))
    with pytest.raises(InvalidArgument):
        DatabaseConfig(durability="none")
    for damage in ("{", json.dumps({"formatVersion": 3, "collections": {}})):
        (tmp_path / "db/CATALOG.json").write_text(damage)
        with pytest.raises(Corrupted):
            Database.open(spark, str(tmp_path / "db"))
    (tmp_path / "db/CATALOG.json").unlink()
    with pytest.raises(Corrupted):
        Database.open(spark, str(tmp_path / "db"))
    memory = Database.open(spark)
    memory.create_collection(config()).upsert([p("m", 1, 1)])
    assert memory.storage_path is None and memory.collection("c").count() == 1
    memory.close()


def test_store_at_an_address(spark, monkeypatch):
    from pointlake.session import shared_dir
    from pointlake.sources import files

    root = f"{shared_dir(spark)}/stores/one"
    db = Database.open(spark, root)
    c = db.create_collection(config())
    c.upsert(spark.createDataFrame([(f"p{i:03d}", [float(i), 0.0]) for i in range(100)], "id string, vector array<float>"))
    c.seal()
    c.delete(spark.createDataFrame([(f"p{i:03d}",) for i in (0, 0, 7, 500)], "id string"))
    c.checkpoint()
    db.close()
    monkeypatch.setattr(files.Place, "read_bytes", lambda self, true=files.Place.read_bytes: pytest.fail("data is read") if self.name.endswith(".parquet") else true(self))
    c = Database.open(spark, root).collection("c")
    assert ids(c, 0, 0, k=2) == ["p001", "p002"] and c.count() == 98 and len(c.segment_ids) == 2
    monkeypatch.setattr(files, "DRIVER_BYTES", 0)  # by tasks
    c.verify()


def test_segments_apart_are_read_without_a_comparison(spark, tmp_path):
    assert apart({1: ("a", "c"), 2: ("d", "f"), 3: ("e", "g"), 4: None, 5: ("x", "x")}) == {1, 4, 5} and apart({}) == set() and apart({1: ("a", "z"), 2: ("b", "c"), 3: ("d", "e")}) == set()
    c = at(spark, tmp_path)
    for a in "abc":
        c.upsert([p(f"{a}{i}", i, 0) for i in range(3)])
        c.seal()
    plan = c.live()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and c.count() == 9 and "Exchange" not in at(spark, tmp_path).live()._jdf.queryExecution().executedPlan().toString()
    c.delete(["b1"])
    assert c.count() == 8
    c.seal()
    assert c.count() == 8 and sorted(ids(at(spark, tmp_path), 0, 0)) == ["a0", "a1", "a2", "b0", "b2", "c0", "c1", "c2"]


def test_a_bad_frame_leaves_nothing(spark, tmp_path):
    c = at(spark, tmp_path, config=config(normalize_vectors=True))
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, op string, vector array<float>")
    for bad, error in ((("a", "upsert", [1.0]), InvalidArgument), (("a", "upsert", [0.0, 0.0]), ZeroVectorNotAllowed), (("", "delete", None), InvalidPointId), (("a", "drop", None), InvalidArgument), ((None, "delete", None), InvalidPointId)):
        with pytest.raises(error):
            c.apply(frame(("ok", "upsert", [3.0, 4.0]), bad))
    assert c.count() == 0 and not list((tmp_path / "collections/c/log").glob("0*"))
    c.apply(frame(("ok", "upsert", [3.0, 4.0]), ("gone", "delete", None)))
    assert c.get(["ok"], True)[0].vector == pytest.approx([0.6, 0.8]) and at(spark, tmp_path, config=config(normalize_vectors=True)).count() == 1


def test_quick_start(spark):
    db = Database.open(spark)
    c = db.create_collection(config(dimension=3, metric=Metric.COSINE, normalize_vectors=True))
    c.upsert([p("intro", 1, 0, 0, title="Intro"), p("guide", 0.9, 0.1, 0, title="Guide"), p("api", 0, 1, 0, title="API")])
    assert [s.payload["title"] for s in c.search(SearchRequest([1.0, 0.05, 0.0], 2))] in (["Intro", "Guide"], ["Guide", "Intro"])
