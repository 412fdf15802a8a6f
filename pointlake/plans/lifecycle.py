"""Queries over stores in use: sealed, reopened, recovered and compacted collections, databases, and the binary formats, each with SQL
over the tables that must give the same rows. Stores are made in the shared folder."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.plans.collection import Collection
from pointlake.plans.database import Database, choose_compute
from pointlake.session import stage_path, table
from pointlake.sources import interop
from pointlake.sources.commitlog import ARROW_SCHEMA
from pointlake.sources.files import SyncStats, read_json
from pointlake.streaming.ingest import change_stream, ingest
from pointlake.types import PAYLOAD, BackendUnavailable, BalancedPolicy, Closed, CollectionConfig, DatabaseConfig, InvalidCollectionName, Metric, Point, SearchRequest, StorageFailure, require_collection_name

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# ---- a store with two sealed segments and an unsealed log, closed and opened again

_DIM = 64
_MEMBERS = "(SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: (-x)::FLOAT) WHEN vec_id % 2 = 0 THEN list_transform(embedding, lambda x: (x * 2)::FLOAT) ELSE embedding END AS v FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0 OR vec_id % 7 = 0)"
_GONE = "(1, 2, 3)"
_D = "(SELECT v, q, vec_id, list_reduce(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y, 0::FLOAT) AS distance FROM {} m, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) q0 WHERE vec_id NOT IN (1, 2, 3))"


def store(spark: SparkSession, d: str, seal_all: bool = False) -> Collection:
    e = table(spark, d, "embeddings")
    rows = lambda f, g: e.where(F.col("vec_id") % f == 0).select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", g).alias("vector"))
    root = stage_path(spark, "store")
    db = Database.open(spark, root, DatabaseConfig(mutable_segment_max_points=1 << 30, mutable_segment_max_bytes=1 << 50))
    c = db.create_collection(CollectionConfig("points", _DIM, Metric.L2_SQUARED))
    for part in (rows(3, lambda x: x), rows(2, lambda x: (x * 2).cast("float"))):
        c.upsert(part)
        c.seal()
    c.upsert(rows(7, lambda x: -x))
    c.delete(["1", "2", "3", "nobody"])
    if seal_all:
        c.checkpoint()
    db.close()
    return Database.open(spark, root).collection("points")


def _first(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("sealed_search", f"SELECT CAST(vec_id AS VARCHAR) AS id, distance FROM {_D.format(_MEMBERS)} ORDER BY distance, id LIMIT 1000000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).search_frame(SearchRequest(_first(spark, d), 1_000_000, with_payload=False))


@query("compacted_search", SQL["sealed_search"])
def _(spark: SparkSession, d: str) -> DataFrame:
    c = store(spark, d)
    c.compact()
    c.verify()
    return c.search_frame(SearchRequest(_first(spark, d), 1_000_000, with_payload=False))


@query("reopened_count", f"SELECT count(*) FILTER (vec_id NOT IN {_GONE}) AS live, count(*) AS with_tombstones FROM {_MEMBERS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Replayed deletes of live points count as tombstones."""
    c = store(spark, d)
    return spark.createDataFrame([(c.count(), c.count(include_tombstones=True))], "live long, with_tombstones long")


@query("sealed_get", f"SELECT k.ord, CAST(vec_id AS VARCHAR) AS id, v AS vector FROM {_MEMBERS} m JOIN (VALUES (0, 14), (1, 2), (2, 9), (3, 14), (4, 4)) k(ord, want) ON k.want = vec_id WHERE vec_id NOT IN {_GONE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).get_frame(["14", "2", "9", "14", "4"], with_vector=True).select("ord", "id", "vector")


@query("get_without_vectors", f"SELECT k.ord, CAST(vec_id AS VARCHAR) AS id, 0 AS dimensions FROM {_MEMBERS} m JOIN (VALUES (0, 14), (1, 2), (2, 9)) k(ord, want) ON k.want = vec_id WHERE vec_id NOT IN {_GONE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).get_frame(["14", "2", "9"]).select("ord", "id", F.size("vector").alias("dimensions"))


@query("sealed_segments", f"""SELECT 1::BIGINT AS segment_id, count(*) FILTER (vec_id % 3 = 0) AS rows, 0::BIGINT AS tombstones FROM embeddings
    UNION ALL SELECT 2, count(*) FILTER (vec_id % 2 = 0), 0 FROM embeddings
    UNION ALL SELECT 3, count(*) FILTER (vec_id % 7 = 0), count(*) FILTER (vec_id IN {_GONE} AND (vec_id % 3 = 0 OR vec_id % 2 = 0)) FROM embeddings""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What the meta documents of a checkpointed store say; deletes of unknown ids leave no tombstones."""
    c = store(spark, d, seal_all=True)
    meta = [read_json(c.layout.segment_meta("points", s)) for s in read_json(c.layout.manifest("points"))["segmentIds"]]
    return spark.createDataFrame([(m["segmentId"], m["rowCount"], m["tombstoneCount"]) for m in meta], "segment_id long, rows long, tombstones long")


@query("automatic_seal", "SELECT i + 1 AS segment_id, 2::BIGINT AS rows FROM range(5) t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = Database.open(spark, stage_path(spark, "store"), DatabaseConfig(durability="strict", mutable_segment_max_points=2))
    c = db.create_collection(CollectionConfig("points", 1, Metric.L2))
    for i in range(10):
        c.upsert([Point(f"p{i}", [float(i)], {})])
    meta = [read_json(c.layout.segment_meta("points", s)) for s in c.segment_ids]
    return spark.createDataFrame([(m["segmentId"], m["rowCount"]) for m in meta], "segment_id long, rows long")


@query("recovered_store", f"SELECT name, next_id, live FROM (VALUES ('1', 3::BIGINT), ('2', 3::BIGINT), ('notes', 3::BIGINT)) v(name, next_id), (SELECT count(*) FILTER (vec_id NOT IN {_GONE}) AS live FROM {_MEMBERS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned segments and leftovers are removed on opening, other folders stay; the next id is repaired."""
    c = store(spark, d)
    folder = c.layout.segments("points")
    for name in ("99", "7", "notes", "8.tmp"):
        (folder / name).mkdir()
    (c.layout.log("points") / "00000000000000000999.parquet").write_bytes(b"torn")
    again = Collection(spark, c.config, c.layout, next_segment_id=1)
    live = again.count()
    return spark.createDataFrame([(p.name, again.next_segment_id, live) for p in folder.iterdir()], "name string, next_id long, live long")


# ---- databases

@query("list_collections", "SELECT name, dimension, metric, normalize_vectors FROM collection_configs WHERE dimension <> 8 ORDER BY name")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All collections made, those of 8 dimensions dropped, the database closed and opened again."""
    root = stage_path(spark, "store")
    db = Database.open(spark, root)
    for r in table(spark, d, "collection_configs").collect():
        db.create_collection(CollectionConfig(r["name"], r["dimension"], Metric(r["metric"]), r["index_kind"], r["normalize_vectors"]))
    for name in db.list_collections():
        if db.collection(name).config.dimension == 8:
            db.drop_collection(name)
    db.checkpoint()
    db.close()
    db = Database.open(spark, root)
    configs = [db.collection(n).config for n in db.list_collections()]
    return spark.createDataFrame([(c.name, c.dimension, c.metric.value, c.normalize_vectors) for c in configs], "name string, dimension int, metric string, normalize_vectors boolean")


@query("name_validity", """SELECT name, octet_length(encode(name)) BETWEEN 1 AND 128 AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AND name NOT IN ('.', '..') AS valid
    FROM (SELECT unnest([name, name || '/x', name || chr(92), repeat(name, 20), '..', '.', '', name || 'é']) AS name FROM collection_configs)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    def ok(name: str) -> bool:
        try:
            require_collection_name(name)
        except InvalidCollectionName:
            return False
        return True

    names = [n for r in table(spark, d, "collection_configs").collect() for n in (r["name"], r["name"] + "/x", r["name"] + "\\", r["name"] * 20, "..", ".", "", r["name"] + "é")]
    return spark.createDataFrame([(n, ok(n)) for n in names], "name string, valid boolean")


@query("durability", "SELECT * FROM (VALUES ('strict', 3::BIGINT, true, true), ('balanced', 3::BIGINT, true, true), ('relaxed', 0::BIGINT, true, true)) v(durability, syncs, refused_after_failure, usable_after_checkpoint)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Files synced by three batches: each at once, all at the threshold of three, none. A failed sync refuses changes until a checkpoint."""
    out = []
    for durability in ("strict", "balanced", "relaxed"):
        stats = SyncStats()
        c = Collection(spark, CollectionConfig("c", 1, Metric.L2), Database.open(spark, stage_path(spark, "store")).layout, durability, BalancedPolicy(3, 1 << 30, 3600), stats=stats)
        for i in range(3):
            c.upsert([Point(f"p{i}", [0.0], {})])
        syncs, stats.fail_next, refused = stats.syncs, OSError("disk"), 0
        for change in (lambda: c.log.sync(), lambda: c.delete(["p0"])):
            try:
                change()
            except StorageFailure:
                refused += 1
        c.checkpoint()
        c.delete(["p0"])
        out.append((durability, syncs, refused == 2, c.count() == 2))
        c.prepare_for_close(sync=True)
    return spark.createDataFrame(out, "durability string, syncs long, refused_after_failure boolean, usable_after_checkpoint boolean")


@query("closed_database", "SELECT * FROM (VALUES ('close', true), ('list', true), ('checkpoint', true), ('upsert', true)) v(call, refused)")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = Database.open(spark)
    c = db.create_collection(CollectionConfig("c", 1, Metric.L2))
    db.close()
    out = []
    for name, call in (("close", db.close), ("list", db.list_collections), ("checkpoint", db.checkpoint), ("upsert", lambda: c.upsert([Point("a", [0.0], {})]))):
        try:
            call()
            out.append((name, False))
        except Closed:
            out.append((name, True))
    return spark.createDataFrame(out, "call string, refused boolean")


@query("compute_choice", "SELECT * FROM (VALUES ('auto', 'auto'), ('cpu', 'auto'), ('expr', 'expr'), ('arrow', 'auto'), ('mlx', 'unavailable')) v(preference, kernel)")
def _(spark: SparkSession, d: str) -> DataFrame:
    def kernel(x: str) -> str:
        try:
            return choose_compute(x)
        except BackendUnavailable:
            return "unavailable"

    return spark.createDataFrame([(x, kernel(x)) for x in ("auto", "cpu", "expr", "arrow", "mlx")], "preference string, kernel string")


# ---- the binary formats

@query("binary_segments", """SELECT DISTINCT db_id, collection, segment_id, i - 1 AS pos, ids[i] AS id, vectors[(i - 1) * (len(vectors) // row_count) + 1 : i * (len(vectors) // row_count)] AS vector, payloads[i]['stamp'].i AS stamp, len(tombstones) AS tombstones
    FROM (SELECT *, unnest(range(1, row_count + 1)) AS i FROM segments WHERE len(ids) = row_count AND len(payloads) = row_count)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every finished segment written as VECTORS, IDS, PAYLOAD, TOMBSTONES and meta document, and read back."""
    s = table(spark, d, "segments").where("row_count > 0 and size(ids) = row_count and size(payloads) = row_count").dropDuplicates(["db_id", "collection", "segment_id"])
    s = s.withColumn("collection", F.concat_ws("\u0001", "db_id", "collection"))
    back = interop.decode_segments(interop.segment_blobs(s))
    dim = F.col("dimension")
    rows = F.transform(F.arrays_zip("ids", "payloads"), lambda x, i: F.struct(i.cast("bigint").alias("pos"), x["ids"].alias("id"), F.slice(F.col("vectors"), i * dim + 1, dim).alias("vector"), x["payloads"]["stamp"]["i"].alias("stamp")))
    name = F.split("collection", "\u0001")
    return back.select(name[0].alias("db_id"), name[1].alias("collection"), "segment_id", F.size("tombstones").cast("bigint").alias("tombstones"), F.explode(rows).alias("r")).select("db_id", "collection", "segment_id", "tombstones", "r.*")


@query("binary_log", "SELECT db_id, collection, seq, ord, op, nfc_normalize(id) AS id, coalesce(len(vector), 0)::BIGINT AS dimensions, payload['stamp'].i AS stamp, segment_id, row_count FROM wal_records WHERE op <> 'delete' OR id IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Log records framed, joined by ranges of seq, cut short by an unfinished frame, and read back."""
    kinds = {"upsert": interop.UPSERT, "delete": interop.DELETE, "checkpoint": interop.CHECKPOINT, "seal": interop.SEAL_V2}

    names = {code: name for name, code in kinds.items()}
    out = pa.schema([("db_id", pa.string()), ("collection", pa.string()), ("seq", pa.int64()), ("ord", pa.int32()), ("op", pa.string()), ("id", pa.string()), ("dimensions", pa.int64()), ("stamp", pa.int64()), ("segment_id", pa.int64()), ("row_count", pa.int64())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        frames = [interop.encode_record(interop.Record(kinds[r["op"]], (r["id"],) if r["id"] is not None else (), tuple(r["vector"] or ()), dict(r["payload"] or ()), r["segment_id"], r["row_count"])) for r in rows]
        records, used = interop.decode_log(b"".join(frames) + frames[0][:-3], str(key))
        if used != sum(map(len, frames)) or len(records) != len(rows):
            raise ValueError("the torn frame was not left out")
        back = [{**{k: o[k] for k in ("db_id", "collection", "seq", "ord")}, "op": names[r.kind], "id": r.ids[0] if r.ids else None, "dimensions": len(r.vector), "stamp": ((r.payload or {}).get("stamp") or {}).get("i"), "segment_id": r.segment_id, "row_count": r.row_count} for o, r in zip(rows, records)]
        return pa.Table.from_pylist(back, schema=out)

    w = table(spark, d, "wal_records").where("op <> 'delete' or id is not null").select("db_id", "collection", "seq", "ord", "op", "id", "vector", "payload", "segment_id", "row_count")
    w = w.withColumn("part", F.expr("seq div 1024"))
    return w.groupBy("db_id", "collection", "part").applyInArrow(run, "db_id string, collection string, seq long, ord int, op string, id string, dimensions long, stamp long, segment_id long, row_count long")


@query("payload_json", "SELECT collection, id, coalesce(cardinality(payload), 0)::BIGINT AS members, payload['votes'].i AS votes, payload['site'].s AS site, payload['quality'].d AS quality, payload['tags'].ss AS tags FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Payloads written as JSON and read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [interop.payload_from(interop.payload_json(dict(p or ())), "points") for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(x.items()) for x in back], ARROW_SCHEMA.field("payload").type)], names=["collection", "id", "payload"])

    p = table(spark, d, "points").select("collection", "id", "payload").mapInArrow(run, f"collection string, id string, payload {PAYLOAD.simpleString()}")
    m = F.col("payload")
    return p.select("collection", "id", F.size(m).cast("bigint").alias("members"), m["votes"]["i"].alias("votes"), m["site"]["s"].alias("site"), m["quality"]["d"].alias("quality"), m["tags"]["ss"].alias("tags"))


# ---- streams

@query("streamed_changes", """SELECT id, value FROM (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(value, event_id)::FLOAT AS value, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last <> 'purchase'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of changes into a collection; purchases delete."""
    e = table(spark, d, "events")
    src = stage_path(spark, "changes")
    e.select(F.col("user_id").cast("string").alias("id"), F.struct(F.col("event_id").alias("a")).alias("order"), F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("op"), F.array(F.col("value").cast("float")).alias("vector"), F.lit(None).cast(PAYLOAD).alias("payload")).write.parquet(src)
    c = Collection(spark, CollectionConfig("events", 1, Metric.L2))
    changes = change_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1_000_000)
    ingest(changes, c, stage_path(spark, "stream"), available_now=True).awaitTermination()
    return c.live().select("id", F.element_at("vector", 1).alias("value"))
