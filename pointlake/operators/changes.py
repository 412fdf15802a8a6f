"""Applying a stream of inserts, updates and deletes.

A change is a function on the state of one key: an upsert is the constant function of its value, a delete is the constant
function "absent", and a key without changes keeps the identity. Such functions compose associatively: of two of them the
one with the higher order stays. So the log of a key needn't be walked in order: any grouping of its changes can be reduced
first and composed later, within one key as well.

`compose` does that as a tree: changes are reduced within (key, range chunk of the order) - in Spark's partial aggregation,
before anything is shuffled - and the chunks' patches are composed by key. A key that holds a third of all changes reaches the last
step as one patch a chunk. `apply_changes` composes the base as the oldest patch.
"""
from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointlake.functions.vectors import nfc
from pointlake.session import has_map, small, stage

STORE_KEY = ("db_id", "collection", "id")


def compose(changes: DataFrame, key: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Reduce patches (key..., order, op, value) to one a key, or one a (key, by). Of different values of an equal order and op the
    one of the greater hash stays, whatever the order of arrival."""
    kind = changes.schema["value"].dataType
    if has_map(kind):
        tie = F.xxhash64(F.to_json(F.struct("value")))
    else:
        tie = F.col("value") if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)) else F.xxhash64("value")
    patch = F.max_by(F.struct("op", "value", "order"), F.struct(F.col("order"), F.col("op"), tie.alias("tie")))
    return changes.groupBy(*key, *by).agg(patch.alias("patch")).select(*key, *by, "patch.op", "patch.value", "patch.order")


def apply_changes(base: DataFrame | None, changes: DataFrame, key: tuple[str, ...], chunk: Column) -> DataFrame:
    """The state after all changes: key..., value, order.

    changes: key..., order (any orderable column), op ('upsert' or 'delete'), value (any type). base: the same columns, its
    orders below all those of changes. Defined cases: a repeated change counts once, of different changes with an equal order the
    upsert wins, of different upserts the value of the greater hash; arrival order is irrelevant; a row with NULL in the key, the order or the op isn't a change and is left out;
    deletes of unknown keys do nothing; a NULL value is a value. Empty inputs give no rows.
    """
    def proper(df: DataFrame) -> DataFrame:
        ok = F.col("op").isin("upsert", "delete") & F.col("order").isNotNull()
        for k in key:
            ok = ok & F.col(k).isNotNull()
        return df.where(ok).select(*key, "order", "op", "value")

    patches = compose(proper(changes).withColumn("_chunk", chunk), key, ("_chunk",)).select(*key, "order", "op", "value")
    if base is not None:
        patches = patches.unionByName(proper(base))
    return compose(patches, key).where(F.col("op") == "upsert").select(*key, "value", "order")


def current_manifests(manifests: DataFrame) -> DataFrame:
    """db_id, collection, generation, segment_ids of the highest generation; repeated rows count once.

    Rows without a collection, database, generation or list are left out, and formats other than 1. Should rows of
    one generation differ, the greater list wins.
    """
    ok = F.col("db_id").isNotNull() & F.col("collection").isNotNull() & F.col("generation").isNotNull() & F.col("segment_ids").isNotNull() & (F.col("format_version") == 1)
    m = manifests.where(ok).groupBy("db_id", "collection").agg(F.max(F.struct("generation", "segment_ids")).alias("m"))
    return m.select("db_id", "collection", "m.generation", "m.segment_ids")


def published_segments(manifests: DataFrame) -> DataFrame:
    """db_id, collection, segment_id, pos: the place in the current manifest's list. Named twice, the later place counts."""
    listed = current_manifests(manifests).select("db_id", "collection", F.posexplode("segment_ids").alias("pos", "segment_id"))
    return listed.where(F.col("segment_id").isNotNull()).groupBy("db_id", "collection", "segment_id").agg(F.max("pos").alias("pos"))


def orphans(segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """db_id, collection, segment_id of the segments that no current manifest names, once each."""
    key = ["db_id", "collection", "segment_id"]
    return segments.select(*key).join(published_segments(manifests), key, "left_anti").distinct()


def next_segment_ids(manifests: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """db_id, collection, next_id: the id after all published ones, or the persisted one (db_id, collection, next_id) if that is higher.
    A collection whose current manifest lists nothing starts with 1."""
    m = current_manifests(manifests).select("db_id", "collection", (F.coalesce(F.array_max("segment_ids"), F.lit(0)) + 1).alias("next_id"))
    if persisted is None:
        return m
    return m.unionByName(persisted.select("db_id", "collection", "next_id")).groupBy("db_id", "collection").agg(F.max("next_id").alias("next_id"))


def complete(segments: DataFrame) -> DataFrame:
    """Only segments that were written to their end: arrays as long as row_count says."""
    return segments.where((F.size("ids") == F.col("row_count")) & (F.size("payloads") == F.col("row_count")))


def segment_changes(segments: DataFrame, published: DataFrame, values: Column) -> DataFrame:
    """Published segments as changes, ordered (0, place in the manifest, row or tombstone, row number).

    values: an array parallel to ids. A segment's tombstones come after its rows. Directories listed twice repeat the same
    changes, which is harmless.
    """
    s = complete(segments).select("db_id", "collection", "segment_id", "ids", F.coalesce("tombstones", F.array().cast("array<string>")).alias("tombstones"), values.alias("values"))
    s = s.join(published, ["db_id", "collection", "segment_id"])
    rows = F.transform(F.arrays_zip("ids", "values"), lambda x, i: F.struct(x["ids"].alias("id"), F.lit("upsert").alias("op"), x["values"].alias("value"), F.lit(0).alias("part"), i.cast("long").alias("row")))
    kind = s.select(values_type(s, "values")).schema[0].dataType
    gone = F.transform("tombstones", lambda x, i: F.struct(x.alias("id"), F.lit("delete").alias("op"), F.lit(None).cast(kind).alias("value"), F.lit(1).alias("part"), i.cast("long").alias("row")))
    c = s.select("db_id", "collection", "segment_id", "pos", F.explode(F.concat(rows, gone)).alias("c"))
    order = F.struct(F.lit(0).alias("phase"), F.col("pos").cast("long").alias("a"), F.col("c.part").cast("long").alias("b"), F.col("c.row").alias("c"))
    return c.select("db_id", "collection", "segment_id", nfc(F.col("c.id")).alias("id"), order.alias("order"), "c.op", "c.value")


def values_type(df: DataFrame, column: str) -> Column:
    return F.element_at(F.col(column), 1).alias("value")


def replay_start(wal: DataFrame, published: DataFrame) -> DataFrame:
    """db_id, collection, start: (seq, ord) of the last seal whose segment was published; what is not after it is in the segments.

    A seal that was never published doesn't count, so that the changes before it are replayed.
    """
    seals = wal.where((F.col("op") == "seal") & F.col("seq").isNotNull()).select("db_id", "collection", "segment_id", "seq", F.coalesce("ord", F.lit(0)).alias("ord"))
    return seals.join(published, ["db_id", "collection", "segment_id"]).groupBy("db_id", "collection").agg(F.max(F.struct("seq", "ord")).alias("start"))


def replayed(wal: DataFrame, published: DataFrame, value: Column) -> DataFrame:
    """db_id, collection, id (NFC), op, seq, ord, value of the upserts and deletes that aren't in published segments yet."""
    w = wal.where(F.col("op").isin("upsert", "delete") & F.col("seq").isNotNull() & F.col("id").isNotNull())
    w = w.select("db_id", "collection", "id", "op", F.col("seq").cast("long").alias("seq"), F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), value.alias("value"))
    start = replay_start(wal, published).select("db_id", "collection", F.struct(F.col("start.seq").cast("long").alias("seq"), F.col("start.ord").cast("long").alias("ord")).alias("start"))
    w = w.join(small(start, "replay"), ["db_id", "collection"], "left").where(F.col("start").isNull() | (F.struct("seq", "ord") > F.col("start")))
    return w.select("db_id", "collection", nfc(F.col("id")).alias("id"), "op", "seq", "ord", "value")


def log_changes(wal: DataFrame, published: DataFrame, value: Column) -> DataFrame:
    """The records to replay as changes, ordered (1, seq, ord, 0)."""
    order = F.struct(F.lit(1).alias("phase"), F.col("seq").alias("a"), F.col("ord").alias("b"), F.lit(0).cast("long").alias("c"))
    return replayed(wal, published, value).select(*STORE_KEY, order.alias("order"), "op", "value")


def live_rows(wal: DataFrame, segments: DataFrame, manifests: DataFrame, value: Column, values: Column, span: int = 1024) -> DataFrame:
    """db_id, collection, id (NFC), value of each point that lives after everything published and logged.

    value is an expression on a log row, values the same as an array on a segment. span: sequence numbers in a range
    chunk. A collection without a manifest has only its log.
    """
    published = small(published_segments(manifests), "published")
    state = apply_changes(segment_changes(segments, published, values), log_changes(wal, published, value), STORE_KEY, F.floor(F.col("order.a") / F.lit(span)))
    return state.select(*STORE_KEY, "value")


def row_vectors() -> Column:
    """The row-major vectors of a segment, cut into one array a row."""
    dim = F.when(F.col("row_count") > 0, F.floor(F.size("vectors") / F.col("row_count"))).otherwise(F.lit(0)).cast("int")
    return F.transform(F.col("ids"), lambda _, i: F.slice(F.col("vectors"), i * dim + 1, dim))


def located(segments: DataFrame) -> DataFrame:
    """segments with the column place, which tells copies of one directory apart: a hash of the row's place in its file."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    if len(segments._jdf.inputFiles()):
        try:
            return segments.withColumn("place", place)
        except AnalysisException:  # computed from files: as for rows of no file
            pass
    return stage(segments, "segments").withColumn("place", place)


def row_places() -> Column:
    """An array parallel to ids: where the row is."""
    return F.transform(F.col("ids"), lambda _, i: F.struct(F.col("segment_id").alias("segment_id"), F.col("place").alias("place"), i.alias("row")))


def rows_at(segments: DataFrame, keep: DataFrame) -> DataFrame:
    """db_id, collection, segment_id, id (NFC), vector, payload of the rows that keep (db_id, collection, segment_id, place, row)
    names; segments as located().

    Only numbers of rows move: a segment's come to it as one list, broadcast while they are few, and vectors and payloads stay in the
    task that reads them; beyond that the segments are shuffled once.
    """
    key = ["db_id", "collection", "segment_id", "place"]
    lists = small(keep.groupBy(*key).agg(F.sort_array(F.collect_list("row")).alias("rows")), "keep")
    s = complete(segments).select(*key, "ids", "vectors", "payloads", "row_count").join(lists, key).withColumn("dim", F.floor(F.size("vectors") / F.col("row_count")).cast("int"))
    rows = F.transform("rows", lambda i: F.struct(F.element_at("ids", i + 1).alias("id"), F.slice(F.col("vectors"), i * F.col("dim") + 1, F.col("dim")).alias("vector"), F.element_at("payloads", i + 1).alias("payload")))
    return s.select(*key[:3], F.explode(rows).alias("r")).select(*key[:3], nfc(F.col("r.id")).alias("id"), "r.vector", "r.payload")


def live_points(wal: DataFrame, segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """db_id, collection, id, vector, payload of all live points.

    Changes are composed with the places of their values; vectors and payloads are fetched for what survives.
    """
    published, s = small(published_segments(manifests), "published"), located(segments)
    log = log_changes(wal, published, F.lit(None).cast("struct<segment_id:bigint,place:bigint,row:int>"))
    state = stage(apply_changes(segment_changes(s, published, row_places()), log, STORE_KEY, F.floor(F.col("order.a") / F.lit(1024))), "live")
    sealed = rows_at(s, state.where("order.phase = 0").select("db_id", "collection", "value.segment_id", "value.place", "value.row"))
    at = state.where("order.phase = 1").select(*STORE_KEY, F.col("order.a").alias("seq"), F.col("order.b").alias("ord"))
    w = replayed(wal.where("op <> 'delete'"), published, F.struct("vector", "payload")).drop("op")
    by = [*STORE_KEY, "seq", "ord"]
    logged = w.join(at, by).groupBy(*by).agg(F.max_by("value", F.xxhash64(F.to_json(F.struct("value")))).alias("value"))
    return sealed.select(*STORE_KEY, "vector", "payload").unionByName(logged.select(*STORE_KEY, "value.vector", "value.payload"))


def hits(events: DataFrame, key: tuple[str, ...], place: Column, span: int = 1024) -> DataFrame:
    """key..., last (op), hits: deletes that came directly after an upsert of the same key. events: key..., order, op; ops other than
    'upsert' and 'delete' count as what stands between. place: a bigint that grows with order.

    The patch of a stretch of changes is (its first op, its last op, hits within); patches compose associatively, here by ranges of
    place, span places a range and span ranges a greater one, so that no task holds all changes of a hot key.
    """
    patch = F.struct(F.col("order"), F.col("op").alias("first"), F.col("op").alias("last"), F.lit(0).cast("long").alias("hits"))
    p = events.select(*key, place.alias("_place"), patch.alias("patch"))

    def both(a: Column, b: Column) -> Column:
        between = ((a["last"] == "upsert") & (b["first"] == "delete")).cast("long")
        return F.when(a.isNull(), b).otherwise(F.struct(a["order"].alias("order"), a["first"].alias("first"), b["last"].alias("last"), (a["hits"] + b["hits"] + between).alias("hits")))

    kind = p.schema["patch"].dataType.simpleString()
    for level in (1, 2, 3):
        by = [F.expr(f"_place div {span}").alias("_place")] if level < 3 else []
        p = p.groupBy(*key, *by).agg(F.aggregate(F.sort_array(F.collect_list("patch")), F.lit(None).cast(kind), both).alias("patch"))
    return p.select(*key, "patch.last", "patch.hits")


def count_with_tombstones(wal: DataFrame, segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """db_id, collection, n: live points plus the replayed deletes that hit a live point.

    Whether a delete hits depends on the change before it of the same id: see hits(). Only keys and orders move. Repeated log rows
    count once. A delete by a segment's tombstone isn't a replayed one.
    """
    published = small(published_segments(manifests), "published")
    nothing = F.lit(None).cast("boolean")
    log = log_changes(wal, published, nothing).groupBy(*STORE_KEY, "order").agg(F.max("op").alias("op"))
    sealed = segment_changes(segments, published, F.transform("ids", lambda _: nothing)).select(*STORE_KEY, "order", F.when(F.col("op") == "delete", "gone").otherwise(F.col("op")).alias("op"))
    place = F.when(F.col("order.phase") == 0, F.col("order.a") - F.lit(1 << 62)).otherwise(F.col("order.a"))
    h = hits(sealed.unionByName(log), STORE_KEY, place)
    return h.groupBy("db_id", "collection").agg((F.count_if(F.col("last") == "upsert") + F.sum("hits")).alias("n")).where("n > 0")


def verify_segments(segments: DataFrame) -> DataFrame:
    """db_id, collection, segment_id, complete, ids_ok, tombstones_ok, vectors_ok: recorded CRC-32 values against the contents.

    Ids and tombstones are summed joined by NUL bytes, vectors as little-endian float32; an empty list has the checksum 0.
    A NULL array or checksum doesn't verify.
    """
    def of_list(a: str, crc: str) -> Column:
        return F.coalesce(F.when(F.size(a) == 0, F.col(crc) == 0).otherwise(F.crc32(F.expr(f"array_join({a}, char(0))").cast("binary")) == F.col(crc)), F.lit(False))

    crc = F.arrow_udf(_float_crc, "bigint")
    vectors = F.coalesce(F.when(F.size("vectors") == 0, F.col("vectors_crc32") == 0).otherwise(crc("vectors") == F.col("vectors_crc32")), F.lit(False))
    complete_ = F.coalesce((F.size("ids") == F.col("row_count")) & (F.size("payloads") == F.col("row_count")), F.lit(False))
    return segments.select("db_id", "collection", "segment_id", complete_.alias("complete"), of_list("ids", "ids_crc32").alias("ids_ok"), of_list("tombstones", "tombstones_crc32").alias("tombstones_ok"), vectors.alias("vectors_ok"))


def _float_crc(lists: pa.Array) -> pa.Array:
    """CRC-32 of each list's float32 bytes; NULL for a NULL list or one with a NULL in it."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<f4", copy=False), lists.offsets.to_numpy()
    holes = lists.values.null_count > 0
    out = []
    for i, ok in enumerate(lists.is_valid().to_pylist()):
        lo, hi = offsets[i], offsets[i + 1]
        out.append(zlib.crc32(values[lo:hi].tobytes()) if ok and not (holes and lists.values.slice(lo, hi - lo).null_count) else None)
    return pa.array(out, pa.int64())
