"""A collection: immutable Parquet segments and a mutation log, seen through one last-write-wins plan.

Every stored row is (seq, ord, op, id, vector, payload); the live view is the row of the highest (seq, ord) of each id, if it is
an upsert. Nothing is loaded on open, and reads are ordinary DataFrame plans over all files at once. Segments whose ranges of ids meet no
other's are read without any comparison.
"""
from __future__ import annotations

import json
import threading
import warnings
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions import vectors as V
from pointlake.functions.filters import compile_filter
from pointlake.operators import search as S
from pointlake.operators.changes import compose, hits
from pointlake.session import stage
from pointlake.sources.commitlog import ARROW_SCHEMA, CommitLog, replay_start
from pointlake.sources.files import Layout, Place, SyncStats, fingerprints, read_json, remove_leftovers, require_checksums, require_sizes, sync_file, write_json
from pointlake.types import (
    FORMAT_VERSION, LOG_SCHEMA, MAX_DELETE_IDS, MAX_DIMENSION, BalancedPolicy, Closed, CollectionConfig, Corrupted, HNSWParams,
    InvalidArgument, InvalidPointId, Metric, Point, ScoredPoint, SearchRequest, StoreError, ZeroVectorNotAllowed, canonical_id, normalized,
    payload_python, payload_row, require_collection_name, require_dimension, require_point_id,
)


def config_document(c: CollectionConfig) -> dict:
    return {"name": c.name, "dimension": c.dimension, "metric": c.metric.value, "index": c.index, "normalizeVectors": c.normalize_vectors, "hnsw": asdict(c.hnsw) if c.hnsw else None}


def config_from(d: dict) -> CollectionConfig:
    return CollectionConfig(d["name"], d["dimension"], Metric(d["metric"]), d["index"], d["normalizeVectors"], HNSWParams(**d["hnsw"]) if d.get("hnsw") else None)


def repaired_next_segment_id(persisted: int, published: list[int]) -> int:
    return max(persisted, max(published, default=0) + 1)


def remove_unlisted_segments(folder: Place, listed: set[int]) -> list[int]:
    """Delete segment folders with a numeric name that no manifest names; others stay, as does what can't be deleted."""
    return sorted(int(p.name) for p in list(Place(folder).iterdir()) if p.name.isascii() and p.name.isdigit() and int(p.name) not in listed and p.is_dir() and p.delete())


def apart(ranges: dict[int, tuple[str, str] | None]) -> set[int]:
    """The segments whose range of ids (bytes compared; None: no rows) meets no other's."""
    known = sorted((lo.encode(), hi.encode(), s) for s, r in ranges.items() if r for lo, hi in [r])
    out, high = {s for s, r in ranges.items() if r is None}, None
    for i, (lo, hi, s) in enumerate(known):
        if (high is None or lo > high) and (i + 1 == len(known) or known[i + 1][0] > hi):
            out.add(s)
        high = hi if high is None else max(high, hi)
    return out


class Collection:
    def __init__(self, spark: SparkSession, config: CollectionConfig, layout: Layout | None = None, durability: str = "balanced", policy: BalancedPolicy | None = None,
                 compute: str = "auto", max_points: int = 10_000, max_bytes: int = 64 << 20, next_segment_id: int = 1, stats: SyncStats | None = None):
        require_collection_name(config.name)
        if config.dimension < 1 or config.dimension > MAX_DIMENSION:
            raise InvalidArgument(f"a dimension is 1 to {MAX_DIMENSION}, got {config.dimension}")
        if config.index != "flat":
            raise InvalidArgument(f"index {config.index!r} is not available, only 'flat' is")
        if max_points < 1 or max_bytes < 1:
            raise InvalidArgument("the seal thresholds are at least 1")
        self.spark, self.config, self.layout, self.compute = spark, config, layout, compute
        self.max_points, self.max_bytes, self.next_segment_id = max_points, max_bytes, next_segment_id
        self.lock = threading.RLock()
        self._accepting = True
        self._seq = 0
        self._memory: list[pa.Table | DataFrame] = []
        self._ranges: dict[int, tuple[str, str] | None] = {}
        self._removed_before = 0  # deletes that hit a live id, sealed in this session
        self._ops = self._bytes = 0
        self.generation, self.segment_ids, self.wal_epoch = 0, [], 0
        self.log: CommitLog | None = None
        self._after = 0
        if layout is not None:
            self._load(CommitLog(spark, layout.log(config.name), durability, policy or BalancedPolicy(), self.lock, stats))

    # ---- opening

    def _load(self, log: CommitLog) -> None:
        name = self.config.name
        if self.layout.manifest(name).exists():
            m = read_json(self.layout.manifest(name))
            self.generation, self.segment_ids, self.wal_epoch = m["generation"], list(m["segmentIds"]), m["walEpoch"]
            self._seq = m.get("lastSeq", 0)
        remove_unlisted_segments(self.layout.segments(name), set(self.segment_ids))
        remove_leftovers(self.layout.collection(name))
        remove_leftovers(self.layout.segments(name))
        for s in dict.fromkeys(self.segment_ids):
            folder = self.layout.segment(name, s)
            remove_leftovers(folder)
            meta = read_json(self.layout.segment_meta(name, s))
            if meta["segmentId"] != s or meta["dimension"] != self.config.dimension:
                raise Corrupted(folder, "its meta document describes another segment")
            require_sizes(folder, meta["files"])
            self._note(s, meta)
        repaired = repaired_next_segment_id(self.next_segment_id, self.segment_ids)
        if repaired != self.next_segment_id:
            self.next_segment_id = repaired
            self.write_meta()
        log.recover()
        self.log = log
        self._after = replay_start(log.markers, set(self.segment_ids))
        self._seq = max([self._seq, *(m.seq for m in log.markers)])
        replayed = [m for m in log.markers[self._after:] if m.kind == "changes"]
        self._ops, self._bytes = sum(m.ops for m in replayed), sum(m.vector_bytes for m in replayed)

    def _note(self, segment_id: int, meta: dict) -> None:
        if "idRange" in meta:
            self._ranges[segment_id] = tuple(meta["idRange"]) if meta["idRange"] else None

    def verify(self) -> None:
        """Raise Corrupted unless all segment files have the checksums that were recorded; they are read by tasks."""
        if self.layout is not None:
            name = self.config.name
            require_checksums(self.spark, [(self.layout.segment(name, s), read_json(self.layout.segment_meta(name, s))["files"]) for s in dict.fromkeys(self.segment_ids)])

    def write_meta(self) -> None:
        write_json(self.layout.collection_meta(self.config.name), {"formatVersion": FORMAT_VERSION, "config": config_document(self.config), "nextSegmentId": self.next_segment_id})

    # ---- the live view

    def _unsealed(self) -> DataFrame:
        if self.log is not None:
            paths = self.log.paths(self._after)
            return self.spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)
        out = self.spark.createDataFrame([], LOG_SCHEMA)
        tables = [t for t in self._memory if isinstance(t, pa.Table)]
        if tables:
            out = self.spark.createDataFrame(pa.concat_tables(tables), LOG_SCHEMA)
        for t in self._memory:
            out = out if isinstance(t, pa.Table) else out.unionByName(t)
        return out

    def _sealed(self, segment_ids: list[int] | None = None) -> DataFrame:
        ids = dict.fromkeys(self.segment_ids if segment_ids is None else segment_ids)
        paths = [str(self.layout.segment(self.config.name, s)) for s in ids] if self.layout else []
        return self.spark.read.schema(LOG_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(*paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)

    def _state(self, rows: DataFrame) -> DataFrame:
        return compose(rows.select("id", F.struct("seq", "ord").alias("order"), "op", F.struct("vector", "payload").alias("value")), ("id",))

    def live(self) -> DataFrame:
        """id, vector, payload of the live points: a plan over the files; nothing is kept in memory."""
        with self.lock:
            alone: list[int] = []
            if self.layout is not None and not self._ops and all(s in self._ranges for s in self.segment_ids):
                free = apart({s: self._ranges[s] for s in self.segment_ids})
                alone = [s for s in dict.fromkeys(self.segment_ids) if s in free]
            others = [s for s in self.segment_ids if s not in alone]
            out = self._sealed(alone).where("op = 'upsert'").select("id", "vector", "payload") if alone else None
            if alone and not others:
                return out
            state = self._state(self._sealed(others).unionByName(self._unsealed())).where("op = 'upsert'").select("id", "value.vector", "value.payload")
            return state if out is None else out.unionByName(state)

    # ---- changes

    def _ensure_writable(self) -> None:
        if not self._accepting:
            raise Closed("the collection takes no more changes")
        if self.log is not None:
            self.log.ensure_sound()

    def upsert(self, points: list[Point] | DataFrame) -> None:
        """Insert or replace. The whole batch is validated first; of repeated ids in a list the last counts. A DataFrame (id, vector,
        payload, optionally ord) must have unique ids or an ord column."""
        with self.lock:
            if isinstance(points, DataFrame):
                return self._upsert_frame(points)
            if not points:
                return
            self._ensure_writable()
            rows = []
            for i, p in enumerate(points):
                pid = require_point_id(p.id)
                require_dimension(p.vector, self.config.dimension)
                vector = normalized(p.vector) if self.config.normalize_vectors else p.vector
                rows.append({"ord": i, "op": "upsert", "id": pid, "vector": vector, "payload": list(payload_row(p.payload).items())})
            self._append(rows, 4 * self.config.dimension * len(rows))

    def _upsert_frame(self, df: DataFrame) -> None:
        self.apply(df.withColumn("op", F.lit("upsert")))

    def apply(self, changes: DataFrame) -> None:
        """One batch of changes (id, op 'upsert' or 'delete', and for upserts vector and payload; ids unique, or ordered by a column ord), all
        or nothing. It is written once and validated as written."""
        with self.lock:
            df = changes
            if "ord" not in df.columns:
                df = df.withColumn("ord", F.lit(0))
            if "payload" not in df.columns:
                df = df.withColumn("payload", F.lit(None).cast(LOG_SCHEMA["payload"].dataType))
            if "vector" not in df.columns:
                df = df.withColumn("vector", F.lit(None).cast("array<float>"))
            self._ensure_writable()
            up, vector = F.col("op") == "upsert", F.col("vector").cast("array<float>")
            if self.config.normalize_vectors:
                n = V.norm(vector)
                vector = F.when(n > 0, F.transform(vector, lambda x: (x / n).cast("float"))).otherwise(vector)
            seq = self._seq + 1
            df = df.select(F.lit(seq).cast("long").alias("seq"), F.col("ord").cast("int").alias("ord"), "op", V.nfc(F.col("id")).alias("id"), F.when(up, vector).alias("vector"), F.when(up, F.col("payload")).alias("payload"))
            batch = self.log.stage(seq, df) if self.log is not None else stage(df, "batch")
            try:
                n = self._validated(batch)
            except StoreError:
                if self.log is not None:
                    self.log.data(seq).delete()
                raise
            if n["n"]:
                self._append_batch(batch, n["n"], 4 * self.config.dimension * n["upserts"])
            elif self.log is not None:
                self.log.data(seq).delete()

    def _validated(self, batch: DataFrame) -> dict:
        up, vector = F.col("op") == "upsert", F.col("vector")
        r = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(up).alias("upserts"), F.count_if(F.coalesce(~F.col("op").isin("upsert", "delete"), F.lit(True))).alias("ops"), F.count_if(~V.valid_id(F.col("id"))).alias("ids"),
                      F.count_if(up & F.coalesce(F.size(vector) != self.config.dimension, F.lit(True))).alias("dims"), F.count_if(up & (V.norm(vector) == 0)).alias("zeros")).first().asDict()
        if r["ids"]:
            raise InvalidPointId(f"{r['ids']} ids are empty, NULL or too long")
        if r["ops"]:
            raise InvalidArgument(f"{r['ops']} changes are neither upserts nor deletes")
        if r["dims"]:
            raise InvalidArgument(f"{r['dims']} vectors don't have {self.config.dimension} dimensions")
        if not batch.groupBy("id", "ord").count().where("count > 1").isEmpty():
            raise InvalidArgument("ids of a batch must be unique, or ordered by a column ord")
        if self.config.normalize_vectors and r["zeros"]:
            raise ZeroVectorNotAllowed(f"{r['zeros']} vectors have norm 0")
        return r

    def delete(self, ids: list[str] | DataFrame) -> None:
        """Unknown ids are ignored. A DataFrame has the column id; repeated ones are one."""
        with self.lock:
            if isinstance(ids, DataFrame):
                return self.apply(ids.select("id").distinct().withColumn("op", F.lit("delete")))
            if not ids:
                return
            self._ensure_writable()
            if len(ids) > MAX_DELETE_IDS:
                raise InvalidArgument(f"at most {MAX_DELETE_IDS} ids can be deleted at once")
            self._append([{"ord": i, "op": "delete", "id": require_point_id(x), "vector": None, "payload": None} for i, x in enumerate(ids)], 0)

    def _append(self, rows: list[dict], vector_bytes: int) -> None:
        seq = self._seq + 1
        self._append_batch(pa.Table.from_pylist([r | {"seq": seq} for r in rows], schema=ARROW_SCHEMA), len(rows), vector_bytes)

    def _append_batch(self, batch: pa.Table | DataFrame, ops: int, vector_bytes: int) -> None:
        seq = self._seq + 1
        if self.log is not None:
            self.log.append(seq, None if isinstance(batch, DataFrame) else batch, ops, vector_bytes)
        else:
            self._memory.append(batch)
        self._seq = seq
        self._ops += ops
        self._bytes += vector_bytes
        if self.log is not None and (self._ops >= self.max_points or self._bytes >= self.max_bytes):
            self._seal()

    # ---- reads; they go on after a close and ignore failed syncs

    def get_frame(self, ids: list[str], with_vector: bool = False) -> DataFrame:
        want = list(map(canonical_id, ids))
        df = S.get_by_ids(self.live(), want)
        return df.select("ord", "id", *(["vector"] if with_vector else [F.array().cast("array<float>").alias("vector")]), "payload")

    def get(self, ids: list[str], with_vector: bool = False) -> list[Point]:
        """In the order of ids, unknown ones left out; without vectors they are empty."""
        if not ids:
            return []
        rows = self.get_frame(ids, with_vector).collect()
        return [Point(r["id"], list(r["vector"]), payload_python(r["payload"])) for r in sorted(rows, key=lambda r: r["ord"])]

    def search_frame(self, request: SearchRequest) -> DataFrame:
        """id, distance and what the request asks for; no rows if the collection is empty."""
        require_dimension(request.vector, self.config.dimension)
        if request.k < 1:
            raise InvalidArgument(f"k must be at least 1, got {request.k}")
        live, query = self.live(), request.vector
        if self.config.normalize_vectors:
            try:
                query = normalized(request.vector)
            except ZeroVectorNotAllowed:
                if not live.isEmpty():  # an empty collection answers any query
                    raise
        if request.filter is not None:
            if request.apply_filter:
                live = live.where(compile_filter(request.filter))
            else:
                warnings.warn("the filter is not evaluated; set apply_filter to do so", stacklevel=3)
        keep = [*(["payload"] if request.with_payload else []), *(["vector"] if request.with_vector else [])]
        if self.compute == "expr":
            return S.topk(live, query, request.k, self.config.metric, tuple(keep))
        hits = S.arrow_topk(live, query, request.k, self.config.metric)
        if not keep:
            return hits
        # payloads and vectors of the k hits only; few of them are broadcast
        hits = F.broadcast(hits) if request.k <= 10_000 else hits
        return live.select("id", *keep).join(hits, "id").select("id", "distance", *keep).orderBy("distance", "id")

    def search(self, request: SearchRequest) -> list[ScoredPoint]:
        rows = self.search_frame(request).collect()
        return [ScoredPoint(r["id"], r["distance"], payload_python(r["payload"]) if request.with_payload else None, list(r["vector"]) if request.with_vector else None) for r in rows]

    def count(self, include_tombstones: bool = False) -> int:
        """Live points, and with include_tombstones also the deletes of this session, or replayed on open, that hit one."""
        return self.live().count() + (self._removed_before + self._removed() if include_tombstones else 0)

    def _removed(self) -> int:
        before = self._state(self._sealed()).where("op = 'upsert'").select("id", F.struct(F.lit(0).cast("long").alias("seq"), F.lit(0).alias("ord")).alias("order"), "op")
        now = self._unsealed().select("id", F.struct("seq", "ord").alias("order"), "op")
        return hits(before.unionByName(now), ("id",), F.col("order.seq")).agg(F.sum("hits")).first()[0] or 0

    # ---- sealing

    def checkpoint(self) -> None:
        with self.lock:
            if not self._accepting:
                raise Closed("the collection takes no more changes")
            if self.log is None:
                return
            if not (self._ops and self._seal()):
                self._seq += 1
                self.log.mark(self._seq, "checkpoint")

    def seal(self) -> None:
        with self.lock:
            if not self._accepting:
                raise Closed("the collection takes no more changes")
            if self.log is not None and self._ops:
                self._seal()

    def _seal(self) -> bool:
        """Segment id, segment, seal marker, manifest, log: in this order, so that a crash leaves the old or the new state."""
        name = self.config.name
        state = self._state(self._unsealed()).select("order.seq", "order.ord", "op", "id", "value.vector", "value.payload")
        known = self._sealed().where("op = 'upsert'").select("id").distinct()
        rows = state.where("op = 'upsert'").unionByName(state.where("op = 'delete'").join(known, "id", "left_semi"))
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA.fields])
        removed = self._removed()
        segment_id = self.next_segment_id
        self.next_segment_id += 1
        try:
            self.write_meta()
        except StoreError:
            self.next_segment_id = segment_id
            raise
        if not self._write_segment(segment_id, rows):
            return False
        self._seq += 1
        self.log.mark(self._seq, "seal", segment_id)
        self._publish([*self.segment_ids, segment_id])
        self.log.reset()
        self._after = 0
        self._removed_before += removed
        self._ops = self._bytes = 0
        return True

    def _write_segment(self, segment_id: int, rows: DataFrame) -> bool:
        """Whether there were rows; the segment is there as a whole, with its meta document last, or not at all."""
        folder = self.layout.segment(self.config.name, segment_id)
        tmp = folder.with_name(folder.name + ".tmp")
        tmp.delete()
        rows.write.parquet(str(tmp))
        written = self.spark.read.schema(LOG_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(str(tmp))
        n = written.agg(F.count_if(F.col("op") == "upsert").alias("rows"), F.count_if(F.col("op") == "delete").alias("gone"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        if not n["rows"] + n["gone"]:
            tmp.delete()
            return False
        files = fingerprints(self.spark, tmp)
        for f in files:
            sync_file(tmp / f)
        tmp.rename(folder)
        meta = {"formatVersion": FORMAT_VERSION, "segmentId": segment_id, "dimension": self.config.dimension, "rowCount": n["rows"], "tombstoneCount": n["gone"], "index": self.config.index, "idRange": [n["lo"], n["hi"]], "files": files}
        write_json(self.layout.segment_meta(self.config.name, segment_id), meta)
        self._note(segment_id, meta)
        return True

    def _publish(self, segment_ids: list[int]) -> None:
        self.generation, self.segment_ids, self.wal_epoch = self.generation + 1, segment_ids, self.wal_epoch + 1
        write_json(self.layout.manifest(self.config.name), {"formatVersion": FORMAT_VERSION, "generation": self.generation, "segmentIds": self.segment_ids, "walEpoch": self.wal_epoch, "lastSeq": self._seq})

    def compact(self) -> None:
        """An extension: seal, then rewrite the live points as one segment and drop the others with their tombstones."""
        with self.lock:
            self.seal()
            if self.layout is None or len(self.segment_ids) < 2:
                return
            name, segment_id = self.config.name, self.next_segment_id
            self.next_segment_id += 1
            self.write_meta()
            state = self._state(self._sealed()).where("op = 'upsert'").select("order.seq", "order.ord", "op", "id", "value.vector", "value.payload")
            if not self._write_segment(segment_id, state):
                return
            self._publish([segment_id])
            remove_unlisted_segments(self.layout.segments(name), {segment_id})

    def prepare_for_close(self, sync: bool) -> None:
        with self.lock:
            self._accepting = False
            if self.log is not None:
                self.log.cancel_timer()
                if sync:
                    self.log.sync()

    def __repr__(self) -> str:
        return f"Collection({json.dumps(config_document(self.config))})"

