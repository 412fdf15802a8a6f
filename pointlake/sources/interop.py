"""Reading and writing stores in the binary file format: one VECTORS, IDS, PAYLOAD and TOMBSTONES file a segment, and a framed log.

The codecs work on bytes and fail closed. `read_segments` and `read_log` decode many files as Spark tasks, one file a row, and
give the tables that operators.changes takes.
"""
from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators.changes import live_points
from pointlake.sources.files import Place, read_json
from pointlake.types import FORMAT_VERSION, MAX_DELETE_IDS, MAX_DIMENSION, MAX_FRAME_BYTES, PAYLOAD, Corrupted, InvalidPointId, StoreError, require_point_id

# Fixed values of the format: magic numbers as stored, record types, and the names of payload kinds.
MAGIC = {"VECTORS": b"VVEC", "IDS": b"VIDS", "PAYLOAD": b"VPLD"}
UPSERT, DELETE, CHECKPOINT, SEAL_V1, SEAL_V2 = 1, 2, 3, 4, 5
KINDS = ("bool", "int", "double", "string", "strings")
MEMBERS = ("b", "i", "d", "s", "ss")


def _fail(what: str, reason: str) -> StoreError:
    return Corrupted(what, reason)


class Reader:
    """A cursor over bytes that never reads past the end."""

    def __init__(self, data: bytes, what: str, at: int = 0, end: int | None = None):
        self.data, self.what, self.at, self.end = data, what, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise _fail(self.what, "cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def text(self, n: int) -> str:
        try:
            return self.take(n).decode("utf-8")
        except UnicodeDecodeError as e:
            raise _fail(self.what, "not UTF-8") from e

    def point_id(self) -> str:
        raw = self.text(self.number("H"))
        try:
            require_point_id(raw)
        except InvalidPointId as e:
            raise _fail(self.what, str(e)) from e
        return raw

    def done(self) -> None:
        if self.at != self.end:
            raise _fail(self.what, f"{self.end - self.at} bytes too many")


def payload_json(payload: dict[str, dict[str, Any]]) -> bytes:
    """A payload of tagged values as JSON: {"key": {"kind": {"_0": value}}}, keys sorted; null has no value."""
    def one(v: dict[str, Any]) -> dict[str, Any]:
        return {"null": {}} if v["kind"] == "null" else {v["kind"]: {"_0": v[MEMBERS[KINDS.index(v["kind"])]]}}

    return json.dumps({k: one(v) for k, v in payload.items()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def payload_from(raw: bytes, what: str) -> dict[str, dict[str, Any]]:
    types = dict(zip(KINDS, (bool, int, (int, float), str, list)))
    try:
        out = {}
        for key, tagged in json.loads(raw).items():
            ((kind, body),) = tagged.items()
            v = dict.fromkeys(("kind", *MEMBERS)) | {"kind": kind}
            if kind != "null":
                x = body["_0"]
                if not isinstance(x, types[kind]) or kind != "bool" and isinstance(x, bool):
                    raise ValueError(kind)
                v[MEMBERS[KINDS.index(kind)]] = float(x) if kind == "double" else x
            out[key] = v
        return out
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise _fail(what, f"not a payload: {e}") from e


# ---- segment files

def _sealed(head: bytes, body: bytes) -> bytes:
    return head + body + struct.pack("<I", zlib.crc32(body))


def _opened(data: bytes, kind: str, header: int, what: str) -> Reader:
    if len(data) < header + 4:
        raise _fail(what, "too short")
    if data[:4] != MAGIC[kind]:
        raise _fail(what, "wrong magic number")
    if struct.unpack_from("<I", data, 4)[0] != FORMAT_VERSION:
        raise _fail(what, "unsupported version")
    return Reader(data, what, 8, len(data) - 4)


def _check_body(data: bytes, header: int, what: str) -> None:
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[header:-4]):
        raise _fail(what, "its checksum is wrong")


def encode_vectors(matrix: np.ndarray, flags: int = 0) -> bytes:
    m = np.ascontiguousarray(matrix, dtype="<f4")
    return _sealed(MAGIC["VECTORS"] + struct.pack("<IIQII", FORMAT_VERSION, m.shape[1], m.shape[0], flags, 0), m.tobytes())


def decode_vectors(data: bytes, what: str = "VECTORS") -> np.ndarray:
    r = _opened(data, "VECTORS", 28, what)
    dim, count = r.number("I"), r.number("Q")
    if dim == 0:
        raise _fail(what, "dimension 0")
    if count > 2**32 - 1 or len(data) != 28 + 4 * dim * count + 4:
        raise _fail(what, "its size doesn't fit its count")
    _check_body(data, 28, what)
    return np.frombuffer(data, dtype="<f4", count=dim * count, offset=28).reshape(count, dim)


def _encode_list(kind: str, items: list[bytes], length: str) -> bytes:
    return _sealed(MAGIC[kind] + struct.pack("<IQ", FORMAT_VERSION, len(items)), b"".join(struct.pack("<" + length, len(x)) + x for x in items))


def encode_ids(ids: list[str]) -> bytes:
    for i in ids:
        require_point_id(i)
    return _encode_list("IDS", [i.encode() for i in ids], "H")


def decode_ids(data: bytes, what: str = "IDS") -> list[str]:
    r = _opened(data, "IDS", 16, what)
    n = r.number("Q")
    if n > 2**32 - 1:
        raise _fail(what, "too many")
    _check_body(data, 16, what)
    out = [r.point_id() for _ in range(n)]
    r.done()
    return out


def encode_payloads(payloads: list[dict[str, dict[str, Any]]]) -> bytes:
    return _encode_list("PAYLOAD", [payload_json(p) for p in payloads], "I")


def decode_payloads(data: bytes, what: str = "PAYLOAD") -> list[dict[str, dict[str, Any]]]:
    r = _opened(data, "PAYLOAD", 16, what)
    n = r.number("Q")
    if n > 2**32 - 1:
        raise _fail(what, "too many")
    _check_body(data, 16, what)
    out = [payload_from(r.take(r.number("I")), what) for _ in range(n)]
    r.done()
    return out


def trailer(data: bytes) -> int:
    return struct.unpack("<I", data[-4:])[0]


# ---- the framed log

@dataclass(frozen=True)
class Record:
    kind: int
    ids: tuple[str, ...] = ()
    vector: tuple[float, ...] = ()
    payload: dict[str, dict[str, Any]] | None = None
    segment_id: int | None = None
    row_count: int | None = None
    crcs: tuple[int, int, int] = (0, 0, 0)
    flags: int = 0


def encode_record(r: Record) -> bytes:
    """[length][type][payload][CRC-32 of type and payload]; what could not be read again is refused."""
    if r.kind == UPSERT:
        raw, pid = payload_json(r.payload or {}), require_point_id(r.ids[0]).encode()
        if len(r.vector) > MAX_DIMENSION:
            raise InvalidPointId("too many dimensions")
        body = struct.pack("<H", len(pid)) + pid + struct.pack("<I", len(r.vector)) + np.asarray(r.vector, dtype="<f4").tobytes() + struct.pack("<I", len(raw)) + raw
    elif r.kind == DELETE:
        if len(r.ids) > MAX_DELETE_IDS:
            raise InvalidPointId("too many ids")
        body = struct.pack("<I", len(r.ids)) + b"".join(struct.pack("<H", len(x)) + x for x in (require_point_id(i).encode() for i in r.ids))
    elif r.kind == SEAL_V1:
        body = struct.pack("<Q", r.segment_id)
    elif r.kind == SEAL_V2:
        body = struct.pack("<QQIIII", r.segment_id, r.row_count, *r.crcs, r.flags)
    else:
        body = b""
    frame = bytes([r.kind]) + body
    if len(frame) + 4 > MAX_FRAME_BYTES:
        raise InvalidPointId("the record is too large")
    return struct.pack("<I", len(frame) + 4) + frame + struct.pack("<I", zlib.crc32(frame))


def decode_body(kind: int, body: bytes, what: str) -> Record:
    r = Reader(body, what)
    if kind == UPSERT:
        pid = r.point_id()
        dim = r.number("I")
        if dim > MAX_DIMENSION:
            raise _fail(what, "too many dimensions")
        vector = np.frombuffer(r.take(4 * dim), dtype="<f4")
        out = Record(UPSERT, (pid,), tuple(vector.tolist()), payload_from(r.take(r.number("I")), what))
    elif kind == DELETE:
        n = r.number("I")
        if n > MAX_DELETE_IDS:
            raise _fail(what, "too many ids")
        out = Record(DELETE, tuple(r.point_id() for _ in range(n)))
    elif kind == CHECKPOINT:
        out = Record(CHECKPOINT)
    elif kind == SEAL_V1:
        out = Record(SEAL_V1, segment_id=r.number("Q"))
    elif kind == SEAL_V2:
        out = Record(SEAL_V2, segment_id=r.number("Q"), row_count=r.number("Q"), crcs=(r.number("I"), r.number("I"), r.number("I")), flags=r.number("I"))
    else:
        raise _fail(what, f"unknown record type {kind}")
    r.done()
    return out


def decode_log(data: bytes, what: str = "log") -> tuple[list[Record], int]:
    """The whole records, and how many bytes they take. An unfinished tail is left out; anything else wrong is corruption."""
    records, at = [], 0
    while at + 4 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        if n < 5 or n > MAX_FRAME_BYTES:
            raise _fail(what, f"record length {n}")
        if at + 4 + n > len(data):
            break
        frame, crc = data[at + 4 : at + n], struct.unpack_from("<I", data, at + n)[0]
        if zlib.crc32(frame) != crc:
            raise _fail(what, "a record's checksum is wrong")
        records.append(decode_body(frame[0], frame[1:], what))
        at += 4 + n
    return records, at


def append_log(log: Place, records: list[Record]) -> int:
    """Write records after the whole ones of a log, over an unfinished tail; gives the records that the log then has. What could not be read
    again is refused before anything is written."""
    frames = b"".join(map(encode_record, records))
    before, at = decode_log(log.read_bytes(), str(log)) if log.exists() else ([], 0)
    log.append_bytes(frames, at)
    return len(before) + len(records)


# ---- tables

_SEGMENT = "collection string, segment_id bigint, dimension int, row_count bigint, ids array<string>, vectors array<float>, payloads array<" + PAYLOAD.simpleString() + ">, tombstones array<string>, vectors_crc32 bigint, ids_crc32 bigint, payloads_crc32 bigint, tombstones_crc32 bigint"


def _decode_segment(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    files = {Path(p).name: bytes(c) for p, c in zip(pdf.path, pdf.content)}
    what = f"{key[0]}/{key[1]}"
    try:
        meta = json.loads(files["SEGMENT_META.json"])
        wanted = [meta[k] for k in ("vectorsCrc32", "idsCrc32", "payloadsCrc32")]
        version, segment, dim, rows = (meta[k] for k in ("formatVersion", "segmentId", "dimension", "rowCount"))
    except (KeyError, ValueError) as e:
        raise _fail(what, f"no usable meta document: {e}") from e
    if version != FORMAT_VERSION or segment != int(key[1]):
        raise _fail(what, "its meta document describes something else")
    for name in ("VECTORS.bin", "IDS.bin", "PAYLOAD.bin"):
        if name not in files:
            raise _fail(what, f"{name} is missing")
    m, ids, payloads = decode_vectors(files["VECTORS.bin"], what), decode_ids(files["IDS.bin"], what), decode_payloads(files["PAYLOAD.bin"], what)
    tomb_crc, gone = meta.get("tombstonesCrc32", 0), []
    if "TOMBSTONES.bin" in files:
        gone = decode_ids(files["TOMBSTONES.bin"], what)
        if tomb_crc not in (0, trailer(files["TOMBSTONES.bin"])):
            raise _fail(what, "tombstones don't match the meta document")
    elif tomb_crc:
        raise _fail(what, "TOMBSTONES.bin is missing")
    crcs = [trailer(files[n]) for n in ("VECTORS.bin", "IDS.bin", "PAYLOAD.bin")]
    if crcs != wanted or m.shape[1] != dim or not len(m) == len(ids) == len(payloads) == rows:
        raise _fail(what, "files don't match the meta document")
    row = [key[0], int(key[1]), dim, rows, ids, m.ravel().tolist(), payloads, gone, *crcs, tomb_crc]
    return pd.DataFrame([row], columns=["collection", "segment_id", "dimension", "row_count", "ids", "vectors", "payloads", "tombstones", "vectors_crc32", "ids_crc32", "payloads_crc32", "tombstones_crc32"])


def read_segments(spark: SparkSession, root: str, collections: str = "*") -> DataFrame:
    """All numeric segment folders under root/collections/<name>/segments, decoded and verified by tasks, one folder each."""
    f = spark.read.format("binaryFile").load(f"{root}/collections/{collections}/segments/*/*")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    f = f.select(part(-4).alias("collection"), part(-2).alias("segment"), "path", "content").where("segment rlike '^[0-9]+$' and not endswith(path, '.tmp')")
    return decode_segments(f)


def read_documents(root: Place) -> dict[str, dict[str, Any]]:
    """The configuration of each collection of a store, from DB_META, CATALOG and COLL_META, which must agree."""
    read_json(root / "DB_META.json")
    out = {}
    for name, path in read_json(root / "CATALOG.json").get("collections", {}).items():
        meta = read_json(root / path / "COLL_META.json")
        config = meta.get("config", {})
        if path != f"collections/{name}" or config.get("name") != name:
            raise _fail(f"{root}/{path}", "the catalog and the collection's meta document differ")
        out[name] = config | {"nextSegmentId": meta.get("nextSegmentId", 1)}
    return out


def read_live(spark: SparkSession, root: Place) -> DataFrame:
    """collection, id, vector, payload of all live points of a store: its published segments, then its log."""
    db = lambda df: df.withColumn("db_id", F.lit(""))
    folder = str(root)
    names = [p for p in (root / "collections").iterdir() if p.is_dir()]
    segments = [s for c in names for s in (c / "segments").iterdir() if s.is_dir()]
    empty = lambda schema: spark.createDataFrame([], schema)
    s = read_segments(spark, folder) if segments else empty(_SEGMENT)
    w = read_log(spark, folder) if any((c / "wal/wal.log").exists() for c in names) else empty(_LOG)
    m = read_manifests(spark, folder) if any((c / "MANIFEST.json").exists() for c in names) else empty("collection string, format_version int, generation bigint, segment_ids array<bigint>, wal_epoch bigint")
    return live_points(db(w), db(s), db(m)).drop("db_id")


def decode_segments(files: DataFrame) -> DataFrame:
    """Segments of files (collection, segment, path, content), verified; a segment's files are decoded by one task."""
    return files.groupBy("collection", "segment").applyInPandas(_decode_segment, _SEGMENT)


def segment_blobs(segments: DataFrame) -> DataFrame:
    """collection, segment, path, content of the files of each segment (collection, segment_id, row_count, ids, vectors, payloads, tombstones)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = np.asarray(r["vectors"], dtype="<f4").reshape(r["row_count"], -1) if r["row_count"] else np.empty((0, 1), "<f4")
                files, _ = segment_files(r["segment_id"], m, r["ids"], [dict(p or ()) for p in r["payloads"]], r["tombstones"] or [])
                n, s = len(files), str(r["segment_id"])
                yield pa.RecordBatch.from_arrays([pa.array([r["collection"]] * n), pa.array([s] * n), pa.array([f"{s}/{name}" for name in files]), pa.array(list(files.values()), pa.binary())], names=["collection", "segment", "path", "content"])

    return segments.select("collection", "segment_id", "row_count", "ids", "vectors", "payloads", "tombstones").mapInArrow(run, "collection string, segment string, path string, content binary")


_LOG = "collection string, seq bigint, ord int, op string, id string, vector array<float>, payload " + PAYLOAD.simpleString() + ", segment_id bigint, row_count bigint"


def read_log(spark: SparkSession, root: str, collections: str = "*") -> DataFrame:
    """The records of root/collections/<name>/wal/wal.log as log rows; seq counts a log's records from 1."""
    names = {UPSERT: "upsert", DELETE: "delete", CHECKPOINT: "checkpoint", SEAL_V1: "seal", SEAL_V2: "seal"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf.path, pdf.content):
                rows = []
                for seq, r in enumerate(decode_log(bytes(content), path)[0], 1):
                    for o, pid in enumerate(r.ids or (None,)):
                        rows.append([path.split("/")[-3], seq, o, names[r.kind], pid, list(r.vector) if r.kind == UPSERT else None, r.payload, r.segment_id, r.row_count])
                yield pd.DataFrame(rows, columns=["collection", "seq", "ord", "op", "id", "vector", "payload", "segment_id", "row_count"]).astype({"segment_id": "Int64", "row_count": "Int64"})

    return spark.read.format("binaryFile").load(f"{root}/collections/{collections}/wal/wal.log").select("path", "content").mapInPandas(run, _LOG)


def read_manifests(spark: SparkSession, root: str, collections: str = "*") -> DataFrame:
    """collection, format_version, generation, segment_ids, wal_epoch of each MANIFEST.json."""
    m = spark.read.schema("formatVersion int, generation bigint, segmentIds array<bigint>, walEpoch bigint").json(f"{root}/collections/{collections}/MANIFEST.json", multiLine=True, mode="FAILFAST")
    name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return m.select(name.alias("collection"), F.col("formatVersion").alias("format_version"), "generation", F.col("segmentIds").alias("segment_ids"), F.col("walEpoch").alias("wal_epoch"))


def segment_files(segment_id: int, m: np.ndarray, ids: list[str], payloads: list[dict], tombstones: list[str]) -> tuple[dict[str, bytes], dict[str, Any]]:
    """The files of a segment by name, its meta document last, and that document."""
    files = {"VECTORS.bin": encode_vectors(m), "IDS.bin": encode_ids(ids), "PAYLOAD.bin": encode_payloads(payloads), "TOMBSTONES.bin": encode_ids(tombstones)}
    crcs = {k: trailer(files[f]) for k, f in (("vectorsCrc32", "VECTORS.bin"), ("idsCrc32", "IDS.bin"), ("payloadsCrc32", "PAYLOAD.bin"), ("tombstonesCrc32", "TOMBSTONES.bin"))}
    meta = {"formatVersion": FORMAT_VERSION, "segmentId": segment_id, "dimension": m.shape[1], "rowCount": len(ids), "index": "flat", **crcs}
    return files | {"SEGMENT_META.json": json.dumps(meta, sort_keys=True).encode()}, meta


def write_segment(folder: Path, segment_id: int, dimension: int, rows: list[tuple[str, list[float], dict]], tombstones: list[str] = ()) -> dict[str, Any]:
    """One segment folder; its meta document comes last."""
    folder.mkdir(parents=True, exist_ok=True)
    files, meta = segment_files(segment_id, np.array([r[1] for r in rows], dtype="<f4").reshape(-1, dimension), [r[0] for r in rows], [r[2] for r in rows], list(tombstones))
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return meta
