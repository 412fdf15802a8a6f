"""Data model: metrics, limits, errors, configurations, points, and the Spark schemas they map to."""
from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

import numpy as np
from pyspark.sql import types as T

# Limits and defaults that results depend on.
MAX_ID_BYTES = 512
MAX_NAME_BYTES = 128
MAX_DIMENSION = 65_536
MAX_DELETE_IDS = 1_000_000
MAX_FRAME_BYTES = 16 * 1024 * 1024
FORMAT_VERSION = 1

PAYLOAD_VALUE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("b", T.BooleanType()),
    T.StructField("i", T.LongType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("s", T.StringType()),
    T.StructField("ss", T.ArrayType(T.StringType())),
])
PAYLOAD = T.MapType(T.StringType(), PAYLOAD_VALUE)
VECTOR = T.ArrayType(T.FloatType())
POINT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", VECTOR),
    T.StructField("payload", PAYLOAD),
])
LOG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("op", T.StringType()),
    *POINT_SCHEMA.fields,
])


class Metric(str, Enum):
    """Distance measures; for each of them smaller means closer."""

    L2 = "l2"
    L2_SQUARED = "l2Squared"
    INNER_PRODUCT = "innerProduct"
    COSINE = "cosine"


class StoreError(Exception):
    """Base of all errors of the store."""


class InvalidArgument(StoreError):
    pass


class DimensionMismatch(StoreError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected {expected} dimensions, got {actual}")
        self.expected, self.actual = expected, actual


class InvalidPointId(StoreError):
    pass


class InvalidCollectionName(StoreError):
    pass


class ZeroVectorNotAllowed(StoreError):
    pass


class CollectionNotFound(StoreError):
    pass


class CollectionExists(StoreError):
    pass


class BackendUnavailable(StoreError):
    pass


class Closed(StoreError):
    pass


class StorageFailure(StoreError):
    """An I/O operation failed."""


class Corrupted(StoreError):
    def __init__(self, path: Any, reason: str):
        super().__init__(f"{path}: {reason}")
        self.path, self.reason = str(path), reason


@dataclass(frozen=True)
class HNSWParams:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64

    @property
    def max_m0(self) -> int:
        return 2 * self.m


@dataclass(frozen=True)
class BalancedPolicy:
    """Thresholds at which pending log records are synced together."""

    sync_every_records: int = 64
    sync_every_bytes: int = 256 * 1024
    sync_interval_s: float = 0.1


@dataclass(frozen=True)
class DatabaseConfig:
    durability: str = "balanced"
    compute: str = "auto"
    mutable_segment_max_points: int = 10_000
    mutable_segment_max_bytes: int = 64 * 1024 * 1024
    tombstone_ratio_compact: float = 0.20
    balanced: BalancedPolicy = field(default_factory=BalancedPolicy)

    def __post_init__(self) -> None:
        if self.durability not in ("strict", "balanced", "relaxed"):
            raise InvalidArgument(f"unknown durability {self.durability!r}")


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    metric: Metric = Metric.L2
    index: str = "flat"
    normalize_vectors: bool = False
    hnsw: HNSWParams | None = None


@dataclass(frozen=True)
class Point:
    id: str
    vector: list[float]
    payload: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ScoredPoint:
    id: str
    distance: float
    payload: dict[str, Any] | None = None
    vector: list[float] | None = None


@dataclass(frozen=True)
class SearchRequest:
    vector: list[float]
    k: int
    filter: Any = None
    ef: int | None = None
    with_payload: bool = True
    with_vector: bool = False
    apply_filter: bool = False


def canonical_id(value: str) -> str:
    """Canonically equivalent ids are one id: NFC, compared by bytes from there on."""
    return value if value.isascii() else unicodedata.normalize("NFC", value)


def require_point_id(value: str) -> str:
    if not isinstance(value, str) or not value:
        raise InvalidPointId("a point id must not be empty")
    value = canonical_id(value)
    if len(value.encode()) > MAX_ID_BYTES:
        raise InvalidPointId(f"a point id may have at most {MAX_ID_BYTES} bytes")
    return value


def require_collection_name(value: str) -> str:
    if not isinstance(value, str) or not value:
        raise InvalidCollectionName("a collection name must not be empty")
    if len(value.encode()) > MAX_NAME_BYTES:
        raise InvalidCollectionName(f"a collection name may have at most {MAX_NAME_BYTES} bytes")
    if "/" in value or "\\" in value or "\0" in value or value in (".", ".."):
        raise InvalidCollectionName(f"{value!r} can't be a directory name")
    return value


def require_dimension(vector: list[float], expected: int) -> None:
    if len(vector) != expected:
        raise DimensionMismatch(expected, len(vector))


def normalized(vector: list[float]) -> list[float]:
    """v / |v| with the squares summed one after the other in float32; a norm of 0 is an error."""
    v = np.asarray(vector, dtype=np.float32)
    total = np.float32(0)
    with np.errstate(over="ignore", invalid="ignore"):
        for x in v:
            total = np.float32(total + np.float32(x * x))
        norm = np.float32(np.sqrt(total))
        if norm == 0:
            raise ZeroVectorNotAllowed("a vector of norm 0 can't be normalized")
        return (v / norm).astype(np.float32).tolist()


def payload_value(value: Any) -> dict[str, Any]:
    """Tag a Python value; bool before int, as True is also an int."""
    out: dict[str, Any] = dict.fromkeys(("kind", "b", "i", "d", "s", "ss"))
    if value is None:
        out["kind"] = "null"
    elif isinstance(value, bool):
        out |= {"kind": "bool", "b": value}
    elif isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise InvalidArgument("payload integers have 64 bits")
        out |= {"kind": "int", "i": value}
    elif isinstance(value, float):
        out |= {"kind": "double", "d": value}
    elif isinstance(value, str):
        out |= {"kind": "string", "s": value}
    elif isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        out |= {"kind": "strings", "ss": list(value)}
    else:
        raise InvalidArgument(f"no payload kind holds {type(value).__name__}")
    return out


def payload_row(payload: dict[str, Any]) -> dict[str, dict[str, Any]]:
    return {k: payload_value(v) for k, v in payload.items()}


def payload_python(row: Any) -> dict[str, Any]:
    """The reverse of payload_row; a null map is an empty payload."""
    member = {"bool": "b", "int": "i", "double": "d", "string": "s", "strings": "ss"}
    return {k: None if v["kind"] == "null" else v[member[v["kind"]]] for k, v in (row or {}).items()}
