"""What the vector operators share: usable points in a compact form, staged once."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.session import stage
from pointlake.types import Metric

#: Collections a table may have: their configurations and models are held on the driver.
MAX_COLLECTIONS = 10_000


@dataclass(frozen=True)
class Shape:
    dim: int
    metric: str


def shapes(configs: DataFrame) -> dict[str, Shape]:
    """Dimension and metric by collection; unknown metrics and NULLs are left out, of repeated names the first in order counts."""
    known = [m.value for m in Metric]
    rows = configs.where(F.col("name").isNotNull() & F.col("metric").isin(known) & (F.col("dimension") > 0)).groupBy("name").agg(F.min(F.struct("dimension", "metric")).alias("m")).limit(MAX_COLLECTIONS + 1).collect()
    if len(rows) > MAX_COLLECTIONS:
        raise ValueError(f"more than {MAX_COLLECTIONS} collections")
    return {r["name"]: Shape(r["m"]["dimension"], r["m"]["metric"]) for r in rows}


def rows_of(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the usable vectors of this length: no nulls, NaN or infinity, not all zero."""
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    offsets = lists.offsets.to_numpy()
    at = np.flatnonzero((np.diff(offsets) == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
    m = values[offsets[at][:, None] + np.arange(dim)] if len(at) else np.empty((0, dim), np.float32)
    ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return at[ok], m[ok]


def matrix(blobs: pa.Array, dim: int) -> np.ndarray:
    """Binary values of 4 * dim bytes each as one float32 matrix."""
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype="<f4").reshape(-1, dim)


def by_collection(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    coll = np.array(b.column(0).to_pylist(), dtype=object)
    for c in sorted(set(coll)):
        yield c, b.take(pa.array(np.flatnonzero(coll == c)))


def usable(points: DataFrame, known: dict[str, Shape], carry: Column | None = None, kind: str = "boolean") -> DataFrame:
    """collection, id, vec (little-endian float32), h1, h2 (128 bits of its hash), norm: staged, one row an id.

    Of repeated ids the latest load with a usable vector counts; vectors that are null, empty, of another length than the
    dimension, all zero, or hold null, NaN or infinity, and rows without id or of an unknown collection are left out.
    carry, of the SQL type kind, comes along as the column carry.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coll = np.array(b.column(0).to_pylist(), dtype=object)
            for dim in {known[c].dim for c in set(coll) if c in known}:
                at, m = rows_of(b.column(2), dim)
                keep = np.array([coll[i] in known and known[coll[i]].dim == dim for i in at], dtype=bool)
                at, m = at[keep], m[keep]
                if not len(at):
                    continue
                m = m + np.float32(0)  # -0.0 is 0.0
                blobs = [r.tobytes() for r in m]
                h = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in blobs), dtype="<i8").reshape(-1, 2)
                t = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), b.column(3).take(t), b.column(4).take(t), pa.array(blobs, pa.binary()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.linalg.norm(m.astype(np.float64), axis=1))], names=["collection", "id", "loaded_at", "carry", "vec", "h1", "h2", "norm"])

    p = points.where("id is not null and collection is not null").select("collection", "id", "vector", F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit(0).cast("timestamp")).cast("long").alias("loaded_at"), (F.lit(None) if carry is None else carry).cast(kind).alias("carry"))
    p = p.mapInArrow(run, f"collection string, id string, loaded_at long, carry {kind}, vec binary, h1 long, h2 long, norm double")
    p = p.groupBy("collection", "id").agg(F.max(F.struct("loaded_at", "vec", "h1", "h2", "norm", "carry")).alias("m"))
    return stage(p.select("collection", "id", "m.vec", "m.h1", "m.h2", "m.norm", *([] if carry is None else ["m.carry"])), "usable")


def copies(points: DataFrame) -> DataFrame:
    """collection, h1, h2, rep, n of each vector that several ids share: rep is the smallest id, n their number."""
    return points.groupBy("collection", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
