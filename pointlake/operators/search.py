"""Exact nearest neighbours: full scan, batches of queries, merges of partial results.

Order is (distance, id): ascending, ids by bytes, NaN distances last. Ties at the boundary of k are cut by id. Fewer
than k rows give all of them; an empty table gives none.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions import vectors as V
from pointlake.session import stage
from pointlake.types import InvalidArgument, Metric


def score(points: DataFrame, query: list[float] | Column, metric: Metric | str) -> DataFrame:
    """points with a float column distance; the vector column is `vector`. Rows of another length get NULL."""
    q = query if isinstance(query, Column) else V.vector_lit(query)
    return points.withColumn("distance", V.distance(F.col("vector"), q, metric))


def topk(points: DataFrame, query: list[float] | Column, k: int, metric: Metric | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest rows: id, distance and the columns of keep. Partial top-k a partition, then one merge of k rows each."""
    if k < 1:
        raise InvalidArgument(f"k must be at least 1, got {k}")
    scored = score(points, query, metric).select("id", "distance", *keep)
    return scored.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)


#: Vectors of one block of queries, which is broadcast: so many bytes at most.
BLOCK_BYTES = 32 << 20


def batch_topk(points: DataFrame, queries: DataFrame, k: int, metric: Metric | str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row (qid, vector) of queries its k nearest points: qid, id, distance, rank.

    The queries are a stated set; they meet all points in blocks of at most about block_bytes of vectors, broadcast. A partition keeps
    the k best rows of each query, so that only these are shuffled. Points whose vector is NULL or of another length than the query's
    are left out, as are queries without a vector.
    """
    if k < 1:
        raise InvalidArgument(f"k must be at least 1, got {k}")
    metric = Metric(metric).value
    q = queries.where("vector is not null").select(F.lit("").alias("collection"), F.lit(metric).alias("metric"), "qid", F.size("vector").alias("dim"), F.col("vector").cast("array<float>").alias("vector"))
    return _nearest(points.select(F.lit("").alias("collection"), "id", "vector"), q, k, block_bytes).drop("collection")


def merge_topk(parts: list[DataFrame], k: int) -> DataFrame:
    """One result out of partial ones (id, distance): the best distance of an id counts. k < 1 gives no rows."""
    union = parts[0].select("id", "distance")
    for p in parts[1:]:
        union = union.unionByName(p.select("id", "distance"))
    return union.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(max(k, 0))


def sequential_distances(rows: np.ndarray, query: np.ndarray, metric: Metric | str) -> np.ndarray:
    """Distances of all rows to one query, float32, dimension after dimension: bit-equal to the Column builders."""
    metric, zero = Metric(metric), np.zeros(len(rows), dtype=np.float32)
    rows, query = rows.astype(np.float32, copy=False), query.astype(np.float32, copy=False)
    with np.errstate(all="ignore"):
        if metric in (Metric.L2, Metric.L2_SQUARED):
            for j in range(rows.shape[1]):
                d = rows[:, j] - query[j]
                zero = zero + d * d
            return np.sqrt(zero) if metric is Metric.L2 else zero
        product = zero
        for j in range(rows.shape[1]):
            product = product + rows[:, j] * query[j]
        if metric is Metric.INNER_PRODUCT:
            return -product + np.float32(0)
        a, b = zero, np.float32(0)
        for j in range(rows.shape[1]):
            a = a + rows[:, j] * rows[:, j]
            b = np.float32(b + query[j] * query[j])
        den = np.sqrt(a) * np.float32(np.sqrt(b))
        return np.where(den == 0, np.float32(1), np.float32(1) - product / np.where(den == 0, np.float32(1), den)).astype(np.float32)


def arrow_topk(points: DataFrame, query: list[float], k: int, metric: Metric | str) -> DataFrame:
    """topk with the batch kernel: Arrow batches, k rows kept a partition, the same values and order as topk.

    Rows whose vector is NULL or of another length are left out (topk ranks them last, with a NULL distance).
    """
    if k < 1:
        raise InvalidArgument(f"k must be at least 1, got {k}")
    q, dim = np.asarray(query, dtype=np.float32), len(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(1)
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False))
            if not b.num_rows:
                continue
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            t = pa.table([b.column(0), pa.array(sequential_distances(rows, q, metric))], names=["id", "distance"])
            yield from t.take(pc.sort_indices(t, [("distance", "ascending"), ("id", "ascending")])[:k]).to_batches()

    return points.select("id", "vector").mapInArrow(run, "id string, distance float").orderBy("distance", "id").limit(k)


def get_by_ids(points: DataFrame, ids: list[str]) -> DataFrame:
    """Points in the order of ids with the column ord; unknown ids are left out, repeated ones come again."""
    spark = points.sparkSession
    want = spark.createDataFrame(list(enumerate(ids)), "ord int, id string")
    return points.join(F.broadcast(want), "id").orderBy("ord")


def usable_points(points: DataFrame, configs: DataFrame) -> DataFrame:
    """collection, id, vector, metric: one row for each id with a usable vector, whatever was loaded again.

    Loads of one id have the same content; should they differ, the latest usable one counts. Rows without id or of
    an unknown collection are left out. configs is small (one row a collection) and checked by Spark's own size limit.
    """
    c = configs.select(F.col("name").alias("collection"), "dimension", "metric").dropDuplicates(["collection"])
    p = points.where(F.col("id").isNotNull()).join(c, "collection")
    p = p.where(V.usable(F.col("vector"), F.col("dimension"))).select("collection", "id", "vector", "metric", "loaded_at")
    return p.groupBy("collection", "id").agg(F.max_by(F.struct("vector", "metric"), F.struct(F.coalesce("loaded_at", F.lit(0).cast("timestamp")), "vector")).alias("m")).select("collection", "id", "m.vector", "m.metric")


def pairwise(rows: np.ndarray, queries: np.ndarray, metric: Metric | str) -> np.ndarray:
    """sequential_distances of many queries at once: (queries, rows), the same float32 values, in blocks that stay in the cache."""
    metric = Metric(metric)
    rows, queries = rows.astype(np.float32, copy=False), queries.astype(np.float32, copy=False)
    out = np.empty((len(queries), len(rows)), dtype=np.float32)
    euclid = metric in (Metric.L2, Metric.L2_SQUARED)

    def square_sums(m: np.ndarray) -> np.ndarray:
        s = np.zeros(len(m), dtype=np.float32)
        for j in range(m.shape[1]):
            s += m[:, j] * m[:, j]
        return s

    with np.errstate(all="ignore"):
        norms = (np.sqrt(square_sums(rows)), np.sqrt(square_sums(queries))) if metric is Metric.COSINE else None
        columns = np.ascontiguousarray(rows.T)
        for lo in range(0, len(rows), 2048):
            for q in range(0, len(queries), 32):
                c, b = columns[:, lo : lo + 2048], queries[q : q + 32]
                s, t = np.zeros((len(b), c.shape[1]), dtype=np.float32), np.empty((len(b), c.shape[1]), dtype=np.float32)
                for j in range(len(c)):
                    if euclid:
                        np.subtract(c[j][None, :], b[:, j][:, None], out=t)
                        np.multiply(t, t, out=t)
                    else:
                        np.multiply(c[j][None, :], b[:, j][:, None], out=t)
                    s += t
                if metric is Metric.L2:
                    s = np.sqrt(s)
                elif metric is Metric.INNER_PRODUCT:
                    s = -s + np.float32(0)
                elif metric is Metric.COSINE:
                    den = norms[0][lo : lo + 2048][None, :] * norms[1][q : q + 32][:, None]
                    s = np.where(den == 0, np.float32(1), np.float32(1) - s / np.where(den == 0, np.float32(1), den))
                out[q : q + 32, lo : lo + 2048] = s
    return out


class Nearest:
    """The k best (distance, id) of each of n queries; NaN comes after everything."""

    def __init__(self, n: int, k: int):
        self.k, self.best = k, [[] for _ in range(n)]
        self.worst = np.full(n, np.inf)

    def add(self, distances: np.ndarray, ids: list[str]) -> None:
        keys = np.nan_to_num(distances.astype(np.float64), copy=False, nan=1e301, posinf=1e300, neginf=-1e300)
        for i, row in enumerate(keys):
            at = np.flatnonzero(row <= self.worst[i])
            if len(at) > 4 * self.k:
                at = at[row[at] <= np.partition(row[at], self.k - 1)[self.k - 1]]
            if len(at):
                self.best[i] = sorted([*self.best[i], *((row[j], ids[j]) for j in at)])[: self.k]
                if len(self.best[i]) == self.k:
                    self.worst[i] = self.best[i][-1][0]


def collection_knn(points: DataFrame, configs: DataFrame, k: int, asks: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact neighbours within the collection of each point for which asks holds: collection, qid, id, distance, rank.

    The asking points are a stated set; they meet their collection's points in blocks of at most about block_bytes of vectors, broadcast. A
    partition keeps the k best rows of each query, so that only these are shuffled. Distances are those of the Column builders.
    """
    if k < 1:
        raise InvalidArgument(f"k must be at least 1, got {k}")
    u = stage(usable_points(points, configs), "usable")
    q = u.where(asks).select("collection", "metric", F.col("id").alias("qid"), F.size("vector").alias("dim"), "vector")
    return _nearest(u.select("collection", "id", "vector"), q, k, block_bytes)


def _nearest(points: DataFrame, queries: DataFrame, k: int, block_bytes: int) -> DataFrame:
    """points: collection, id, vector; queries: collection, metric, qid, dim, vector. Only a block of queries is on the driver at a time."""
    spark, kind = points.sparkSession, queries.schema["qid"].dataType.simpleString()
    pid = points.schema["id"].dataType.simpleString()
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[pid]
    total = queries.agg(F.sum(F.col("dim") * 4 + 64).alias("bytes")).first()["bytes"] or 0
    parts = max(1, -(-total // block_bytes))
    w = Window.partitionBy("collection", "qid").orderBy(F.col("distance").asc_nulls_last(), "id")
    out = None
    for i in range(parts):
        block = queries.where(F.pmod(F.xxhash64("collection", "qid"), F.lit(parts)) == i).toArrow().combine_chunks()
        asking = {}
        for g in block.group_by(["collection", "metric", "dim"]).aggregate([]).to_pylist():
            c, m, d = g["collection"], g["metric"], g["dim"]
            mine = block.filter(pc.and_(pc.and_(pc.equal(block.column("collection"), c), pc.equal(block.column("metric"), m)), pc.equal(block.column("dim"), d)))
            asking[c, m, d] = (mine.column("qid").combine_chunks(), mine.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        shared = spark.sparkContext.broadcast(asking)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[str, str, int], Nearest] = {}
            for b in batches:
                names = b.column(0).to_numpy(zero_copy_only=False)
                for key, (qids, qs) in shared.value.items():
                    part = b.filter(pc.and_(pa.array(names == key[0]), pc.fill_null(pc.equal(pc.list_value_length(b.column(2)), key[2]), False)))
                    if part.num_rows:
                        rows = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, key[2])
                        found.setdefault(key, Nearest(len(qids), k)).add(pairwise(rows, qs, key[1]), part.column(1).to_pylist())
            for key, n in found.items():
                hits = [(j, x, d) for j, best in enumerate(n.best) for d, x in best]
                d = np.array([h[2] for h in hits])
                d = np.select([d == 1e301, d == 1e300, d == -1e300], [np.nan, np.inf, -np.inf], d).astype(np.float32)
                qids = shared.value[key][0].take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hits), pa.string()), qids, pa.array([h[1] for h in hits], kinds), pa.array(d)], names=["collection", "qid", "id", "distance"])

        hits = points.mapInArrow(run, f"collection string, qid {kind}, id {pid}, distance float")
        best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out

