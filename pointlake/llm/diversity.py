"""Choosing a varied subset by tournament-pivoted, rank-revealing QR.

A row's features are its vector and, if a payload field shall vary too, indicators of its values, one feature for each different
value. They are held sparse, numbered anew in each set of rows that is pivoted: only whether two rows' values are equal
matters, so no dictionary of the whole field is needed. Pivoted QR takes, again and again, the row with the greatest part
outside the span of those taken: rows similar to a taken one have little left, however many they are. In a tournament every batch and partition nominates its pivots, and nominees meet
in a tree, FAN at a time, where they are pivoted anew. One round of pivots gives at most as many rows as there are independent
features; the next runs on deflated rows, each scaled by its distance to what has been taken. Every batch, partition and meeting goes on with
rounds until it has as many nominees as are wanted, so that one pass over the points gives up to MOST_PIVOTS picks.

`cover` tells of each point which pick stands for it and how far it is: what a subset leaves out.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm.ivfpq import flat
from pointlake.llm.vectors import Shape, matrix, shapes, usable
from pointlake.session import stage

VALUE_WEIGHT = 0.5  # length of a row's value indicators, against that of its vector
FAN = 8
MOST_PIVOTS = 2048  # picks of one pass; more take several passes
MOST_ROWS = 8192  # rows pivoted at once
PICK_BYTES = 32 << 20  # of the vectors of picks that are broadcast at once, about
MAX_REQUESTS = 10_000
EPS = 1e-6

_NOMINEE = "request int, bucket int, id string, vec binary, carry array<array<string>>"


@dataclass(frozen=True)
class Request:
    collection: str
    size: int
    key: int  # place of the payload field in carry, -1 for none


@dataclass
class Indicators:
    """Sparse features of rows: entries (row, code, amount), sorted by row; every different value has its own code."""

    row: np.ndarray
    code: np.ndarray
    amount: np.ndarray
    codes: int

    def sq(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, self.amount**2, rows)

    def dot(self, i: int, rows: int) -> np.ndarray:
        """Inner products of all rows with row i."""
        lo, hi = np.searchsorted(self.row, [i, i + 1])
        if lo == hi:
            return np.zeros(rows)
        mine = np.zeros(self.codes)
        mine[self.code[lo:hi]] = self.amount[lo:hi]
        return np.bincount(self.row, self.amount * mine[self.code], rows)

    def scaled(self, by: np.ndarray) -> Indicators:
        return Indicators(self.row, self.code, self.amount * by[self.row], self.codes)


def indicators(values: list[list[str] | None], scale: float) -> Indicators:
    """Of length `scale` for each row that has values."""
    known: dict[str, int] = {}
    entries = [(i, c, n) for i, names in enumerate(values) for c, n in Counter(known.setdefault(name, len(known)) for name in names or ()).items()]
    row, code, n = (np.array([e[k] for e in entries], dtype=t) for k, t in enumerate((np.int64, np.int64, np.float64)))
    length = np.sqrt(np.bincount(row, n**2, len(values)))
    return Indicators(row, code, scale * n / length[row], len(known))


def features(x: np.ndarray, metric: str, values: list[list[str] | None] | None) -> tuple[np.ndarray, Indicators | None]:
    """Vectors (of unit length, but for Euclidean metrics, where all are scaled by one constant) and value indicators."""
    x = x.astype(np.float64)
    if metric in ("cosine", "innerProduct"):
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    if values is None:
        return x, None
    return x, indicators(values, VALUE_WEIGHT * (1.0 if metric in ("cosine", "innerProduct") else float(np.sqrt((x * x).sum(1).mean())) if len(x) else 1.0))


def nearness(x: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """What rows are deflated by: the distance of their vector to the nearest taken one, relative to both lengths."""
    if not len(taken):
        return np.ones(len(x))
    sq = (x * x).sum(1)[:, None] + (taken * taken).sum(1)[None, :]
    near = np.maximum(sq - 2 * (x @ taken.T), 0) / np.maximum(sq, 1e-30)
    return np.sqrt(near.min(axis=1))


def pivots(a: np.ndarray, ids: np.ndarray, most: int, values: Indicators | None = None) -> list[int]:
    """Rows in the order that pivoted QR takes them: at most `most`, as far as the rank goes; of equal rests the smallest id.

    It is done on inner products (a pivoted Cholesky decomposition of them takes the same rows), to which values add theirs.
    """
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    a = a[order]
    if values is not None:
        by_row = np.argsort(place[values.row], kind="stable")
        values = Indicators(place[values.row][by_row], values.code[by_row], values.amount[by_row], values.codes)
    rest = (a * a).sum(1) + (0 if values is None else values.sq(len(a)))
    if not len(a) or rest.max() <= 0:
        return []
    steps = min(most, len(a), a.shape[1] + (0 if values is None else values.codes))
    least, q, out = EPS * rest.max(), np.empty((steps, len(a))), []
    while len(out) < steps:
        i = int(rest.argmax())
        if rest[i] <= least:
            break
        k = len(out)
        v = a @ a[i] + (0 if values is None else values.dot(i, len(a))) - q[:k, i] @ q[:k]
        if v[i] <= least:
            rest[i] = 0
            continue
        q[k] = v / np.sqrt(v[i])
        rest -= q[k] ** 2
        out.append(i)
        rest[out] = -1
    return [int(order[i]) for i in out]


def rounds(x: np.ndarray, ids: np.ndarray, most: int, values: Indicators | None, taken: np.ndarray) -> list[int]:
    """Rows in the order of choice, at most `most`: pivots of rows deflated by what is taken, round after round. Rows equal to what is
    taken are never chosen."""
    out: list[int] = []
    by, free = nearness(x, taken), np.ones(len(x), dtype=bool)
    while len(out) < most:
        scale = np.where(free, by, 0)
        best = pivots(x * scale[:, None], ids, most - len(out), values and values.scaled(scale))
        if not best:
            break
        out += best
        free[best] = False
        by = np.minimum(by, nearness(x, x[best]))
    return out


class _Pool:
    """Nominees of one request."""

    def __init__(self, request: Request, shape: Shape, taken: list[tuple[str, bytes, list | None]], most: int):
        self.request, self.shape, self.most = request, shape, min(most, MOST_PIVOTS)
        self.gone = {t[0] for t in taken}
        self.taken = self._features([t[1] for t in taken], [t[2] for t in taken])[0]
        self.rows: list[tuple[str, bytes, list | None]] = []

    def _features(self, vecs: list[bytes], carry: list) -> tuple[np.ndarray, Indicators | None]:
        x = np.frombuffer(b"".join(vecs), dtype="<f4").reshape(-1, self.shape.dim)
        k = self.request.key
        return features(x, self.shape.metric, None if k < 0 else [c[k] if c is not None else None for c in carry])

    def add(self, rows: list[tuple[str, bytes, list | None]]) -> None:
        rows = [r for r in rows if r[0] not in self.gone]
        for lo in range(0, len(rows), MOST_ROWS):
            self.rows += rows[lo : lo + MOST_ROWS]
            if len(self.rows) > max(self.most, MOST_ROWS):
                self.choose()

    def choose(self) -> None:
        x, values = self._features([r[1] for r in self.rows], [r[2] for r in self.rows])
        self.rows = [self.rows[i] for i in rounds(x, np.array([r[0] for r in self.rows], dtype=object), self.most, values, self.taken)]


def _round(p: DataFrame, requests: dict[int, Request], known: dict[str, Shape], taken: dict[int, list]) -> list:
    """The nominees that win one tournament, in the order of choice."""
    spark = p.sparkSession
    open_ = {r: q for r, q in requests.items() if len(taken[r]) < q.size}
    shared = spark.sparkContext.broadcast({r: taken[r] for r in open_})

    def pool(r: int) -> _Pool:
        return _Pool(open_[r], known[open_[r].collection], shared.value[r], open_[r].size - len(shared.value[r]))

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pools: dict[int, _Pool] = {}
        for b in batches:
            coll = np.array(b.column(0).to_pylist(), dtype=object)
            for r, q in open_.items():
                at = np.flatnonzero(coll == q.collection)
                if len(at):
                    part = b.take(pa.array(at))
                    pools.setdefault(r, pool(r)).add(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())))
        for r, x in pools.items():
            x.choose()
            if x.rows:
                yield pa.RecordBatch.from_arrays([pa.array([r] * len(x.rows), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(x.rows), pa.int32()), pa.array([t[0] for t in x.rows]), pa.array([t[1] for t in x.rows], pa.binary()), pa.array([t[2] for t in x.rows], pa.list_(pa.list_(pa.string())))], names=["request", "bucket", "id", "vec", "carry"])

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pool(key[0])
        x.add([(i, v, None if c is None else [None if y is None else list(y) for y in c]) for i, v, c in zip(pdf.id, pdf.vec, pdf.carry)])
        x.choose()
        return pd.DataFrame({"request": pd.Series([key[0]] * len(x.rows), dtype="int32"), "bucket": pd.Series([key[1]] * len(x.rows), dtype="int32"), "id": [t[0] for t in x.rows], "vec": [t[1] for t in x.rows], "carry": [t[2] for t in x.rows]})

    source = p.select("collection", "id", "vec", "carry")
    buckets = source.rdd.getNumPartitions()
    n = source.mapInArrow(nominate, _NOMINEE)
    while True:
        n = n.withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("int")).groupBy("request", "bucket").applyInPandas(meet, _NOMINEE)
        buckets = -(-buckets // FAN)
        if buckets <= 1:
            break
    return n.collect()


def varied(points: DataFrame, configs: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, collection, id, pick: for each request its subset_size points of the collection, in the order of choice.

    Defined cases: a point loaded again is one point; where a collection has fewer usable points than asked for, its points without
    a usable vector follow, in the order of their ids, and one that holds fewer points gives all; identical points are taken
    only when nothing else is left; a NULL or unknown payload field isn't varied; requests for nothing, or for unknown
    collections, and repeated request ids beyond the first give nothing.
    """
    spark = points.sparkSession
    known = shapes(configs)
    asked = requests.where("request_id is not null and collection is not null and subset_size > 0").groupBy("request_id").agg(F.min(F.struct("collection", "subset_size", "payload_key")).alias("m")).limit(MAX_REQUESTS + 1).collect()
    if len(asked) > MAX_REQUESTS:
        raise ValueError(f"more than {MAX_REQUESTS} requests")
    keys = sorted({r["m"]["payload_key"] for r in asked if r["m"]["payload_key"]})
    todo = {r["request_id"]: Request(r["m"]["collection"], r["m"]["subset_size"], keys.index(r["m"]["payload_key"]) if r["m"]["payload_key"] else -1) for r in asked if r["m"]["collection"] in known}
    mine = points.where(F.col("collection").isin(sorted({q.collection for q in todo.values()})))
    p = usable(mine, known, F.array(*[_values(F.col("payload")[k]) for k in keys]) if keys else F.array().cast("array<array<string>>"), "array<array<string>>")

    taken: dict[int, list] = {r: [] for r in todo}
    while True:
        won = _round(p, todo, known, taken) if any(len(taken[r]) < q.size for r, q in todo.items()) else []
        if not won:
            break
        for w in won:
            taken[w["request"]].append((w["id"], bytes(w["vec"]), w["carry"]))
    chosen = spark.createDataFrame([(r, todo[r].collection, t[0], i + 1) for r, rows in taken.items() for i, t in enumerate(rows)], "request_id int, collection string, id string, pick int")

    short = {r: q for r, q in todo.items() if len(taken[r]) < q.size}
    if not short:
        return chosen
    # rows left are copies of taken ones or have no usable vector
    need = spark.createDataFrame([(r, q.collection, len(taken[r]), q.size - len(taken[r])) for r, q in short.items()], "request_id int, collection string, have int, need int")
    rest = mine.where("id is not null").select("collection", "id").distinct().join(p.select("collection", "id", F.lit(0).alias("later")), ["collection", "id"], "left")
    rest = rest.join(F.broadcast(need), "collection").join(F.broadcast(chosen.select("request_id", "id")), ["request_id", "id"], "left_anti")
    rest = rest.withColumn("i", F.row_number().over(Window.partitionBy("request_id").orderBy(F.coalesce("later", F.lit(1)), "id"))).where(F.col("i") <= F.col("need"))
    return chosen.unionByName(rest.select("request_id", "collection", "id", (F.col("have") + F.col("i")).cast("int").alias("pick")))


def cover(points: DataFrame, configs: DataFrame, picks: DataFrame) -> DataFrame:
    """request_id, collection, id, pick_id, distance: of each usable point the nearest pick of each request of its collection.

    picks: request_id, collection, id, as varied() gives them. Defined cases: of picks at an equal distance (to nine places) the smallest id
    stands; picks without a usable vector cover nothing; a request without usable picks gives no rows; points loaded again are one.
    """
    known = shapes(configs)
    p = usable(points, known)
    chosen = stage(picks.select("request_id", "collection", "id").distinct().join(p.select("collection", "id", "vec"), ["collection", "id"]), "picks")
    total = chosen.agg(F.sum(F.length("vec") + 64).alias("bytes")).first()["bytes"] or 0
    parts, kind, out = max(1, -(-total // PICK_BYTES)), picks.schema["request_id"].dataType.simpleString(), None
    for i in range(parts):
        by: dict[tuple, list] = {}
        for r in chosen.where(F.pmod(F.xxhash64("collection", "id"), F.lit(parts)) == i).collect():
            by.setdefault((r["collection"], r["request_id"]), []).append((r["id"], bytes(r["vec"])))
        shared = p.sparkSession.sparkContext.broadcast({k: ([x[0] for x in sorted(v)], np.frombuffer(b"".join(x[1] for x in sorted(v)), dtype="<f4").reshape(-1, known[k[0]].dim)) for k, v in by.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                coll = np.array(b.column(0).to_pylist(), dtype=object)
                for (c, request), (ids, q) in shared.value.items():
                    at = np.flatnonzero(coll == c)
                    for lo in range(0, len(at), 4096):
                        t = pa.array(at[lo : lo + 4096])
                        d = np.round(flat(known[c].metric, matrix(b.column(2).take(t), known[c].dim), q), 9)
                        best = d.argmin(1)  # the first: the smallest id
                        yield pa.RecordBatch.from_arrays([pa.array([request] * len(t)).cast(request_type), b.column(0).take(t), b.column(1).take(t), pa.array([ids[j] for j in best]), pa.array(d[np.arange(len(t)), best] + 0.0)], names=["request_id", "collection", "id", "pick_id", "distance"])

        request_type = pa.int64() if kind == "bigint" else pa.int32()
        hit = p.select("collection", "id", "vec").mapInArrow(run, f"request_id {kind}, collection string, id string, pick_id string, distance double")
        out = hit if out is None else out.unionByName(hit)
    if parts == 1:
        return out
    return out.groupBy("request_id", "collection", "id").agg(F.min(F.struct("distance", "pick_id")).alias("m")).select("request_id", "collection", "id", "m.pick_id", "m.distance")


def covered(points: DataFrame, configs: DataFrame, picks: DataFrame) -> DataFrame:
    """request_id, collection, pick_id, members, radius (of the farthest), mean (distance): what each usable pick stands for."""
    c = cover(points, configs, picks)
    return c.groupBy("request_id", "collection", "pick_id").agg(F.count(F.lit(1)).alias("members"), F.max("distance").alias("radius"), F.avg("distance").alias("mean"))


def _values(at: Column) -> Column:
    """The values of a payload field as tagged strings; missing fields and nulls have none."""
    one = F.coalesce(at["b"].cast("string"), at["i"].cast("string"), at["d"].cast("string"), at["s"])
    return F.when(at["kind"] == "strings", F.array_compact(at["ss"])).when(one.isNotNull(), F.array(F.concat(at["kind"], F.lit(":"), one)))
