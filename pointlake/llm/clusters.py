"""Grouping records into similarity clusters with Gaussian mixtures.

Vectors become standardised principal components, per collection. Coarse mixtures, fitted by distributed rounds of
expectation-maximisation over all rows (each partition gives sums of statistics), divide collections into leaves of at most
LEAF_ROWS rows; within a leaf a finer mixture is fitted, its number of components chosen by the information criterion.
Components are described by their size and their members of highest density. A group may be fitted in several leaves, or in several
pieces of a leaf: parts whose centres are within reach of each other are one component before it is described.

`isolated` then makes exact clusters: the densest members, and all density peaks, are asked against all rows of their collection, in
blocks, and what they find must be mutually near and near to nothing else. What a leaf shows not to be so isn't asked.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm import gmm as G
from pointlake.llm.vectors import Shape, by_collection, copies, matrix, shapes, usable
from pointlake.session import small, stage

VARIANCE, MAX_FEATURES = 0.8, 48
LEAF_ROWS = 6144  # most rows a local fit gets
WANTED_ROWS = 1024  # rows of a leaf, about
MAX_COMPONENTS = 256  # of one coarse mixture
COARSE_ROUNDS, MAX_LEVELS = 3, 6
FAN = 32  # partial sums added by one task
LEAST = 3.0  # weight that a density peak needs within reach
QUERY_BLOCK = 32_768  # representatives asked at once
CHUNK = 8192  # members compared with as many others by one task
SLABS = 4  # parts that one feature divides a leaf into


def metric_rows(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows in a space where the squared Euclidean distance tells what is near: unit length under cosine."""
    return x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-30).astype(np.float32) if metric == "cosine" else x


def metric_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of a to b as stored, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric == "innerProduct":
        return -(a @ b.T)
    if metric == "cosine":
        return 1 - (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    s = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)
    return np.sqrt(s) if metric == "l2" else s


def squared_reach(within: float, metric: str) -> float:
    """The squared Euclidean distance that a greatest metric distance stands for (inner products: of unit vectors)."""
    return {"l2": within**2, "l2Squared": within, "cosine": 2 * within, "innerProduct": 2 * (1 + within)}[metric]


@dataclass
class Node:
    """A coarse mixture's place in the tree of one collection; children by component, absent where a component is a leaf."""

    mixture: G.Mixture | None
    children: dict[int, "Node"]


@dataclass
class Tree:
    shape: Shape
    reduction: G.Reduction
    root: Node

    def features(self, x: np.ndarray) -> np.ndarray:
        return self.reduction.apply(metric_rows(x, self.shape.metric))

    def leaves(self, z: np.ndarray) -> np.ndarray:
        """The path of components of each row, as text."""
        out = np.full(len(z), "", dtype=object)
        todo = [(self.root, np.arange(len(z)))]
        while todo:
            node, at = todo.pop()
            if node.mixture is None or not len(at):
                continue
            k = node.mixture.log_joint(z[at]).argmax(1)
            for c in np.unique(k):
                rows = at[k == c]
                out[rows] = [p + f".{c}" for p in out[rows]]
                if c in node.children:
                    todo.append((node.children[c], rows))
        return out


def _summed(df: DataFrame, per_batch: object) -> dict[str, np.ndarray]:
    """Sums of the arrays that per_batch(collection, rows) yields as (key, array): a partition adds up what it has, then a key's
    partial sums are added in a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for c, part in by_collection(b):
                for key, a in per_batch(c, part):
                    sums[key] = sums[key] + a if key in sums else a
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([TaskContext.get().partitionId()] * len(sums), pa.int32()), pa.array([a.astype("<f8").tobytes() for a in sums.values()], pa.binary())], names=["key", "bucket", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf.sums.iloc[0], dtype="<f8").copy()
        for s in pdf.sums.iloc[1:]:
            total += np.frombuffer(s, dtype="<f8")
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "bucket": pdf.bucket.iloc[:1].to_numpy(), "sums": [total.tobytes()]})

    rows = df.mapInArrow(run, "key string, bucket int, sums binary")
    buckets = df.rdd.getNumPartitions()
    while True:  # a tree: FAN partitions' sums at a time
        buckets = -(-buckets // FAN)
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("int")).groupBy("key", "bucket").applyInPandas(add, "key string, bucket int, sums binary")
        if buckets <= 1:
            break
    return {r["key"]: np.frombuffer(r["sums"], dtype="<f8") for r in rows.collect()}


@dataclass
class Cut:
    """Divides a leaf in which mixtures find nothing to divide, along its widest features, so that what is near stays together."""

    features: np.ndarray
    edges: list[np.ndarray]

    @classmethod
    def of(cls, mean: np.ndarray, var: np.ndarray, pieces: int) -> "Cut":
        """About `pieces` parts at the quantiles of a component's normal density, at most SLABS by one feature while features last."""
        features, edges, left = [], [], pieces
        for j in np.argsort(-var, kind="stable"):
            if left <= 1:
                break
            last = len(features) == len(var) - 1
            n = left if last else min(SLABS, left)
            features.append(int(j))
            edges.append(mean[j] + np.sqrt(var[j]) * np.array([NormalDist().inv_cdf(i / n) for i in range(1, n)]))
            left = -(-left // n)
        return cls(np.array(features, dtype=np.int64), edges)

    def __call__(self, z: np.ndarray) -> np.ndarray:
        out = np.zeros(len(z), dtype=np.int64)
        for j, e in zip(self.features, self.edges):
            out = out * (len(e) + 1) + np.searchsorted(e, z[:, j])
        return out


def plant(reps: DataFrame, known: dict[str, Shape], within: dict[str, float]) -> tuple[dict[str, Tree], dict[tuple[str, str], Cut]]:
    """The trees of coarse mixtures, and how leaves are to be cut that are still too large.

    Only sums of statistics, one array a node, come to the driver. A node is divided while it has more than LEAF_ROWS rows and is
    not dense all over: a component no wider than the reach holds one group of near rows, which may be cut anywhere.
    """
    rows = reps.select("collection", "vec", "h1")

    def moments(c: str, part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        x = metric_rows(matrix(part.column(1), known[c].dim), known[c].metric).astype(np.float64)
        yield c, np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    trees, large, pieces = {}, {}, {}
    for c, s in _summed(rows, moments).items():
        d = known[c].dim
        trees[c] = Tree(known[c], G.reduction(s[0], s[1 : d + 1], s[d + 1 :].reshape(d, d), VARIANCE, MAX_FEATURES), Node(None, {}))
        if s[0] > WANTED_ROWS:
            large[c, ""] = float(s[0])
    spark = reps.sparkSession
    for level in range(MAX_LEVELS):
        if not large:
            break
        wanted = {key: int(min(MAX_COMPONENTS, max(2, -(-n // WANTED_ROWS)))) for key, n in large.items()}
        shared = spark.sparkContext.broadcast(trees)
        involved = rows.where(F.col("collection").isin(sorted({c for c, _ in large})))

        # start from rows with the smallest hashes: about eight a component
        odds = {key: min(1.0, 8 * wanted[key] / n) for key, n in large.items()}
        some = involved.where((F.col("h1").bitwiseAND((1 << 30) - 1)) < int(max(odds.values()) * (1 << 30)))

        def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c, part in by_collection(b):
                    u = (part.column(2).to_numpy() & ((1 << 30) - 1)) / (1 << 30)
                    z = shared.value[c].features(matrix(part.column(1), known[c].dim))
                    path = shared.value[c].leaves(z)
                    ok = [i for i in range(len(z)) if u[i] < odds.get((c, path[i]), 0)]
                    if ok:
                        yield pa.RecordBatch.from_arrays([pa.array([c] * len(ok)), pa.array([path[i] for i in ok]), pa.array([z[i].astype("<f4").tobytes() for i in ok], pa.binary())], names=["collection", "path", "z"])

        seeds: dict[tuple[str, str], list[np.ndarray]] = {}
        for r in some.mapInArrow(starts, "collection string, path string, z binary").collect():
            seeds.setdefault((r["collection"], r["path"]), []).append(np.frombuffer(r["z"], dtype="<f4"))
        mixtures: dict[tuple[str, str], dict[int, G.Mixture]] = {}
        for key, z in seeds.items():
            z = np.unique(np.array(z, dtype=np.float64), axis=0)
            z = z[np.random.default_rng(7).permutation(len(z))]
            for k in {wanted[key], max(2, wanted[key] // 2)}:
                k = min(k, len(z))
                mixtures.setdefault(key, {})[k] = G.Mixture(np.full(k, 1 / k), z[:k].copy(), np.ones((k, z.shape[1])))
        for _ in range(COARSE_ROUNDS):
            now = spark.sparkContext.broadcast(mixtures)

            def step(c: str, part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
                z = shared.value[c].features(matrix(part.column(1), known[c].dim))
                path = shared.value[c].leaves(z)
                for (coll, p), ms in now.value.items():
                    if coll == c and (at := path == p).any():
                        for k, m in ms.items():
                            yield f"{c}\n{p}\n{k}", G.statistics(m, z[at], np.ones(int(at.sum())))

            mixtures, likelihood, counts = {}, {}, {}
            for key, s in _summed(involved, step).items():
                c, p, k = key.split("\n")
                mixtures.setdefault((c, p), {})[int(k)], likelihood[c, p, int(k)] = G.maximised(s, int(k))
                counts[c, p, int(k)] = s[: int(k)]
        next_large = {}
        for (c, p), ms in mixtures.items():
            best = min(ms, key=lambda k: G.bic(likelihood[c, p, k], ms[k], large[c, p]))
            node = trees[c].root
            for k in p.split(".")[1:]:
                node = node.children.setdefault(int(k), Node(None, {}))
            node.mixture = ms[best]
            reach = trees[c].reduction.spread(squared_reach(within[known[c].metric], known[c].metric))
            for k, n in enumerate(counts[c, p, best]):
                if n > 0.8 * LEAF_ROWS:
                    dense = ms[best].var[k].sum() <= 0.75 * reach + G.FLOOR * ms[best].var.shape[1]
                    if dense or level == MAX_LEVELS - 1 or n > 0.8 * large[c, p]:
                        pieces[c, f"{p}.{k}"] = Cut.of(ms[best].mean[k], ms[best].var[k], int(-(-n // (LEAF_ROWS / 2))))
                    else:
                        next_large[c, f"{p}.{k}"] = float(n)
        large = next_large
    return trees, pieces


_PART = "collection string, leaf string, component int, id string, n long, dense double, z binary, size long, kind string, centre binary, middle binary"


@dataclass
class Leaf:
    """What a local fit found: its rows in the order of their ids, the component of each and its log density there."""

    collection: str
    name: str
    shape: Shape
    ids: np.ndarray
    n: np.ndarray
    vecs: np.ndarray
    z: np.ndarray
    mixture: G.Mixture
    at: np.ndarray
    dense: np.ndarray
    peaks: np.ndarray

    def members(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each component that has rows, with these, densest first. The last component of a leaf is its background."""
        for k in range(len(self.mixture.weight)):
            rows = np.flatnonzero(self.at == k)
            if len(rows):
                yield k, rows[np.argsort(-self.dense[rows], kind="stable")]


def fitted(reps: DataFrame, known: dict[str, Shape], within: dict[str, float], tell: Callable[[Leaf], pd.DataFrame], schema: str) -> DataFrame:
    """What tell says of each leaf. reps: collection, id, n, vec, h1.

    Leaves larger than LEAF_ROWS, in which mixtures find nothing to divide, are cut along their widest features: their names end
    with the piece.
    """
    trees, pieces = plant(reps, known, within)
    shared = reps.sparkSession.sparkContext.broadcast((trees, pieces))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, pieces = shared.value
        for b in batches:
            for c, part in by_collection(b):
                t = trees[c]
                z = t.features(matrix(part.column(2), known[c].dim))
                path = t.leaves(z)
                piece = np.zeros(len(z), dtype=np.int64)
                for p in set(path):
                    if (c, p) in pieces:
                        piece[path == p] = pieces[c, p](z[path == p])
                leaf = [f"{p}/{i}" for p, i in zip(path, piece)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(leaf, pa.string()), part.column(1), part.column(2), part.column(3)], names=["collection", "leaf", "id", "vec", "n"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = key[0]
        t = shared.value[0][c]
        pdf = pdf.sort_values("id")
        n = pdf.n.to_numpy(dtype=np.float64)
        z = t.features(np.frombuffer(b"".join(pdf.vec), dtype="<f4").reshape(-1, t.shape.dim))
        m, at, dense, peaks = G.fit_local(z, n, t.reduction.spread(squared_reach(within[t.shape.metric], t.shape.metric)), LEAST)
        return tell(Leaf(c, key[1], t.shape, pdf.id.to_numpy(), n, pdf.vec.to_numpy(), z, m, at, dense, peaks))

    sent = reps.select("collection", "id", "vec", "n", "h1").mapInArrow(send, "collection string, leaf string, id string, vec binary, n long")
    return sent.groupBy("collection", "leaf").applyInPandas(fit, schema)


def candidates(reps: DataFrame, known: dict[str, Shape], within: dict[str, float]) -> DataFrame:
    """collection, id, vec of each component's densest member and of each density peak, whether or not the criterion kept it; but not of
    those whose rows within reach are seen, in the leaf alone, to be in no cluster by themselves: a row of the leaf is within reach of
    one of them and not of the candidate."""
    def tell(f: Leaf) -> pd.DataFrame:
        at = np.array(sorted({int(top[0]) for _, top in f.members()} | {int(i) for i in f.peaks}), dtype=np.int64)
        x = np.frombuffer(b"".join(f.vecs), dtype="<f4").reshape(-1, f.shape.dim)
        limit, keep = within[f.shape.metric], np.ones(len(at), dtype=bool)
        for lo in range(0, len(at), 512):
            near = metric_distances(x[at[lo : lo + 512]], x, f.shape.metric) <= limit
            for i, mine in enumerate(near):
                rows = np.flatnonzero(mine)
                for b in range(0, len(rows), 1024):
                    if keep[lo + i]:
                        keep[lo + i] = not ((metric_distances(x[rows[b : b + 1024]], x, f.shape.metric) <= limit) != mine[None, :]).any()
        at = at[keep]
        return pd.DataFrame({"collection": [f.collection] * len(at), "id": f.ids[at], "vec": f.vecs[at]})

    return fitted(reps, known, within, tell, "collection string, id string, vec binary")


def parts(reps: DataFrame, known: dict[str, Shape], within: dict[str, float]) -> DataFrame:
    """Each row of reps with its component and its features; a component's densest row also tells its size, kind and centre.

    kind says with what a component may be put together: "near" if most of it is within reach of its centre; else it is wide, or the
    rest of its leaf, and belongs to the pieces of that leaf only. centre is a vector of the collection, middle one of features.
    """
    def tell(f: Leaf) -> pd.DataFrame:
        out = []
        for k, top in f.members():
            w, x = f.n[top], np.frombuffer(b"".join(f.vecs[top]), dtype="<f4").reshape(-1, f.shape.dim)
            rows = metric_rows(x, f.shape.metric).astype(np.float64)
            centre = (w @ rows) / w.sum()
            length = np.linalg.norm(centre)
            if f.shape.metric == "innerProduct":  # as long as its rows are
                centre *= (w @ np.linalg.norm(rows, axis=1)) / w.sum() / max(length, 1e-30)
            near = length > 0 and w[metric_distances(x, centre[None], f.shape.metric)[:, 0] <= within[f.shape.metric]].sum() >= 0.5 * w.sum()
            kind = "near" if near else f"{f.name.rpartition('/')[0]}:{'rest' if k == len(f.mixture.weight) - 1 else 'wide'}"
            about = (int(w.sum()), kind, centre.astype("<f4").tobytes(), ((w @ f.z[top]) / w.sum()).astype("<f4").tobytes())
            out += [(f.collection, f.name, k, f.ids[i], int(f.n[i]), float(f.dense[i]), f.z[i].astype("<f4").tobytes(), *(about if i == top[0] else (None,) * 4)) for i in top]
        return pd.DataFrame(out, columns=["collection", "leaf", "component", "id", "n", "dense", "z", "size", "kind", "centre", "middle"]).astype({"size": "Int64"})

    return fitted(reps, known, within, tell, _PART)


def leaders(edges: DataFrame) -> DataFrame:
    """collection, part, leader: what each part that isn't one of the leaders goes to.

    edges: collection, part, size, before: a pair within reach, of which `before`, of this size, goes first. What nothing undecided
    precedes leads, and takes what it reaches; so chains of parts don't run together.
    """
    out = None
    while True:
        edges = stage(edges, "edges")
        if edges.isEmpty():
            return edges.select("collection", "part", F.col("before").alias("leader")) if out is None else out
        lead = edges.select("collection", "before").distinct().join(edges.select("collection", F.col("part").alias("before")).distinct(), ["collection", "before"], "left_anti")
        won = stage(edges.join(lead, ["collection", "before"], "left_semi").groupBy("collection", "part").agg(F.max_by("before", F.struct("size", "before")).alias("leader")), "won")
        out = won if out is None else out.unionByName(won)
        gone = won.select("collection", "part")
        edges = edges.join(gone, ["collection", "part"], "left_anti").join(gone.withColumnRenamed("part", "before"), ["collection", "before"], "left_anti")


def together(told: DataFrame, known: dict[str, Shape], within: dict[str, float]) -> DataFrame:
    """collection, part, leader, middle: the parts that are put together, each with the centre of the whole.

    told: collection, part, size, kind, centre, middle. Pieces of a leaf share its rest; of the others, those of one kind whose centres
    are within reach of each other are one component.
    """
    rest = told.where(F.col("kind").endswith(":rest"))
    rest = rest.join(rest.groupBy("collection", "kind").agg(F.min("part").alias("leader")), ["collection", "kind"]).where("part <> leader").select("collection", "part", "leader")
    others = told.where(~F.col("kind").endswith(":rest")).select("collection", F.col("part").alias("id"), F.col("size").alias("n"), "kind", F.col("centre").alias("vec"))
    about = others.select("collection", F.col("id").alias("part"), F.col("n").alias("own"), F.col("kind").alias("mine"))
    met = None
    for block in blocks(others):
        h = hits(others, block, known, within).select("collection", F.col("rid").alias("part"), F.col("id").alias("before"), F.col("n").alias("size")).where("part <> before")
        met = h if met is None else met.unionByName(stage(h, "near"))
    kinds = others.select("collection", F.col("id").alias("before"), "kind")
    met = met.join(about, ["collection", "part"]).join(kinds, ["collection", "before"]).where("kind = mine and (size > own or size = own and before > part)")
    joined = stage(rest.unionByName(leaders(met.select("collection", "part", "size", "before"))), "joined")
    joined = joined.unionByName(joined.select("collection", F.col("leader").alias("part"), "leader").distinct())

    def middle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.array([np.frombuffer(b, dtype="<f4") for b in pdf.middle], dtype=np.float64)
        return pd.DataFrame({"collection": [key[0]], "leader": [key[1]], "middle": [np.average(z, axis=0, weights=pdf["size"]).astype("<f4").tobytes()]})

    whole = joined.join(told.select("collection", "part", "size", "middle"), ["collection", "part"])
    return joined.join(whole.groupBy("collection", "leader").applyInPandas(middle, "collection string, leader string, middle binary"), ["collection", "leader"]).select("collection", "part", "leader", "middle")


def hits(rows: DataFrame, asking: list[tuple[str, str, bytes]], known: dict[str, Shape], within: dict[str, float]) -> DataFrame:
    """collection, rid, id, n, vec: rows within reach of each asking row (collection, id, vec).

    A stated query set against all rows: the caller keeps it to one block of at most QUERY_BLOCK rows, which is broadcast.
    """
    by: dict[str, tuple[list[str], np.ndarray]] = {}
    for c in {a[0] for a in asking}:
        mine = [a for a in asking if a[0] == c]
        by[c] = ([a[1] for a in mine], np.frombuffer(b"".join(a[2] for a in mine), dtype="<f4").reshape(-1, known[c].dim))
    shared = rows.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, part in by_collection(b):
                if c not in shared.value:
                    continue
                rids, q = shared.value[c]
                x = matrix(part.column(3), known[c].dim)
                for i in range(0, len(q), 512):
                    at, k = near_pairs(x, q[i : i + 512], known[c].metric, within[known[c].metric])
                    if len(at):
                        t = pa.array(at)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(t), pa.array([rids[i + j] for j in k]), part.column(1).take(t), part.column(2).take(t), part.column(3).take(t)], names=["collection", "rid", "id", "n", "vec"])

    return rows.select("collection", "id", "n", "vec").mapInArrow(run, "collection string, rid string, id string, n long, vec binary")


def near_pairs(x: np.ndarray, q: np.ndarray, metric: str, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of q) of the pairs within the limit: found in single precision with a margin, decided in double."""
    a, b = metric_rows(x, metric), metric_rows(q, metric)
    product = a @ b.T
    if metric in ("innerProduct", "cosine"):
        d, margin = -product if metric == "innerProduct" else 1 - product, 1e-5 * max(1.0, float(np.abs(product).max(initial=0)))
        bound = limit
    else:
        top = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
        d, bound = top - 2 * product, limit**2 if metric == "l2" else limit
        margin = 1e-5 * max(1.0, float(top.max(initial=0)))
    at, k = np.nonzero(d <= bound + margin)
    ok = one_to_one(x[at], q[k], metric) <= limit
    return at[ok], k[ok]


def one_to_one(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of a to the same row of b, as metric_distances has it."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric == "innerProduct":
        return -(a * b).sum(1)
    if metric == "cosine":
        return 1 - ((a / np.linalg.norm(a, axis=1, keepdims=True)) * (b / np.linalg.norm(b, axis=1, keepdims=True))).sum(1)
    s = np.maximum((a * a).sum(1) + (b * b).sum(1) - 2 * (a * b).sum(1), 0)
    return np.sqrt(s) if metric == "l2" else s


def blocks(df: DataFrame, size: int = QUERY_BLOCK, columns: tuple[str, ...] = ("collection", "id", "vec")) -> Iterator[list[tuple]]:
    """The columns of df, in blocks of about `size` rows; one block is on the driver at a time."""
    n = df.count()
    parts = max(1, -(-n // size))
    for i in range(parts):
        yield [tuple(r) for r in df.where(F.pmod(F.xxhash64("collection", "id"), F.lit(parts)) == i).select(*columns).collect()]


def read(vecs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype="<f4").reshape(-1, dim)


def agreeing(met: DataFrame, known: dict[str, Shape], within: dict[str, float], most_parts: int) -> DataFrame:
    """collection, rid, size (rows), sum, far: of the sets met (collection, rid, id, vec, parts) those of which any two rows are within reach.

    sum is that of the rows as metric_rows() has them, far the greatest distance of one to their mean. Sets of more than CHUNK rows
    are taken in parts of about that many (most_parts: of the largest set): first each part by itself, which refuses most, then parts with each other, unless all rows are
    so near to the mean that any two are near.
    """
    def within_part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = known[key[0]]
        x = read(pdf.vec, shape.dim)
        ok = all((metric_distances(x[i : i + 1024], x, shape.metric) <= within[shape.metric]).all() for i in range(0, len(x), 1024))
        rows = metric_rows(x, shape.metric).astype(np.float64)
        far = float(np.sqrt(((rows - rows.mean(0)) ** 2).sum(1).max()))
        return pd.DataFrame({"collection": [key[0]], "rid": [key[1]], "size": [len(x)], "sum": [rows.sum(0).astype("<f8").tobytes()], "far": [far], "ok": [ok]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sum([np.frombuffer(b, dtype="<f8") for b in pdf["sum"]], axis=0)
        return pd.DataFrame({"collection": pdf.collection[:1], "rid": pdf.rid[:1], "size": [int(pdf["size"].sum())], "sum": [s.tobytes()], "far": [float("nan")]})

    def far_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = metric_rows(read(pdf.vec, known[key[0]].dim), known[key[0]].metric).astype(np.float64)
        mean = np.frombuffer(pdf["sum"].iloc[0], dtype="<f8") / pdf["size"].iloc[0]
        return pd.DataFrame({"collection": [key[0]], "rid": [key[1]], "far": [float(np.sqrt(((rows - mean) ** 2).sum(1).max()))]})

    def between(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = known[key[0]]
        a, b = read(pdf.vec[pdf.left], shape.dim), read(pdf.vec[~pdf.left], shape.dim)
        wrong = any((metric_distances(a[i : i + 1024], b, shape.metric) > within[shape.metric]).any() for i in range(0, len(a), 1024))
        return pd.DataFrame({"collection": [key[0]], "rid": [key[1]], "wrong": [wrong]})

    kind = "collection string, rid string, size long, sum binary, far double"
    cut = met.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    first = cut.groupBy("collection", "rid", "part").applyInPandas(within_part, f"{kind}, ok boolean")
    if most_parts <= 1:
        return first.where("ok").drop("ok")
    first = stage(first, "parts")
    refused = first.where("not ok").select("collection", "rid").distinct()
    good = first.join(refused, ["collection", "rid"], "left_anti").drop("ok")
    n = good.groupBy("collection", "rid").agg(F.count(F.lit(1)).alias("parts"))
    good = good.join(n, ["collection", "rid"])
    one, more = good.where("parts = 1").drop("parts"), stage(good.where("parts > 1").drop("parts").groupBy("collection", "rid").applyInPandas(added, kind), "large")
    if more.isEmpty():
        return one
    large = cut.join(F.broadcast(more.drop("far")), ["collection", "rid"])
    far = large.select("collection", "rid", "part", "vec", "sum", "size").groupBy("collection", "rid", "part").applyInPandas(far_of, "collection string, rid string, far double").groupBy("collection", "rid").agg(F.max("far").alias("far"))
    more = stage(more.drop("far").join(far, ["collection", "rid"]), "large-far")
    reach = more.sparkSession.createDataFrame([(c, float("-inf") if s.metric == "innerProduct" else squared_reach(within[s.metric], s.metric) ** 0.5) for c, s in known.items()], "collection string, reach double")
    unsure = cut.join(more.join(F.broadcast(reach), "collection").where("2 * far > reach").select("collection", "rid"), ["collection", "rid"], "left_semi")
    left = unsure.select("collection", "rid", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("left"), "vec").where("i < j")
    right = unsure.select("collection", "rid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("part").alias("j"), F.lit(False).alias("left"), "vec").where("i < j")
    wrong = left.unionByName(right).groupBy("collection", "rid", "i", "j").applyInPandas(between, "collection string, rid string, wrong boolean").where("wrong").select("collection", "rid").distinct()
    return one.unionByName(more.join(wrong, ["collection", "rid"], "left_anti").select(*one.columns))


def strangers(rows: DataFrame, asking: list, known: dict[str, Shape], within: dict[str, float]) -> DataFrame:
    """collection, rid, vec of the rows that aren't within reach of the asking row but could be of a member of its set, as far as the set's
    mean and its greatest distance to it tell. asking: rows (collection, rid, vec of the asking row, mean, far)."""
    by: dict[str, tuple] = {}
    for c in {a[0] for a in asking}:
        mine = [a for a in asking if a[0] == c]
        by[c] = ([a[1] for a in mine], np.frombuffer(b"".join(bytes(a[2]) for a in mine), dtype="<f4").reshape(-1, known[c].dim), np.array([np.frombuffer(a[3], dtype="<f8") for a in mine]).astype(np.float32), np.array([a[4] for a in mine]))
    shared = rows.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, part in by_collection(b):
                if c not in shared.value:
                    continue
                rids, q, mean, far = shared.value[c]
                metric, limit = known[c].metric, within[known[c].metric]
                x = matrix(part.column(3), known[c].dim)
                a = metric_rows(x, metric)
                sq = (a * a).sum(1)
                for i in range(0, len(q), 512):
                    m, f = mean[i : i + 512], far[i : i + 512]
                    product = a @ m.T
                    if metric == "innerProduct":
                        could = -product - np.sqrt(sq)[:, None] * f[None, :] <= limit + 1e-5 * (1 + np.abs(product).max(initial=0))
                    else:
                        top = sq[:, None] + (m * m).sum(1)[None, :]
                        could = top - 2 * product <= (f[None, :] + squared_reach(limit, metric) ** 0.5) ** 2 + 1e-5 * (1 + top.max(initial=0))
                    at, k = np.nonzero(could)
                    out = one_to_one(x[at], q[i + k], metric) > limit
                    at, k = at[out], k[out]
                    if len(at):
                        t = pa.array(at)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(t), pa.array([rids[i + j] for j in k]), part.column(1).take(t), part.column(3).take(t)], names=["collection", "rid", "id", "vec"])

    return rows.select("collection", "id", "n", "vec").mapInArrow(run, "collection string, rid string, id string, vec binary")


def isolated(points: DataFrame, configs: DataFrame, within: dict[str, float], least: int = 12) -> DataFrame:
    """collection, cluster_id, id: clusters of at least `least` points, any two within the metric's distance and no other point of
    the collection that near to any of them; cluster_id is the smallest id.

    Candidates are the components' densest members and all density peaks, but for those that their leaf refuses; of candidates near to each
    other one is asked (in a cluster all are near to each other, so none is lost). Every row of the collection is compared with them: what is
    within reach is the set, of which any two rows must be near. Every row is then compared with the sets' means: what could be
    near to a member, and isn't near to the candidate, is compared with the members. Identical vectors are one row with a weight. Unusable
    vectors are in no cluster; of points loaded again the latest usable load counts; empty tables and collections give nothing.
    """
    known = shapes(configs)
    p = usable(points, known)
    several = small(copies(p), "copies")
    p = p.join(several, ["collection", "h1", "h2"], "left")
    reps = p.where("rep is null or rep = id").withColumn("n", F.coalesce("n", F.lit(1)))
    found = stage(candidates(reps, known, within).select("collection", "id", F.lit(1).cast("long").alias("n"), "vec"), "candidates")
    lost = None
    for block in blocks(found):
        near = hits(found, block, known, within).where("id > rid").select("collection", "id")
        lost = near if lost is None else lost.unionByName(stage(near, "near"))  # one block is broadcast at a time
    asking = stage(found.join(lost.distinct(), ["collection", "id"], "left_anti"), "asking")

    met = None
    for block in blocks(asking):  # staged one by one, so that one block is broadcast at a time
        h = stage(hits(reps, block, known, within), "hits")
        met = h if met is None else met.unionByName(h)
    sizes = met.groupBy("collection", "rid").agg(F.sum("n").alias("weight"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")).where(F.col("weight") >= least)
    sizes = small(sizes.select("collection", "rid", "parts"), "sizes")
    most_parts = sizes.agg(F.max("parts")).first()[0] or 0
    met = stage(met.join(sizes, ["collection", "rid"]), "sets")

    sets = stage(agreeing(met, known, within, most_parts).join(asking.select("collection", F.col("id").alias("rid"), "vec"), ["collection", "rid"]), "agreeing")

    @F.pandas_udf("binary")
    def mean(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(a, dtype="<f8") / k).astype("<f8").tobytes() for a, k in zip(s, n)], dtype=object)

    others = None
    for block in blocks(sets.select("collection", F.col("rid").alias("id"), "vec", mean("sum", "size").alias("mean"), "far"), columns=("collection", "id", "vec", "mean", "far")):
        h = stage(strangers(reps, block, known, within), "strangers")
        others = h if others is None else others.unionByName(h)
    # a set's members, and the rows that could be near to them, in parts of CHUNK rows
    theirs = small(others.groupBy("collection", "rid").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("b")), "touched")
    both = small(met.select("collection", "rid", F.col("parts").alias("a")).distinct().join(theirs, ["collection", "rid"]), "both")
    mine, theirs = met.join(both, ["collection", "rid"]), others.join(both, ["collection", "rid"])
    left = mine.select("collection", "rid", F.pmod(F.xxhash64("id"), "a").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"), F.lit(True).alias("left"), "vec")
    right = theirs.select("collection", "rid", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "b").cast("int").alias("j"), F.lit(False).alias("left"), "vec")

    def near_one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = known[key[0]]
        a, b = read(pdf.vec[pdf.left], shape.dim), read(pdf.vec[~pdf.left], shape.dim)
        wrong = any((metric_distances(a[i : i + 1024], b, shape.metric) <= within[shape.metric]).any() for i in range(0, len(a), 1024))
        return pd.DataFrame({"collection": [key[0]], "rid": [key[1]], "wrong": [wrong]})

    wrong = left.unionByName(right).groupBy("collection", "rid", "i", "j").applyInPandas(near_one, "collection string, rid string, wrong boolean").where("wrong").select("collection", "rid").distinct()
    good = met.select("collection", "rid", "id").join(sets.select("collection", "rid").join(stage(wrong, "wrong"), ["collection", "rid"], "left_anti"), ["collection", "rid"])
    good = good.join(good.groupBy("collection", "rid").agg(F.min("id").alias("cluster_id")), ["collection", "rid"])
    members = p.where("rep is not null").select("collection", F.col("rep").alias("id"), F.col("id").alias("copy"))
    return good.join(members, ["collection", "id"], "left").select("collection", "cluster_id", F.coalesce("copy", "id").alias("id")).distinct()


def divided(points: DataFrame, configs: DataFrame, within: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(collection, id, n, component, far of each different vector, usable points with the smallest id of their copies, rep).

    far orders a component's rows, most typical first: by density, or where it was put together of several parts, by the distance
    to the centre of the whole.
    """
    known = shapes(configs)
    p = usable(points, known)
    several = small(copies(p), "copies")
    p = p.join(several, ["collection", "h1", "h2"], "left")
    reps = p.where("rep is null or rep = id").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = stage(parts(reps, known, within).withColumn("part", F.concat_ws(":", "leaf", "component")), "parts")
    joined = small(together(rows.where("size is not null"), known, within), "together")

    @F.pandas_udf("double")
    def distance(z: pd.Series, middle: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else float(((np.frombuffer(a, dtype="<f4") - np.frombuffer(m, dtype="<f4")) ** 2).sum()) for a, m in zip(z, middle)], dtype="float64")

    rows = rows.select("collection", "part", "id", "n", "dense", "z").join(joined, ["collection", "part"], "left")
    far = F.coalesce(distance("z", "middle"), -F.col("dense"))
    return rows.select("collection", "id", "n", F.coalesce("leader", "part").alias("component"), far.alias("far")), p


def members(points: DataFrame, configs: DataFrame, within: dict[str, float]) -> DataFrame:
    """collection, id, component: the component of `describe` that each usable point is in."""
    rows, p = divided(points, configs, within)
    same = p.where("rep is not null").select("collection", F.col("rep").alias("id"), F.col("id").alias("copy"))
    return rows.join(same, ["collection", "id"], "left").select("collection", F.coalesce("copy", "id").alias("id"), "component")


def describe(points: DataFrame, configs: DataFrame, within: dict[str, float], typical: int = 3) -> DataFrame:
    """collection, component, size, typical: the division of each collection's usable points by the mixtures, one row a component.

    A group of near points is one component, however many leaves or pieces of leaves its rows were fitted in.
    """
    rows, _ = divided(points, configs, within)
    sizes = rows.groupBy("collection", "component").agg(F.sum("n").alias("size"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("collection", "component").orderBy("far", "id"))).where(F.col("r") <= typical)
    first = first.groupBy("collection", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    return sizes.join(first, ["collection", "component"])
