"""The most similar vectors for every vector, by an inverted file with product-quantised residuals and exact reranking.

The models are trained on a bounded hash sample of each collection; every row is indexed and every row asks. A collection has cells
in proportion to the square root of its rows, put into blocks of neighbouring cells. A row is sent to its own block, and as
a query to each block that holds a cell it asks. In a block, the rows of the cells asked are compared by asymmetric distance
tables and the best KEEP ranked by their vectors.

Which cells a query asks: where only neighbours within a distance are wanted, the NEAR_CELLS nearest of those that can hold one, by geometry. Else the nearest
cells with a share of the rows that is measured: a few queries of each collection are compared with all its rows, and
the share is the least that gives RECALL of their true neighbours. Identical vectors are one class and asked once: members of a class share their
neighbours.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm import ivfpq as I
from pointlake.llm.vectors import Shape, by_collection, copies, matrix, shapes, usable
from pointlake.session import small, stage

SAMPLE, MOST_SAMPLE = 8192, 1 << 18  # rows a model is trained on, about: eight a cell, at least and at most
CELLS = 6.0  # cells of a collection, times the square root of its rows
SLICES = 16
KEEP = 120  # candidates of each block that are ranked by their vectors
RECALL, ASKED = 0.95, 64  # of the true neighbours of so many measured queries a collection, the part that lies in the cells asked
NEAR_CELLS = 32  # of the cells that can hold a neighbour within the wanted distance, asked by a query; 0: all
WHOLE = 4096  # rows up to which a collection is compared as a whole
BLOCK_ROWS, MOST_BLOCK_ROWS = 8192, 65_536  # rows of a block: a 64th of the collection within these bounds where queries ask few cells, else the most
QUERY_ROWS = 16_384  # queries of a block that one task answers, about
AT_ONCE = 64  # queries whose cells are asked together

_RESULT = "collection string, id string, n long, nid array<string>, nd array<double>, nn array<long>"


def _models(reps: DataFrame, known: dict[str, Shape], within: dict[str, float] | None, block_rows: int, near_cells: int) -> dict[str, I.Model]:
    stats = {r["collection"]: (r["rows"], r["top"]) for r in reps.groupBy("collection").agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("top")).collect()}
    if not stats:
        return {}
    cells = {c: max(1, round(CELLS * n**0.5)) if n > 64 else 1 for c, (n, _) in stats.items()}
    cells = {c: min(k, MOST_SAMPLE // 8) for c, k in cells.items()}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.collection.iloc[0]
        rows, top = stats[c]
        pdf = pdf.sort_values(["h1", "h2"])
        x = np.frombuffer(b"".join(pdf.vec), dtype="<f4").reshape(-1, known[c].dim)
        size = int(min(max(block_rows, rows // 64), max(block_rows, MOST_BLOCK_ROWS)))
        m = I.train(x, known[c].metric, rows, top, cells[c], SLICES, size, None if within is None else within[known[c].metric], near_cells)
        return pd.DataFrame({"collection": [c], "model": [pickle.dumps(m)]})

    spark = reps.sparkSession
    share = spark.createDataFrame([(c, min(1.0, max(SAMPLE, 8 * cells[c]) / n)) for c, (n, _) in stats.items()], "collection string, share double")
    sample = reps.join(F.broadcast(share), "collection").where(F.pmod("h2", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    rows = sample.select("collection", "vec", "h1", "h2").groupBy("collection").applyInPandas(fit, "collection string, model binary").collect()
    models = {r["collection"]: pickle.loads(r["model"]) for r in rows}
    if len(models) < len(stats):  # a sample without rows: one cell for all
        for c in stats.keys() - models.keys():
            first = reps.where(F.col("collection") == c).select("vec").limit(256).collect()
            x = np.frombuffer(b"".join(bytes(r["vec"]) for r in first), dtype="<f4").reshape(-1, known[c].dim)
            models[c] = I.train(x, known[c].metric, *stats[c], 1, SLICES, block_rows, None if within is None else within[known[c].metric])
    return models


def measure(reps: DataFrame, models: dict[str, I.Model], sizes: dict[str, int], k: int, recall: float) -> None:
    """Set each model's probe_share to the least that holds `recall` of the true neighbours of ASKED queries, which are compared with
    all rows; collections of at most WHOLE rows are compared as a whole."""
    large = [c for c in models if sizes[c] > WHOLE]
    if not large:
        return
    spark = reps.sparkSession
    odds = spark.createDataFrame([(c, 4 * ASKED / sizes[c]) for c in large], "collection string, odds double")
    some = reps.join(F.broadcast(odds), "collection").where(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < F.col("odds") * (1 << 30))
    w = Window.partitionBy("collection").orderBy("h1", "h2")
    asking: dict[str, list] = {}
    for r in some.withColumn("i", F.row_number().over(w)).where(F.col("i") <= ASKED).select("collection", "vec", "h1", "h2").collect():
        asking.setdefault(r["collection"], []).append((bytes(r["vec"]), r["h1"], r["h2"]))
    shared = spark.sparkContext.broadcast((asking, models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, models = shared.value
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for c, part in by_collection(b):
                if c not in asking:
                    continue
                m = models[c]
                x, q = matrix(part.column(1), m.dim), np.frombuffer(b"".join(a[0] for a in asking[c]), dtype="<f4").reshape(-1, m.dim)
                d = I.flat(m.metric, q, x)
                own = (part.column(2).to_numpy()[None, :] == np.array([a[1] for a in asking[c]])[:, None]) & (part.column(3).to_numpy()[None, :] == np.array([a[2] for a in asking[c]])[:, None])
                d[own] = np.inf
                cell = np.broadcast_to(I.nearest(m.prepared(x), m.centroids), d.shape)
                if c in best:
                    d, cell = np.concatenate([best[c][0], d], axis=1), np.concatenate([best[c][1], cell], axis=1)
                pick = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.arange(d.shape[1])[None, :].repeat(len(d), 0)
                best[c] = np.take_along_axis(d, pick, 1), np.take_along_axis(cell, pick, 1)
        for c, (d, cell) in best.items():
            ok = np.isfinite(d)
            n = int(ok.sum())
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.string()), pa.array(np.nonzero(ok)[0].astype(np.int32)), pa.array(d[ok]), pa.array(cell[ok].astype(np.int32))], names=["collection", "q", "d", "cell"])

    hits = reps.select("collection", "vec", "h1", "h2").mapInArrow(run, "collection string, q int, d double, cell int")
    first = hits.withColumn("r", F.row_number().over(Window.partitionBy("collection", "q").orderBy("d", "cell"))).where(F.col("r") <= k)
    where: dict[str, list] = {}
    for r in first.select("collection", "q", "cell").collect():
        where.setdefault(r["collection"], []).append((r["q"], r["cell"]))
    for c, pairs in where.items():
        m = models[c]
        q = m.as_query(np.frombuffer(b"".join(a[0] for a in asking[c]), dtype="<f4").reshape(-1, m.dim))
        d = I.sq_distances(q, m.centroids)
        order = np.argsort(d, axis=1)
        before = np.empty_like(d)
        np.put_along_axis(before, order, np.cumsum(m.share[order], axis=1) - m.share[order], 1)
        at = np.array(pairs)
        m.probe_share = float(min(1.0, np.quantile(before[at[:, 0], at[:, 1]], recall) + 1e-6))


class _Block:
    """One block's rows, sorted by cell, and queries that meet them."""

    def __init__(self, model: I.Model, k: int, keep: int, exact: bool, col: dict):
        self.m, self.k, self.exact = model, k, exact
        self.cell, self.x, self.ids, self.n, self.h1, self.h2 = (col[c] for c in ("cell", "x", "id", "n", "h1", "h2"))
        self.code, self.middle, self.keep = col["code"], col["middle"], min(keep, len(self.x))
        self.cells = np.unique(self.cell)
        self.starts = np.searchsorted(self.cell, np.arange(len(model.centroids) + 1))

    def answer(self, x: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, row numbers) of the k best rows of each query, unordered; queries sorted by cell."""
        q = self.m.as_query(x)
        out_d, out_at = np.full((len(x), self.k), np.inf), np.zeros((len(x), self.k), dtype=np.int64)
        for lo in range(0, len(x), 2048):
            asked = self.m.probes(q[lo : lo + 2048])[:, self.cells] if not self.exact else np.ones((len(q[lo : lo + 2048]), len(self.cells)), dtype=bool)
            for a in range(0, len(asked), AT_ONCE):
                cells = self.cells[asked[a : a + AT_ONCE].any(axis=0)]
                if not len(cells):
                    continue
                at = slice(lo + a, min(lo + a + AT_ONCE, lo + len(asked)))
                if self.exact:
                    d, rows = I.flat(self.m.metric, x[at], self.x), np.arange(len(self.x))[None, :].repeat(at.stop - at.start, 0)
                else:
                    best = I.candidates(q[at], self.m, cells, self.starts, self.code, self.middle, self.keep)
                    rows = np.maximum(best.at, 0)
                    d = I.exact(self.m.metric, x[at], self.x[rows]).astype(np.float64)
                    d[best.at < 0] = np.inf
                d[(self.h1[rows] == h1[at, None]) & (self.h2[rows] == h2[at, None])] = np.inf
                pick = np.argpartition(d, self.k - 1, axis=1)[:, : self.k] if d.shape[1] > self.k else np.arange(d.shape[1])[None, :].repeat(len(d), 0)
                d, rows = np.take_along_axis(d, pick, 1), np.take_along_axis(rows, pick, 1)
                out_d[at, : d.shape[1]] = np.where(np.isinf(d), d, I.exact(self.m.metric, x[at].astype(np.float64), self.x[rows].astype(np.float64)))
                out_at[at, : d.shape[1]] = rows
        return out_d, out_at

    def result(self, collection: str, ids: pa.Array, n: pa.Array, d: np.ndarray, at: np.ndarray, limit: float) -> pa.RecordBatch:
        """One row for each query that has neighbours within the limit."""
        ok = np.isfinite(d) & (d <= limit)
        some = np.flatnonzero(ok.any(axis=1))
        ids, n, d, at, ok = ids.take(pa.array(some)), n.take(pa.array(some)), d[some], at[some], ok[some]
        ends = pa.array(np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (self.ids.take(pa.array(at[ok])), pa.array(d[ok]), pa.array(self.n[at[ok]]))]
        return pa.RecordBatch.from_arrays([pa.array([collection] * len(ids), pa.string()), ids, n, *lists], names=["collection", "id", "n", "nid", "nd", "nn"])


def class_neighbors(reps: DataFrame, known: dict[str, Shape], k: int, within: dict[str, float] | None = None, probe_share: float | None = None, recall: float = RECALL, keep: int = KEEP, exact: bool = False, near_cells: int = NEAR_CELLS, block_rows: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """collection, id, n and up to k nearest other representatives (nid, nd, nn) of each row of reps (collection, id, n, vec, h1, h2, norm)
    that has any.

    within: by metric, a distance beyond which neighbours aren't wanted; with near_cells=0 no cell that can hold one is left out. probe_share: a share of the rows to ask instead of the
    measured one. exact: every row is compared with all rows of its collection by vector.
    """
    spark = reps.sparkSession
    near = None if exact or probe_share is not None else within
    models = _models(reps, known, near, block_rows or (MOST_BLOCK_ROWS if near is None else BLOCK_ROWS), near_cells)
    if not models:
        return spark.createDataFrame([], _RESULT)
    sizes = {r["collection"]: r["count"] for r in reps.groupBy("collection").count().collect()}
    if probe_share is not None or exact:
        for m in models.values():
            m.probe_share = 1.0 if exact else probe_share
    elif within is None:
        measure(reps, models, sizes, k, recall)
    base, gids, parts = {}, [], {}
    for c in sorted(models):
        m = models[c]
        base[c] = len(gids)
        gids += [c] * m.blocks
        # tasks of a block: its queries are about all rows, times the part of blocks a query asks
        parts[c] = max(1, -(-int(sizes[c] * (m.probe_share or 1.2 / m.blocks)) // query_rows)) if m.blocks > 1 else max(1, -(-sizes[c] // query_rows))
    first, total = {}, 0
    for c in sorted(models):
        first[c] = total
        total += models[c].blocks * parts[c]
    shared, limit = spark.sparkContext.broadcast(models), within or {}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            for c, part in by_collection(b):
                m, tasks = models[c], parts[c]
                x = matrix(part.column(3), m.dim)
                p, q, h = m.prepared(x), m.as_query(x), part.column(4).to_numpy()
                cell = I.nearest(p, m.centroids)
                code, middle = m.encode(p, cell)
                mine = m.block[cell] + (h >> 7) % m.pieces[cell]
                near = I.nearest(q, m.centroids) if m.metric == "innerProduct" else cell
                asked = np.zeros((len(x), m.blocks), dtype=bool)
                for lo in range(0, len(x), 2048):
                    hit = m.probes(q[lo : lo + 2048])
                    order = np.argsort(m.block, kind="stable")
                    starts = np.unique(m.block, return_index=True)
                    any_ = np.logical_or.reduceat(hit[:, order], starts[1], axis=1)
                    for j, b0 in enumerate(starts[0]):
                        asked[lo : lo + 2048, b0 : b0 + m.pieces[m.block == b0].max()] |= any_[:, j, None]
                # a row also asks where it lies: there it isn't sent again
                all_, here = np.arange(len(x)), near * 31 % tasks
                own = np.where(asked[all_, mine], mine * tasks + here, -1)
                asked[all_, mine] = False
                rows, block = np.nonzero(asked)
                out = [(np.repeat(all_, tasks), np.repeat(mine, tasks) * tasks + np.tile(np.arange(tasks), len(x)), 0), (rows, block * tasks + here[rows], 1)]
                for rows, task, role in out:
                    for lo in range(0, len(rows), 16_384):
                        r = rows[lo : lo + 16_384]
                        t, none, at = pa.array(r), pa.nulls(len(r), pa.binary()), task[lo : lo + 16_384]
                        yield pa.RecordBatch.from_arrays([
                            pa.array((first[c] + at).astype(np.int32)), pa.array(np.full(len(r), role, np.int32)), pa.array((near if role else cell)[r].astype(np.int32)), pa.array(own[r] == at),
                            *[part.column(i).take(t) for i in (1, 2, 3, 4, 5)], none if role else pa.array([code[i].tobytes() for i in r], pa.binary()), pa.array(middle[r])],
                            names=["task", "role", "cell", "asks", "id", "n", "vec", "h1", "h2", "code", "middle"])

    names = [c for c in sorted(models) for _ in range(models[c].blocks * parts[c])]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, block, now, held = shared.value, None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            m = models[names[now[0]]]
            col = {name: t.column(name).chunk(0) for name in t.column_names}
            x, h1, h2 = matrix(col["vec"], m.dim), col["h1"].to_numpy(), col["h2"].to_numpy()
            asks = slice(None)
            if now[1] == 0:
                block = _Block(m, k, keep, exact, {"cell": col["cell"].to_numpy(), "x": x, "id": col["id"], "n": col["n"].to_numpy(), "h1": h1, "h2": h2, "code": np.frombuffer(b"".join(col["code"].to_pylist()), dtype=np.uint8).reshape(len(x), -1), "middle": col["middle"].to_numpy()})
                asks = np.flatnonzero(col["asks"].to_numpy(zero_copy_only=False))
            if block is not None:
                t = pa.array(np.arange(len(x))[asks])
                yield block.result(names[now[0]], col["id"].take(t), col["n"].take(t), *block.answer(x[asks], h1[asks], h2[asks]), limit.get(m.metric, np.inf))

        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                at = (int(key[lo]) // 2, int(key[lo]) % 2)
                if at != now or at[1] and sum(x.num_rows for x in held) >= 8192:
                    yield from flush()
                    if now is None or at[0] != now[0]:
                        block = None
                    now = at
                held.append(b.slice(lo, hi - lo))
        yield from flush()

    rows = reps.select("collection", "id", "n", "vec", "h1", "h2").mapInArrow(index, "task int, role int, cell int, asks boolean, id string, n long, vec binary, h1 long, h2 long, code binary, middle float")
    found = rows.repartitionById(total, F.col("task")).sortWithinPartitions("task", "role", "cell", "id").mapInArrow(search, _RESULT)
    if len(gids) == len(models):
        return found
    # the blocks' results of a query together
    z = F.transform(F.arrays_zip("nid", "nd", "nn"), lambda x: F.struct(x["nd"].alias("nd"), x["nid"].alias("nid"), x["nn"].alias("nn")))
    met = found.select("collection", "id", "n", z.alias("z")).groupBy("collection", "id").agg(F.max("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
    return met.select("collection", "id", "n", "z.nid", "z.nd", "z.nn")


def neighbors(points: DataFrame, configs: DataFrame, k: int = 10, within: dict[str, float] | None = None, **tuning: float) -> DataFrame:
    """collection, id, neighbor, distance: for each usable point its k most similar others of its collection, with little loss.

    within: a greatest distance for each metric; pairs beyond it are left out. tuning: as class_neighbors() takes it; with exact=True the
    result is exact. Defined cases: unusable vectors neither
    ask nor answer; of points loaded again the latest usable load counts; fewer than k others give all of them; of equal
    distances the smaller ids come first among copies of one vector; empty tables give no rows.
    """
    known = shapes(configs)
    p = usable(points, known)
    several = small(copies(p), "copies")
    p = p.join(several, ["collection", "h1", "h2"], "left")
    reps = p.where("rep is null or rep = id").withColumn("n", F.coalesce("n", F.lit(1)))
    found = stage(class_neighbors(reps, known, k, within, **tuning), "neighbors")
    limits = [(c, s.metric, float(within[s.metric]) if within else float("inf")) for c, s in known.items()] or [("", "l2", 0.0)]
    metric = points.sparkSession.createDataFrame(limits, "collection string, metric string, limit double")

    # places of a class's list that its own copies and each neighbouring class take; own copies come before what is as near, and
    # under inner products after longer vectors that are nearer
    own = reps.where("n > 1").join(F.broadcast(metric), "collection").withColumn("distance", F.when(F.col("metric") == "innerProduct", -F.col("norm") * F.col("norm")).otherwise(0.0))
    own = own.select("collection", F.col("id").alias("a"), "distance", "limit", F.col("n").alias("copies"))
    z = F.arrays_zip("nid", "nd", "nn")
    total = lambda at: F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x["nn"])
    nearer = own.join(found.select("collection", F.col("id").alias("a"), z.alias("zs")), ["collection", "a"], "left")
    ahead = F.when(F.col("distance") < 0, F.coalesce(total(F.filter("zs", lambda x: x["nd"] < F.col("distance"))), F.lit(0))).otherwise(0)
    placed = nearer.where("distance <= limit").select("collection", "a", F.col("a").alias("b"), "distance", F.least(F.col("copies") - 1, k - ahead).alias("take")).where("take > 0")
    near = found.select("collection", F.col("id").alias("a"), z.alias("zs"), F.posexplode(z).alias("i", "z")).join(F.broadcast(metric), "collection").where(F.col("z.nd") <= F.col("limit"))
    near = near.join(own.select("collection", "a", F.col("distance").alias("at"), "copies"), ["collection", "a"], "left")
    first_own = F.when((F.col("at") >= 0) | (F.col("at") <= F.col("z.nd")), F.col("copies") - 1).otherwise(0)
    before = first_own + total(F.slice("zs", F.lit(1), F.col("i")))
    near = near.select("collection", "a", F.col("z.nid").alias("b"), F.col("z.nd").alias("distance"), F.least(F.col("z.nn"), k - before).alias("take")).where("take > 0")
    pairs = placed.unionByName(near)

    members = p.where("rep is not null").select("collection", "rep", "id")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("collection", "rep").orderBy("id"))).where(F.col("r") <= k + 1)
    asking = members.join(first.select("collection", "rep", "id", F.col("r").alias("ra")), ["collection", "rep", "id"], "left")
    pairs = pairs.join(first.select("collection", F.col("rep").alias("b"), F.col("id").alias("bid"), "r"), ["collection", "b"], "left")
    pairs = pairs.join(asking.select("collection", F.col("rep").alias("a"), F.col("id").alias("aid"), "ra"), ["collection", "a"], "left")
    same = F.col("a") == F.col("b")
    fits = F.coalesce(F.col("r"), F.lit(1)) <= F.col("take") + F.when(same & (F.col("ra") <= F.col("take")), 1).otherwise(0)
    out = pairs.where(fits).select("collection", F.coalesce("aid", "a").alias("id"), F.coalesce("bid", "b").alias("neighbor"), "distance")
    return out.where("id <> neighbor")


def near_pairs(points: DataFrame, configs: DataFrame, within: dict[str, float], k: int = 10, **tuning: float) -> DataFrame:
    """collection, id_a, id_b (id_a < id_b): pairs within the metric's distance, one among the k nearest of the other."""
    n = neighbors(points, configs, k, within, **tuning)
    return n.select("collection", F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()
