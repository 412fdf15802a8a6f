"""Inverted file with product-quantised residuals: the numpy side.

A model has coarse centroids and, for each of the slices of the residual x - centroid, a codebook. With r the decoded residual,

    |q - c - r|^2 = |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r

so a row needs its code and one number (the middle term), and a query one table of products with the codebook
entries a slice; the distance of a pair is then a sum of table entries. The best of these are ranked again with the vectors.
All metrics become squared Euclidean distance: cosine on unit vectors, inner product with one more dimension that
levels the norms.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Array = np.ndarray


def sq_distances(a: Array, b: Array) -> Array:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def nearest(a: Array, b: Array, block: int = 8192) -> Array:
    half = (b * b).sum(1) / 2
    return np.concatenate([np.argmax(a[i : i + block] @ b.T - half, axis=1) for i in range(0, len(a), block)]) if len(a) else np.empty(0, np.int64)


def kmeans(x: Array, k: int, rounds: int, rng: np.random.Generator) -> Array:
    """Lloyd's rounds from random rows; an empty centroid moves to a random row."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=k)
        full = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
        c[full] = np.add.reduceat(x[order], starts, axis=0) / n[full, None]
        if len(empty := np.flatnonzero(n == 0)):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c.astype(np.float32)


def tree_kmeans(x: Array, k: int, rounds: int, rng: np.random.Generator, polish: int = 2) -> Array:
    """About k centroids in two levels, each level's square root of k in number, so that training costs len(x) * sqrt(k); centroids that
    lie together stand together. A few flat rounds follow, in which every row takes the nearest of all."""
    if k <= 64 or len(x) <= 64:
        return kmeans(x, k, rounds, rng)
    top = kmeans(x, round(k**0.5), rounds, rng)
    at = nearest(x, top)
    axis = np.linalg.svd(top - top.mean(0), full_matrices=False)[2][0]
    parts = []
    for t in np.argsort(top @ axis, kind="stable"):
        mine = x[at == t]
        if len(mine):
            parts.append(kmeans(mine, max(1, round(k * len(mine) / len(x))), rounds, rng))
    c = np.concatenate(parts)
    for _ in range(polish):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        order, full = np.argsort(at, kind="stable"), np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return c.astype(np.float32)


@dataclass
class Model:
    metric: str
    dim: int
    top_norm: float  # of the collection, for inner products
    centroids: Array  # (cells, d)
    codebooks: Array  # (slices, entries, width)
    share: Array  # of the rows, in each cell
    block: Array  # of each cell, the first of its blocks
    pieces: Array  # of each cell, how many blocks its rows are spread over
    blocks: int
    probe_share: float  # of the rows that a query is compared with; 0: cells within its radius
    radius: float  # Euclidean, in the index's space; for probe_share 0
    near_cells: int  # of the cells within the radius, as many of the nearest are asked; 0: all

    def prepared(self, x: Array) -> Array:
        """Rows as the index sees them: dimensions padded to whole slices."""
        return prepare(x, self.metric, self.top_norm, self.centroids.shape[1])

    def encode(self, x: Array, cell: Array) -> tuple[Array, Array]:
        """Codes (rows, slices) and the middle term of each row; x prepared."""
        r = x - self.centroids[cell]
        w = self.codebooks.shape[2]
        code = np.empty((len(x), len(self.codebooks)), dtype=np.uint8)
        decoded = np.empty_like(r)
        for m, book in enumerate(self.codebooks):
            code[:, m] = nearest(r[:, m * w : (m + 1) * w], book)
            decoded[:, m * w : (m + 1) * w] = book[code[:, m]]
        return code, ((decoded * decoded).sum(1) + 2 * (decoded * self.centroids[cell]).sum(1)).astype(np.float32)

    def probes(self, q: Array, cells: slice = slice(None)) -> Array:
        """(queries, cells): whether a query (prepared) asks a cell. With a radius these are all cells that can hold a row within
        it: a row of cell b is on b's side of the plane between b and the query's nearest centroid a, so that plane is no further
        from the query than the radius; of these the near_cells nearest are asked. Else the nearest cells that hold probe_share of the rows, four at least."""
        d = sq_distances(q, self.centroids)
        if not self.probe_share:
            a = d.argmin(1)
            apart = np.sqrt(sq_distances(self.centroids[np.unique(a)], self.centroids))[np.unique(a, return_inverse=True)[1]]
            asked = (d - d[np.arange(len(q)), a][:, None]) <= 2 * self.radius * apart + 1e-4
            if 0 < self.near_cells < d.shape[1]:
                asked &= d <= np.partition(d, self.near_cells - 1, axis=1)[:, self.near_cells - 1, None]
            return asked[:, cells]
        if self.probe_share >= 1:
            return np.ones((len(q), len(self.centroids)), dtype=bool)[:, cells]
        order = np.argsort(d, axis=1)
        before = np.cumsum(self.share[order], axis=1) - self.share[order]
        before[:, :4] = 0
        asked = np.empty(d.shape, dtype=bool)
        np.put_along_axis(asked, order, before < self.probe_share, 1)
        return asked[:, cells]

    def as_query(self, x: Array) -> Array:
        q = self.prepared(x)
        if self.metric == "innerProduct" and q.shape[1] > self.dim:
            q[:, self.dim] = 0  # asks with its own direction only
        return q


def prepare(x: Array, metric: str, top_norm: float, width: int) -> Array:
    x = x.astype(np.float32, copy=False)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-30).astype(np.float32)
    out = np.zeros((len(x), width), dtype=np.float32)
    out[:, : x.shape[1]] = x
    if metric == "innerProduct" and width > x.shape[1]:
        out[:, x.shape[1]] = np.sqrt(np.maximum(top_norm**2 - (x.astype(np.float64) ** 2).sum(1), 0))
    return out


def width_of(metric: str, dim: int, slices: int) -> int:
    d = dim + (metric == "innerProduct")
    return -(-d // slices) * slices


def radius_of(metric: str, within: float, top_norm: float, norms: float) -> float:
    """The Euclidean distance in the index's space that a greatest metric distance stands for; norms: the greatest of queries."""
    return float(np.sqrt(max({"l2": within**2, "l2Squared": within, "cosine": 2 * within, "innerProduct": norms**2 + top_norm**2 + 2 * within}[metric], 0))) * (1 + 1e-5)


def train(x: Array, metric: str, total: int, top_norm: float, cells: int, slices: int, block_rows: int, within: float | None = None, near_cells: int = 0, seed: int = 7) -> Model:
    """A model from a sample x (rows as stored) of a collection with total rows; cells stand in the order of a tree and are put
    into blocks of about block_rows rows, a cell of more into several."""
    rng = np.random.default_rng(seed)
    p = prepare(x, metric, top_norm, width_of(metric, x.shape[1], slices))
    c = tree_kmeans(p, cells, 8, rng)
    at = nearest(p, c)
    r = p - c[at]
    w = p.shape[1] // slices
    books = [kmeans(np.ascontiguousarray(r[:, m * w : (m + 1) * w]), 256, 6, rng) for m in range(slices)]
    entries = min(len(b) for b in books)
    share = np.bincount(at, minlength=len(c)) / max(len(p), 1)
    block, pieces, now, held = np.zeros(len(c), dtype=np.int64), np.ones(len(c), dtype=np.int64), 0, 0.0
    for i, n in enumerate(share * total):
        if held and held + n > block_rows:
            now, held = now + 1, 0.0
        block[i], pieces[i] = now, max(1, -(-int(n) // (2 * block_rows)))
        held += n
        if pieces[i] > 1:
            now, held = now + int(pieces[i]), 0.0
    blocks = int((block + pieces).max())
    return Model(metric, x.shape[1], top_norm, c, np.stack([b[:entries] for b in books]), share, block, pieces, blocks, 1.0 if within is None else 0.0, 0.0 if within is None else radius_of(metric, within, top_norm, top_norm), near_cells)


def exact(metric: str, q: Array, rows: Array) -> Array:
    """Distances of each query to its own candidates: q (n, d), rows (n, r, d), as stored."""
    if metric in ("l2", "l2Squared"):
        d = rows - q[:, None, :]
        s = np.einsum("qrd,qrd->qr", d, d)
        return np.sqrt(s) if metric == "l2" else s
    s = np.einsum("qrd,qd->qr", rows, q)
    if metric == "innerProduct":
        return -s
    den = np.linalg.norm(rows, axis=2) * np.linalg.norm(q, axis=1)[:, None]
    return np.where(den == 0, 1, 1 - s / np.where(den == 0, 1, den))


def flat(metric: str, q: Array, x: Array) -> Array:
    """All distances (queries, rows) in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    if metric == "innerProduct":
        return -(q @ x.T)
    if metric == "cosine":
        return 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    s = sq_distances(q, x)
    return np.sqrt(s) if metric == "l2" else s


class Best:
    """The running best candidates of a block of queries by table distance, unordered."""

    def __init__(self, n: int, keep: int):
        self.keep, self.n = keep, n
        self.d = np.full((n, keep), np.inf, dtype=np.float32)
        self.at = np.full((n, keep), -1, dtype=np.int64)
        self.worst = np.full(n, np.inf, dtype=np.float32)

    def add(self, dist: Array, numbers: Array) -> None:
        """dist (rows, queries) of the candidates with these numbers. Only those better than a query's worst are looked at."""
        if np.isinf(self.worst).any():
            d, at = np.concatenate([self.d, dist.T], axis=1), np.concatenate([self.at, np.broadcast_to(numbers, dist.T.shape)], axis=1)
        else:
            flat = np.flatnonzero((dist < self.worst).ravel())
            if not len(flat):
                return
            rows, q = np.divmod(flat, self.n)
            order = np.argsort(q.astype(np.int32), kind="stable")
            rows, q = rows[order], q[order]
            n = np.bincount(q, minlength=self.n)
            place = self.keep + np.arange(len(q)) - (np.cumsum(n) - n)[q]
            d = np.full((self.n, self.keep + n.max()), np.inf, dtype=np.float32)
            at = np.full(d.shape, -1, dtype=np.int64)
            d[:, : self.keep], at[:, : self.keep] = self.d, self.at
            d[q, place], at[q, place] = dist[rows, q], numbers[rows]
        pick = np.argpartition(d, self.keep - 1, axis=1)[:, : self.keep] if d.shape[1] > self.keep else np.arange(self.keep)[None, :].repeat(self.n, 0)
        self.d, self.at = np.take_along_axis(d, pick, 1), np.take_along_axis(at, pick, 1)
        self.worst = self.d.max(axis=1)


def table_distances(tables: list[Array], to_cell: Array, place: Array, code: Array, middle: Array, step: int = 512) -> Array:
    """(rows, queries): sums of table entries. tables: a slice's products, transposed (entries, queries); to_cell (cells,
    queries): squared distances to the centroids; place: each row's line in it. In steps that stay in the cache."""
    out = np.empty((len(code), tables[0].shape[1]), dtype=np.float32)
    for i in range(0, len(code), step):
        s, c = out[i : i + step], code[i : i + step]
        np.take(tables[0], c[:, 0], axis=0, out=s)
        for m in range(1, len(tables)):
            s += tables[m][c[:, m]]
        s *= -2
        s += middle[i : i + step, None]
        s += to_cell[place[i : i + step]]
    return out


def tables_of(q: Array, model: Model) -> list[Array]:
    w = model.codebooks.shape[2]
    return [np.ascontiguousarray(book @ q[:, m * w : (m + 1) * w].T) for m, book in enumerate(model.codebooks)]


def candidates(q: Array, model: Model, cells: Array, starts: Array, code: Array, middle: Array, keep: int, best: Best | None = None, chunk: int = 8192) -> Best:
    """The best `keep` rows for each prepared query among the rows of these cells; row numbers of cell b run from starts[b] to
    starts[b + 1]. Chunks double in size, so that each finds about `keep` better rows a query."""
    best = best or Best(len(q), keep)
    cells = cells[starts[cells + 1] > starts[cells]]
    if not len(cells):
        return best
    tables, to_cell = tables_of(q, model), np.ascontiguousarray(sq_distances(model.centroids[cells], q))
    numbers = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in cells])
    place = np.repeat(np.arange(len(cells)), starts[cells + 1] - starts[cells])
    at, size = 0, max(keep, 1024)
    while at < len(numbers):
        part = numbers[at : at + size]
        best.add(table_distances(tables, to_cell, place[at : at + size], code[part], middle[part]), part)
        at += size
        size = min(size * 2, chunk) if at > size else size
    return best
