import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm import clusters as C
from pointlake.llm import diversity as D
from pointlake.llm import gmm, ivfpq
from pointlake.llm import neighbors as N
from pointlake.llm import vectors as V
from pointlake.types import PAYLOAD, payload_row

DIM = 16
POINTS = f"collection string, id string, vector array<float>, payload {PAYLOAD.simpleString()}, loaded_at timestamp"
CONFIGS = "name string, dimension int, metric string"
METRICS = ("cosine", "innerProduct", "l2", "l2Squared")
WITHIN = {"cosine": 0.05, "innerProduct": -0.95, "l2": 0.3163, "l2Squared": 0.1}


def groups(rng, sizes, noise, spread=0.03):
    """Unit vectors: tight groups around far centres, and single ones."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(len(sizes), DIM)))
    parts = [unit(c + spread * rng.normal(size=(n, DIM))) for c, n in zip(centres, sizes)]
    return np.concatenate([*parts, unit(rng.normal(size=(noise, DIM)))]).astype(np.float32)


@pytest.fixture(scope="module")
def tables(spark):
    rng, rows, t = np.random.default_rng(11), [], dt.datetime(2025, 1, 1)
    for m in METRICS:
        x = groups(rng, [40, 15, 12, 5, 200], 120)
        x[60:62] = x[5]  # identical vectors
        for i, v in enumerate(x):
            rows.append((m, f"{m[:2]}{i:04d}", v.tolist(), payload_row({"site": f"s{i % 4}", "tags": ["x", f"y{i % 2}"]}) if i % 5 else None, t))
        rows.append((m, f"{m[:2]}0003", x[3].tolist(), None, None))  # loaded again
        rows += [(m, "bad1", None, None, t), (m, "bad2", [], None, t), (m, "bad3", [1.0], None, t), (m, "bad4", [0.0] * DIM, None, t), (m, "bad5", [float("nan")] * DIM, None, t), (m, "bad6", [float("inf")] * DIM, None, t), (m, "bad7", [None] * DIM, None, t)]
    rows += [("unknown", "u", [1.0] * DIM, None, t), (None, "v", [1.0] * DIM, None, t), ("single", "only", [1.0] * DIM, None, t), *[("copies", f"c{i:03d}", [1.0] * DIM, None, t) for i in range(300)]]
    configs = spark.createDataFrame([(m, DIM, m) for m in METRICS] + [("single", DIM, "cosine"), ("copies", DIM, "l2"), ("empty", DIM, "l2"), ("odd", DIM, "angle"), ("null", None, "l2")], CONFIGS)
    clash = spark.createDataFrame(rows, POINTS).selectExpr("*", "'x' as vec", "1 as n", "2 as rep", "3 as h1", "'q' as carry")
    return clash, configs


@pytest.fixture(scope="module")
def plain(spark, tables):
    points, configs = tables
    known = V.shapes(configs)
    return known, {c: (g.id.to_numpy(), np.frombuffer(b"".join(g.vec), dtype="<f4").reshape(-1, DIM)) for c, g in V.usable(points, known).toPandas().groupby("collection")}


def test_usable(plain):
    known, data = plain
    assert set(known) == {*METRICS, "single", "copies", "empty"}
    assert {c: len(i) for c, (i, _) in data.items()} == {m: 392 for m in METRICS} | {"single": 1, "copies": 300}


def test_neighbors(tables, plain):
    known, data = plain
    got = {}
    for r in N.neighbors(*tables, k=5, block_rows=90, query_rows=100).collect():
        got.setdefault((r["collection"], r["id"]), {})[r["neighbor"]] = r["distance"]
    hits = total = 0
    for c, (ids, x) in data.items():
        d = C.metric_distances(x, x, known[c].metric)
        np.fill_diagonal(d, np.inf)
        place = {i: k for k, i in enumerate(ids)}
        for i, pid in enumerate(ids):
            mine = got.get((c, pid), {})
            assert pid not in mine and len(mine) == min(5, len(ids) - 1)
            for other, dist in mine.items():
                assert dist == pytest.approx(d[i, place[other]], abs=2e-6)
            if len(ids) > 5 and c != "copies":
                limit = np.sort(d[i])[4]
                hits += sum(d[i, place[o]] <= limit + 1e-7 for o in mine)
                total += 5
    assert hits / total >= 0.9


def test_near_pairs(tables, plain):
    known, data = plain
    near = {"cosine": 0.01, "innerProduct": -0.99, "l2": 0.1414, "l2Squared": 0.02}
    got = {tuple(r) for r in N.near_pairs(*tables, within=near, k=10).where("collection <> 'copies'").collect()}
    want = set()
    for c, (ids, x) in data.items():
        d = C.metric_distances(x, x, known[c].metric)
        np.fill_diagonal(d, np.inf)
        for i in range(len(ids)) if c != "copies" else ():
            for j in np.argsort(d[i], kind="stable")[:10]:
                if d[i, j] <= near[known[c].metric]:
                    want.add((c, min(ids[i], ids[j]), max(ids[i], ids[j])))
    assert len(want) > 500 and len(got & want) / len(want) > 0.9 and len(got - want) / len(got) < 0.05


def test_copies_share_the_first_ids(tables):
    got = {}
    for r in N.near_pairs(*tables, within={"cosine": 0, "innerProduct": -1, "l2": 0.0, "l2Squared": 0}, k=10).where("collection = 'copies'").collect():
        got.setdefault(r["id_b"], set()).add(r["id_a"])
    assert got["c299"] == {f"c{i:03d}" for i in range(10)} and got["c010"] == {f"c{i:03d}" for i in range(10)}


def test_copies_of_a_short_vector_come_after_nearer_ones(spark):
    v = [1.0] + [0.0] * (DIM - 1)
    long = [[2.0 + i] + [0.0] * (DIM - 1) for i in range(3)]
    points = spark.createDataFrame([("c", f"a{i:02d}", v, None, None) for i in range(12)] + [("c", f"z{i}", x, None, None) for i, x in enumerate(long)], POINTS)
    configs = spark.createDataFrame([("c", DIM, "innerProduct")], CONFIGS)
    got = {(r["neighbor"], r["distance"]) for r in N.neighbors(points, configs, k=10).where("id = 'a11'").collect()}
    assert got == {("z2", -4.0), ("z1", -3.0), ("z0", -2.0), *((f"a{i:02d}", -1.0) for i in range(7))}
    got = {r["neighbor"] for r in N.neighbors(points, configs, k=10, within={"innerProduct": -1.5}).where("id = 'a00'").collect()}
    assert got == {"z0", "z1", "z2"}


def test_best_and_tables_against_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    m = ivfpq.train(x, "l2", len(x), 9.0, 20, 8, 10_000)
    cell = ivfpq.nearest(x, m.centroids)
    order = np.argsort(cell, kind="stable")
    x, cell = x[order], cell[order]
    code, middle = m.encode(x, cell)
    starts = np.searchsorted(cell, np.arange(len(m.centroids) + 1))
    q = x[:50]
    best = ivfpq.candidates(q, m, np.arange(len(m.centroids)), starts, code, middle, 30)
    w = m.codebooks.shape[2]
    decoded = m.centroids[cell] + np.concatenate([m.codebooks[s][code[:, s]] for s in range(len(m.codebooks))], axis=1)
    assert w * len(m.codebooks) == 24
    want = np.sort(ivfpq.sq_distances(q, decoded), axis=1)[:, :30]
    assert np.allclose(np.sort(best.d, axis=1), want, atol=1e-3)
    exact = np.argsort(ivfpq.sq_distances(q, x), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, best.at)]) > 0.8


def brute_clusters(known, data, least):
    out = set()
    for c, (ids, x) in data.items():
        near = C.metric_distances(x, x, known[c].metric) <= WITHIN[known[c].metric]
        for i in range(len(ids)):
            s = np.flatnonzero(near[i])
            if len(s) >= least and all((near[j] == near[i]).all() for j in s):
                out |= {(c, min(ids[s]), ids[j]) for j in s}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_isolated_clusters(tables, plain, monkeypatch, small):
    if small:  # many leaves, levels, blocks and chunks
        for name, value in (("LEAF_ROWS", 64), ("WANTED_ROWS", 40), ("QUERY_BLOCK", 16), ("CHUNK", 50)):
            monkeypatch.setattr(C, name, value)
    want = brute_clusters(*plain, least=12)
    got = {tuple(r) for r in C.isolated(*tables, within=WITHIN).collect()}
    assert len({w[:2] for w in want}) >= 12 and ("copies", "c000", "c299") in want
    assert got <= want and len(got) >= 0.97 * len(want)


def test_a_near_point_spoils_a_cluster(spark):
    rng = np.random.default_rng(5)
    x = groups(rng, [30], 60, spread=0.02)
    far = x[:30].mean(0)
    outsider = x[0] + (x[0] - far) / np.linalg.norm(x[0] - far) * 0.9 * WITHIN["l2"]
    rows = [("c", f"p{i:03d}", v.tolist(), None, None) for i, v in enumerate(np.concatenate([x, outsider[None]]))]
    configs = spark.createDataFrame([("c", DIM, "l2")], CONFIGS)
    pts = lambda r: spark.createDataFrame(r, POINTS)
    assert C.isolated(pts(rows[:-1]), configs, WITHIN).count() == 30
    assert C.isolated(pts(rows), configs, WITHIN).count() == 0
    assert C.isolated(pts(rows).limit(0), configs, WITHIN).count() == 0


def test_peaks_without_a_component_are_asked(spark, monkeypatch):
    monkeypatch.setattr(C, "WANTED_ROWS", C.LEAF_ROWS)  # one leaf
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = [12] * 104 + [3] * 300
    x = np.concatenate([np.repeat(unit(rng.normal(size=(len(sizes), 64))), sizes, axis=0) + 0.045 * rng.normal(size=(sum(sizes), 64)), unit(rng.normal(size=(3000, 64)))]).astype(np.float32)
    points, configs = spark.createDataFrame([("c", f"p{i:04d}", v.tolist(), None, None) for i, v in enumerate(x)], POINTS), spark.createDataFrame([("c", 64, "cosine")], CONFIGS)
    d = C.metric_distances(x, x, "cosine")
    near = d <= 0.2
    want = {(f"p{s[0]:04d}", f"p{j:04d}") for s in (range(i, i + 12) for i in range(0, 1248, 12)) if near[s[0]].sum() == 12 and all((near[j] == near[s[0]]).all() for j in s) for j in s}
    got = {(r["cluster_id"], r["id"]) for r in C.isolated(points, configs, {"cosine": 0.2}).collect()}
    assert len(want) > 600 and got == want


def test_components(tables):
    c = C.describe(*tables, within=WITHIN).collect()
    sizes = {}
    for r in c:
        sizes[r["collection"]] = sizes.get(r["collection"], 0) + r["size"]
        assert 1 <= len(r["typical"]) <= 3
    assert sizes == {m: 392 for m in METRICS} | {"single": 1, "copies": 300}


def test_a_large_cluster_is_one_component(spark):
    x = groups(np.random.default_rng(8), [2 * C.LEAF_ROWS, 60, 30], 200)
    rows = [(m, f"p{i:05d}", v.tolist(), None, None) for m in ("l2", "cosine") for i, v in enumerate(x)]
    points, configs = spark.createDataFrame(rows, POINTS), spark.createDataFrame([(m, DIM, m) for m in ("l2", "cosine")], CONFIGS)
    large = 2 * C.LEAF_ROWS
    got = C.describe(points, configs, WITHIN).collect()
    for m in ("l2", "cosine"):
        mine = sorted((r for r in got if r["collection"] == m), key=lambda r: -r["size"])
        assert sum(r["size"] for r in mine) == len(x) and 0.98 * large <= mine[0]["size"] <= large + 20 and mine[1]["size"] <= 300
        assert len(mine[0]["typical"]) == 3 and all(int(i[1:]) < large for i in mine[0]["typical"])
    of = C.members(points, configs, WITHIN).toPandas()
    assert len(of) == len(rows) and not of.duplicated(["collection", "id"]).any()
    for m, g in of.groupby("collection"):
        top = g[g.id < f"p{large:05d}"].component.value_counts()
        assert top.iloc[0] >= 0.98 * large


def test_members_are_those_described(tables):
    size = {}
    for r in C.members(*tables, within=WITHIN).collect():
        size[r["collection"], r["component"]] = size.get((r["collection"], r["component"]), 0) + 1
    assert sorted((k[0], n) for k, n in size.items()) == sorted((r["collection"], r["size"]) for r in C.describe(*tables, within=WITHIN).collect())


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(6, 0.5, (200, 3))]).astype(np.float32)
    m, last = gmm.Mixture(np.full(2, 0.5), z[[0, 1]].astype(float), np.ones((2, 3))), -np.inf
    for _ in range(12):
        m, ll = gmm.maximised(gmm.statistics(m, z, np.ones(len(z))), 2, floor=0.0)
        assert ll >= last - 1e-3
        last = ll
    assert sorted(np.round(m.weight, 1)) == [0.4, 0.6]
    halves = sum(gmm.statistics(m, z[i::2], np.ones(250)) for i in range(2))
    assert np.allclose(halves, gmm.statistics(m, z, np.ones(len(z))), rtol=1e-4)  # statistics add up


def test_subset(spark, tables, plain):
    _, data = plain
    requests = spark.createDataFrame([(1, "cosine", 10, "site"), (2, "l2", 60, None), (3, "copies", 5, None), (4, "single", 9, "tags"), (5, "cosine", 395, None), (6, "gone", 3, None), (7, "l2", 0, None), (None, "l2", 2, None), (8, "l2Squared", 12, "tags"), (8, "l2Squared", 12, "tags")], "request_id int, collection string, subset_size int, payload_key string")
    got = {}
    for r in D.varied(*tables, requests).collect():
        got.setdefault(r["request_id"], {})[r["id"]] = r["pick"]
    assert {k: len(v) for k, v in got.items()} == {1: 10, 2: 60, 3: 5, 4: 1, 5: 395, 8: 12}
    assert all(sorted(v.values()) == list(range(1, len(v) + 1)) for v in got.values())
    assert sum(i.startswith("bad") for i in got[5]) == 3  # usable points come first
    ids, x = data["l2"]
    chosen = x[[list(ids).index(i) for i in got[2]]]
    d = C.metric_distances(chosen, chosen, "l2")
    np.fill_diagonal(d, 9)
    assert d.min() > 0.2 or (d < 0.2).sum() < 6  # hardly two of one group, though most points are in groups
    same = {r["id"] for r in D.varied(tables[0].repartition(9), tables[1], requests.where("request_id = 1")).collect()}
    assert len(same & set(got[1])) >= 5
    assert D.varied(tables[0].limit(0), tables[1], requests).count() == 0 and D.varied(*tables, requests.limit(0)).count() == 0


def test_pivots_reveal_the_rank():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 8))
    ids = np.array([f"{i:02d}" for i in range(40)], dtype=object)
    p = D.pivots(a, ids, 40)
    assert len(p) == 3 and np.linalg.matrix_rank(a[p]) == 3 and p[0] == int((a * a).sum(1).argmax())
    assert D.pivots(np.zeros((4, 3)), ids[:4], 2) == [] and D.pivots(np.ones((4, 3)), ids[:4][::-1].copy(), 2) == [3]


def test_each_value_has_its_own_feature(spark):
    names = [f"v{i:03d}" for i in range(200)]
    x = np.tile(np.eye(1, DIM), (200, 1))
    _, values = D.features(x, "cosine", [[f"string:{n}"] for n in names])
    ids = np.array(names, dtype=object)
    assert len(D.pivots(x, ids, 200, values)) == 200  # equal vectors, but no two equal values
    rng = np.random.default_rng(2)
    x = np.concatenate([np.eye(DIM)[:1] + 0.01 * rng.normal(size=(900, DIM)), np.eye(DIM)[:1] + 0.01 * rng.normal(size=(150, DIM))])
    site = ["common"] * 900 + [f"rare{i % 150}" for i in range(150)]
    points = spark.createDataFrame([("c", f"p{i:04d}", v.tolist(), payload_row({"site": s}), None) for i, (v, s) in enumerate(zip(x, site))], POINTS)
    requests = spark.createDataFrame([(1, "c", 120, "site")], "request_id int, collection string, subset_size int, payload_key string")
    got = [r["id"] for r in D.varied(points, spark.createDataFrame([("c", DIM, "cosine")], CONFIGS), requests).collect()]
    assert len(got) == 120 and len({site[int(i[1:])] for i in got}) >= 110


def test_pivots_of_sparse_values_are_those_of_indicator_columns():
    rng = np.random.default_rng(4)
    x, values = rng.normal(size=(60, 8)), [[f"v{k}" for k in rng.integers(0, 9, rng.integers(0, 4))] for _ in range(60)]
    z, sparse = D.features(x, "cosine", values)
    wide = np.zeros((60, sparse.codes))
    wide[sparse.row, sparse.code] = sparse.amount
    ids = rng.permutation(np.array([f"{i:02d}" for i in range(60)], dtype=object))
    assert D.pivots(z, ids, 60, sparse) == D.pivots(np.concatenate([z, wide], axis=1), ids, 60)
    assert len(D.pivots(z, ids, 60, sparse)) > 10


def test_a_large_subset_takes_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, DIM)).astype(np.float32)
    points, configs = spark.createDataFrame([("c", f"p{i:04d}", v.tolist(), None, None) for i, v in enumerate(x)], POINTS), spark.createDataFrame([("c", DIM, "cosine")], CONFIGS)
    calls, true = [], D._round
    monkeypatch.setattr(D, "_round", lambda *a: calls.append(1) or true(*a))
    got = D.varied(points, configs, spark.createDataFrame([(1, "c", 2500, None)], "request_id int, collection string, subset_size int, payload_key string")).collect()
    assert len({r["id"] for r in got}) == 2500 and len(calls) == 2


def test_subset_covers_better_than_chance_and_large_groups_take_no_more_than_their_due(spark):
    rng = np.random.default_rng(6)
    x = groups(rng, [900, 500, *[8] * 60], 200)
    points, configs = spark.createDataFrame([("c", f"p{i:04d}", v.tolist(), None, None) for i, v in enumerate(x)], POINTS), spark.createDataFrame([("c", DIM, "cosine")], CONFIGS)
    requests = spark.createDataFrame([(1, "c", 150, None)], "request_id int, collection string, subset_size int, payload_key string")
    picks = D.varied(points, configs, requests).cache()
    by_chance = spark.createDataFrame([(1, "c", f"p{i:04d}") for i in rng.choice(len(x), 150, replace=False)], "request_id int, collection string, id string")
    of = {}
    for name, p in (("varied", picks), ("chance", by_chance)):
        c = D.cover(points, configs, p).toPandas()
        assert len(c) == len(x) and (c[c.id == c.pick_id].distance.abs() < 1e-6).all()
        of[name] = (c.distance.max(), (c.distance > 0.05).sum())
    assert of["varied"][0] < of["chance"][0] and of["varied"][1] < 0.6 * of["chance"][1]
    ids = [int(r["id"][1:]) for r in picks.collect()]
    assert sum(i < 900 for i in ids) <= 15 and len({(i - 1400) // 8 for i in ids if 1400 <= i < 1880}) >= 30  # 900 of 2,080 rows are one group, 60 of 8 and 200 single ones share the rest
    sizes = D.covered(points, configs, picks).collect()
    assert sum(r["members"] for r in sizes) == len(x) and max(r["members"] for r in sizes) >= 300


def test_cover_in_blocks_and_edge_cases(spark, tables, monkeypatch):
    picks = spark.createDataFrame([(1, "l2", f"l2{i:04d}") for i in range(0, 392, 10)] + [(2, "cosine", "bad1"), (3, "gone", "x"), (4, "copies", "c007"), (4, "copies", "c003")], "request_id int, collection string, id string")
    whole = sorted(map(tuple, D.cover(*tables, picks).collect()))
    assert {r[0] for r in whole} == {1, 4} and {r[3] for r in whole if r[0] == 4} == {"c003"} and sum(r[0] == 1 for r in whole) == 392
    monkeypatch.setattr(D, "PICK_BYTES", 1000)
    assert sorted(map(tuple, D.cover(*tables, picks).collect())) == whole
    assert D.cover(*tables, picks.limit(0)).count() == 0


def test_small_clusters_in_a_leaf_that_is_cut(spark, monkeypatch):
    monkeypatch.setattr(C, "WANTED_ROWS", 10**9)  # one leaf
    monkeypatch.setattr(C, "plant", lambda reps, known, within, plant=C.plant: cut_in_ten(plant(reps, known, within), reps, known))
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([np.repeat(unit(rng.normal(size=(60, 64))), 12, axis=0) + 0.02 * rng.normal(size=(720, 64)), unit(rng.normal(size=(4000, 64)))]).astype(np.float32)
    points, configs = spark.createDataFrame([("c", f"p{i:04d}", v.tolist(), None, None) for i, v in enumerate(x)], POINTS), spark.createDataFrame([("c", 64, "cosine")], CONFIGS)
    got = {}
    for r in C.isolated(points, configs, {"cosine": 0.1}).collect():
        got.setdefault(r["cluster_id"], set()).add(r["id"])
    assert len(got) == 60 and all(len(g) == 12 for g in got.values())


def cut_in_ten(planted, reps, known):
    trees, pieces = planted
    t = trees["c"]
    z = t.features(np.array([np.frombuffer(r["vec"], dtype="<f4") for r in reps.select("vec").collect()]))
    pieces["c", ""] = C.Cut.of(z.mean(0), z.var(0), 10)
    assert len(np.unique(pieces["c", ""](z))) >= 10
    return trees, pieces


def test_exact_neighbors(tables, plain):
    known, data = plain
    got = {}
    for r in N.neighbors(*tables, k=5, exact=True, block_rows=90).where("collection <> 'copies'").collect():
        got.setdefault((r["collection"], r["id"]), []).append(r["distance"])
    for c, (ids, x) in data.items():
        if c != "copies" and len(ids) > 5:
            d = C.metric_distances(x, x, known[c].metric)
            np.fill_diagonal(d, np.inf)
            for i, pid in enumerate(ids):
                assert np.allclose(sorted(got[c, pid]), np.sort(d[i])[:5], atol=2e-6)


def test_cells_within_a_radius_hold_all_rows_within_it():
    rng = np.random.default_rng(14)
    x = (np.repeat(rng.normal(size=(100, 24)), 30, axis=0) + 0.15 * rng.normal(size=(3000, 24))).astype(np.float32)
    for metric, within in (("l2", 1.2), ("cosine", 0.03), ("innerProduct", -25.0)):
        top = float(np.linalg.norm(x, axis=1).max())
        m = ivfpq.train(x[::2], metric, len(x), top, 120, 8, 500, within)
        cell = ivfpq.nearest(m.prepared(x), m.centroids)
        asked = m.probes(m.as_query(x))
        a, b = np.nonzero(ivfpq.flat(metric, x, x) <= within)
        assert len(a) > 10_000 and asked[a, cell[b]].all() and (metric == "innerProduct" or asked.mean() < 0.7)
        m.near_cells = 8
        assert m.probes(m.as_query(x)).sum(1).mean() < 8.5


def test_a_third_of_the_rows_in_one_cell(spark):
    rng = np.random.default_rng(12)
    x = groups(rng, [3000], 6000)
    points, configs = spark.createDataFrame([("c", f"p{i:04d}", v.tolist(), None, None) for i, v in enumerate(x)], POINTS), spark.createDataFrame([("c", DIM, "l2")], CONFIGS)
    near = {"l2": 0.1}
    small, whole = (N.near_pairs(points, configs, near, **how) for how in ({"block_rows": 300, "query_rows": 300}, {"exact": True}))
    assert small.exceptAll(whole).count() <= 0.02 * whole.count() and whole.exceptAll(small).count() <= 0.02 * whole.count() and whole.count() > 3000
