import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pointlake.llm import mixing as M

TARGETS = "mix string, source string, target_share double, max_repeats int, total_factor double"


def test_knapsack_against_all_subsets():
    rng = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 4))))
        have = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, 60)
        best = max(s for c in itertools.product(*[range(h + 1) for h in have]) if (s := int(np.dot(c, lengths))) <= budget)
        used = M.knapsack(lengths, have, budget)
        assert (used <= have).all() and int(used @ lengths) == best


def test_fit():
    lengths, counts = np.array([10, 20]), np.array([5, 5])
    assert M.fit(lengths, counts, 400, 9, 1)[0] == 2
    passes, extra = M.fit(lengths, counts, 10_000, 3, 1)
    assert passes == 3 and not extra.any()
    passes, extra = M.fit(lengths, counts, 90, 1, 1)
    assert passes == 0 and int(extra @ lengths) == 90 and (extra <= counts).all()
    for budget, repeats in ((0, 3), (50, 0)):
        assert M.fit(lengths, counts, budget, repeats, 1)[0] == 0


def docs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["A", "a ", "B", None]), "word " * rng.randint(1, 60)) for i in range(600)]
    rows += [(1000 + i, "hot", "the same text") for i in range(400)] + [(2000, "B", ""), (2001, "B", None), (0, rows[0][1], rows[0][2]), (None, "A", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("n_tokens", F.lit("clash"))


def test_mix(spark):
    d = docs(spark)
    targets = spark.createDataFrame([("m", "A", 0.5, 2, 0.6), ("m", "b", 0.3, 4, 0.6), ("m", "HOT", 0.2, 1, 0.6), ("n", "a", 1.0, 3, 9.0), ("n", "nobody", 0.0, 3, 9.0), (None, "a", 1.0, 1, 1.0), ("z", "gone", 1.0, 1, 1.0)], TARGETS)
    got = M.mix(d, targets).collect()
    sized = {r["doc_id"]: r for r in M.sized(d).collect()}
    total = sum(r["n_tokens"] for r in sized.values())
    assert len(sized) == 600 + 400 + 2 and len({(r["mix"], r["doc_id"]) for r in got}) == len(got)
    tokens = {}
    for r in got:
        assert r["n_tokens"] == sized[r["doc_id"]]["n_tokens"] > 0 and r["source"] == sized[r["doc_id"]]["source"]
        tokens[r["mix"], r["source"]] = tokens.get((r["mix"], r["source"]), 0) + r["n_tokens"] * r["copies"]
    held = {s: sum(r["n_tokens"] for r in sized.values() if r["source"] == s) for s in ("a", "b", "hot")}
    for (mix, source), share, repeats, factor in ((("m", "a"), 0.5, 2, 0.6), (("m", "b"), 0.3, 4, 0.6), (("m", "hot"), 0.2, 1, 0.6)):
        budget = round(share * factor * total)
        assert max(r["copies"] for r in got if r["mix"] == mix and r["source"] == source) <= repeats
        if budget <= repeats * held[source]:
            assert budget - 3 < tokens[mix, source] <= budget
        else:
            assert tokens[mix, source] == repeats * held[source]
    assert tokens["n", "a"] == 3 * held["a"] and {r["mix"] for r in got} == {"m", "n"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(d.repartition(7), targets).collect()))  # seeded
    shares = {(r["mix"], r["source"]): r for r in M.shares(M.mix(d, targets), total, targets.where("mix = 'm'")).collect()}
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9 and shares["m", "a"]["tokens"] == tokens["m", "a"]
    assert M.mix(d.limit(0), targets).count() == 0 and M.mix(d, targets.limit(0)).count() == 0


def test_large_groups_are_cut_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 16)
    d = spark.createDataFrame([(i, "s", "one two three") for i in range(500)], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("m", "s", 1.0, 2, 1.35)], TARGETS)
    got = M.mix(d, t).collect()
    per = got[0]["n_tokens"]
    assert sum(r["copies"] for r in got) == (round(1.35 * 500 * per)) // per and {r["copies"] for r in got} == {1, 2}


def test_targets_that_name_a_source_twice(spark):
    d = spark.createDataFrame([(i, "a" if i % 2 else "b", "one two three four") for i in range(40)], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("m", "a", 0.25, 2, 0.5), ("m", " A ", 0.25, 3, 0.5), ("m", "b", 0.5, 1, 0.5), ("m", None, 0.5, 1, 0.5), ("m", "  ", 0.5, 1, 0.5)], TARGETS)
    sizes = M.sized(d)
    got = {r["source"]: r for r in M.shares(M.mix(d, t), M.total_tokens(sizes), t).collect()}
    assert set(got) == {"a", "b"} and all(abs(r["share"] - 0.5) < 1e-9 and r["target_share"] == 0.5 and r["tokens"] == r["budget"] for r in got.values()) and got["a"]["max_repeats"] == 3
    none = M.shares(M.mix(d.limit(0), t), 0, t).collect()
    assert len(none) == 2 and all(r["tokens"] == 0 and r["share"] is None for r in none)
