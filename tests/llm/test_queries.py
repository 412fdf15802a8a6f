import pytest

from pointlake.llm.queries import QUERIES, SQL

from ..oracle import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_first_of_each_problem():
    first = {}
    for name in QUERIES:
        first.setdefault(name.split("_")[0], name)
    assert first == {"p2": "p2_subset", "p3": "p3_found", "p4": "p4_found", "p6": "p6_ids", "p7": "p7_mix", "p8": "p8_found"}


def test_subset_and_mix(spark):
    picks = QUERIES["p2_subset"](spark, str(DATA)).collect()
    have = {r["collection"]: r["n"] for r in spark.read.parquet(f"{DATA}/points.parquet").groupBy("collection").agg({"id": "count"}).selectExpr("collection", "`count(id)` n").collect()}
    for r in spark.read.parquet(f"{DATA}/subset_requests.parquet").collect():
        mine = [p for p in picks if p["request_id"] == r["request_id"]]
        assert len({p["id"] for p in mine}) == len(mine) <= r["subset_size"] and (len(mine) == r["subset_size"] or len(mine) <= have[r["collection"]])
    shares = QUERIES["p7_shares"](spark, str(DATA)).collect()
    assert len(shares) == 24 and all(r["tokens"] <= r["budget"] and r["most_copies"] <= r["max_repeats"] for r in shares)
