import pytest

from pointlake.functions.filters import And, Eq, Gte, In, Lte, Neq, Not, Or, compile_filter
from pointlake.types import PAYLOAD, payload_python, payload_row

PAYLOADS = {"a": {"n": 1, "s": "x", "t": ["p", "q"]}, "b": {"n": 1.0, "s": "y"}, "c": {"n": None}, "d": {}, "e": None, "f": {"n": True, "s": "1"}}


@pytest.fixture(scope="module")
def df(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("payload", PAYLOAD)])
    return spark.createDataFrame([(k, payload_row(v) if v is not None else None) for k, v in PAYLOADS.items()], schema)


@pytest.mark.parametrize("tree, want", [
    (Eq("n", 1), "a"), (Eq("n", 1.0), "b"), (Eq("n", None), "c"), (Eq("n", True), "f"), (Eq("t", ["p", "q"]), "a"), (Neq("n", 1), "bcdef"), (Gte("n", 1), "a"), (Lte("n", 2.5), "b"),
    (Gte("s", "x"), "ab"), (In("s", ("x", "1")), "af"), (In("s", ()), ""), (And(()), "abcdef"), (Or(()), ""), (Not(Eq("s", "x")), "bcdef"), (And((Gte("s", "x"), Neq("n", 1))), "b"), (Or((Eq("s", "x"), Eq("n", None))), "ac"), (Gte("t", ["a"]), ""),
])
def test_filters(df, tree, want):
    assert "".join(sorted(r["id"] for r in df.where(compile_filter(tree)).collect())) == want


def test_payload_round_trip(df):
    assert {r["id"]: payload_python(r["payload"]) for r in df.collect()} == {k: v or {} for k, v in PAYLOADS.items()}
