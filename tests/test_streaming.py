from pyspark.sql import functions as F

from pointlake.plans.collection import Collection
from pointlake.streaming import ingest as G
from pointlake.types import PAYLOAD, CollectionConfig, Metric

SCHEMA = f"id string, order bigint, op string, vector array<float>, payload {PAYLOAD.simpleString()}"


def write(spark, rows, path):
    spark.createDataFrame([(*r, None) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ingest(spark, tmp_path):
    c = Collection(spark, CollectionConfig("c", 1, Metric.L2))
    src, ledger = str(tmp_path / "in"), tmp_path / "ledger.json"
    write(spark, [("a", 2, "upsert", [2.0]), ("a", 1, "upsert", [1.0]), ("b", 3, "upsert", [3.0]), ("d", 1, "upsert", [1.0]), ("d", 2, "delete", None)], src)
    G.ingest(G.change_stream(spark, src, SCHEMA), c, str(tmp_path / "cp"), ledger, available_now=True).awaitTermination()
    assert {r["id"]: r["vector"] for r in c.live().collect()} == {"a": [2.0], "b": [3.0]}
    write(spark, [("b", 4, "delete", None), ("e", 5, "upsert", [5.0])], src)
    G.ingest(G.change_stream(spark, src, SCHEMA), c, str(tmp_path / "cp"), ledger, available_now=True).awaitTermination()
    assert sorted(r["id"] for r in c.live().collect()) == ["a", "e"]
    again = G.foreach_batch(c, ledger)  # a batch that was already applied
    again(spark.createDataFrame([("z", 9, "upsert", [1.0], None)], SCHEMA), 0)
    assert c.count() == 2


def test_running_view(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, [("a", 1, "upsert", [1.0]), ("b", 2, "upsert", [2.0])], src)
    write(spark, [("a", 3, "delete", None), ("b", 5, "upsert", [5.0]), ("b", 4, "upsert", [4.0])], src)
    s = G.change_stream(spark, src, SCHEMA).select("id", "order", "op", F.col("vector").alias("value"))
    q = G.latest_by_key(s).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["id"], r["value"]) for r in spark.sql("select * from latest").collect()] == [("b", [5.0])]
