"""Queries of this subpackage's operators over the test tables, and SQL where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import clusters, diversity, mixing, neighbors, residue, tokens
from pointlake.llm.sources import source_key
from pointlake.operators import search
from pointlake.session import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@query("p6_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


@query("p6_counts")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count(table(spark, d, "documents"))


@query("p6_bounds", "SELECT doc_id, coalesce(text, '') = '' AS none, true AS within_bytes FROM documents")
def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Only null and empty texts have no tokens, and no text has more tokens than bytes."""
    docs = table(spark, d, "documents")
    n = tokens.count(docs).join(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), "doc_id")
    return n.select("doc_id", (F.col("n_tokens") == 0).alias("none"), (F.col("n_tokens") <= F.col("bytes")).alias("within_bytes"))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find(table(spark, d, "documents"))


@query("p7_mix")
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    sizes = stage(mixing.sized(table(spark, d, "documents")), "sized")
    return mixing.shares(mixing.mix_sized(sizes, targets), mixing.total_tokens(sizes), targets)


@query("p7_holds", r"""WITH d AS (SELECT doc_id, nullif(lower(regexp_replace(source, '^[\s\x{A0}\x{200B}\x{3000}]+|[\s\x{A0}\x{200B}\x{3000}]+$', '', 'g')), '') AS source, coalesce(text, '') <> '' AS has_text FROM documents),
    t AS (SELECT DISTINCT mix, lower(trim(source)) AS source FROM mix_targets WHERE target_share > 0)
    SELECT mix, source, true AS within_budget, true AS within_repeats, true AS of_source, (SELECT count(*) FROM d WHERE d.source = t.source AND has_text) > 0 AS used FROM t""")
def p7_holds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source of each mix keeps to its budget and repeats, holds documents of that source only, and is used at all."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sizes = stage(mixing.sized(docs), "sized")
    mixed = stage(mixing.mix_sized(sizes, targets), "mixed")
    own = mixed.join(docs.select("doc_id", source_key(F.col("source")).alias("true")).distinct(), "doc_id").groupBy("mix", "source").agg(F.bool_and(F.col("true") == F.col("source")).alias("own"))
    s = mixing.shares(mixed, mixing.total_tokens(sizes), targets).join(own, ["mix", "source"], "left")
    return s.select("mix", "source", (F.col("tokens") <= F.col("budget")).alias("within_budget"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), F.coalesce("own", F.lit(True)).alias("of_source"), (F.col("tokens") > 0).alias("used"))


# Distances up to which two points are near in the stated cases.
NEAR = {"cosine": 0.015, "innerProduct": -0.985, "l2": 0.173, "l2Squared": 0.03}


_USABLE = """u AS (SELECT p.collection, p.id, any_value(p.vector)::DOUBLE[] AS v, any_value(c.metric) AS metric FROM points p JOIN collection_configs c ON c.name = p.collection
      WHERE len(p.vector) = c.dimension AND list_bool_and(list_transform(p.vector, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(p.vector, lambda x: x <> 0)) GROUP BY p.collection, p.id),
    n AS (SELECT *, list_inner_product(v, v) AS sq FROM u),
    d AS (SELECT a.collection, a.metric, a.id AS a, b.id AS b, CASE a.metric WHEN 'innerProduct' THEN -list_inner_product(a.v, b.v) WHEN 'cosine' THEN 1 - list_inner_product(a.v, b.v) / sqrt(a.sq * b.sq)
      WHEN 'l2' THEN sqrt(greatest(a.sq + b.sq - 2 * list_inner_product(a.v, b.v), 0)) ELSE greatest(a.sq + b.sq - 2 * list_inner_product(a.v, b.v), 0) END AS distance FROM n a JOIN n b ON a.collection = b.collection)"""


def _limit(within: dict[str, float]) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in within.items()) + " END"


@query("p3_found", f"""WITH {_USABLE},
    r AS (SELECT *, row_number() OVER (PARTITION BY collection, a ORDER BY distance, b) AS rank FROM d WHERE a <> b)
    SELECT DISTINCT collection, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rank <= 10 AND distance <= {_limit(NEAR)}""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.near_pairs(table(spark, d, "points"), table(spark, d, "collection_configs"), NEAR)


@query("p3_neighbors")
def p3_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors(table(spark, d, "points"), table(spark, d, "collection_configs"))


# Distances within which two points of a cluster are in the stated cases.
TOGETHER = {"cosine": 0.15, "innerProduct": -0.85, "l2": 0.5477, "l2Squared": 0.3}


@query("p4_found", f"""WITH {_USABLE},
    s AS (SELECT collection, a AS id, list_sort(list(b)) AS near FROM d WHERE distance <= {_limit(TOGETHER)} GROUP BY collection, a)
    SELECT collection, near[1] AS cluster_id, unnest(near) AS id FROM s GROUP BY collection, near HAVING count(*) = len(near) AND len(near) >= 12""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.isolated(table(spark, d, "points"), table(spark, d, "collection_configs"), TOGETHER)


@query("p3_neighbor_counts", f"""WITH {_USABLE}, size AS (SELECT collection, count(*) AS n FROM u GROUP BY ALL)
    SELECT collection, id, least(10, size.n - 1) AS neighbors FROM u JOIN size USING (collection) WHERE size.n > 1""")
def p3_neighbor_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_neighbors(spark, d).groupBy("collection", "id").agg(F.countDistinct("neighbor").alias("neighbors"))


@query("p3_recall", "SELECT true AS enough, 10::BIGINT AS k")
def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether at least 0.9 of the ten nearest of every fiftieth point, by an exact search over all points, are found."""
    points, configs = table(spark, d, "points"), table(spark, d, "collection_configs")
    true = search.collection_knn(points, configs, 11, F.expr("try_cast(right(id, 6) as bigint) % 50 = 0")).where("qid <> id").select("collection", "qid", "distance", "rank")
    limit = true.groupBy("collection", "qid").agg(F.max(F.when(F.col("rank") <= 11, F.col("distance"))).alias("limit"), F.least(F.count(F.lit(1)), F.lit(10)).alias("n"))
    found = neighbors.neighbors(points, configs).select("collection", F.col("id").alias("qid"), F.col("distance").alias("d"))
    hits = limit.join(found, ["collection", "qid"], "left").groupBy("collection", "qid").agg(F.max("n").alias("n"), F.count_if(F.col("d") <= F.col("limit") + 1e-5).alias("hits"))
    return hits.agg((F.sum(F.least("hits", "n")) >= 0.9 * F.sum("n")).alias("enough")).select("enough", F.lit(10).cast("long").alias("k"))


@query("p4_components")
def p4_components(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(table(spark, d, "points"), table(spark, d, "collection_configs"), TOGETHER)


@query("p4_members")
def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.members(table(spark, d, "points"), table(spark, d, "collection_configs"), TOGETHER)


@query("p4_member_ids", f"WITH {_USABLE} SELECT collection, id, 1::BIGINT AS components FROM u")
def p4_member_ids(spark: SparkSession, d: str) -> DataFrame:
    """In how many components each usable point is: one."""
    return p4_members(spark, d).groupBy("collection", "id").agg(F.countDistinct("component").alias("components"))


@query("p4_component_sizes", f"WITH {_USABLE} SELECT collection, count(*) AS points FROM u GROUP BY collection")
def p4_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p4_components(spark, d).groupBy("collection").agg(F.sum("size").alias("points"))


@query("p2_subset")
def p2_subset(spark: SparkSession, d: str) -> DataFrame:
    return diversity.varied(table(spark, d, "points"), table(spark, d, "collection_configs"), table(spark, d, "subset_requests"))


@query("p2_coverage")
def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    points, configs = table(spark, d, "points"), table(spark, d, "collection_configs")
    return diversity.cover(points, configs, p2_subset(spark, d))


@query("p2_covered", """WITH u AS (SELECT DISTINCT p.collection, p.id FROM points p JOIN collection_configs c ON c.name = p.collection
      WHERE len(p.vector) = c.dimension AND list_bool_and(list_transform(p.vector, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(p.vector, lambda x: x <> 0))),
    n AS (SELECT collection, count(*) AS n FROM u GROUP BY ALL), a AS (SELECT collection, count(DISTINCT id) AS n FROM points GROUP BY ALL)
    SELECT request_id, r.collection, n.n AS points, least(subset_size, a.n) AS picks FROM subset_requests r JOIN n ON n.collection = r.collection JOIN a ON a.collection = r.collection""")
def p2_covered(spark: SparkSession, d: str) -> DataFrame:
    """Of each request: how many points its picks cover (all usable ones), and how many picks there are (as many as asked for)."""
    picks = stage(p2_subset(spark, d), "picks")
    cover = diversity.cover(table(spark, d, "points"), table(spark, d, "collection_configs"), picks)
    points = cover.groupBy("request_id", "collection").agg(F.countDistinct("id").alias("points"))
    return points.join(picks.groupBy("request_id").agg(F.countDistinct("id").alias("picks")), "request_id")


@query("p2_nearest_pick", f"""WITH {_USABLE},
    k AS (SELECT collection, a AS id, b AS pick_id, round(distance, 9) AS distance FROM d WHERE try_cast(b[-6:] AS BIGINT) % 50 = 0)
    SELECT 1 AS request_id, collection, id, arg_min(pick_id, (distance, pick_id)) AS pick_id, round(min(distance), 6) + 0.0 AS distance FROM k GROUP BY collection, id""")
def p2_nearest_pick(spark: SparkSession, d: str) -> DataFrame:
    """The covering of all points by a stated set, those whose number is divisible by 50."""
    points = table(spark, d, "points")
    picks = points.where(F.expr("try_cast(right(id, 6) as bigint) % 50 = 0")).select(F.lit(1).alias("request_id"), "collection", "id")
    return diversity.cover(points, table(spark, d, "collection_configs"), picks).withColumn("distance", F.round("distance", 6) + F.lit(0.0))
