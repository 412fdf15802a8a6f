"""The engine's operators as queries over the test tables, each with SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions import filters as P
from pointlake.functions import vectors as V
from pointlake.operators import changes, compaction, search
from pointlake.plans import lifecycle
from pointlake.plans.collection import Collection
from pointlake.session import table
from pointlake.types import CollectionConfig, Metric, SearchRequest

Query = Callable[[SparkSession, str], DataFrame]
K = 10
NAMES = {"l2": Metric.L2, "l2sq": Metric.L2_SQUARED, "ip": Metric.INNER_PRODUCT, "cosine": Metric.COSINE}


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), P.tagged("int", F.col("label"))).alias("payload"))


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


# ---- SQL of the float32 arithmetic, summed in order

def s_sum(a: str, b: str, term: str) -> str:
    return f"coalesce(list_reduce(list_transform(list_zip({a}, {b}), lambda z: {term}), lambda x, y: x + y, 0::FLOAT), 0::FLOAT)"


def s_dot(a: str, b: str) -> str:
    return s_sum(a, b, "z[1] * z[2]")


def s_norm(a: str) -> str:
    return f"sqrt({s_dot(a, a)})::FLOAT"


def s_distance(name: str, a: str, b: str) -> str:
    sq = s_sum(a, b, "(z[1] - z[2]) * (z[1] - z[2])")
    den = f"({s_norm(a)} * {s_norm(b)})"
    return {
        "l2sq": sq,
        "l2": f"sqrt({sq})::FLOAT",
        "ip": f"(-{s_dot(a, b)} + 0::FLOAT)",
        "cosine": f"CASE WHEN {den} = 0 THEN 1::FLOAT ELSE (1::FLOAT - ({s_dot(a, b)} / {den})::FLOAT)::FLOAT END",
    }[name]


Q0 = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0) q0"
SQL: dict[str, str] = {}
QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- M1-M10, S1: distances of all rows; T1, T5: top-k

def _metric_queries(short: str, metric: Metric) -> None:
    d_sql = s_distance(short, "embedding", "q")

    @query(f"distance_{short}", f"SELECT CAST(vec_id AS VARCHAR) AS id, {d_sql} AS distance FROM embeddings, {Q0}")
    def _(spark: SparkSession, d: str) -> DataFrame:
        return search.score(points(spark, d), first_vector(spark, d), metric).select("id", "distance")

    @query(f"topk_{short}", f"SELECT CAST(vec_id AS VARCHAR) AS id, {d_sql} AS distance FROM embeddings, {Q0} ORDER BY distance, id LIMIT {K}")
    def _(spark: SparkSession, d: str) -> DataFrame:
        return search.topk(points(spark, d), first_vector(spark, d), K, metric)

    @query(f"arrow_topk_{short}", SQL[f"topk_{short}"])
    def _(spark: SparkSession, d: str) -> DataFrame:
        return search.arrow_topk(points(spark, d), first_vector(spark, d), K, metric)

    @query(f"batch_topk_{short}", f"""
        SELECT qid, id, distance, rank FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM (
            SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(e.vec_id AS VARCHAR) AS id, {s_distance(short, "e.embedding", "q.embedding")} AS distance
            FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= {K}""")
    def _(spark: SparkSession, d: str) -> DataFrame:
        p = points(spark, d)
        return search.batch_topk(p, p.where(F.col("id").cast("long") % 50 == 0).select(F.col("id").alias("qid"), "vector"), K, metric)


for _short, _metric in NAMES.items():
    _metric_queries(_short, _metric)

_SCALED = "list_transform(embedding, lambda x: (x * (1 + label))::FLOAT)"
_NORMED = f"(SELECT vec_id, list_transform(v, lambda x: (x / n)::FLOAT) AS v FROM (SELECT vec_id, v, {s_norm('v')} AS n FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings)))"


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: (x * (1 + F.col("label"))).cast("float")).alias("vector"))


@query("normalize_vectors", f"SELECT CAST(vec_id AS VARCHAR) AS id, v AS vector FROM {_NORMED}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d).select("id", V.normalized(F.col("vector")).alias("vector"))


@query("topk_normalized", f"SELECT CAST(n.vec_id AS VARCHAR) AS id, {s_distance('cosine', 'n.v', 'q.v')} AS distance FROM {_NORMED} n, {_NORMED} q WHERE q.vec_id = 0 ORDER BY distance, id LIMIT {K}")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = _scaled(spark, d).select("id", V.normalized(F.col("vector")).alias("vector"))
    return search.topk(p, p.where("id = '0'").first()["vector"], K, Metric.COSINE)


@query("topk_k_exceeds_n", f"SELECT CAST(vec_id AS VARCHAR) AS id, {s_distance('l2', 'embedding', 'q')} AS distance FROM embeddings, {Q0} ORDER BY distance, id LIMIT 1000000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.topk(points(spark, d), first_vector(spark, d), 1_000_000, Metric.L2)


_ZEROED = "(SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS v FROM embeddings UNION ALL SELECT 'zero', list_transform(embedding, lambda x: 0::FLOAT) FROM embeddings WHERE vec_id = 0)"


@query("topk_zero_vector_cosine", f"SELECT id, {s_distance('cosine', 'v', 'q')} AS distance FROM {_ZEROED}, {Q0} ORDER BY distance, id LIMIT 1000000")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("id", "vector")
    zero = p.where("id = '0'").select(F.lit("zero").alias("id"), F.transform("vector", lambda x: F.lit(0.0).cast("float")).alias("vector"))
    return search.topk(p.unionByName(zero), first_vector(spark, d), 1_000_000, Metric.COSINE)


@query("topk_with_vector", f"SELECT CAST(vec_id AS VARCHAR) AS id, {s_distance('ip', 'embedding', 'q')} AS distance, embedding AS vector FROM embeddings, {Q0} ORDER BY distance, id LIMIT {K}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.topk(points(spark, d), first_vector(spark, d), K, Metric.INNER_PRODUCT, ("vector",))


@query("topk_with_payload", f"SELECT CAST(vec_id AS VARCHAR) AS id, {s_distance('ip', 'embedding', 'q')} AS distance, CAST(label AS BIGINT) AS label FROM embeddings, {Q0} ORDER BY distance, id LIMIT {K}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.topk(points(spark, d), first_vector(spark, d), K, Metric.INNER_PRODUCT, ("payload",)).select("id", "distance", F.col("payload")["label"]["i"].alias("label"))


@query("filtered_topk", f"SELECT CAST(vec_id AS VARCHAR) AS id, {s_distance('l2', 'embedding', 'q')} AS distance FROM embeddings, {Q0} WHERE label = 3 ORDER BY distance, id LIMIT {K}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.topk(points(spark, d).where(P.compile_filter(P.Eq("label", 3))), first_vector(spark, d), K, Metric.L2)


@query("merge_topk", f"""
    WITH s AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, {s_distance('l2', 'embedding', 'q')} AS distance FROM embeddings, {Q0}),
    parts AS (SELECT id, distance FROM s UNION ALL SELECT id, distance FROM s WHERE vec_id % 8 = 0)
    SELECT id, min(distance) AS distance FROM parts GROUP BY id ORDER BY distance, id LIMIT {K}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, q = points(spark, d), first_vector(spark, d)
    part = F.col("id").cast("long") % 4
    parts = [search.topk(p.where(part == i), q, K, Metric.L2) for i in range(4)]
    return search.merge_topk([*parts, search.topk(p.where(F.col("id").cast("long") % 8 == 0), q, K, Metric.L2)], K)


@query("knn_points", f"""
    WITH u AS (SELECT p.collection, p.id, any_value(p.vector) AS v, any_value(c.metric) AS metric FROM points p JOIN collection_configs c ON c.name = p.collection
      WHERE len(p.vector) = c.dimension AND list_bool_and(list_transform(p.vector, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(p.vector, lambda x: x <> 0)) GROUP BY p.collection, p.id),
    h AS (SELECT q.collection, q.id AS qid, u.id, CASE q.metric WHEN 'cosine' THEN {s_distance('cosine', 'u.v', 'q.v')} WHEN 'innerProduct' THEN {s_distance('ip', 'u.v', 'q.v')} WHEN 'l2' THEN {s_distance('l2', 'u.v', 'q.v')} ELSE {s_distance('l2sq', 'u.v', 'q.v')} END AS distance
      FROM u JOIN u q ON u.collection = q.collection WHERE try_cast(q.id[-6:] AS BIGINT) % 50 = 0)
    SELECT collection, qid, id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY collection, qid ORDER BY distance, id) AS rank FROM h) WHERE rank <= {K}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.collection_knn(table(spark, d, "points"), table(spark, d, "collection_configs"), K, F.expr("try_cast(right(id, 6) as bigint) % 50 = 0"))


# ---- J1, T6

@query("get_by_ids", "SELECT v.ord, CAST(e.vec_id AS VARCHAR) AS id, e.embedding AS vector FROM embeddings e JOIN (VALUES (0, '7'), (2, '3'), (3, '7'), (4, '0')) v(ord, id) ON CAST(e.vec_id AS VARCHAR) = v.id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.get_by_ids(points(spark, d).select("id", "vector"), ["7", "missing", "3", "7", "0"]).select("ord", "id", "vector")


# ---- A1, L1, L2, P3: last write wins over the events, seen as a log

_LOG = "(SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, CASE WHEN event_type = '{gone}' THEN 'delete' ELSE 'upsert' END AS op, value FROM events)"


def _event_log(spark: SparkSession, d: str, gone: str | None = None) -> DataFrame:
    op = F.when(F.col("event_type") == gone, "delete").otherwise("upsert") if gone else F.lit("upsert")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.struct(F.col("event_id").alias("a")).alias("order"), op.alias("op"), "value")


def _apply(base: DataFrame | None, log: DataFrame) -> DataFrame:
    return changes.apply_changes(base, log, ("id",), F.floor(F.col("order.a") / 4096)).select("id", "value")


@query("lww_upsert", "SELECT CAST(user_id AS VARCHAR) AS id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _apply(None, _event_log(spark, d))


@query("delete_tombstone", f"SELECT id, arg_max(value, seq) AS value FROM {_LOG.format(gone='purchase')} GROUP BY id HAVING arg_max(op, seq) = 'upsert'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _apply(None, _event_log(spark, d, "purchase"))


@query("delete_then_reupsert", f"SELECT id, arg_max(value, seq) AS value FROM {_LOG.format(gone='click')} GROUP BY id HAVING arg_max(op, seq) = 'upsert' AND count(*) FILTER (op = 'delete') > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    log = _event_log(spark, d, "click")
    return _apply(None, log).join(log.where("op = 'delete'").select("id").distinct(), "id", "left_semi")


@query("later_segment_wins", """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id % 4 AS segment, event_id, value FROM events)
    SELECT id, arg_max(value, segment * 1000000000000 + event_id) AS value FROM e GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    base = e.where(F.col("event_id") % 4 < 3).select(F.col("user_id").cast("string").alias("id"), F.struct((F.col("event_id") % 4).alias("s"), F.col("event_id").alias("a")).alias("order"), F.lit("upsert").alias("op"), "value")
    log = e.where(F.col("event_id") % 4 == 3).select(F.col("user_id").cast("string").alias("id"), F.struct((F.col("event_id") % 4).alias("s"), F.col("event_id").alias("a")).alias("order"), F.lit("upsert").alias("op"), "value")
    return _apply(base, log)


# ---- L10, L13, L14, A2, A3 and the first problem: manifests, segments and the log

_PUBLISHED = """
    cur AS (SELECT db_id, collection, max(generation) AS generation, arg_max(segment_ids, generation) AS segment_ids FROM manifests WHERE format_version = 1 GROUP BY ALL),
    pub AS (SELECT db_id, collection, segment_id, max(pos) AS pos FROM (SELECT db_id, collection, unnest(segment_ids) AS segment_id, generate_subscripts(segment_ids, 1) AS pos FROM cur) GROUP BY ALL),
    seg AS (SELECT DISTINCT s.db_id, s.collection, segment_id, ids, payloads, tombstones, pos FROM segments s JOIN pub USING (db_id, collection, segment_id) WHERE len(ids) = row_count),
    start AS (SELECT w.db_id, w.collection, max((w.seq, w.ord)) AS s FROM wal_records w JOIN pub USING (db_id, collection, segment_id) WHERE op = 'seal' GROUP BY ALL)"""
_LIVE = f"""{_PUBLISHED},
    ev AS (
      SELECT db_id, collection, nfc_normalize(unnest(ids)) AS id, 0::BIGINT AS ph, pos::BIGINT AS a, 0::BIGINT AS b, unnest(list_transform(payloads, lambda p: p['stamp'].i)) AS stamp, 'upsert' AS op, segment_id FROM seg
      UNION ALL SELECT db_id, collection, nfc_normalize(unnest(tombstones)), 0, pos, 1, NULL, 'delete', segment_id FROM seg
      UNION ALL SELECT w.db_id, w.collection, nfc_normalize(id), 1, seq, ord, payload['stamp'].i, op, NULL FROM wal_records w LEFT JOIN start USING (db_id, collection) WHERE op IN ('upsert', 'delete') AND (s IS NULL OR (seq, ord) > s)),
    live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, collection, id ORDER BY ph DESC, a DESC, b DESC) AS rn FROM ev) WHERE rn = 1 AND op = 'upsert')"""


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "wal_records"), table(spark, d, "segments"), table(spark, d, "manifests")


@query("p1_found", f"WITH {_LIVE} SELECT db_id, collection, id, stamp FROM live")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    stamp = lambda p: p["stamp"]["i"]
    return changes.live_rows(*_three(spark, d), stamp(F.col("payload")), F.transform("payloads", stamp)).select("db_id", "collection", "id", F.col("value").alias("stamp"))


@query("p1_live_points")
def p1_live_points(spark: SparkSession, d: str) -> DataFrame:
    return changes.live_points(*_three(spark, d))


@query("p5_found", f"""WITH {_PUBLISHED},
    ev AS (SELECT db_id, collection, nfc_normalize(unnest(ids)) AS id, pos AS a, 0 AS b, segment_id, 'upsert' AS op FROM seg
      UNION ALL SELECT db_id, collection, nfc_normalize(unnest(tombstones)), pos, 1, NULL, 'delete' FROM seg)
    SELECT db_id, collection, id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY db_id, collection, id ORDER BY a DESC, b DESC) AS rn FROM ev) WHERE rn = 1 AND op = 'upsert'""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, segments, manifests = _three(spark, d)
    return compaction.compact_segments(segments, manifests).select("db_id", "collection", "id", "segment_id")


@query("replay_after_published_seal", f"WITH {_PUBLISHED} SELECT db_id, collection, s[1] AS seq, s[2] AS ord FROM start")
def _(spark: SparkSession, d: str) -> DataFrame:
    wal, _, manifests = _three(spark, d)
    return changes.replay_start(wal, changes.published_segments(manifests)).select("db_id", "collection", "start.seq", "start.ord")


@query("count_live", f"WITH {_LIVE} SELECT db_id, collection, count(*) AS n FROM live GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    nothing = F.lit(None).cast("boolean")
    live = changes.live_rows(*_three(spark, d), nothing, F.transform("ids", lambda _: nothing))
    return live.groupBy("db_id", "collection").agg(F.count(F.lit(1)).alias("n"))


@query("count_with_tombstones", f"""WITH {_LIVE},
    step AS (SELECT *, lag(op) OVER (PARTITION BY db_id, collection, id ORDER BY ph, a, b) AS before FROM ev),
    hit AS (SELECT db_id, collection, count(*) AS hits FROM (SELECT DISTINCT db_id, collection, id, a, b FROM step WHERE ph = 1 AND op = 'delete' AND before = 'upsert') GROUP BY ALL),
    n AS (SELECT db_id, collection, count(*) AS n FROM live GROUP BY ALL)
    SELECT db_id, collection, coalesce(n, 0) + coalesce(hits, 0) AS n FROM n FULL JOIN hit USING (db_id, collection)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return changes.count_with_tombstones(*_three(spark, d))


@query("next_segment_id", "SELECT db_id, collection, list_max(arg_max(segment_ids, generation)) + 1 AS next_id FROM manifests WHERE format_version = 1 GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return changes.next_segment_ids(table(spark, d, "manifests"))


@query("orphan_segments", f"WITH {_PUBLISHED} SELECT DISTINCT s.db_id, s.collection, s.segment_id FROM segments s ANTI JOIN pub USING (db_id, collection, segment_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    _, segments, manifests = _three(spark, d)
    return changes.orphans(segments, manifests)


@query("repaired_segment_id", """
    WITH m AS (SELECT db_id, collection, list_max(arg_max(segment_ids, generation)) + 1 AS next_id FROM manifests WHERE format_version = 1 GROUP BY ALL),
    k AS (SELECT db_id, collection, max(segment_id) + 1 AS next_id FROM segments GROUP BY ALL)
    SELECT db_id, collection, max(next_id) AS next_id FROM (SELECT * FROM m UNION ALL SELECT * FROM k) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The ids persisted here are those after every segment on disk, published or not."""
    _, segments, manifests = _three(spark, d)
    return changes.next_segment_ids(manifests, segments.groupBy("db_id", "collection").agg((F.max("segment_id") + 1).alias("next_id")))


_MEMBERS = ("stamp", "votes")
_WHOLE = f"""{_PUBLISHED.replace("ids, payloads, tombstones, pos", "row_count, vectors, ids, payloads, tombstones, pos")},
    ev AS (
      SELECT db_id, collection, nfc_normalize(ids[i]) AS id, 0::BIGINT AS ph, pos::BIGINT AS a, 0::BIGINT AS b, vectors[(i - 1) * (len(vectors) // row_count) + 1 : i * (len(vectors) // row_count)] AS vector, payloads[i] AS payload, 'upsert' AS op
        FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM seg)
      UNION ALL SELECT db_id, collection, nfc_normalize(unnest(tombstones)), 0, pos, 1, NULL, NULL, 'delete' FROM seg
      UNION ALL SELECT w.db_id, w.collection, nfc_normalize(id), 1, seq, ord, vector, payload, op FROM wal_records w LEFT JOIN start USING (db_id, collection) WHERE op IN ('upsert', 'delete') AND (s IS NULL OR (seq, ord) > s)),
    live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, collection, id ORDER BY ph DESC, a DESC, b DESC) AS rn FROM ev) WHERE rn = 1 AND op = 'upsert')"""


@query("p1_live_values", f"WITH {_WHOLE} SELECT db_id, collection, id, vector, cardinality(payload) AS members, {', '.join(f'payload[{chr(39)}{m}{chr(39)}].i AS {m}' for m in _MEMBERS)}, payload['title'].s AS title FROM live")
def p1_live_values(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("payload")
    return changes.live_points(*_three(spark, d)).select("db_id", "collection", "id", "vector", F.size(p).cast("bigint").alias("members"), *(p[m]["i"].alias(m) for m in _MEMBERS), p["title"]["s"].alias("title"))


# ---- P4-P11: the filter tree on payloads

_TAGS = {"eq": (P.Eq("site", "forge_qa"), "payload['site'].kind = 'string' AND payload['site'].s = 'forge_qa'"),
         "neq": (P.Neq("lang", "en"), "NOT coalesce(payload['lang'].kind = 'string' AND payload['lang'].s = 'en', false)"),
         "gte": (P.Gte("votes", 20), "payload['votes'].kind = 'int' AND payload['votes'].i >= 20"),
         "lte": (P.Lte("quality", 0.5), "payload['quality'].kind = 'double' AND payload['quality'].d <= 0.5"),
         "in": (P.In("lang", ("de", "fr")), "payload['lang'].kind = 'string' AND payload['lang'].s IN ('de', 'fr')"),
         "and_or_not": (P.And((P.Or((P.Eq("accepted", True), P.Gte("votes", 50))), P.Not(P.Eq("site", "sysroom")))),
                        "(coalesce(payload['accepted'].kind = 'bool' AND payload['accepted'].b, false) OR coalesce(payload['votes'].kind = 'int' AND payload['votes'].i >= 50, false)) AND NOT coalesce(payload['site'].kind = 'string' AND payload['site'].s = 'sysroom', false)")}


def _filter_query(name: str, tree: object, where: str) -> None:
    @query(f"filter_{name}", f"SELECT collection, id FROM points WHERE {where}")
    def _(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "points").where(P.compile_filter(tree)).select("collection", "id")


for _name, (_tree, _where) in _TAGS.items():
    _filter_query(_name, _tree, _where)


# ---- P12, M11: validation and checksums

@query("id_validity", "SELECT doc_id, coalesce(octet_length(encode(text)) BETWEEN 1 AND 512, false) AS valid FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.valid_id(F.col("text")).alias("valid"))


@query("usable_vectors", """SELECT collection, id, coalesce(len(vector) = dimension AND list_bool_and(list_transform(vector, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(vector, lambda x: x <> 0)), false) AS usable
    FROM points JOIN collection_configs ON name = collection""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "collection_configs").select(F.col("name").alias("collection"), "dimension")
    return table(spark, d, "points").join(F.broadcast(c), "collection").select("collection", "id", V.usable(F.col("vector"), F.col("dimension")).alias("usable"))


def s_crc(hexes: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits, bit by bit."""
    bit = "list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, {})"
    step = bit.format("xor(c, b)")
    return f"xor(list_reduce(list_transform(range(len({hexes}) // 2), lambda i: ('0x' || {hexes}[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


@query("crc32_ids", f"SELECT collection, id, {s_crc('h')} AS crc FROM (SELECT collection, id, hex(encode(id)) AS h FROM points)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "points").select("collection", "id", V.crc32(F.col("id")).alias("crc"))


@query("nfc_ids", "SELECT DISTINCT db_id, collection, nfc_normalize(id) AS id FROM wal_records WHERE id IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wal_records").where("id is not null").select("db_id", "collection", V.nfc(F.col("id")).alias("id")).distinct()


# ---- L1-L5, S4-S9 over the tables: a collection in use, and the checksums of segments

@query("collection_search", f"""SELECT CAST(vec_id AS VARCHAR) AS id, {s_distance('cosine', 'v', 'q')} AS distance FROM
    (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: (-x)::FLOAT) ELSE embedding END AS v FROM embeddings WHERE vec_id NOT IN (1, 2, 3)), {Q0} ORDER BY distance, id LIMIT 1000000""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    c = Collection(spark, CollectionConfig("c", 64, Metric.COSINE))
    c.upsert(p)
    c.upsert(p.where(F.col("id").cast("long") % 7 == 0).withColumn("vector", F.transform("vector", lambda x: -x)))
    c.delete(["1", "2", "3", "nobody"])
    return c.search_frame(SearchRequest(first_vector(spark, d), 1_000_000, with_payload=False))


@query("segments_complete", "SELECT db_id, collection, segment_id, len(ids) = row_count AND len(payloads) = row_count AS complete FROM segments")
def _(spark: SparkSession, d: str) -> DataFrame:
    return changes.verify_segments(table(spark, d, "segments")).select("db_id", "collection", "segment_id", "complete")


@query("segment_id_checksums", f"""SELECT db_id, collection, segment_id, CASE WHEN len(ids) = 0 THEN ids_crc32 = 0 ELSE {s_crc('h')} = ids_crc32 END AS ids_ok
    FROM (SELECT *, hex(encode(array_to_string(ids, chr(0)))) AS h FROM segments)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return changes.verify_segments(table(spark, d, "segments")).select("db_id", "collection", "segment_id", "ids_ok")


@query("segment_checksums")
def _(spark: SparkSession, d: str) -> DataFrame:
    return changes.verify_segments(table(spark, d, "segments"))


@query("manifest_generations", "SELECT db_id, collection, max(generation) AS generation, arg_max(segment_ids, generation) AS segment_ids FROM manifests WHERE format_version = 1 GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return changes.current_manifests(table(spark, d, "manifests")).select("db_id", "collection", "generation", "segment_ids")


QUERIES |= lifecycle.QUERIES
SQL |= lifecycle.SQL
