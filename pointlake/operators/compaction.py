"""Far too many small files: consolidate them into few of good size.

The work is left to the scan: with the maximum partition size at the wanted file size and a low cost for opening a file, the engine
packs many small files into one combined split; each split is written as one file, coalesced without a shuffle. The output is
staged, compared with the sources and only then renamed to its place. `pack_files` does so with files as they are;
`compact_segments` on the way leaves out the rows that don't survive.
"""
from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.operators.changes import located, published_segments, row_places, rows_at, segment_changes
from pointlake.session import drop_path, has_map, rename_path, settings, small, stage, stage_path
from pointlake.types import Corrupted, InvalidArgument


@dataclass(frozen=True)
class Packed:
    path: str
    rows: int
    files_before: int
    files_after: int


def _size(df: DataFrame) -> tuple[int, int]:
    """(files, bytes) that a read of files takes, as the engine's own (parallel) listing found them."""
    return len(df._jdf.inputFiles()), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free checksum over all columns); repeated rows count as often as they occur."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def _publish(spark: SparkSession, staged: str, out: str) -> None:
    if not rename_path(spark, staged, out):
        raise Corrupted(out, "the staged output could not be published")


def pack_files(spark: SparkSession, sources: list[str], out: str, target_bytes: int = 128 << 20, open_cost: int = 64 << 10) -> Packed:
    """Rewrite the Parquet files under sources as few files of about target_bytes under out.

    Every row comes out once for each time it is there. Files may differ in their columns: the output has all of them, NULL where
    a file has none; columns of one name whose types can't be merged are refused (InvalidArgument). No source is refused, too;
    sources without rows give a table without rows. Raises Corrupted, and leaves no output, if the staged files don't hold what
    the sources hold.
    """
    if not sources:
        raise InvalidArgument("there is nothing to pack")
    staged = out + ".staged"
    with settings(spark, spark__sql__files__maxPartitionBytes=target_bytes, spark__sql__files__openCostInBytes=open_cost, spark__sql__files__minPartitionNum=1):
        try:
            df = spark.read.option("mergeSchema", True).parquet(*sources)
        except (PySparkException, Py4JJavaError) as e:
            raise InvalidArgument(f"the sources can't be read as one table: {str(e)[:500]}") from e
        files, size = _size(df)
        wanted = max(1, -(-(size + open_cost * files) // target_bytes))
        try:
            df.coalesce(wanted).write.parquet(staged)
            written = spark.read.schema(df.schema).parquet(staged)
            before, after = checksum(df), checksum(written)
            if before != after:
                raise Corrupted(out, f"packed {after[0]} of {before[0]} rows, or other contents")
        except Exception:
            drop_path(spark, staged)
            raise
    _publish(spark, staged, out)
    return Packed(out, after[0], files, _size(spark.read.parquet(out))[0])


def survivors(segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """db_id, collection, id (NFC), segment_id, place, row of the row that survives of each id in the current segments (as located()).

    Found by keys alone. Segments listed twice count once; unlisted, unfinished and empty ones give nothing.
    """
    c = segment_changes(segments, small(published_segments(manifests), "published"), row_places())
    last = c.groupBy("db_id", "collection", "id").agg(F.max(F.struct("order", "op", "value")).alias("m")).where(F.col("m.op") == "upsert")
    return last.select("db_id", "collection", "id", "m.value.*")


def surviving_rows(segments: DataFrame, manifests: DataFrame) -> DataFrame:
    """db_id, collection, segment_id, id (NFC), vector, payload: for each id the row that survives in the current segments."""
    s = located(segments)
    return rows_at(s, survivors(s, manifests))


def _keys(df: DataFrame) -> tuple[int, int]:
    return checksum(df.select("db_id", "collection", "id", "segment_id"))


def compact_segments(segments: DataFrame, manifests: DataFrame, out: str | None = None, target_bytes: int = 128 << 20, open_cost: int = 64 << 10) -> DataFrame:
    """The table of surviving_rows, written in few files of about target_bytes; returns a read of it.

    The segments are read in combined splits and what survives of a split is written where it was read, without a shuffle. The staged
    output must hold exactly the surviving keys, each from its segment and with a vector, as the pass over the keys of the
    sources found them, else Corrupted is raised and nothing is published.
    """
    spark = segments.sparkSession
    out = out or stage_path(spark, "compacted")
    staged = out + ".staged"
    s = located(segments)
    keys = stage(survivors(s, manifests), "survivors")
    with settings(spark, spark__sql__files__maxPartitionBytes=target_bytes, spark__sql__files__openCostInBytes=open_cost, spark__sql__files__minPartitionNum=1):
        files, size = _size(s)
        rows = rows_at(s, keys)
        try:
            rows.coalesce(max(1, -(-(size + open_cost * files) // target_bytes))).write.parquet(staged)
            written = spark.read.schema(rows.schema).parquet(staged)
            want, have = _keys(keys), _keys(written.where("vector is not null"))
            if want != have:
                raise Corrupted(out, f"packed {have[0]} of {want[0]} rows, or others")
        except Exception:
            drop_path(spark, staged)
            raise
    _publish(spark, staged, out)
    return spark.read.schema(rows.schema).parquet(out)
