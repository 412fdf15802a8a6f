"""What operators share about the session: the shared folder, staged tables, checked broadcasts, scoped settings."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach; only where it is unset (tests) an own one."""
    for read in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.getCheckpointDir):
        if found := read():
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="pointlake-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


_staged: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is emptied when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_clean, spark)
    _staged.append(path)
    return path


def _clean(spark: SparkSession) -> None:
    for path in _staged:
        try:
            if path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            else:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rename_path(spark: SparkSession, old: str, new: str) -> bool:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    return a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b)


def stored_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if a scan gives fewer: for costly work on few bytes. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: A table is broadcast up to so many rows and stored (compressed) bytes; in memory it may take several times as much.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20


def small(df: DataFrame, name: str, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is small, by rows and by bytes, else df for an ordinary shuffle join.

    df is staged first, so that measuring it costs no second computation.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    fits = stored_bytes(spark, path) <= (BROADCAST_BYTES if max_bytes is None else max_bytes) and staged.count() <= (BROADCAST_ROWS if max_rows is None else max_rows)
    return F.broadcast(staged) if fits else staged.hint("merge")


def has_map(t: T.DataType) -> bool:
    """Whether values of the type can't be hashed or compared."""
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return has_map(t.elementType)
    return isinstance(t, T.StructType) and any(has_map(f.dataType) for f in t.fields)


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Set SQL settings (dots as __) while an action inside the block runs, then put the old ones back."""
    keys = {k.replace("__", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
