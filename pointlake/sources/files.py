"""Files of a store on any file system that Hadoop reaches: atomic JSON documents, checksums, syncing, and the folder layout."""
from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.types import FORMAT_VERSION, Corrupted, StorageFailure

#: Bytes of files whose checksums the driver computes itself; more are left to tasks.
DRIVER_BYTES = 8 << 20


class Place:
    """A file or folder by its address, with the calls of pathlib that a store needs. Local paths need no scheme."""

    def __init__(self, address: str | os.PathLike):
        if isinstance(address, Place):
            address = address.uri
        address = os.fspath(address)
        if "://" not in address:
            address = address.removeprefix("file:")
            address = "file://" + (address if address.startswith("/") else str(Path(address).resolve()))
        self.uri = address.rstrip("/")

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self.uri}/{name}")

    def __str__(self) -> str:
        return self.uri

    __repr__ = __str__

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Place) and self.uri == other.uri

    def __hash__(self) -> int:
        return hash(self.uri)

    @property
    def name(self) -> str:
        return self.uri.rpartition("/")[2]

    @property
    def stem(self) -> str:
        return self.name.rpartition(".")[0] or self.name

    @property
    def parent(self) -> Place:
        return Place(self.uri.rpartition("/")[0])

    def with_name(self, name: str) -> Place:
        return self.parent / name

    @property
    def local(self) -> Path | None:
        return Path(self.uri.removeprefix("file://")) if self.uri.startswith("file://") else None

    # ---- the file system

    def _path(self, uri: str | None = None) -> Any:
        return SparkContext._active_spark_context._jvm.org.apache.hadoop.fs.Path(uri or self.uri)

    def _conf(self) -> Any:
        return SparkContext._active_spark_context._jsc.hadoopConfiguration()

    def _fs(self) -> Any:
        fs = self._path().getFileSystem(self._conf())
        return fs.getRaw() if self.local else fs

    def _call(self, what: str, f: Any) -> Any:
        try:
            return f()
        except Py4JError as e:
            raise StorageFailure(f"can't {what} {self}: {str(e)[:300]}") from e

    def exists(self) -> bool:
        return self._call("look at", lambda: self._fs().exists(self._path()))

    def is_dir(self) -> bool:
        return self.exists() and self._call("look at", lambda: self._fs().getFileStatus(self._path()).isDirectory())

    def is_file(self) -> bool:
        return self.exists() and not self.is_dir()

    def size(self) -> int:
        return self._call("look at", lambda: self._fs().getFileStatus(self._path()).getLen())

    def iterdir(self) -> Iterator[Place]:
        """What lies directly in the folder, by name; nothing if it isn't one. Hidden checksum files are left out."""
        if not self.is_dir():
            return
        names = self._call("list", lambda: [s.getPath().getName() for s in self._fs().listStatus(self._path())])
        yield from (self / n for n in sorted(names) if not (n.startswith(".") and n.endswith(".crc")))

    def mkdir(self) -> None:
        self._call("make", lambda: self._fs().mkdirs(self._path()))

    def delete(self) -> bool:
        """Whether it is gone; a folder with all that is in it."""
        try:
            self._fs().delete(self._path(), True)
            return not self._fs().exists(self._path())
        except Py4JError:
            return False

    def rename(self, to: Place) -> None:
        if not self._call("rename", lambda: self._fs().rename(self._path(), to._path())):
            raise StorageFailure(f"can't rename {self} to {to}")

    def replace(self, to: Place) -> None:
        """Rename a file over another, in one step where the file system has one."""
        def run() -> None:
            jvm = SparkContext._active_spark_context._jvm
            options = jvm.org.apache.hadoop.fs.Options.Rename
            how = SparkContext._active_spark_context._gateway.new_array(options, 1)
            how[0] = options.OVERWRITE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf()).rename(self._path(), to._path(), how)

        if self.local:
            try:
                os.replace(self.local, to.local)
            except OSError as e:
                raise StorageFailure(f"can't write {to}: {e}") from e
        else:
            self._call("replace", run)

    def read_bytes(self) -> bytes:
        def run() -> bytes:
            stream = self._fs().open(self._path())
            try:
                return bytes(SparkContext._active_spark_context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()

        return self._call("read", run)

    def write_bytes(self, data: bytes) -> None:
        """Written and synced as far as the file system can."""
        def run() -> None:
            out = self._fs().create(self._path(), True)
            try:
                out.write(bytearray(data))
                out.hsync()
            finally:
                out.close()

        self._call("write", run)


    def append_bytes(self, data: bytes, at: int) -> None:
        """Cut the file to `at` bytes and write on from there, synced; a missing file is made."""
        if not self.exists():
            return self.write_bytes(data)

        def run() -> None:
            fs = self._fs()
            if fs.getFileStatus(self._path()).getLen() > at:
                fs.truncate(self._path(), at)
            out = fs.append(self._path())
            try:
                out.write(bytearray(data))
                out.hsync()
            finally:
                out.close()

        self._call("append to", run)


@dataclass
class SyncStats:
    """Counts syncs; a test may set fail_next to make the next one fail."""

    syncs: int = 0
    fail_next: Exception | None = None


def sync_file(place: Place, stats: SyncStats | None = None) -> None:
    """Where files are local, fsync; elsewhere a closed file is as durable as the file system makes it."""
    if stats is not None:
        if stats.fail_next is not None:
            error, stats.fail_next = stats.fail_next, None
            raise StorageFailure(f"{place}: {error}")
        stats.syncs += 1
    if place.local is None:
        return
    try:
        fd = os.open(place.local, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)
    except OSError as e:
        raise StorageFailure(f"can't sync {place}: {e}") from e


def write_json(place: Place, document: dict[str, Any]) -> None:
    """Written beside, synced, then renamed, so that a reader sees the old or the new document."""
    place = Place(place)
    tmp = place.with_name(place.name + ".tmp")
    place.parent.mkdir()
    tmp.write_bytes(json.dumps(document, sort_keys=True).encode())
    tmp.replace(place)
    if place.local:
        try:
            sync_file(place.parent)
        except StorageFailure:
            pass  # not every file system can sync a folder


def read_json(place: Place, version_key: str = "formatVersion") -> dict[str, Any]:
    place = Place(place)
    if not place.exists():
        raise Corrupted(place, "missing")
    try:
        document = json.loads(place.read_bytes().decode("utf-8"))
    except (ValueError, UnicodeDecodeError) as e:
        raise Corrupted(place, f"not JSON: {e}") from e
    if not isinstance(document, dict) or document.get(version_key) != FORMAT_VERSION:
        raise Corrupted(place, f"unsupported {version_key}")
    return document


def fingerprint(data: bytes) -> dict[str, int]:
    return {"size": len(data), "crc32": zlib.crc32(data)}


def checksums(spark: SparkSession, folder: Place) -> DataFrame:
    """path, size, crc32 of the Parquet files in a folder, each read whole by a task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(str(folder)).select("path", F.col("length").alias("size"), F.crc32("content").alias("crc32"))


def fingerprints(spark: SparkSession, folder: Place) -> dict[str, dict[str, int]]:
    """Size and CRC-32 of each data file in a folder, by name."""
    return {r["path"].rpartition("/")[2]: {"size": r["size"], "crc32": r["crc32"]} for r in checksums(spark, folder).collect()}


def require_sizes(folder: Place, files: dict[str, dict[str, int]]) -> None:
    """Fail closed: every listed file is there with its size. No data is read."""
    for name, want in files.items():
        if not (folder / name).is_file():
            raise Corrupted(folder / name, "missing")
        if (folder / name).size() != want["size"]:
            raise Corrupted(folder / name, "its size is not the recorded one")


def require_checksums(spark: SparkSession, folders: list[tuple[Place, dict[str, dict[str, int]]]]) -> None:
    """Fail closed: every listed file has its size and checksum. Few bytes are read here, more by tasks, one a file."""
    todo = []
    for folder, files in folders:
        require_sizes(folder, files)
        todo += [(str(folder / name), want["crc32"]) for name, want in files.items()]
    if not todo:
        return
    if sum(want["size"] for _, files in folders for want in files.values()) <= DRIVER_BYTES:
        bad = [path for path, crc in todo if zlib.crc32(Place(path).read_bytes()) != crc]
    else:
        want = spark.createDataFrame(todo, "path string, want long").withColumn("path", _plain("path"))
        have = spark.read.format("binaryFile").load([path for path, _ in todo]).select(_plain("path").alias("path"), F.crc32("content").alias("crc32"))
        bad = [r["path"] for r in want.join(have, "path", "left").where("crc32 is null or crc32 <> want").limit(1).collect()]
    if bad:
        raise Corrupted(bad[0], "its checksum is not the recorded one")


def _plain(path: str) -> Any:
    return F.regexp_replace(path, "^file:/+", "/")


def remove_leftovers(folder: Place) -> list[Place]:
    """Delete *.tmp directly under folder; what can't be deleted stays."""
    return [p for p in Place(folder).iterdir() if p.name.endswith(".tmp") and p.delete()]


@dataclass(frozen=True)
class Layout:
    root: Place

    def __post_init__(self) -> None:
        object.__setattr__(self, "root", Place(self.root))

    @property
    def db_meta(self) -> Place:
        return self.root / "DB_META.json"

    @property
    def catalog(self) -> Place:
        return self.root / "CATALOG.json"

    @property
    def collections(self) -> Place:
        return self.root / "collections"

    def collection(self, name: str) -> Place:
        return self.collections / name

    def collection_meta(self, name: str) -> Place:
        return self.collection(name) / "COLL_META.json"

    def manifest(self, name: str) -> Place:
        return self.collection(name) / "MANIFEST.json"

    def log(self, name: str) -> Place:
        return self.collection(name) / "log"

    def segments(self, name: str) -> Place:
        return self.collection(name) / "segments"

    def segment(self, name: str, segment_id: int) -> Place:
        return self.segments(name) / str(segment_id)

    def segment_meta(self, name: str, segment_id: int) -> Place:
        return self.segment(name, segment_id) / "SEGMENT_META.json"
