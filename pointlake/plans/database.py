"""A catalog of collections over a folder, or in memory."""
from __future__ import annotations

from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pointlake.plans.collection import Collection, config_from
from pointlake.session import stage
from pointlake.sources.files import Layout, Place, read_json, write_json
from pointlake.sources.interop import read_documents, read_live
from pointlake.types import (
    FORMAT_VERSION, BackendUnavailable, BalancedPolicy, Closed, CollectionConfig, CollectionExists, CollectionNotFound, Corrupted, DatabaseConfig,
    InvalidArgument, require_collection_name,
)


def choose_compute(preference: str) -> str:
    """auto and cpu choose a kernel by the request, expr and arrow name one; mlx isn't there."""
    if preference == "mlx":
        raise BackendUnavailable("mlx")
    if preference not in ("auto", "cpu", "expr", "arrow"):
        raise InvalidArgument(f"unknown compute {preference!r}")
    return "expr" if preference == "expr" else "auto"


def _document(c: DatabaseConfig) -> dict:
    return {"formatVersion": FORMAT_VERSION, "config": asdict(c)}


class Database:
    def __init__(self, spark: SparkSession, layout: Layout | None, config: DatabaseConfig):
        self.spark, self.layout, self.config = spark, layout, config
        self._compute = choose_compute(config.compute)
        self._collections: dict[str, Collection] = {}
        self._closed = False

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, config: DatabaseConfig | None = None) -> "Database":
        """Without a path in memory; a path is local, or an address of any file system that Hadoop reaches. On an existing folder its own
        configuration holds, whatever is passed. Segments are checked by the sizes of their files, without reading them: see
        Collection.verify()."""
        config = config or DatabaseConfig()
        choose_compute(config.compute)
        if path is None:
            return cls(spark, None, config)
        layout = Layout(path)
        layout.collections.mkdir()
        if not layout.db_meta.exists():
            write_json(layout.db_meta, _document(config))
            write_json(layout.catalog, {"formatVersion": FORMAT_VERSION, "collections": {}})
            return cls(spark, layout, config)
        d = read_json(layout.db_meta)["config"]
        db = cls(spark, layout, DatabaseConfig(**{**d, "balanced": BalancedPolicy(**d["balanced"])}))
        for name in read_json(layout.catalog)["collections"]:
            meta = read_json(layout.collection_meta(name))
            c = config_from(meta["config"])
            if c.name != name:
                raise Corrupted(layout.collection_meta(name), f"it describes {c.name!r}")
            db._collections[name] = db._make(c, meta["nextSegmentId"])
        return db

    @classmethod
    def imported(cls, spark: SparkSession, binary: str, path: str | None = None, config: DatabaseConfig | None = None) -> "Database":
        """A database with the collections and live points of a store in the binary format; fails closed on what doesn't verify."""
        root = Place(binary)
        known, live = read_documents(root), None
        db = cls.open(spark, path, config)
        for name, c in known.items():
            made = db.create_collection(config_from(c))
            live = live if live is not None else stage(read_live(spark, root), "imported")
            mine = live.where(F.col("collection") == name).drop("collection")
            if not mine.isEmpty():
                made.apply(mine.withColumn("op", F.lit("upsert")))
        return db

    def _make(self, c: CollectionConfig, next_segment_id: int = 1) -> Collection:
        return Collection(self.spark, c, self.layout, self.config.durability, self.config.balanced, self._compute, self.config.mutable_segment_max_points, self.config.mutable_segment_max_bytes, next_segment_id)

    def _ensure_open(self) -> None:
        if self._closed:
            raise Closed("the database is closed")

    @property
    def storage_path(self) -> Path | str | None:
        """A Path where it is local, else the address."""
        return (self.layout.root.local or self.layout.root.uri) if self.layout else None

    def create_collection(self, config: CollectionConfig) -> Collection:
        """What a crashed drop has left of the name is removed first."""
        self._ensure_open()
        require_collection_name(config.name)
        if config.name in self._collections:
            raise CollectionExists(config.name)
        if self.layout:
            self.layout.collection(config.name).delete()
        c = self._make(config)
        if self.layout:
            c.write_meta()
            self._catalog(add=config.name)
        self._collections[config.name] = c
        return c

    def drop_collection(self, name: str) -> None:
        self._ensure_open()
        if name not in self._collections:
            raise CollectionNotFound(name)
        self._collections.pop(name).prepare_for_close(sync=False)
        if self.layout:
            self._catalog(remove=name)
            self.layout.collection(name).delete()

    def _catalog(self, add: str | None = None, remove: str | None = None) -> None:
        d = read_json(self.layout.catalog)
        if add:
            d["collections"][add] = f"collections/{add}"
        if remove:
            d["collections"].pop(remove, None)
        write_json(self.layout.catalog, d)

    def list_collections(self) -> list[str]:
        self._ensure_open()
        return sorted(self._collections)

    def collection(self, name: str) -> Collection:
        self._ensure_open()
        if name not in self._collections:
            raise CollectionNotFound(name)
        return self._collections[name]

    def checkpoint(self) -> None:
        self._ensure_open()
        for c in self._collections.values():
            c.checkpoint()

    def close(self) -> None:
        """A second close is an error; if a sync fails the database stays open."""
        self._ensure_open()
        for c in self._collections.values():
            c.prepare_for_close(sync=True)
        self._closed = True
        self._collections.clear()
