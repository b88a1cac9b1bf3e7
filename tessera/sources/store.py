"""Canonical store, index and step cache: Parquet by fingerprint, a JSON manifest written last.

A dataset is complete when its manifest is there: data are written to a folder of the attempt's own first. All paths
are opened through Spark's file systems, so that stores that only Spark reads work.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.seeds import fingerprint

SCHEMA_VERSION = 1


class Files:
    """A folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        if ".." in name.split("/") or name.startswith("/"):
            raise ValueError(f"{name!r} leaves the folder")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        p = self._path(name)
        return self._fs(p).exists(p)

    def read(self, name: str) -> str:
        rows = self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect()  # one small file
        return rows[0][0] if rows else ""

    def write(self, name: str, text: str) -> None:
        """Replaces the file at once: written beside it, then renamed."""
        p, t = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        fs = self._fs(p)
        out = fs.create(t, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(t, p):
            raise OSError(f"cannot write {name}")

    def move(self, a: str, b: str) -> bool:
        s, t = self._path(a), self._path(b)
        self._fs(t).mkdirs(t.getParent())
        return not self._fs(t).exists(t) and self._fs(s).rename(s, t)

    def delete(self, name: str) -> None:
        p = self._path(name)
        self._fs(p).delete(p, True)

    def names(self, name: str = "") -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs(p).listStatus(p)) if self._fs(p).exists(p) else []


def latest(rows: DataFrame, by: str = "uri", at: str = "created_at") -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))).filter("_r = 1").drop("_r")


class Store:
    """Datasets by fingerprint of their identity."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def key(self, identity: dict) -> str:
        return fingerprint({k: v for k, v in identity.items() if k not in ("doc", "citation", "homepage")})

    def manifest(self, key: str) -> dict | None:
        name = f"{key}/manifest.json"
        return json.loads(self.files.read(name)) if self.files.exists(name) else None

    def put(self, identity: dict, tables: dict[str, DataFrame]) -> str:
        """Write tables (nodes partitioned by split, if they have one); another writer that was first is left alone."""
        key, attempt = self.key(identity), f"_attempt-{uuid.uuid4().hex}"
        if self.manifest(key):
            return key
        info = {}
        for name, df in tables.items():
            w = df.write.partitionBy("split") if "split" in df.columns else df.write
            w.parquet(f"{self.files.root}/{attempt}/{name}")
            info[name] = {"schema": json.loads(df.schema.json()), "rows": self.spark.read.parquet(f"{self.files.root}/{attempt}/{name}").count()}
        if self.files.exists(key) and not self.manifest(key):
            self.files.delete(key)  # what a writer that died left
        if self.files.move(attempt, key):
            self.files.write(f"{key}/manifest.json", json.dumps({"schema_version": SCHEMA_VERSION, "fingerprint": key, "identity": identity, "tables": info, "created_at": datetime.now(UTC).isoformat()}, sort_keys=True))
        else:
            self.files.delete(attempt)
        return key

    def get(self, key: str, table: str = "nodes") -> DataFrame:
        m = self.manifest(key)
        if m is None:
            raise KeyError(key)
        return self.spark.read.parquet(f"{self.files.root}/{key}/{table}")

    def cached(self, identity: dict, make: Callable[[], dict[str, DataFrame]], download: bool = True, force: bool = False) -> str:
        key = self.key(identity)
        if force and self.manifest(key):
            self.files.delete(key)
        if self.manifest(key) is None:
            if not download:
                raise FileNotFoundError("not in the store, and downloads are off")
            self.put(identity, make())
        return key

    def index(self) -> list[dict]:
        """Manifests, newest first: the index is rebuilt from what is there."""
        found = [m for k in self.files.names() if not k.startswith("_") and (m := self.manifest(k))]
        return sorted(found, key=lambda m: m["created_at"], reverse=True)

    def purge(self, key: str) -> None:
        self.files.delete(key)

    def purge_dataset(self, uri: str) -> int:
        gone = [m["fingerprint"] for m in self.index() if m["identity"].get("uri") == uri]
        for k in gone:
            self.purge(k)
        return len(gone)

    def collect_garbage(self) -> list[str]:
        """All but the newest of each URI go."""
        seen, gone = set(), []
        for m in self.index():
            uri = m["identity"].get("uri")
            if uri in seen:
                gone.append(m["fingerprint"])
                self.purge(m["fingerprint"])
            seen.add(uri)
        return gone


def save_split(assignment: DataFrame, path: str, overwrite: bool = False) -> None:
    assignment.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def save_edges(edges: DataFrame, path: str, shards: int) -> None:
    edges.repartition(shards, "src").write.parquet(path)
