"""Several tables that change together: versions of a manifest, the newest of which says which folders are current.

Every table has a key column, and its rows lie in buckets by a hash of it, a folder a bucket. A commit writes the buckets that change to new folders
and then, last, one small manifest file under the next number. Until that file is in place readers meet the old folders of all tables, from then on the
new ones; a commit that fails before leaves nothing but folders that no manifest names. What a commit writes is in proportion to the buckets it
touches, not to the tables. One writer at a time: a second one finds its number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, path: str, key: str = "ep", buckets: int = BUCKETS):
        """``buckets`` holds for a new store; one that exists keeps its own."""
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets = self.manifest().get("buckets", buckets)

    def _fs(self, at: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, at: str) -> list[str]:
        fs, p = self._fs(at)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.path}/manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """What a version says, the newest by default; empty before the first commit."""
        known = self.versions()
        if not known:
            return {}
        fs, p = self._fs(f"{self.path}/manifests/{version or max(known):012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def bucket(self, key: Column | None = None) -> Column:
        """The bucket of a row's key."""
        return F.pmod(F.xxhash64((F.col(self.key) if key is None else key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame | None:
        """A table, or some of its buckets, as one version has them; None if there is no such table."""
        t = self.manifest(version).get("tables", {}).get(name)
        if t is None:
            return None
        wanted = None if buckets is None else {*map(int, buckets)}
        folders = [f"{self.path}/{f}" for b, f in sorted(t["folders"].items(), key=lambda x: int(x[0])) if wanted is None or int(b) in wanted]
        schema = StructType.fromJson(t["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, changes: Mapping[str, DataFrame], buckets: Iterable[int] | None = None, notes: Mapping[str, object] | None = None) -> int:
        """Put each table's rows of the changed buckets (None: of all) in place of what these held; the new version.

        The rows may come from this store's own tables.
        """
        old = self.manifest()
        version, wanted = old.get("version", 0) + 1, None if buckets is None else sorted({*map(int, buckets)})
        tables = {n: {"schema": t["schema"], "folders": dict(t["folders"])} for n, t in old.get("tables", {}).items()}
        for name, df in changes.items():
            folder = f"{name}/{version:012d}-{uuid.uuid4().hex}"
            rows = df.withColumn("_bucket", self.bucket())
            rows = rows if wanted is None else rows.where(F.col("_bucket").isin(wanted))
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            kept = tables.get(name, {}).get("folders", {})
            kept = {} if wanted is None else {b: f for b, f in kept.items() if int(b) not in wanted}
            written = {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith("_bucket=")}
            tables[name] = {"schema": df.schema.jsonValue(), "folders": kept | written}
        self._point({"version": version, "buckets": self.buckets, "tables": tables, "notes": old.get("notes", {}) | dict(notes or {})})
        return version

    def _point(self, manifest: dict) -> None:
        at = f"{self.path}/manifests/{manifest['version']:012d}.json"
        fs, p = self._fs(at)
        _, new = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(p) or not fs.rename(new, p):
            fs.delete(new, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} is there already: another writer was first")

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders and manifests that none of the ``keep`` newest versions needs; how many folders went."""
        known = sorted(self.versions())
        kept, gone = known[-keep:], 0
        named = {f.rsplit("/", 1)[0] for v in kept for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        for table in (n for n in self._names(self.path) if n != "manifests"):
            for folder in self._names(f"{self.path}/{table}"):
                if f"{table}/{folder}" not in named:
                    fs, p = self._fs(f"{self.path}/{table}/{folder}")
                    fs.delete(p, True)
                    gone += 1
        for v in known[:-keep]:
            fs, p = self._fs(f"{self.path}/manifests/{v:012d}.json")
            fs.delete(p, False)
        return gone
