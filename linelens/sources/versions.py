"""A registry as a versioned table: rows in buckets by id hash, a manifest for each version.

An upsert reads and rewrites only the buckets its ids fall in; every other bucket stays the files it was. A version is
there when its manifest is, which is renamed into place last and never over another one. Readers keep to one version.
Folders of an upsert that did not commit are in no manifest and are never read. Nothing is deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linelens.functions.expr import q
from linelens.session import materialize
from linelens.sources import registry

BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another writer committed the version this one was about to write."""


class VersionedRegistry:
    """Rows with one id each, the newest by stamp (ties: the later upsert). ``buckets`` is fixed by the first version.

    Ids compare as text. A null id is an id. On HDFS and local disks the rename decides which of two writers commits;
    an object store needs a file system whose rename does not overwrite.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, stamp: str, buckets: int = 64):
        self.spark, self.path, self.key, self.stamp, self.buckets = spark, path.rstrip("/"), key, stamp, buckets
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.path)).toUri(), conf)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:010d}.json"

    def version(self) -> int:
        """The newest version, 0 before the first upsert. One listing of the manifests."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Folder of each bucket, schema and number of buckets of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "schema": None}
        rows = self.spark.read.text(self._manifest(version), wholetext=True).first()
        return json.loads(rows["value"])

    def _commit(self, manifest: dict) -> None:
        folder = f"{self.path}/manifests"
        temp, final = self._path(f"{folder}/.{uuid.uuid4().hex}.tmp"), self._path(self._manifest(manifest["version"]))
        self._fs.mkdirs(self._path(folder))
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.NONE
        try:
            self._context.rename(temp, final, kinds)
        except Exception as exc:  # noqa: BLE001 - anything but a version that is there goes on up
            if self._fs.exists(final):
                raise VersionConflict(f"version {manifest['version']} was written by another writer") from exc
            raise

    def _bucket_of(self, value: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(value.cast("string")), F.lit(buckets)).cast("int")

    def _folders(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of the named buckets (all, if not named) at the manifest's schema; None where none is stored."""
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; a later upsert does not change what this returns."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"'{self.path}' holds no version")
        rows = self._folders(manifest)
        return rows if rows is not None else self.spark.createDataFrame([], StructType.fromJson(manifest["schema"]))

    def by_id(self, value, version: int | None = None) -> DataFrame:
        """The row of one id, from its bucket alone; no row where the id is unknown."""
        manifest = self.manifest(version)
        bucket = self.spark.range(1).select(self._bucket_of(F.lit(value), manifest["buckets"]).alias("b")).first()["b"]
        rows = self._folders(manifest, [bucket])
        rows = rows if rows is not None else self.read(version).limit(0)
        return rows.where(q(self.key).cast("string").eqNullSafe(F.lit(value).cast("string")))

    def upsert(self, arriving: DataFrame, base: int | None = None) -> int:
        """Replace by id and commit a version on top of ``base`` (the newest, if not given); returns the version.

        Raises VersionConflict where another writer was first: nothing of this upsert is then visible.
        """
        before = self.manifest(base)
        placed = materialize(arriving.withColumn(BUCKET, self._bucket_of(q(self.key), before["buckets"])))
        touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]  # at most the number of buckets
        rows = placed.drop(BUCKET)
        stored = self._folders(before, touched)
        if stored is None:
            stored = self.spark.createDataFrame([], StructType.fromJson(before["schema"]) if before["schema"] else rows.schema)
        merged = registry.upsert(stored, rows, self.key, self.stamp)
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn(BUCKET, self._bucket_of(q(self.key), before["buckets"])).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        after = {"version": before["version"] + 1, "buckets": before["buckets"], "schema": merged.schema.jsonValue(),
                 "folders": before["folders"] | {str(b): f"{folder}/{BUCKET}={b}" for b in touched}}
        self._commit(after)
        return after["version"]

    def upsert_retrying(self, arriving: DataFrame, attempts: int = 5) -> int:
        """Upsert on top of whatever is newest, again after a conflict."""
        kept = materialize(arriving)
        for left in range(attempts - 1, -1, -1):
            try:
                return self.upsert(kept)
            except VersionConflict:
                if not left:
                    raise
        raise ValueError("attempts must be at least 1")
