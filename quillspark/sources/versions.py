"""Tables that change together: batches are staged side by side and become visible by one small manifest.

A store is a folder with a folder per table, each partitioned by batch, and ``versions`` with a manifest per version. A
manifest lists the committed batches in order. A batch may hold rows of any file; its ``changes`` say which files it speaks
for: those it replaces (live) and those it removes. Readers take the newest whole manifest and, of each file, the rows of the
last committed batch that speaks for it. Rows of a batch that is in no manifest are never seen, so that a job that dies at any
point leaves the version before. A manifest is created exclusively: of two writers of the same version one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHANGES = "file_id long, live boolean"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def manifest(self) -> dict:
        """The newest whole manifest; a torn one counts as not there."""
        folder = self._hadoop.Path(f"{self.root}/versions")
        names = sorted((x.getPath().getName() for x in self._files.listStatus(folder)), reverse=True) if self._files.exists(folder) else []
        last = int(names[0].split(".")[0]) if names else 0
        for name in names:
            try:
                return {"next": last + 1} | json.loads(self._text(f"{self.root}/versions/{name}"))
            except ValueError:
                continue
        return {"version": 0, "batches": [], "schemas": {}, "clean": True, "next": last + 1}

    def _text(self, path: str) -> str:
        with_bytes = self._files.open(self._hadoop.Path(path))
        try:
            return bytes(with_bytes.readAllBytes()).decode()
        finally:
            with_bytes.close()

    def _publish(self, base: dict, batches: list[str], schemas: dict[str, str], clean: bool) -> int:
        version = base["next"]
        path = self._hadoop.Path(f"{self.root}/versions/{version:010d}.json")
        try:
            out = self._files.create(path, False)
        except Exception as error:
            if self._files.exists(path):
                raise Conflict(f"version {version} is taken") from error
            raise
        out.write(json.dumps({"version": version, "batches": batches, "schemas": schemas, "clean": clean}).encode())
        out.close()
        return version

    # writing

    def stage(self, batch: str, table: str, rows: DataFrame) -> DataFrame:
        """Write a batch's rows of a table, which have a file_id, and read them back; nobody else sees them yet."""
        path = f"{self.root}/{table}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, batch: str, tables: list[str], changes: DataFrame, base: dict | None = None) -> int:
        """Make a staged batch visible; ``base`` is the manifest that it was made from. Returns the version."""
        base = base or self.manifest()
        self.stage(batch, "changes", changes.select(F.col("file_id").cast("long").alias("file_id"), "live"))
        schemas = dict(base["schemas"])
        for table in tables:
            kept = self.spark.read.parquet(f"{self.root}/{table}/batch={batch}").schema
            schemas[table] = kept.json()
        return self._publish(base, [*base["batches"], batch], schemas, False)

    def compact(self) -> int:
        """Rewrite the live rows as one batch, so that reading takes no join; older batches stay for running readers."""
        base, batch = self.manifest(), new_batch()
        for table in base["schemas"]:
            self.stage(batch, table, self.read(table, base))
        self.stage(batch, "changes", self.owners(base).select("file_id", F.lit(True).alias("live")))
        return self._publish(base, [batch], base["schemas"], True)

    # reading

    def owners(self, manifest: dict) -> DataFrame:
        """(file_id, batch) of the live files: the last committed batch that speaks for a file."""
        batches = manifest["batches"]
        if not batches:
            return self.spark.createDataFrame([], "file_id long, batch string")
        rows = self.spark.read.schema(f"{CHANGES}, batch string").parquet(f"{self.root}/changes").filter(F.col("batch").isin(batches))
        place = F.create_map(*(F.lit(x) for k, b in enumerate(batches) for x in (b, k)))[F.col("batch")]
        last = rows.groupBy("file_id").agg(F.max_by(F.struct("batch", "live"), place).alias("x"))
        return last.filter("x.live").select("file_id", "x.batch")

    def read(self, table: str, manifest: dict | None = None, columns: list[str | Column] | None = None) -> DataFrame:
        """The committed rows of a table, as of a manifest (the newest by default).

        ``columns``, the file_id among them, are computed where the rows are read, so that nothing else travels to the owners.
        """
        manifest = manifest or self.manifest()
        schema = StructType.fromJson(json.loads(manifest["schemas"][table]))
        rows = self.spark.read.schema(StructType([*schema.fields]).add("batch", "string")).parquet(f"{self.root}/{table}").filter(F.col("batch").isin(manifest["batches"]))
        if columns:
            rows = rows.select(*columns, "batch")
        if not manifest["clean"]:
            rows = rows.join(self.owners(manifest), ["file_id", "batch"], "left_semi")
        return rows.drop("batch") if columns else rows.select(*schema.names)


def new_batch() -> str:
    return uuid.uuid4().hex
