"""A versioned store of facts in Parquet: each version is a folder of its own, and readers pin one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators import build
from tracewarden.schema import CALL_SITES, FUNCTIONS, PARSED_NODES

FACTS = {"files": "file_path string, hash string", "parsed": PARSED_NODES, "functions": FUNCTIONS, "calls": CALL_SITES}


class FactStore:
    """The facts of files below ``path``, dealt into ``buckets`` by a hash of the file; the graph is built from them when it is read.

    A new version holds only the buckets whose files changed; its manifest says for every bucket which folder holds it. So a
    batch of changes rewrites its own buckets, a reader reads one manifest (a row a bucket) however many versions there
    were, and calls in files that didn't change find functions that did: the graph after any batches is that of one build over
    the files as they are. A version becomes visible with its manifest, after its tables are written. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str = "default", buckets: int = 64):
        self.spark, self.path, self.buckets = spark, f"{path.rstrip('/')}/{namespace}", buckets

    def _versions(self) -> DataFrame:
        """(number, bucket, folder): a row for each bucket of each version."""
        try:
            return self.spark.read.schema("number long, bucket int, folder string").parquet(f"{self.path}/versions")
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "number long, bucket int, folder string")

    def latest(self) -> int | None:
        """The number of the latest version; None before the first."""
        return self._versions().agg(F.max("number")).first()[0]

    def manifest(self, number: int | None = None) -> dict[int, str]:
        """The folder of each bucket in a version, by default the latest: at most ``buckets`` entries."""
        number = self.latest() if number is None else number
        return {} if number is None else {r["bucket"]: r["folder"] for r in self._versions().filter(F.col("number") == number).collect()}

    def _bucket(self) -> Column:
        return F.expr(f"cast(pmod(xxhash64(file_path), {self.buckets}) as int)")

    def table(self, name: str, number: int | None = None, only: list[int] | None = None, manifest: dict[int, str] | None = None) -> DataFrame:
        """A table of facts in a version, by default the latest; only some of its buckets, if given. ``manifest`` saves reading it again."""
        folders: dict[str, list[int]] = {}
        for bucket, folder in (self.manifest(number) if manifest is None else manifest).items():
            if only is None or bucket in only:
                folders.setdefault(folder, []).append(bucket)
        out = None
        for folder, buckets in sorted(folders.items()):
            found = self.spark.read.schema(f"{FACTS[name]}, bucket int").parquet(f"{self.path}/{folder}/{name}").filter(F.col("bucket").isin(buckets)).drop("bucket")
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], FACTS[name]) if out is None else out

    def facts(self, number: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        found = self.manifest(number)
        return tuple(self.table(name, manifest=found) for name in ("parsed", "functions", "calls"))

    def read(self, number: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a version, with call edges whatever the order of files."""
        return build.build_graph(*self.facts(number), ordered=False)

    def replace(self, files: DataFrame, new: dict[str, DataFrame]) -> int:
        """A new version in which the facts of ``files`` (column file_path) are those in ``new`` (by table), and no others."""
        last = self.latest()
        held = self.manifest(last)
        number, folder = (last or 0) + 1, f"v-{uuid.uuid4().hex}"
        gone = files.select("file_path").distinct()
        touched = sorted(r[0] for r in gone.select(self._bucket()).distinct().collect())  # at most ``buckets``
        for name in FACTS:
            columns = [c.split()[0] for c in FACTS[name].split(", ")]
            kept = self.table(name, only=touched, manifest=held).join(gone, "file_path", "left_anti")
            rows = kept.select(columns).unionByName(new[name].select(columns))
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/{name}")
        shown = held | dict.fromkeys(touched, folder)
        self.spark.createDataFrame([(number, b, f) for b, f in sorted(shown.items())], "number long, bucket int, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return number
