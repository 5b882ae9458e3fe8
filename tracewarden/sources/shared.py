"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is unset, a session in one process gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracewarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def width(spark: SparkSession) -> int:
    """The number of tasks of an exchange."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def written(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Cut lineage: write a table and read it again. With ``key`` it is dealt by that column on disk, in as many buckets as an exchange has
    tasks, so that joins on it need no exchange of the table; the catalog forgets it at once."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if key is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    named = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(width(spark), key).saveAsTable(named)
    table = spark.table(named)
    spark.sql(f"DROP TABLE {named}")  # an external table: its files stay
    return table


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def removed(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` returned and nothing reads any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def measured(df: DataFrame, name: str, key: str | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """``written``, with aggregates that the write itself collects (null or missing ones over no rows are None)."""
    seen = Observation()
    table = written(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name, key)
    found = seen.get
    return table, {k: found.get(k) for k in metrics}
