"""Source trees as DataFrames: a scan of files, and the state of a tree at a git ref."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.rules import IGNORED
from tracewarden.functions.scalar import LANGUAGE
from tracewarden.operators.extract import source_files


def inside_tree(path, ignored: tuple[str, ...] = IGNORED):
    """Whether no folder of a relative path is ignored."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.coalesce(F.arrays_overlap(folders, F.array(*map(F.lit, ignored))), F.lit(False))


def scan(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, language, hash, content) of the supported files below ``root``, by paths relative to it.

    Folders on the deny list are left out, whatever their depth, and extensions match in any case. Files are
    read in parallel by Spark, so ``root`` may be in any store.
    """
    whole = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    whole = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*LANGUAGE)
    # both as paths without a scheme, of which one store has several spellings (file:/ and file:///)
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/+(?=/)|^[A-Za-z][A-Za-z0-9+.-]*:", "")
    start = len(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+(?=/)|^[A-Za-z][A-Za-z0-9+.-]*:", "", whole)) + 2
    named = files.filter(known).withColumn("path", F.substring(plain, start, 1 << 20)).filter(inside_tree(F.col("path"), ignored))
    return source_files(named.select("path", F.decode("content", "UTF-8").alias("content")))


def changed_files(spark: SparkSession, repo: str, ref: str = "HEAD~1") -> DataFrame:
    """(path) of supported files that differ from a git ref: a list of names, as long as a diff's."""
    names = subprocess.run(["git", "-C", repo, "diff", "--name-only", ref], capture_output=True, text=True, check=True).stdout.split("\n")
    rows = [(n,) for n in names if n.rpartition(".")[2].lower() in LANGUAGE]
    return spark.createDataFrame(rows, "path string")


def files_at(changed: DataFrame, repo: str, ref: str) -> DataFrame:
    """(path, content) of changed files at a git ref, fetched by the tasks; files that the ref lacks are left out.

    ``repo`` must be at the same place on all executors.
    """

    def run(frames):
        for frame in frames:
            found = [subprocess.run(["git", "-C", repo, "show", f"{ref}:{p}"], capture_output=True, check=False) for p in frame["path"]]
            frame = frame.assign(content=[x.stdout.decode(errors="replace") if not x.returncode else None for x in found])
            yield frame[frame["content"].notna()]

    return changed.mapInPandas(run, "path string, content string")
