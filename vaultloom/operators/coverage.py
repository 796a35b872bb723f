"""Which files should have parity: the nearest marked ancestor decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def directories(files: DataFrame, marks: DataFrame, default: str = "exclude") -> DataFrame:
    """directory, mode, mark (the deciding directory, null without one) of each distinct directory of the files."""
    own = files.select(paths.parent(F.col("path")).alias("directory")).distinct()
    up = own.select("directory", F.posexplode(paths.ancestors(F.col("directory"))).alias("steps", "mark"))
    found = up.join(marks.select(F.col("path").alias("mark"), "mode"), "mark")
    nearest = found.groupBy("directory").agg(F.min_by(F.struct("mode", "mark"), "steps").alias("m"))
    return own.join(nearest, "directory", "left").select("directory", F.coalesce("m.mode", F.lit(default)).alias("mode"), F.col("m.mark").alias("mark"))


def covered(files: DataFrame, marks: DataFrame, default: str = "exclude") -> DataFrame:
    """files with mode and mark. Ancestors are met once a directory, not once a file."""
    by = files.withColumn("directory", paths.parent(F.col("path")))
    return by.join(directories(files, marks, default), "directory").drop("directory")


def report(files: DataFrame, marks: DataFrame, live: DataFrame, default: str = "exclude") -> DataFrame:
    """One row: counts and bytes of files that should have parity, that have it, and whose parity isn't wanted; missing files left out.

    live: content_hash of live members.
    """
    rows = covered(files.where("state <> 'missing'"), marks, default)
    rows = rows.join(live.select("content_hash", F.lit(True).alias("has")).distinct(), "content_hash", "left")
    want, has = (F.col("mode") == "include") & (F.col("size") > 0), F.coalesce("has", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    return rows.agg(
        F.count_if(want).alias("should_files"), total(want).alias("should_bytes"),
        F.count_if(want & has).alias("have_files"), total(want & has).alias("have_bytes"),
        F.count_if(~want & has).alias("stale_files"), total(~want & has).alias("stale_bytes"),
    )


def mounted(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """path, dataset: the dataset (name, mountpoint) with the longest mountpoint above each path, null without one; met once a directory."""
    own = files.select(paths.parent(F.col("path")).alias("directory")).distinct()
    up = own.select("directory", F.posexplode(paths.ancestors(F.col("directory"))).alias("steps", "mountpoint"))
    nearest = up.join(datasets.select("name", "mountpoint"), "mountpoint").groupBy("directory").agg(F.min_by("name", "steps").alias("dataset"))
    return files.select("path", paths.parent(F.col("path")).alias("directory")).join(nearest, "directory", "left").select("path", "dataset")
