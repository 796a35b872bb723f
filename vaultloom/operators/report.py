"""Listings and totals over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def totals(files: DataFrame, live: DataFrame, sets: DataFrame, member_rows: DataFrame, events: DataFrame) -> DataFrame:
    """One row: files, bytes, contents, never verified, oldest check, covered files and bytes, sets, degraded sets, events."""
    rows = files.join(live.select("content_hash", F.lit(True).alias("has")).distinct(), "content_hash", "left")
    present, has = F.col("state") != "missing", F.coalesce("has", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    one = rows.agg(F.count("*").alias("files"), total(present).alias("bytes"), F.countDistinct("content_hash").alias("contents"), F.count_if(F.col("last_verified_at").isNull()).alias("never_verified"), F.min("last_verified_at").alias("oldest_verified"), F.count_if(has).alias("covered_files"), total(has).alias("covered_bytes"))
    two = sets.agg(F.count("*").alias("sets"))
    three = member_rows.where("dead").agg(F.countDistinct("g").alias("degraded_sets"))
    four = events.agg(F.count("*").alias("events"))
    rows = one
    for more in (two, three, four):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def by_state(files: DataFrame) -> DataFrame:
    return files.groupBy("state").agg(F.count("*").alias("files")).orderBy("state")


def listed(files: DataFrame, roots: list[str] = ("",), state: str | None = None, live: DataFrame | None = None, parity: bool | None = None) -> DataFrame:
    """Files under any of the roots, of a state, with or without live parity."""
    rows = files.where(paths.under_any(F.col("path"), list(roots)))
    if state:
        rows = rows.where(F.col("state") == state)
    if parity is not None:
        rows = rows.join(live.select("content_hash"), "content_hash", "left_semi" if parity else "left_anti")
    return rows


def flagged(files: DataFrame, roots: list[str] = ("",)) -> DataFrame:
    """What repair takes up: damaged and missing files, and files named themselves."""
    rows = listed(files, roots)
    return rows.where(F.col("state").isin("corrupt", "unrecoverable", "missing") | F.col("path").isin([r for r in roots if r]))


def acceptable(files: DataFrame, roots: list[str]) -> DataFrame:
    """What accept takes up: files under the roots with any flag, and files named themselves."""
    return listed(files, roots).where((F.col("state") != "ok") | F.col("path").isin(list(roots)))


def summary(rows: DataFrame, column: str, size: str = "size") -> DataFrame:
    """files and bytes of each outcome of a scan, check or import, worst first by count."""
    return rows.groupBy(F.col(column).alias("outcome")).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def phase(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: sets made, kept and dropped by a parity phase, and bytes of the new ones. before, after: set_id, data_bytes."""
    both = before.select("set_id", F.lit(1).alias("b")).join(after.select("set_id", "data_bytes", F.lit(1).alias("a")), "set_id", "full_outer")
    made = F.col("b").isNull()
    return both.agg(F.count_if(made).alias("made"), F.count_if(F.col("a").isNotNull() & ~made).alias("kept"), F.count_if(F.col("a").isNull()).alias("dropped"), F.coalesce(F.sum(F.when(made, F.col("data_bytes"))), F.lit(0)).cast("long").alias("made_bytes"))


def preview(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first rows by path: what a refusal shows."""
    return rows.orderBy(F.encode("path", "UTF-8")).limit(n)


def set_counts(sets: DataFrame, member_rows: DataFrame, underfull: DataFrame) -> DataFrame:
    """One row: sets, degraded and underfull ones, members and dead members."""
    dead = member_rows.groupBy("g").agg(F.count("*").alias("m"), F.count_if("dead").alias("d"))
    rows = sets.select("g").join(dead, "g", "left").join(underfull.select("g", F.lit(True).alias("low")), "g", "left")
    return rows.agg(F.count("*").alias("sets"), F.count_if(F.col("d") > 0).alias("degraded"), F.count_if(F.coalesce("low", F.lit(False))).alias("underfull"), F.coalesce(F.sum("m"), F.lit(0)).alias("members"), F.coalesce(F.sum("d"), F.lit(0)).alias("dead"))


def copies(files: DataFrame) -> DataFrame:
    """content_hash, files, first_path, last_path of contents that several files have."""
    return files.groupBy("content_hash").agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).where("files > 1")


def due(files: DataFrame, cutoff: int) -> DataFrame:
    """Files never verified or last verified before the cutoff."""
    return files.where(F.col("last_verified_at").isNull() | (F.col("last_verified_at") < cutoff))


def within_budget(files: DataFrame, budget: int) -> DataFrame:
    """Least recently verified first (never first of all), while the bytes before a file are below the budget.

    Sums of a day, or of a top directory among those never verified, tell where each begins; what begins beyond the budget
    goes before anything is sorted, and the rest is sorted day by day.
    """
    t = F.col("last_verified_at")
    rows = files.select("path", "size", "last_verified_at").withColumn("day", F.coalesce(F.floor(t / 86400), F.lit(-(1 << 40)))).withColumn("top", F.when(t.isNull(), F.split("path", "/")[0]).otherwise(""))
    sums = rows.groupBy("day", "top").agg(F.sum("size").alias("n"))
    begins = sums.select("day", "top", F.coalesce(F.sum("n").over(Window.orderBy("day", "top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin")).where(F.col("begin") < budget)
    w = Window.partitionBy("day", "top").orderBy("last_verified_at", paths.components(F.col("path")))
    inside = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = rows.join(begins, ["day", "top"]).withColumn("bytes_before", F.col("begin") + inside)
    return near.where(F.col("bytes_before") < budget).select("path", "size", "last_verified_at", "bytes_before")


def history(events: DataFrame, path: str | None = None, since: int | None = None, limit: int = 200) -> DataFrame:
    """The newest events of a subtree or of all, oldest first."""
    rows = events if path is None else events.where(paths.under(F.col("path"), path))
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    return rows.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))
