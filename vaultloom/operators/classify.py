"""Change states: the disk joined with the index, before and after anything is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def matched(disk: DataFrame, files: DataFrame) -> DataFrame:
    """Full outer join by path: d_size, d_mtime_ns, d_hash and the index's content_hash, size, mtime_ns, state."""
    there = disk.select("path", F.lit(True).alias("on_disk"), F.col("size").alias("d_size"), F.col("mtime_ns").alias("d_mtime_ns"), F.col("hash").alias("d_hash"))
    known = files.select("path", F.lit(True).alias("indexed"), "content_hash", "size", "mtime_ns", "state")
    both = there.join(known, "path", "full_outer")
    return both.withColumn("on_disk", F.coalesce("on_disk", F.lit(False))).withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def scan_actions(pairs: DataFrame, accept: bool = True) -> DataFrame:
    """pairs (matched() with `covered` and `has_parity`) with `action`: what a scan does before reading, the first that holds."""
    same_time = F.col("mtime_ns") == F.col("d_mtime_ns")
    action = (
        F.when(~F.col("on_disk"), "gone")
        .when(~F.col("indexed") & F.col("covered") & (F.col("d_size") > 0), "encode")
        .when(~F.col("indexed"), "new")
        .when(same_time & (F.col("size") != F.col("d_size")), "recheck-size")
        .when(same_time & (F.col("state") == "missing"), "recheck-reappeared")
        .when(same_time, "unchanged")
    )
    if not accept:
        action = action.when(F.lit(True), "declined")
    action = action.when(F.col("has_parity") & (F.col("size") == F.col("d_size")), "check-blocks").otherwise("hash")
    return pairs.withColumn("action", action)


def removed(pairs: DataFrame, failed: list[str] = ()) -> DataFrame:
    """Indexed files that aren't on disk, but for those under directories that couldn't be read (the root is the empty string)."""
    return pairs.where(~F.col("on_disk") & ~paths.under_any(F.col("path"), list(failed)))


def moved(gone: DataFrame, new: DataFrame) -> DataFrame:
    """path (old), content_hash, moved_to: gone files whose content is new elsewhere; of several places the largest path."""
    target = new.where("d_size is not null").groupBy(F.col("d_hash").alias("content_hash")).agg(F.max("path").alias("moved_to"))
    return gone.select("path", "content_hash").join(target, "content_hash").select("path", "content_hash", "moved_to")


def outcomes(actions: DataFrame) -> DataFrame:
    """actions with `outcome` once contents are read and nothing is in doubt: counts of a scan."""
    same = F.col("d_hash") == F.col("content_hash")
    return actions.withColumn(
        "outcome",
        F.when(F.col("action").isin("new", "encode"), "added")
        .when(F.col("action") == "gone", "gone")
        .when(F.col("action") == "unchanged", "unchanged")
        .when(F.col("action") == "declined", "modified")
        .when(F.col("action") == "recheck-reappeared", F.when(same, "reappeared").otherwise(F.when(F.col("has_parity"), "corrupt").otherwise("unrecoverable")))
        .when(F.col("action") == "recheck-size", F.when(same, "verified").otherwise(F.when(F.col("has_parity"), "corrupt").otherwise("unrecoverable")))
        .otherwise(F.when(same, "touched").otherwise("modified")),
    )


def suspected(bad: Column, unreadable: Column, n_blocks: Column, margin_ok: Column, whole_equal: Column) -> Column:
    """State of a file with a new time and its blocks compared: few bad blocks are suspected corruption, not an edit."""
    suspect = (bad > 0) & (margin_ok | (unreadable > 0)) & (2 * bad <= F.greatest(n_blocks, F.lit(1)))
    return (
        F.when((bad == 0) & whole_equal, "touched")
        .when(suspect, F.when(margin_ok, "corrupt").otherwise("unrecoverable"))
        .when(unreadable > 0, "unrecoverable")
        .otherwise("modified")
    )


def checked(pairs: DataFrame) -> DataFrame:
    """State of each indexed file by a check: pairs with has_parity, table_ok, bad, extra_bytes, unreadable and margin_ok."""
    same = F.col("d_hash") == F.col("content_hash")
    state = (
        F.when(~F.col("on_disk"), "missing")
        .when(F.col("mtime_ns") != F.col("d_mtime_ns"), "modified")
        .when(~F.col("has_parity") | ~F.coalesce("table_ok", F.lit(True)), F.when(same, "ok").otherwise("unrecoverable"))
        .when((F.col("bad") == 0) & same, "ok")
        .when(F.coalesce("margin_ok", F.lit(True)), "corrupt")
        .otherwise("unrecoverable")
    )
    message = (
        F.when((F.col("extra_bytes") > 0) & (F.col("bad") <= 1), F.concat(F.col("extra_bytes").cast("string"), F.lit(" extra bytes appended")))
        .when(F.col("unreadable") > 0, F.concat(F.col("unreadable").cast("string"), F.lit(" unreadable block(s)")))
        .otherwise(F.concat(F.col("bad").cast("string"), F.lit(" bad block(s) of "), F.col("n_blocks").cast("string")))
    )
    return pairs.where("indexed").withColumn("new_state", state).withColumn("message", F.when(F.col("new_state").isin("corrupt", "unrecoverable") & F.col("bad").isNotNull(), message))


def imported(listed: DataFrame, disk: DataFrame, files: DataFrame, algorithm: str, native: str, trust: bool = False) -> DataFrame:
    """path, outcome of each line of a checksum list (path, digest). disk: path, hash (native) and foreign (the list's algorithm)."""
    rows = listed.join(disk.select("path", "hash", "foreign", F.lit(True).alias("there")), "path", "left").join(files.select("path", "content_hash"), "path", "left")
    same_native = F.col("digest") == F.col("hash")
    if algorithm == native:
        outcome = (
            F.when(F.col("content_hash").isNotNull(), F.when(F.col("content_hash") == F.col("digest"), "verified").otherwise("mismatch"))
            .when(F.col("there").isNull(), "not found")
            .when(F.lit(trust), "trusted")
            .when(same_native, "indexed")
            .otherwise("mismatch")
        )
    else:
        good = F.col("digest") == F.col("foreign")
        outcome = (
            F.when(F.col("there").isNull(), "not found")
            .when(~good, "mismatch")
            .when(F.col("content_hash").isNull(), "indexed")
            .when(F.col("content_hash") == F.col("hash"), "verified")
            .otherwise("verified, index differs")
        )
    return rows.select("path", outcome.alias("outcome"))
