"""Parity sets: packing, members, block digests, margins and the life of a set."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, paths
from ..functions.geometry import Config, ceil_div, little_endian


def distinct_contents(files: DataFrame, hash_column: str = "content_hash") -> DataFrame:
    """hash, size, path: the first path, in order of its parts, of each content that isn't empty."""
    rows = files.where("size > 0").select(F.col(hash_column).alias("hash"), "size", "path")
    return rows.groupBy("hash", "size").agg(F.min(paths.components(F.col("path"))).alias("p")).select("hash", "size", F.array_join("p", "/").alias("path"))


def packed(contents: DataFrame, target: int, most: int = geometry.MOST_MEMBERS) -> DataFrame:
    """hash, size, g, ord: groups in order of path parts, closed once they hold `target` bytes; a content that large stands alone.

    The rule depends on all that came before, so one task folds over (hash, size), sorted by path; no content is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, count = 0, 0, 0
        for b in batches:
            groups, places = [], []
            for size in b.column("size").to_pylist():
                if count and (held >= target or count >= most or size >= target):
                    g, held, count = g + 1, 0, 0
                groups.append(g)
                places.append(count)
                held, count = held + size, count + 1
            yield pa.RecordBatch.from_arrays([b.column("hash"), b.column("size"), pa.array(groups, pa.int64()), pa.array(places, pa.int64())], ["hash", "size", "g", "ord"])

    ordered = contents.select("hash", "size", paths.components(F.col("path")).alias("p")).repartition(1).sortWithinPartitions("p", "hash")
    return ordered.select("hash", "size").mapInArrow(run, "hash string, size long, g long, ord long")


def members(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """g, ord, content_hash, size, first_block, n_blocks."""
    n = ceil_div(F.col("size"), F.col("block_size"))
    before = F.sum("n_blocks").over(Window.partitionBy("g").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_blocks")
    return groups.join(sets.select("g", "block_size"), "g").withColumn("n_blocks", n).select("g", "ord", F.col("hash").alias("content_hash"), "size", before.alias("first_block"), "n_blocks")


def set_ids(member_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """g, set_id: digest of the geometry and of all members' digests and sizes in order. A set has 32768 members at most."""
    table = F.transform(F.array_sort(F.collect_list(F.struct("ord", "content_hash", "size"))), lambda m: F.concat(F.upper(m["content_hash"]), little_endian(m["size"], 8)))
    joined = member_rows.groupBy("g").agg(F.array_join(table, "").alias("table")).join(sets, "g")
    head = F.concat(*(little_endian(F.col(c), 4) for c in ("block_size", "blocks_per_stripe", "parity_ppm", "min_parity_blocks", "n_members")), F.lit("00000000"))
    return joined.select("g", F.sha2(F.unhex(F.concat(head, "table")), 256).alias("set_id"))


def blocks(contents: DataFrame, size: Column) -> DataFrame:
    """contents (with `content` and others) with a row for each block: b and bytes, the last one as short as it is."""
    n = ceil_div(F.octet_length("content").cast("long"), size)
    rows = contents.where(F.octet_length("content") > 0).select("*", size.alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("b"))
    return rows.withColumn("bytes", F.substring("content", (F.col("b") * F.col("_b") + 1).cast("int"), F.col("_b").cast("int"))).drop("content", "_b")


def padded(data: Column, size: Column) -> Column:
    return F.rpad(data, size.cast("int"), F.lit(b"\0"))


def block_digest(data: Column, size: Column) -> Column:
    return F.sha2(padded(data, size), 256)


def table_digest(block_rows: DataFrame, keys: list[str], order: str, digest: str = "hash") -> DataFrame:
    """Digest of the digests of each group in order: of a set's block table, or of a stripe's shards."""
    table = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest]), "")
    return block_rows.groupBy(*keys).agg(F.sha2(F.unhex(table), 256).alias("table_digest"), F.count("*").alias("n_blocks"))


def stripe_digests(hashes: DataFrame, shards: DataFrame) -> DataFrame:
    """set_id, stripe, blocks, shards: digest of a stripe's block digests and of its shards' digests, each in order. hashes: set_id, stripe, g, hash."""
    one = table_digest(hashes, ["set_id", "stripe"], "g").select("set_id", "stripe", F.col("table_digest").alias("blocks"))
    own = shards.select("set_id", "stripe", "idx", F.sha2("bytes", 256).alias("hash"))
    two = table_digest(own, ["set_id", "stripe"], "idx").select("set_id", "stripe", F.col("table_digest").alias("shards"))
    return one.join(two, ["set_id", "stripe"], "full_outer")


def damaged_stripes(sets: DataFrame, block_rows: DataFrame, digests: DataFrame, column: str = "blocks") -> DataFrame:
    """g, stripe whose block digests (block_rows: g, b, hash) aren't those that `digests` (g, stripe, blocks) recorded."""
    rows = block_rows.join(sets.select("g", "blocks_per_stripe"), "g").withColumn("stripe", geometry.floor_div(F.col("b"), F.col("blocks_per_stripe")))
    now = table_digest(rows, ["g", "stripe"], "b").select("g", "stripe", "table_digest")
    want = geometry.stripes(sets).where("data_blocks > 0").select("g", "stripe").join(digests.select("g", "stripe", column), ["g", "stripe"], "left")
    return want.join(now, ["g", "stripe"], "left").where(~F.coalesce(F.col(column) == F.col("table_digest"), F.lit(False))).select("g", "stripe")


def damaged_shards(sets: DataFrame, shard_rows: DataFrame, digests: DataFrame) -> DataFrame:
    """g, stripe whose shards (g, stripe, idx, bytes) aren't those that were written."""
    now = table_digest(shard_rows.select("g", "stripe", "idx", F.sha2("bytes", 256).alias("hash")), ["g", "stripe"], "idx").select("g", "stripe", "table_digest")
    want = geometry.stripes(sets).where("parity_blocks > 0").select("g", "stripe").join(digests.select("g", "stripe", "shards"), ["g", "stripe"], "left")
    return want.join(now, ["g", "stripe"], "left").where(~F.coalesce(F.col("shards") == F.col("table_digest"), F.lit(False))).select("g", "stripe")


def adoptable(sets: DataFrame, digests: DataFrame, block_rows: DataFrame, shard_rows: DataFrame) -> DataFrame:
    """set_id, part of the sets whose every stripe lies in a part of the store with the digests recorded there; the first such part."""
    key = lambda x: x.withColumn("g", F.concat_ws("|", "set_id", "part"))
    shape = key(sets.drop("part").join(digests.select("set_id", "part").distinct(), "set_id"))
    marks = key(digests)
    torn = damaged_stripes(shape, key(block_rows.withColumnRenamed("g", "b")), marks).union(damaged_shards(shape, key(shard_rows), marks))
    return shape.join(torn.select("g").distinct(), "g", "left_anti").groupBy("set_id").agg(F.min("part").alias("part"))


def ejected(groups: DataFrame, lost: DataFrame) -> DataFrame:
    """Groups (hash, size, g, ord) that hold one of the lost members (g, ord), without those, and numbered anew."""
    left = groups.join(lost.select("g").distinct(), "g", "left_semi").join(lost, ["g", "ord"], "left_anti")
    return left.withColumn("ord", F.row_number().over(Window.partitionBy("g").orderBy("ord")).cast("long") - 1).select("hash", "size", "g", "ord")


def block_owners(member_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, b, ord, at: which member each wanted block (g, b) of a set belongs to, and its place there. Blocks come from the members, so the join is by value."""
    end = F.col("first_block") + F.col("n_blocks") - 1
    each = member_rows.select("g", "ord", "first_block", F.explode(F.sequence("first_block", end)).alias("b"))
    return wanted.join(each, ["g", "b"]).select("g", "b", "ord", (F.col("b") - F.col("first_block")).alias("at"))


def memberships(member_rows: DataFrame, sets: DataFrame, content_hash: str) -> DataFrame:
    """All memberships of a content with their sets' times, oldest first."""
    rows = member_rows.where(F.col("content_hash") == content_hash)
    return rows.join(sets.select("set_id", "created_at"), "set_id").orderBy("created_at", "set_id", "ord")


# ---------------------------------------------------------------- margins


def per_stripe(member_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """member rows with a row for each stripe touched: stripe, overlap (blocks there)."""
    rows = member_rows.join(sets.select("g", "blocks_per_stripe"), "g")
    s = F.col("blocks_per_stripe")
    end = F.col("first_block") + F.col("n_blocks")
    each = rows.select("*", F.explode(F.sequence(geometry.floor_div(F.col("first_block"), s), geometry.floor_div(end - 1, s))).alias("stripe"))
    overlap = F.least(end, (F.col("stripe") + 1) * s) - F.greatest("first_block", F.col("stripe") * s)
    return each.withColumn("overlap", overlap).drop("blocks_per_stripe")


def dead_blocks(member_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """g, stripe, dead: blocks of dead members, for stripes that have some."""
    return per_stripe(member_rows.where("dead"), sets).groupBy("g", "stripe").agg(F.sum("overlap").alias("dead"))


def loss_protected(member_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """g, ord, protected: whether parity covers the loss of the whole member next to the dead ones, in all its stripes."""
    gone = dead_blocks(member_rows, sets).withColumnRenamed("dead", "gone")
    rows = per_stripe(member_rows, sets).join(gone, ["g", "stripe"], "left").join(geometry.stripes(sets), ["g", "stripe"])
    others = F.coalesce("gone", F.lit(0)) - F.when(F.col("dead"), F.col("overlap")).otherwise(0)
    return rows.groupBy("g", "ord").agg(F.bool_and(F.col("overlap") + others <= F.col("parity_blocks")).alias("protected"))


def margins(bad: DataFrame, dead: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, margin_ok: bad blocks (keys, g, stripe) plus dead ones fit into the parity of each stripe touched."""
    rows = bad.groupBy(*keys, "g", "stripe").agg(F.count("*").alias("bad")).join(dead, ["g", "stripe"], "left").join(geometry.stripes(sets), ["g", "stripe"])
    return rows.groupBy(*keys).agg(F.bool_and(F.col("bad") + F.coalesce("dead", F.lit(0)) <= F.col("parity_blocks")).alias("margin_ok"))


# ---------------------------------------------------------------- membership


def live_membership(member_rows: DataFrame) -> DataFrame:
    """The first live membership, by set and place, of each content."""
    w = Window.partitionBy("content_hash").orderBy("set_id", "ord")
    return member_rows.where("not dead").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def converged(member_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """members with `dead` also where another live membership of the content is in a set with fewer dead blocks, or an older one."""
    worn = member_rows.groupBy("set_id").agg(F.sum(F.when(F.col("dead"), F.col("n_blocks")).otherwise(0)).alias("worn"))
    rows = member_rows.join(worn, "set_id").join(sets.select("set_id", "created_at"), "set_id")
    w = Window.partitionBy("content_hash", "dead").orderBy("worn", "created_at", "set_id", "ord")
    return rows.withColumn("dead", F.col("dead") | (F.row_number().over(w) > 1)).drop("worn", "created_at")


def duplicates(member_rows: DataFrame) -> DataFrame:
    return member_rows.where("not dead").groupBy("content_hash").agg(F.count("*").alias("memberships")).where("memberships > 1")


def degraded(sets: DataFrame, member_rows: DataFrame) -> DataFrame:
    return sets.join(member_rows.where("dead").select("g"), "g", "left_semi")


def underfull(sets: DataFrame, config: Config) -> DataFrame:
    return sets.where(F.col("data_bytes") * 2 < config.stripe_size)


def sources(member_rows: DataFrame, files: DataFrame, disk: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """g, ord, source (first intact file by path), blocker (why there is none) of the live members that aren't excluded."""
    rows = member_rows.where("not dead")
    if excluded is not None:
        rows = rows.join(excluded.select("content_hash"), "content_hash", "left_anti")
    held = files.select("content_hash", "path", "state", F.col("size").alias("f_size"), "mtime_ns").join(disk.select("path", F.col("size").alias("d_size"), F.col("mtime_ns").alias("d_mtime_ns")), "path", "left")
    reason = F.when(F.col("state") != "ok", F.concat(F.lit("state is "), F.col("state"))).when(F.col("d_size").isNull(), "not on disk").when(~F.col("f_size").eqNullSafe(F.col("d_size")) | ~F.col("mtime_ns").eqNullSafe(F.col("d_mtime_ns")), "changed on disk")
    held = held.withColumn("reason", reason)
    best = held.groupBy("content_hash").agg(F.min(F.when(F.col("reason").isNull(), F.col("path"))).alias("source"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("path"))).alias("reason"))
    return rows.join(best, "content_hash", "left").select("g", "ord", "content_hash", "source", F.when(F.col("source").isNull(), F.coalesce("reason", F.lit("no file"))).alias("blocker"))


def eligible(source_rows: DataFrame) -> DataFrame:
    """g, eligible, blockers: a set can be dissolved when every live member has a readable source."""
    return source_rows.groupBy("g").agg(F.bool_and(F.col("source").isNotNull()).alias("eligible"), F.count("blocker").alias("blockers"))


def pool(parts: list[DataFrame]) -> DataFrame:
    """hash, size, path of several parts, a content once; earlier parts win."""
    out = None
    for k, part in enumerate(parts):
        one = part.select("hash", "size", "path", F.lit(k).alias("part"))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("hash").orderBy("part", paths.components(F.col("path")))
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def rehomed(old: DataFrame, now: DataFrame) -> DataFrame:
    """g, rehomed: whether each live member of old sets lives in another set too. old, now: g, set_id, content_hash, dead."""
    elsewhere = now.where("not dead").select("content_hash", F.col("set_id").alias("other"))
    rows = old.where("not dead").select("g", "set_id", "ord", "content_hash").join(elsewhere, "content_hash", "left")
    each = rows.groupBy("g", "ord").agg(F.max(F.coalesce(F.col("other") != F.col("set_id"), F.lit(False))).alias("found"))
    return each.groupBy("g").agg(F.bool_and("found").alias("rehomed"))


def dying(files: DataFrame, doomed: DataFrame) -> DataFrame:
    """content_hash of contents all of whose files are doomed (path)."""
    rows = files.join(doomed.select("path", F.lit(True).alias("doomed")), "path", "left")
    return rows.groupBy("content_hash").agg(F.bool_and(F.coalesce("doomed", F.lit(False))).alias("all_doomed")).where("all_doomed").select("content_hash")


def affected(dying_rows: DataFrame, member_rows: DataFrame) -> DataFrame:
    return member_rows.where("not dead").join(dying_rows, "content_hash", "left_semi").select("g").distinct()


def uncovered(files_with_mode: DataFrame, live: DataFrame) -> DataFrame:
    """content_hash of live members none of whose files should have parity."""
    wanted = files_with_mode.groupBy("content_hash").agg(F.bool_or(F.col("mode") == "include").alias("wanted"))
    return live.select("content_hash").distinct().join(wanted, "content_hash", "left").where(~F.coalesce("wanted", F.lit(False))).select("content_hash")
