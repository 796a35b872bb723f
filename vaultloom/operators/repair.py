"""Encoding parity shards and rebuilding blocks, a stripe a group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import galois


def shards(block_rows: DataFrame) -> DataFrame:
    """g, stripe, idx, bytes of parity. block_rows: g, stripe, j (place in the stripe), bytes (padded), parity_blocks.

    A group is one stripe, whose size the configuration bounds.
    """

    kind = block_rows.schema["g"].dataType.simpleString()

    def encode(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("j").to_pylist(), group.column("bytes").to_pylist()))
        p = group.column("parity_blocks")[0].as_py()
        out = galois.encode([b for _, b in rows], p, len(rows[0][1]))
        n = len(out)
        return pa.table({"g": pa.array([group.column("g")[0].as_py()] * n, group.column("g").type), "stripe": pa.array([group.column("stripe")[0].as_py()] * n, pa.int64()), "idx": pa.array(range(n), pa.int64()), "bytes": pa.array(out, pa.binary())})

    return block_rows.select("g", "stripe", "j", "bytes", "parity_blocks").groupBy("g", "stripe").applyInArrow(encode, f"g {kind}, stripe long, idx long, bytes binary")


def rebuilt(block_rows: DataFrame, shard_rows: DataFrame) -> DataFrame:
    """g, stripe, j, bytes of blocks whose bytes are null in block_rows; bytes stay null where more were lost than parity is left.

    Only stripes that lost something are grouped at all.
    """
    worn = block_rows.where("bytes is null").select("g", "stripe").distinct()
    data = block_rows.join(worn, ["g", "stripe"], "left_semi").select("g", "stripe", "j", "bytes")
    parity = shard_rows.join(worn, ["g", "stripe"], "left_semi").select("g", "stripe", "idx", "bytes")

    def decode(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(left.column("j").to_pylist(), left.column("bytes").to_pylist()), key=lambda r: r[0])
        kept = sorted(zip(right.column("idx").to_pylist(), right.column("bytes").to_pylist()), key=lambda r: r[0])
        size = next((len(b) for _, b in [*kept, *rows] if b is not None), 0)
        found = galois.decode([b for _, b in rows], [b for _, b in kept], size)
        lost = [(j, None if found is None else found[k]) for k, (j, b) in enumerate(rows) if b is None]
        n = len(lost)
        return pa.table({"g": pa.array([left.column("g")[0].as_py()] * n, left.column("g").type), "stripe": pa.array([left.column("stripe")[0].as_py()] * n, pa.int64()), "j": pa.array([j for j, _ in lost], pa.int64()), "bytes": pa.array([b for _, b in lost], pa.binary())})

    return data.groupBy("g", "stripe").cogroup(parity.groupBy("g", "stripe")).applyInArrow(decode, f"g {data.schema['g'].dataType.simpleString()}, stripe long, j long, bytes binary")


def restored(member_rows: DataFrame, block_rows: DataFrame, rebuilt_rows: DataFrame) -> DataFrame:
    """g, ord, digest, failed of members: blocks as they are or rebuilt, put together, cut to size and hashed.

    block_rows: g, ord, b, stripe, j, bytes.
    """
    fixed = rebuilt_rows.select("g", "stripe", "j", F.col("bytes").alias("fixed"))
    rows = block_rows.join(fixed, ["g", "stripe", "j"], "left").select("g", "ord", "b", F.coalesce("bytes", "fixed").alias("bytes"))
    parts = F.array_sort(F.collect_list(F.struct("b", F.hex("bytes").alias("h"))))
    whole = rows.groupBy("g", "ord").agg(F.array_join(F.transform(parts, lambda p: p["h"]), "").alias("hx"), F.count_if(F.col("bytes").isNull()).alias("lost"))
    out = member_rows.join(whole, ["g", "ord"])
    digest = F.sha2(F.unhex(F.expr("left(hx, cast(2 * size as int))")), 256)
    return out.select("g", "ord", "content_hash", F.when(F.col("lost") == 0, digest).alias("digest"), (F.col("lost") > 0).alias("failed"))
