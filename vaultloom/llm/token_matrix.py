"""Packed token-id matrices: best-fit-decreasing packing with a segment tree over free capacities.

Documents (ids plus one end id) longer than a row are split without loss into full rows and a remainder. A task pools the
remainders of its input split, largest first, and puts each into the open row with the least free space that still holds
it; a segment tree over the capacities 0..row finds that row in O(log row). Rows are written as Parquet: `ids` holds one
row of the id matrix (little-endian, padded), `cu_seqlens` the cumulative segment lengths from 0 to the row's used
length, `resets` the columns at which positions start again from 0.

Defined results: null text counts as empty and has the end id only; ids of rows may repeat or be null; other columns are
ignored; an empty table gives no rows; texts of any length are split without loss.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import pieces, scratch


class CapacityTree:
    """Counts of open rows by free space; least(c) is the smallest free space of at least c, or None."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, free: int, by: int = 1) -> None:
        k = free + self.base
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, need: int) -> int | None:
        k, count = need + self.base, self.count
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.base:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.base
            k >>= 1
        return None


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: rows of part numbers, none above the capacity. Ties go to the part and the row that came first."""
    tree, open_rows, rows = CapacityTree(capacity), defaultdict(list), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        free = tree.least(sizes[k])
        if free is None:
            row, free = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[free].pop(0)
            tree.add(free, -1)
        rows[row].append(k)
        open_rows[free - sizes[k]].append(row)
        tree.add(free - sizes[k])
    return rows


def matrix_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 50256, pad_id: int = 0, pool_parts: int = 8192) -> DataFrame:
    """A row of the id matrix for each packed sequence.

    sequence_id, ids (binary: `capacity` ids of `id_bytes` bytes), id_bytes, n_tokens, cu_seqlens, resets, doc_ids, doc_starts.
    """
    tokenizer = tokenizer or tokens.default_path()
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.TextTokenizer(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1, pad_id + 1) <= 1 << 16 else 4
        first, made, schema = TaskContext.get().partitionId() << 36, 0, None
        pool: list[tuple] = []
        out: list[tuple] = []

        def put(parts):
            nonlocal made
            row = np.full(capacity, pad_id, f"<u{width}")
            at, borders = 0, [0]
            for _, _, ids in parts:
                row[at : at + len(ids)] = ids
                at += len(ids)
                borders.append(at)
            out.append((first + made, row.tobytes(), width, at, borders, borders[:-1], [p[0] for p in parts], [p[1] for p in parts]))
            made += 1

        def flush():
            nonlocal pool
            for row in best_fit([len(p[2]) for p in pool], capacity):
                put([pool[k] for k in row])
            pool = []

        def batch():
            nonlocal out
            cols, out = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in pieces(batches, "text"):
            if schema is None:
                schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("id_bytes", pa.int32()), ("n_tokens", pa.int64()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(b.schema.field("doc_id").type)), ("doc_starts", pa.list_(pa.int64()))])
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, np.int32(end_id))
                whole = len(ids) // capacity * capacity
                for s in range(0, whole, capacity):
                    put([(doc, s, ids[s : s + capacity])])
                if whole < len(ids):
                    pool.append((doc, whole, ids[whole:]))
                if len(pool) >= pool_parts:
                    flush()
                while len(out) >= 1000:
                    yield batch()
        if pool:
            flush()
        if out:
            yield batch()

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"sequence_id long, ids binary, id_bytes int, n_tokens long, cu_seqlens array<int>, resets array<int>, doc_ids array<{kind}>, doc_starts array<long>")


def position_ids(cu_seqlens: Column, capacity: int = 2048) -> Column:
    """Positions of a row: from 0 at each reset; padding counts from 0 too."""
    borders = F.concat(F.filter(cu_seqlens, lambda x: x < capacity), F.array(F.lit(capacity)))
    runs = F.transform(F.slice(borders, 2, F.size(borders) - 1), lambda end, k: F.sequence(F.lit(0), end - F.element_at(borders, k + 1) - 1))
    return F.flatten(runs)


def written(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the rows as Parquet, to `path` or the shared scratch folder, and returns what can be read back."""
    if path is None:
        return scratch(rows, "token-matrix")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("sequence_id", "n_tokens", F.size("resets").cast("long").alias("n_segments"), F.crc32("ids").alias("ids_crc32"), F.octet_length("ids").cast("long").alias("n_bytes"), "id_bytes", "cu_seqlens", "resets", "doc_ids", "doc_starts")
