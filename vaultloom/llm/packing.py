"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Each document's ids (plus one end id) are cut into full windows and a remainder; remainders are cut into parts of at
most a quarter window, so that differencing has parts small enough to level the windows. A task pools the parts of its
input split, and differences each pool into ceil(total / capacity) windows; while some window exceeds the capacity, the
count rises by one and the pool is differenced anew. Nothing is shuffled, a pool bounds the memory, and a lost task is
simply run again with the same result.

Defined results: null text counts as empty and has the end id only; ids of rows may repeat or be null (each row is a
document of its own); other columns are ignored; an empty table gives no pieces; a text of any length is cut without loss.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import pieces

SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: splits parts 0..n-1 into `windows` groups of near-equal total; returns the parts of each non-empty group.

    A partial partition holds the totals of its non-empty groups, largest first. The two with the widest spread are
    merged, the largest group of one meeting the smallest of the other, until one partition is left.
    """
    children: list[tuple[int, int]] = []
    n = len(sizes)
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = windows - len(b)  # that many of a's groups meet an empty one
        merged = a[:free]
        for (s, x), (t, y) in zip(a[free:], b[::-1]):
            children.append((x, y))
            merged.append((s + t, n + len(children) - 1))
        merged += b[: max(0, len(b) - max(0, len(a) - free))]
        merged.sort(reverse=True)
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], count, merged))
        count += 1
    groups = []
    for _, node in heap[0][2] if heap else []:
        todo, members = [node], []
        while todo:
            node = todo.pop()
            if node < n:
                members.append(node)
            else:
                todo += children[node - n]
        groups.append(sorted(members))
    return groups


def pack_pool(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of parts, none above the capacity: the window count rises until differencing keeps to it."""
    windows = -(-sum(sizes) // capacity)
    while True:
        groups = difference(sizes, windows)
        if all(sum(sizes[k] for k in g) <= capacity for g in groups):
            return groups
        windows += 1


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, pool_windows: int = 512) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    Pieces of one sequence_id lie without gaps from offset 0 to at most `capacity` ids.
    """
    tokenizer = tokenizer or tokens.default_path()
    part = max(1, capacity // 4)
    kind = df.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.TextTokenizer(tokenizer)
        first = TaskContext.get().partitionId() << 36
        made = 0
        pool: list[tuple] = []
        pooled = 0
        out: list[tuple] = []

        def close(groups):
            nonlocal made
            for g in groups:
                at = 0
                for doc, start, ids, total in g:
                    out.append((doc, start, len(ids), ids.tobytes(), total, first + made, at))
                    at += len(ids)
                made += 1

        def flush():
            nonlocal pool, pooled
            close([[pool[k] for k in g] for g in pack_pool([len(p[2]) for p in pool], capacity)])
            pool, pooled = [], 0

        def batch():
            nonlocal out
            cols, out = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        names, types = [], []
        for b in pieces(batches, "text"):
            if not names:
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
                types = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(texts)):
                ids = np.append(ids, np.int32(end_id)).astype("<u4")
                whole = len(ids) // capacity * capacity
                close([[(doc, s, ids[s : s + capacity], len(ids))] for s in range(0, whole, capacity)])
                for s in range(whole, len(ids), part):
                    pool.append((doc, s, ids[s : s + part], len(ids)))
                pooled += len(ids) - whole
                if pooled >= pool_windows * capacity:
                    flush()
                if len(out) >= 2000:
                    yield batch()
        if pool:
            flush()
        if out:
            yield batch()

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, {SCHEMA}")


def digest(pieces_df: DataFrame) -> DataFrame:
    """packed() with a checksum in place of the ids."""
    return pieces_df.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
