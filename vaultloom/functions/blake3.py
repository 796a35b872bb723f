"""BLAKE3 after its public specification, in numpy: all chunks of an input are compressed side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Initial state, the permutation of message words, and the flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def _mix(v: np.ndarray, a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for m, r1, r2 in ((x, 16, 12), (y, 8, 7)):
        v[a] += v[b] + m
        v[d] = _rotate(v[d] ^ v[a], r1)
        v[c] += v[d]
        v[b] = _rotate(v[b] ^ v[c], r2)


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8 x n) of n inputs. cv: 8 x n, words: 16 x n."""
    n = cv.shape[1]
    v = np.concatenate((cv, np.repeat(IV[:4, None], n, 1), np.stack(((counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)))))
    m = words
    for turn in range(7):
        for k, at in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            _mix(v, *at, m[2 * k], m[2 * k + 1])
        if turn < 6:
            m = m[PERMUTATION]
    return v[:8] ^ v[8:]


def digest(data: bytes) -> bytes:
    n = max(1, -(-len(data) // CHUNK))
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words = padded.view("<u4").reshape(n, CHUNK // BLOCK, 16)
    sizes = np.full(n, CHUNK)
    sizes[-1] = len(data) - (n - 1) * CHUNK
    blocks = np.maximum(1, -(-sizes // BLOCK))
    cv = np.repeat(IV[:, None], n, 1)
    numbers = np.arange(n, dtype=np.int64)
    for b in range(CHUNK // BLOCK):
        on = np.flatnonzero(blocks > b)
        if not len(on):
            break
        last = blocks[on] == b + 1
        flags = CHUNK_START * (b == 0) + CHUNK_END * last + (ROOT * last if n == 1 else 0)
        cv[:, on] = compress(cv[:, on], np.ascontiguousarray(words[on, b].T.astype(np.uint32)), numbers[on], np.minimum(sizes[on] - b * BLOCK, BLOCK), flags)
    while cv.shape[1] > 1:  # neighbours meet; an odd one moves up, which is the tree of the specification
        pairs = cv.shape[1] // 2
        both = np.concatenate((cv[:, 0 : 2 * pairs : 2], cv[:, 1 : 2 * pairs : 2]))
        root = ROOT if cv.shape[1] == 2 else 0
        joined = compress(np.repeat(IV[:, None], pairs, 1), both, np.zeros(pairs, np.int64), np.full(pairs, BLOCK), np.full(pairs, PARENT + root))
        cv = np.concatenate((joined, cv[:, 2 * pairs :]), 1)
    return cv[:, 0].astype("<u4").tobytes()


def hex_digest(column):
    """Hex digests of a binary column."""

    def run(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in data:
            yield part.map(lambda x: None if x is None else digest(bytes(x)).hex())

    return F.pandas_udf(run, "string")(column)
