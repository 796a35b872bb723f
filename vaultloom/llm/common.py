"""Shared helpers: table reading, scratch tables in the shared folder, Arrow text buffers, vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import glob
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed to _c0, _c1, ..., which clash with nothing that operators add, and the names they had."""
    return df.toDF(*(f"_c{k}" for k in range(len(df.columns)))), df.columns


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master (tests) gets a folder of its own when the setting is missing; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="vaultloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet under shared_dir and reads it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    # shuffle files go once the driver's garbage is collected, which it may not do for a long while
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the scratch tables this process wrote, but for the last `keep`. Call it once results are stored."""
    while len(_written) > keep:
        _delete(spark, _written.pop(0))


HOT_KEYS, HOT_ROWS = 256, 2000


def spread_join(big: DataFrame, small: DataFrame, on: list[str], sizes: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """big joined with small, no key's rows in one task: sizes (on, n) counts big's rows of each key.

    The HOT_KEYS largest keys (a table of that many rows goes out with the tasks) are dealt by a hash of big's columns `by`
    into parts of about HOT_ROWS rows, and small's rows of these keys are there once a part. A smaller key holds less than
    1 / HOT_KEYS of all rows.
    """
    hot = sizes.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *on).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(*on, F.least(F.lit(4096), F.ceil(F.col("n") / HOT_ROWS)).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    right = small.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


CUT = 128


def cuts(array: Column) -> Column:
    """0, 1, ... for each CUT entries of an array."""
    return F.filter(F.sequence(F.lit(0), F.floor(F.size(array) / CUT).cast("int")), lambda k: k * CUT < F.size(array))


def running(values: Column, zero: int, op) -> Column:
    """op over all entries before each one, and last over all of them (bigint). Cut in two levels, so that building it isn't quadratic."""
    start = F.lit(zero).cast("bigint")

    def along(part: Column, first: Column) -> Column:
        state = F.struct(first.alias("now"), F.array().cast("array<bigint>").alias("seen"))
        return F.aggregate(part, state, lambda a, x: F.struct(op(a["now"], x).alias("now"), F.concat(a["seen"], F.array(a["now"])).alias("seen")), lambda a: a["seen"])

    parts = F.transform(cuts(values), lambda k: F.slice(values, k * CUT + 1, F.lit(CUT)))
    parts = F.transform(parts, lambda p: F.struct(p.alias("p"), F.aggregate(p, start, op).alias("all")))

    def levels(p: Column) -> Column:
        firsts = along(F.transform(p, lambda x: x["all"]), start)
        return F.concat(F.flatten(F.zip_with(p, firsts, lambda x, f: along(x["p"], f))), F.array(F.aggregate(p, start, lambda a, x: op(a, x["all"]))))

    return let(parts, levels)


def one_thread() -> None:
    """Has numpy's OpenBLAS use one thread in this process: for small products, threads that wait double the CPU time."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


# ---------------------------------------------------------------- Arrow text


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string (or binary) column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts record batches at row borders so that each piece holds about `most` bytes of text (a longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)


# ---------------------------------------------------------------- word hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1


def _byte_table(seed: int) -> np.ndarray:
    values = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[_SPACE] = 0
    return values


_TABLE = _byte_table(20240611)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift and multiply rounds), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased.

    Returns hashes, each text's range in them (n + 1 offsets), and the words' first and last-plus-one byte.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's border also ends a word
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64), starts, ends


def word_hash(word: str) -> int:
    """word_hashes of one word, for tests and small tables."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words of one text; a shorter text has one run of all its words; none without words."""
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    total = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        factor = int(mix(np.array([k + 1], np.uint64))[0]) | 1
        total += words[k : n - w + 1 + k] * np.uint64(factor)
    return mix(total)
