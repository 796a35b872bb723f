"""Reading an archive's directory tree and its contents."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, mtime_ns long, inode long, kind string, error string"
CHUNK = 1 << 20
STATE = "_state"
TEMPORARY = ".repairing."


class TreeDataSource(DataSource):
    """spark.read.format("archive_tree").option("root", ...): a row for each file, link, unreadable directory or name that isn't UTF-8.

    `roots` (a JSON list) are the subtrees to walk, all by default; `skip` is a regular expression of relative paths whose whole
    subtree is left out. Directories are opened level by level until there is work for SPLITS tasks, then dealt out.
    The state directory, the root's .zfs and files of unfinished repairs never show; kind is file, link, other, unreadable or badname.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


SPLITS, OPENED = 256, 512


class Entries(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.skip = options["root"], options.get("skip") or None
        self.roots = json.loads(options.get("roots") or '[""]')

    def partitions(self) -> list[InputPartition]:
        skip = re.compile(self.skip).search if self.skip else lambda _: None
        units, opened = [r for r in dict.fromkeys(self.roots) if not r or os.path.lexists(os.path.join(self.root, r))], 0
        units = [r for r in units if not any(r != o and (not o or r.startswith(o + "/")) for o in units)]
        plain: list[str] = []
        while units and opened < OPENED and len(units) + len(plain) < SPLITS:
            deeper = []
            for path in units:
                full = os.path.join(self.root, path) if path else self.root
                names = None
                if opened < OPENED and not os.path.islink(full) and os.path.isdir(full) and not (path and skip(path)):
                    with contextlib.suppress(OSError):
                        names = sorted(os.listdir(full))
                if names is None:
                    plain.append(path)
                else:
                    opened += 1
                    deeper += [child(path, n) for n in names if shown(path, n)]
            units = deeper
        every = plain + units
        size = max(1, -(-len(every) // SPLITS))
        return [Entries([p.encode("utf-8", "surrogateescape") for p in every[k::-(-len(every) // size)]]) for k in range(-(-len(every) // size))] or [Entries([])]

    def read(self, partition: Entries) -> Iterator[tuple]:
        skip = re.compile(self.skip).search if self.skip else lambda _: None
        for path in partition.paths:
            yield from walk(self.root, path.decode("utf-8", "surrogateescape"), skip)


def child(path: str, name: str) -> str:
    return f"{path}/{name}" if path else name


def shown(path: str, name: str) -> bool:
    return bool(path) or name not in (STATE, ".zfs")


def row(path: str, s: os.stat_result, kind: str) -> tuple:
    return path, s.st_size, s.st_mtime_ns, s.st_ino, kind, None


def walk(root: str, path: str, skip) -> Iterator[tuple]:
    """Rows of a path and all below it, by name. A name that isn't UTF-8 gives one row, shown with replacement characters, and nothing below it."""
    if any(0xD800 <= ord(c) < 0xE000 for c in path):
        yield path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), None, None, None, "badname", "the name isn't UTF-8"
        return
    if skip(path):
        return
    full = os.path.join(root, path) if path else root
    try:
        s = os.lstat(full)
    except OSError as e:
        yield path, None, None, None, "unreadable", e.strerror
        return
    mode = s.st_mode & 0o170000
    if mode == 0o040000:
        try:
            names = sorted(os.listdir(full))
        except OSError as e:
            yield path, None, None, None, "unreadable", e.strerror
            return
        for name in names:
            if shown(path, name):
                yield from walk(root, child(path, name), skip)
    elif TEMPORARY not in os.path.basename(path):
        yield row(path, s, {0o100000: "file", 0o120000: "link"}.get(mode, "other"))


def tree(spark: SparkSession, root: str, skip: str | None = None, roots: list[str] = ("",)) -> DataFrame:
    spark.dataSource.register(TreeDataSource)
    reader = spark.read.format("archive_tree").option("root", root).option("roots", json.dumps(list(roots)))
    return (reader.option("skip", skip) if skip else reader).load()


def hasher(algo: str):
    if algo == "sha256":
        return hashlib.sha256()

    class Whole:
        def __init__(self):
            self.parts = []

        def update(self, data: bytes) -> None:
            self.parts.append(data)

        def hexdigest(self) -> str:
            from ..functions import blake3

            return blake3.digest(b"".join(self.parts)).hex()

    return Whole()


def digested(files: DataFrame, root: str, *algos: str) -> DataFrame:
    """files (path, size, mtime_ns) with hash, further digests, settled and error: contents read once, in chunks, by the tasks.

    settled is false if size or time changed meanwhile; error holds what stopped a read. Every executor must see `root`.
    """
    algos = algos or ("sha256",)
    names = ["hash", *(f"hash_{k}" for k in range(1, len(algos)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, size, mtime in zip(*(b.column(c).to_pylist() for c in ("path", "size", "mtime_ns"))):
                full, hashes, error = os.path.join(root, path), [hasher(a) for a in algos], None
                try:
                    with open(full, "rb") as f:
                        while chunk := f.read(CHUNK):
                            for h in hashes:
                                h.update(chunk)
                    s = os.stat(full)
                    settled = (s.st_size, s.st_mtime_ns) == (size, mtime)
                except OSError as e:
                    settled, error = False, e.strerror or str(e)
                out.append((*(None if error else h.hexdigest() for h in hashes), settled, error))
            cols = list(zip(*out)) if out else [()] * (len(names) + 2)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string()) for c in cols[:-2]), pa.array(cols[-2], pa.bool_()), pa.array(cols[-1], pa.string())], [*b.schema.names, *names, "settled", "error"])

    rows = files.select("path", "size", "mtime_ns")
    return rows.mapInArrow(run, "path string, size long, mtime_ns long, " + ", ".join(f"{n} string" for n in names) + ", settled boolean, error string")


def read_tolerant(full: str, offset: int, length: int, block: int) -> tuple[bytes, list[int]]:
    """A region of a file; blocks that can't be read are zeroed and numbered."""
    with open(full, "rb", buffering=0) as f:
        try:
            return os.pread(f.fileno(), length, offset), []
        except OSError:
            parts, bad = [], []
            for k in range(-(-length // block)):
                n = min(block, length - k * block)
                try:
                    parts.append(os.pread(f.fileno(), n, offset + k * block))
                except OSError:
                    parts.append(b"\0" * n)
                    bad.append(k)
            return b"".join(parts), bad


def file_blocks(files: DataFrame, root: str, keep: list[str]) -> DataFrame:
    """A row for each recorded block of files (path, size, block_size, n_blocks and kept columns): b, bytes (null if missing or unreadable), short.

    A block shorter on disk than recorded is null; a file that isn't there has null blocks only.
    """
    types = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (path, size, bs, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "size", "block_size", "n_blocks")))):
                step = max(1, (1 << 22) // bs)
                for at in range(0, n, step):
                    count = min(step, n - at)
                    try:
                        data, bad = read_tolerant(os.path.join(root, path), at * bs, min(count * bs, size - at * bs), bs) if path is not None else (b"", [])
                    except OSError:
                        data, bad = b"", []
                    rows = []
                    for i in range(count):
                        want = min(bs, size - (at + i) * bs)
                        part = data[i * bs : i * bs + want]
                        rows.append(None if i in bad or len(part) < want else part.ljust(bs, b"\0"))
                    took = b.take(pa.array([k] * count))
                    yield pa.RecordBatch.from_arrays([*(took.column(c) for c in keep), pa.array(range(at, at + count), pa.int64()), pa.array(rows, pa.binary()), pa.array([i in bad for i in range(count)])], [*keep, "b", "bytes", "unreadable"])

    need = [c for c in ("path", "size", "block_size", "n_blocks") if c not in keep]
    return files.select(*keep, *need).mapInArrow(run, f"{types}, b long, bytes binary, unreadable boolean")


def digested_blocks(files: DataFrame, root: str, algo: str, keep: list[str]) -> DataFrame:
    """Files with recorded blocks (path, size, mtime_ns, block_size, n_blocks, m_size and kept columns), read once for both digests.

    A row for each block: b, now (null if missing, short or unreadable) and unreadable; and one with a null b for the whole file:
    hash, settled, error. Blocks are cut at the recorded size m_size.
    """
    types = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    names = ["b", "now", "unreadable", "hash", "settled", "error"]
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]

    def of(path: str, size: int, mtime: int, bs: int, n: int, recorded: int) -> Iterator[tuple]:
        full, whole, error, at = os.path.join(root, path), hasher(algo), None, 0
        step = max(1, CHUNK // bs) * bs
        try:
            while at < max(recorded, size):
                data, bad = read_tolerant(full, at, min(step, max(recorded, size) - at), bs)
                if bad:
                    error = "Input/output error"
                whole.update(data[: max(0, size - at)])
                for k in range(0, min(step, recorded - at), bs):
                    want, part = min(bs, recorded - at - k), data[k : k + bs]
                    lost = k // bs in bad
                    part = part[:want]
                    yield (at + k) // bs, None if lost or len(part) < want else hashlib.sha256(part.ljust(bs, b"\0")).hexdigest(), lost, None, None, None
                at += step
            s = os.stat(full)
            yield None, None, None, None if error else whole.hexdigest(), (s.st_size, s.st_mtime_ns) == (size, mtime), error
        except OSError as e:
            for b in range(at // bs, n):
                yield b, None, True, None, None, None
            yield None, None, None, None, False, e.strerror or str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, values in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "size", "mtime_ns", "block_size", "n_blocks", "m_size")))):
                rows: list[tuple] = []
                for r in of(*values):
                    rows.append(r)
                    if r[0] is None or len(rows) >= 4096:
                        took = batch.take(pa.array([k] * len(rows)))
                        yield pa.RecordBatch.from_arrays([*(took.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*keep, *names])
                        rows = []

    need = [c for c in ("path", "size", "mtime_ns", "block_size", "n_blocks", "m_size") if c not in keep]
    return files.select(*keep, *need).mapInArrow(run, f"{types}, b long, now string, unreadable boolean, hash string, settled boolean, error string")


def datasets(listing: str) -> list[tuple[str, str, int]]:
    """name, mountpoint, record size of the lines of a tab-separated dataset listing; others are skipped."""
    out = []
    for line in listing.splitlines():
        part = line.split("\t")
        if len(part) >= 3 and part[1].startswith("/") and part[2].isdigit():
            out.append((part[0], part[1], int(part[2])))
    return out


def dataset_of(found: list[tuple[str, str, int]], path: str) -> tuple[str, str, int] | None:
    """The dataset with the longest mountpoint above the path."""
    above = [d for d in found if path == d[1] or path.startswith(d[1].rstrip("/") + "/")]
    return max(above, key=lambda d: len(d[1]), default=None)


def stored_bytes(spark: SparkSession, directory: str) -> int:
    if not os.path.isdir(directory):
        return 0
    return tree(spark, directory).where("kind = 'file'").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
