import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultloom.functions import blake3, formats, galois, paths
from vaultloom.functions.geometry import Config
from vaultloom.operators import manifest
from vaultloom.sources import archive


def test_geometry(spark):
    """Golden shapes, by the columns that all plans use."""
    from vaultloom.functions import geometry

    def shape(sizes):
        rows = spark.createDataFrame([(0, n) for n in sizes], "g long, size long")
        one = geometry.set_geometry(rows, Config())
        first = geometry.stripes(one).where("stripe = 0").first()
        r = one.first()
        return r["block_size"], r["blocks_per_stripe"], r["n_blocks"], r["n_stripes"], first["parity_blocks"]

    assert shape([1000] * 100) == (64, 32768, 1600, 1, 1600)
    assert shape([10 << 30]) == (65536, 2048, 163840, 80, 103)
    for bad in (dict(block_size=100), dict(stripe_size=1), dict(parity_ppm=2_000_000), dict(algo="md5"), dict(parity_default="x"), dict(parity_min_bytes=1 << 30)):
        with pytest.raises(ValueError):
            Config(**bad).checked()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 60), st.integers(1, 12), st.randoms())
def test_any_losses_up_to_parity_come_back(d, p, r):
    data = [r.randbytes(64) for _ in range(d)]
    parity = galois.encode(data, p, 64)
    lost = r.sample(range(d + p), min(p, d + p))
    got = galois.decode([None if k in lost else b for k, b in enumerate(data)], [None if d + k in lost else b for k, b in enumerate(parity)], 64)
    assert all(got[k] == data[k] for k in lost if k < d)


def test_too_many_losses():
    data = [os.urandom(64) for _ in range(5)]
    assert galois.decode([None, None, None, *data[3:]], galois.encode(data, 2, 64), 64) is None


def test_parity_is_the_cauchy_matrix():
    """The transforms give what the matrix gives, and any parity block alone brings a lost block back."""
    import numpy as np

    r = random.Random(7)
    for d, p in ((1, 1), (3, 5), (20, 3), (33, 16), (16, 33)):
        data = [r.randbytes(64) for _ in range(d)]
        parity = galois.encode(data, p, 64)
        for i in range(p):
            want = np.zeros(32, np.uint16)
            for j in range(d):
                want ^= galois.times(galois.coefficient(i, j, p), galois.words(data[j], 64))
            assert want.astype("<u2").tobytes() == parity[i]
            j = r.randrange(d)
            only = [b if k == i else None for k, b in enumerate(parity)]
            assert galois.decode([None if k == j else b for k, b in enumerate(data)], only, 64) == {j: data[j]}


def test_large_blocks_in_slices():
    r = random.Random(8)
    data = [r.randbytes(1 << 16) for _ in range(9)]
    parity = galois.encode(data, 5, 1 << 16)
    got = galois.decode([None if k in (0, 4, 8) else b for k, b in enumerate(data)], [None, *parity[1:]], 1 << 16)
    assert got == {k: data[k] for k in (0, 4, 8)}


def test_blake3_vectors():
    count = lambda n: bytes(k % 251 for k in range(n))
    for data, start in ((b"", "af1349b9f5f9a1a6"), (b"abc", "6437b3ac38465133"), (count(1025), "d00278ae47eb27b3"), (count(3073), "7124b49501012f81")):
        assert blake3.digest(data).hex().startswith(start)


def test_formats():
    assert [formats.parse_size(x) for x in ("64KiB", "1MiB", "123", "1.5kB", "2G")] == [65536, 1 << 20, 123, 1500, 2 * 10**9]
    assert [formats.parse_parity(x) for x in ("5%", "5", "0.05", "0.2%", "100")] == [50_000, 50_000, 50_000, 2_000, 1_000_000]
    assert [formats.parse_duration(x) for x in ("30d", "12h", "1h 30m")] == [30 * 86400, 43200, 5400]
    for f, bad in ((formats.parse_size, "x"), (formats.parse_parity, "101%"), (formats.parse_parity, "-1"), (formats.parse_duration, "5 parsecs")):
        with pytest.raises(ValueError):
            f(bad)


def test_column_formats_like_the_parsers(spark):
    def like(f, column, texts):
        got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", column(F.col("t")).alias("v")).collect()}
        for t in texts:
            try:
                want = f(t)
            except ValueError:
                want = None
            assert got[t] == want, t

    like(formats.parse_size, formats.sizes, ["64KiB", "1MiB", "123", "1.5kB", "2G", " 7 b ", "x", "", "-1", "1.5.5", "8000000 TiB"])
    assert spark.range(1).select(formats.sizes(F.lit("9999999 TiB"))).first()[0] is None
    like(formats.parse_parity, formats.parities, ["5%", "5", "0.05", "0.2%", "100", "101", "-1", "abc", "12.34567 %", "0"])
    like(formats.parse_duration, formats.durations, ["30d", "12h", "1h 30m", "1M 2y", "5 parsecs", "", "7", "3 weeks", "1min2sec"])


def test_paths(spark):
    rows = spark.createDataFrame([("a/b",), ("a-b",), ("foo",), ("foobar/x",), ("foo/x",), ("a/./b/../c",), ("",)], "p string")
    assert [r[0] for r in rows.where(paths.under(F.col("p"), "foo")).collect()] == ["foo", "foo/x"]
    assert [r[0] for r in rows.where("p like 'a%b'").orderBy(paths.components(F.col("p"))).collect()] == ["a/b", "a-b"]
    assert [r[0] for r in rows.where("p like 'a-%' or p = 'a/b'").orderBy(F.encode("p", "UTF-8")).collect()] == ["a-b", "a/b"]
    assert rows.where("p like '%..%'").select(paths.normalized(F.col("p"))).first()[0] == "a/c" == paths.normalize("a/./b/../c")
    assert rows.where("p = 'a/b'").select(paths.ancestors(F.lit("x/y"))).first()[0] == ["x/y", "x", ""]
    odd = "dir\\n/line\nend\r\\"
    line = spark.createDataFrame([(odd, "ab" * 32, "ok")], "path string, content_hash string, state string")
    told = manifest.sum_lines(line)
    assert told.first()["line"].startswith("\\ab") and manifest.parsed_sums(told).first()["path"] == odd


def test_checksum_lines(spark):
    lines = ["# c", "", "%%%% x", "AB01  a b", "cd *bin", "sha256:ef12 named", "\\aa  x\\ny", "nonsense line"]
    got = manifest.parsed_sums(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [tuple(r) for r in got] == [(None, "ab01", "a b"), (None, "cd", "bin"), ("sha256", "ef12", "named"), (None, "aa", "x\ny")]
    with pytest.raises(ValueError):
        manifest.one_length(manifest.parsed_sums(spark.createDataFrame([("abcd  x",)], "line string")))


@pytest.mark.parametrize("pattern, path, hit", [("cache", "a/cache/b", True), ("*.tmp", "x/y.tmp", True), ("photos/raw", "photos/raw/1", True), ("photos/raw", "x/photos/raw", False), ("a/*", "a/b/c", True), ("a/*c", "a/b/c", False), ("**/.x/*", "p/q/.x/f", True), ("f[0-3]?", "f2z", True), ("{a,b}.c", "k/b.c", True), ("cache", "cached", False)])
def test_globs(pattern, path, hit):
    import re

    assert bool(re.search(paths.exclude_regex([pattern]), path)) == hit


def test_datasets():
    found = archive.datasets("tank\t/tank\t131072\ntank/a\t/tank/a\t1048576\nx\tnone\t1\n")
    assert archive.dataset_of(found, "/tank/a/b")[0] == "tank/a" and archive.dataset_of(found, "/tank/ab")[0] == "tank" and archive.dataset_of(found, "/other") is None


def test_tolerant_reads(tmp_path, monkeypatch):
    f = tmp_path / "f"
    f.write_bytes(bytes(range(200)))
    real = os.pread

    def fails(fd, n, at):
        if at <= 64 < at + n:
            raise OSError(5, "Input/output error")
        return real(fd, n, at)

    monkeypatch.setattr(os, "pread", fails)
    data, bad = archive.read_tolerant(str(f), 0, 200, 64)
    assert bad == [1] and data == bytes(range(64)) + bytes(64) + bytes(range(128, 200))
    random.seed(0)


def test_adoptable_sets(spark):
    """A set is taken up from a part whose every stripe has the digests recorded there: not from one with another block, shard or missing stripe."""
    import hashlib

    from vaultloom.operators import sets

    sha = lambda b: hashlib.sha256(b).hexdigest()
    shape = spark.createDataFrame([(k, None, 2, 3, 2, 100_000, 1) for k in ("a", "b", "c", "d")], "set_id string, part string, blocks_per_stripe long, n_blocks long, n_stripes long, parity_ppm long, min_parity_blocks long")
    blocks, shards, digests = [], [], []
    for k in ("a", "b", "c", "d"):
        hashes = [sha(f"{k}{g}".encode()) for g in range(3)]
        for stripe, own in ((0, hashes[:2]), (1, hashes[2:])):
            data = f"{k}{stripe}".encode()
            shards.append((k, "p1", stripe, 0, data + b"!" * (k == "c")))
            if (k, stripe) != ("d", 1):
                digests.append((k, "p1", stripe, sha(bytes.fromhex("".join(own))), sha(bytes.fromhex(sha(data)))))
        blocks += [(k, "p1", g, sha(b"other") if (k, g) == ("b", 2) else h) for g, h in enumerate(hashes)]
    got = sets.adoptable(
        shape, spark.createDataFrame(digests, "set_id string, part string, stripe long, blocks string, shards string"),
        spark.createDataFrame(blocks, "set_id string, part string, g long, hash string"), spark.createDataFrame(shards, "set_id string, part string, stripe long, idx long, bytes binary"),
    )
    assert [tuple(r) for r in got.collect()] == [("a", "p1")]
