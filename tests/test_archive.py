import os
import random

import pytest

from vaultloom.archive import Archive
from vaultloom.functions import blake3


def write(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def flip(root, path, at, new_time=False):
    full = os.path.join(root, path)
    s = os.stat(full)
    with open(full, "r+b") as f:
        f.seek(at)
        b = f.read(1)
        f.seek(at)
        f.write(bytes([b[0] ^ 255]))
    os.utime(full, ns=(s.st_atime_ns, s.st_mtime_ns + 5 * 10**9 * new_time))


@pytest.fixture
def made(spark, tmp_path):
    r, root = random.Random(1), str(tmp_path)
    content = {f"data/f{k:02}": r.randbytes(1000) for k in range(12)} | {"other/x": b"hello", "other/empty": b"", "skip/cache/y": b"no", "data/z.tmp": b"no"}
    for path, data in content.items():
        write(root, path, data)
    os.symlink("f00", os.path.join(root, "data/link"))
    a = Archive.init(spark, root, block_size=64, stripe_size="32KiB", parity_default="include", exclude=["cache", "*.tmp"])
    first = {x["path"]: x["outcome"] for x in a.scan().collect()}
    assert first == {p: "added" for p in content if "cache" not in p and not p.endswith(".tmp")}
    return a, content


def outcomes(rows, column="outcome"):
    return {r["path"]: r[column] for r in rows.collect() if r[column] not in ("unchanged", "ok")}


def test_damage_is_found_and_repaired(made):
    a, content = made
    flip(a.root, "data/f03", 5)
    os.remove(os.path.join(a.root, "data/f07"))
    flip(a.root, "data/f09", 70, new_time=True)
    assert outcomes(a.scan()) == {"data/f07": "gone", "data/f09": "corrupt"}  # few bad blocks are no edit; rot with its time kept isn't read
    assert outcomes(a.check(), "new_state") == {"data/f03": "corrupt", "data/f07": "missing", "data/f09": "corrupt"}
    dry = outcomes(a.repair(dry_run=True))
    assert dry == {"data/f03": "would repair", "data/f07": "would restore", "data/f09": "would repair"}
    assert outcomes(a.repair(keep_corrupt=True)) == {"data/f03": "repaired", "data/f07": "restored", "data/f09": "repaired"}
    for path in ("data/f03", "data/f07", "data/f09"):
        with open(os.path.join(a.root, path), "rb") as f:
            assert f.read() == content[path]
    assert os.path.exists(os.path.join(a.state, "quarantine/data/f03"))
    assert outcomes(a.check(), "new_state") == {}


def test_beyond_the_margin(made):
    a, _ = made
    for k in range(8):
        os.remove(os.path.join(a.root, f"data/f{k:02}"))
    a.scan()
    assert set(outcomes(a.repair()).values()) == {"failed"}


def test_moves_edits_and_removals(made):
    a, _ = made
    os.rename(os.path.join(a.root, "data/f01"), os.path.join(a.root, "data/g01"))
    write(a.root, "data/f02", b"quite another text" * 60)
    os.remove(os.path.join(a.root, "data/f04"))
    assert outcomes(a.scan(assume="yes")) == {"data/f01": "moved", "data/g01": "added", "data/f02": "modified", "data/f04": "gone"}
    kinds = {(r["kind"], r["path"]) for r in a.history().collect()}
    assert {("moved", "data/g01"), ("modified", "data/f02"), ("removed", "data/f04")} <= kinds
    s = a.status().first()
    assert s["files"] == 13 and s["degraded_sets"] == 0 and s["sets"] == 1
    assert [r["finding"] for r in a.fsck(deep=True).collect()] == ["ok"]


def test_rm_builds_sets_anew(made):
    a, _ = made
    assert [r["path"] for r in a.rm(["data/f02"]).collect()] == ["data/f02"]
    assert not os.path.exists(os.path.join(a.root, "data/f02"))
    assert a.status().first()["degraded_sets"] == 0 and a.members.where("dead").count() == 0
    with pytest.raises(FileNotFoundError):
        a.rm(["nothing"])


def test_marks_export_import_rebuild(made, tmp_path_factory):
    a, _ = made
    a.mark(["other"], "exclude")
    assert a.coverage().first()["stale_files"] == 1
    a.parity_sync(prune=True)
    assert a.coverage().first()["stale_files"] == 0 and a.ls(parity=False).count() == 2
    out = str(tmp_path_factory.mktemp("out"))
    a.export(f"{out}/sums")
    lines = a.spark.read.text(f"{out}/sums").collect()
    assert len(lines) == 14
    assert {r["outcome"] for r in a.import_list(f"{out}/sums").collect()} == {"verified"}
    a.export(f"{out}/tsv", "tsv")
    before = {(r["path"], r["content_hash"], r["size"]) for r in a.table("file").collect()}
    a.rebuild(f"{out}/tsv")
    assert {(r["path"], r["content_hash"], r["size"]) for r in a.table("file").collect()} == before
    assert a.show("data/f00").first()["protected"] is True
    with pytest.raises(ValueError):
        a.export(f"{out}/x", "md5")


def test_declined_changes_and_accept(made):
    a, _ = made
    write(a.root, "data/f05", b"new" * 200)
    assert outcomes(a.scan(accept_changes=False)) == {"data/f05": "modified"}
    assert a.ls(state="modified").count() == 1
    assert [r["path"] for r in a.accept(["data"]).collect()] == ["data/f05"]
    assert a.ls(state="modified").count() == 0


def test_guards(made, spark):
    a, _ = made
    for bad in ("../x", "_state/CURRENT"):
        with pytest.raises(ValueError):
            a.relative(bad)
    with pytest.raises(FileNotFoundError):
        a.scan(["nowhere"])
    with pytest.raises(ValueError):
        a.set_config("algo", "blake3")
    with pytest.raises(FileExistsError):
        Archive.init(spark, a.root)
    assert a.check(budget=1500).count() == 2


def test_blake3_archive(spark, tmp_path):
    write(str(tmp_path), "a/b", b"abc")
    a = Archive.init(spark, str(tmp_path), algo="blake3")
    a.scan(parity=False)
    assert a.table("file").first()["content_hash"] == blake3.digest(b"abc").hex()


def test_scan_on_arrival(made):
    from vaultloom.streaming.incremental import scan_on_arrival

    a, _ = made
    write(a.root, "landing/new", b"just arrived")
    scan_on_arrival(a, "landing").awaitTermination(120)
    assert a.ls(["landing"]).count() == 1


def test_generations(spark, tmp_path):
    from vaultloom.operators.catalog import Catalogue

    c = Catalogue(spark, str(tmp_path))
    rows = lambda n: spark.createDataFrame([(str(k), "v") for k in range(n)], "key string, value string")
    assert c.read("meta").count() == 0
    for n in (1, 2, 3):
        assert c.commit(meta=rows(n)) == n
    assert c.read("meta").count() == 3 and c.verify() == [] and sum(n.startswith("gen=") for n in os.listdir(tmp_path)) == 2
    c.roll_back()
    assert c.read("meta").count() == 2
    place = os.path.join(tmp_path, c.current()["tables"]["meta"][0])
    os.remove(os.path.join(place, next(n for n in os.listdir(place) if n.endswith(".parquet"))))
    assert len(c.verify()) == 1


def part_files(a, tables=("parity_shard", "block_hash", "stripe_digest")):
    return {f"{place}/{n}" for t in tables for place in a.catalogue.current()["tables"].get(t, []) for n in a.catalogue.current()["parts"][place]}


def test_scans_only_add_to_sets_and_log(made):
    a, content = made
    for k in range(8):  # the set is no longer underfull
        write(a.root, f"data/h{k}", bytes([k]) * 1000)
    a.scan()
    before, log = part_files(a), part_files(a, ["event"])
    times = {p: os.stat(os.path.join(a.state, p)).st_mtime_ns for p in before}
    a.scan()
    assert part_files(a) == before and part_files(a, ["event"]) == log
    write(a.root, "data/new", b"fresh" * 3000)
    first = a.scan()
    assert before < part_files(a) and log < part_files(a, ["event"])
    assert all(os.stat(os.path.join(a.state, p)).st_mtime_ns == t for p, t in times.items())
    seqs = [r["seq"] for r in a.history().collect()]
    assert len(set(seqs)) == len(seqs) == len(content) - 2 + 9 and a.history(limit=1).first()["path"] == "data/new"
    assert a.table("meta").where("key = 'saved_at'").count() == 1
    with open(next(os.path.join(a.state, "MANIFEST.txt", n) for n in os.listdir(os.path.join(a.state, "MANIFEST.txt")) if n.startswith("part-"))) as f:
        assert sum(1 for _ in f) == a.ls().count()
    # an earlier result outlives later commands
    flip(a.root, "data/f03", 5)
    told = a.check(repair=True)
    assert outcomes(told, "new_state") == {"data/f03": "corrupt"} and "data/new" in outcomes(first) and outcomes(a.check(), "new_state") == {}


def spoil(a, table, at=-200):
    place = a.catalogue.current()["tables"][table][0]
    name = max(a.catalogue.current()["parts"][place], key=lambda n: a.catalogue.current()["parts"][place][n][0])
    full = os.path.join(a.state, place, name)
    crc = os.path.join(a.state, place, f".{name}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with open(full, "r+b") as f:
        f.seek(at, os.SEEK_END)
        b = f.read(1)
        f.seek(at, os.SEEK_END)
        f.write(bytes([b[0] ^ 255]))


def test_a_flipped_byte_in_the_state_is_found(made):
    a, _ = made
    assert a.catalogue.verify() == []
    for table in ("file", "parity_member", "parity_shard", "block_hash"):
        old = {p: open(os.path.join(a.state, p), "rb").read() for p in part_files(a, [table])}
        spoil(a, table)
        assert any(x.startswith(table) for x in a.catalogue.verify(deep=table in ("parity_shard", "block_hash")))
        for p, data in old.items():
            with open(os.path.join(a.state, p), "wb") as f:
                f.write(data)
    assert a.catalogue.verify() == []


def test_damaged_tables_and_shards(made):
    """Another digest in the block table, another byte in a shard: found by fsck, and neither misleads check or repair."""
    from pyspark.sql import functions as F

    a, content = made
    good = {t: a.catalogue.stored(t).collect() for t in ("block_hash", "parity_shard")}
    remake = lambda t, rows: a.spark.createDataFrame(rows, a.catalogue.stored(t).schema)
    part = a.table("parity_set").first()["part"]
    torn = remake("block_hash", good["block_hash"]).withColumn("hash", F.when(F.col("g") == 3, "00").otherwise(F.col("hash")))
    a.catalogue.commit(part=part + "x", block_hash=torn, parity_set=a.table("parity_set"))
    place = a.catalogue.current()
    assert place["tables"]["block_hash"] == []  # a part that no set names is left out
    now = a.catalogue.fresh()
    sets_ = a.table("parity_set").withColumn("part", F.lit(now))
    a.catalogue.commit(part=now, parity_set=a._kept(sets_), block_hash=a._kept(torn.withColumn("part", F.lit(now))), parity_shard=remake("parity_shard", good["parity_shard"]).withColumn("part", F.lit(now)), stripe_digest=a._kept(a.catalogue.stored("stripe_digest").withColumn("part", F.lit(now))))
    assert {"block table damaged"} <= {r["finding"] for r in a.fsck(deep=True).collect()}
    assert outcomes(a.check(), "new_state") == {}
    flip(a.root, "data/f03", 5)
    assert outcomes(a.check(), "new_state") == {"data/f03": "unrecoverable"}
    now = a.catalogue.fresh()
    shards = remake("parity_shard", good["parity_shard"]).withColumn("bytes", F.when(F.col("idx") == 0, F.lit(b"\0" * 64)).otherwise(F.col("bytes")))
    a.catalogue.commit(part=now, parity_set=a._kept(a.table("parity_set").withColumn("part", F.lit(now))), block_hash=remake("block_hash", good["block_hash"]).withColumn("part", F.lit(now)), parity_shard=a._kept(shards.withColumn("part", F.lit(now))), stripe_digest=a._kept(a.catalogue.stored("stripe_digest").withColumn("part", F.lit(now))))
    assert {"shards damaged"} <= {r["finding"] for r in a.fsck(deep=True).collect()}
    assert outcomes(a.repair()) == {"data/f03": "failed"}


def test_trusted_lists_keep_their_digests(made, tmp_path_factory):
    a, content = made
    write(a.root, "late/one", b"one")
    write(a.root, "late/two", b"two")
    out = tmp_path_factory.mktemp("list") / "sums"
    out.write_text("0" * 64 + "  late/one\n" + "0" * 64 + "  data/f01\n" + "0" * 64 + "  late/none\n")
    assert outcomes(a.import_list(str(out), trust=True)) == {"late/one": "trusted", "data/f01": "mismatch", "late/none": "not found"}
    assert a.table("file").where("path = 'late/one'").first()["content_hash"] == "0" * 64
    assert outcomes(a.check(["late"]), "new_state") == {"late/one": "unrecoverable"}
    out.write_text("0" * 64 + "  late/two\n")
    assert outcomes(a.import_list(str(out))) == {"late/two": "mismatch"}


def test_names_that_are_not_utf8(made):
    a, _ = made
    top, deep = os.fsencode(a.root) + b"/caf\xe9", os.fsencode(a.root) + b"/data/caf\xe9"
    for name in (top, deep):
        with open(name, "wb") as f:
            f.write(b"x")
    os.remove(os.path.join(a.root, "data/f05"))
    got = outcomes(a.scan(assume="yes", skipped=True))
    assert got == {"caf\ufffd": "name isn't UTF-8", "data/caf\ufffd": "name isn't UTF-8", "data/f05": "gone", "data/link": "skipped"}
    assert a.ls(["data"]).where("path = 'data/f05'").count() == 0 and a.check().count() == 13


def test_walks_open_only_what_is_asked_for(made):
    from vaultloom.sources.archive import TreeReader

    a, _ = made
    reader = TreeReader({"root": a.root, "roots": '["data", "data/f01", "nowhere"]'})
    found = [p for part in reader.partitions() for p in part.paths]
    assert len(found) == len(set(found)) and all(p.startswith(b"data/") for p in found)
    assert {r["path"] for r in a._disk(["other"]).collect()} == {"other/x", "other/empty"}
    rows = a.spark.createDataFrame([("data/f00", 1000, 1, 64, 16, 1000), ("gone", 130, 1, 64, 3, 130)], "path string, size long, mtime_ns long, block_size long, n_blocks long, m_size long")
    from vaultloom.sources import archive as source

    got = source.digested_blocks(rows, a.root, "sha256", ["path"]).collect()
    whole = {r["path"]: (r["hash"] is not None, r["settled"], r["error"] is not None) for r in got if r["b"] is None}
    assert whole == {"data/f00": (True, False, False), "gone": (False, False, True)}  # changed since it was listed; not there
    assert sorted((r["path"], r["b"]) for r in got if r["b"] is not None) == [("data/f00", k) for k in range(16)] + [("gone", k) for k in range(3)]


def test_commands(made, capsys, monkeypatch):
    import sys

    from vaultloom.__main__ import main

    a, _ = made

    def call(*args):
        monkeypatch.setattr(sys, "argv", ["vaultloom", "--root", a.root, *args])
        return main(), capsys.readouterr().out

    assert call("status")[0] == 0
    flip(a.root, "data/f03", 5)
    code, out = call("check")
    assert code == 2 and out.startswith("data/f03\tcorrupt")
    assert call("repair") == (0, "data/f03\trepaired\n")
    assert call("check")[0] == 0 and call("fsck", "--deep")[0] == 0
    assert call("export", "/nowhere/at/all", "--format", "x")[0] == 1
