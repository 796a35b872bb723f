"""An archive on disk: index, checks, parity and repair of a directory tree, one method a command.

State lies in `_state` under the root: the configuration, generations of the catalogue's tables, manifests, quarantined files.
Methods that change it hold a lock, stage their reading in a scratch table and commit one generation; sets' blocks, shards and
events are only added to. Results are tables of their own under `_state/results`, kept for a day. Every executor sees the root.
"""

from __future__ import annotations

import contextlib
import dataclasses
import fcntl
import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats, geometry, paths
from .functions.geometry import Config
from .operators import catalog, classify, coverage, manifest, repair, report, sets
from .sources import archive as source


class Archive:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self.state = os.path.join(self.root, source.STATE)
        with open(os.path.join(self.state, "config.json")) as f:
            known = json.load(f)
        self.config = Config(**(known | {"exclude": tuple(known["exclude"])})).checked()
        self.catalogue = catalog.Catalogue(spark, self.state)

    @staticmethod
    def init(spark: SparkSession, root: str, algo: str = "sha256", block_size: str | int = "64KiB", parity: str = "5%", stripe_size: str | int = "128MiB", parity_default: str = "exclude", exclude: list[str] = (), parity_min_bytes: int = 0) -> Archive:
        size = lambda x: x if isinstance(x, int) else formats.parse_size(x)
        config = Config(algo, size(block_size), size(stripe_size), formats.parse_parity(parity), parity_min_bytes, parity_default, tuple(exclude)).checked()
        state = os.path.join(os.path.abspath(root), source.STATE)
        if os.path.exists(os.path.join(state, "config.json")):
            raise FileExistsError("this is an archive already")
        os.makedirs(state, exist_ok=True)
        _write_json(os.path.join(state, "config.json"), dataclasses.asdict(config))
        return Archive(spark, root)

    # ------------------------------------------------------------ helpers

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        with open(os.path.join(self.state, "lock"), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            try:
                yield
            finally:
                shutil.rmtree(os.path.join(self.state, "tmp"), ignore_errors=True)

    def _staged(self, rows: DataFrame) -> DataFrame:
        """Read once: what follows sees one state of the disk."""
        path = os.path.join(self.state, "tmp", uuid.uuid4().hex)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def relative(self, path: str, must_exist: bool = False) -> str:
        full = path if os.path.isabs(path) else os.path.join(self.root, path)
        rel = paths.normalize(os.path.relpath(full, self.root).replace(os.sep, "/"))
        if os.path.relpath(full, self.root).startswith(".."):
            raise ValueError(f"{path} is outside the archive")
        if rel == source.STATE or rel.startswith(source.STATE + "/"):
            raise ValueError(f"{path} belongs to the archive's own state")
        if must_exist and not os.path.lexists(os.path.join(self.root, rel)):
            raise FileNotFoundError(path)
        return rel

    def _roots(self, given: list[str] | None, must_exist: bool = False) -> list[str]:
        return [self.relative(p, must_exist) for p in given] if given else [""]

    def table(self, name: str) -> DataFrame:
        return self.catalogue.read(name)

    @property
    def sets(self) -> DataFrame:
        return self.table("parity_set").withColumn("g", F.col("set_id"))

    @property
    def members(self) -> DataFrame:
        return self.table("parity_member").withColumn("g", F.col("set_id"))

    def live(self) -> DataFrame:
        return sets.live_membership(self.members)

    def _tree(self, roots: list[str]) -> DataFrame:
        return source.tree(self.spark, self.root, paths.exclude_regex(list(self.config.exclude)), roots)

    def _disk(self, roots: list[str] = ("",)) -> DataFrame:
        return self._tree(list(roots)).where("kind = 'file'").select("path", "size", "mtime_ns", "inode")

    def _here(self, rows: DataFrame) -> DataFrame:
        """path, size, mtime_ns of those of the rows' files that are on disk: looked up one by one, without a walk."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for path in b.column(0).to_pylist():
                    with contextlib.suppress(OSError, ValueError):
                        found = os.lstat(os.path.join(root, path))
                        if found.st_mode & 0o170000 == 0o100000:
                            out.append((path, found.st_size, found.st_mtime_ns))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "mtime_ns"])

        return rows.select("path").distinct().mapInArrow(run, "path string, size long, mtime_ns long")

    def _events(self, rows: DataFrame, now: int) -> dict:
        """What commit() needs to add the rows (path, kind, detail), in order of path, to the log."""
        last = self.catalogue.current().get("last_seq", 0)
        # numbers grow along the sorted rows and have gaps, so that no task numbers all of them
        numbered = rows.orderBy("path", "kind").select("path", "kind", "detail", (F.monotonically_increasing_id() + last + 1).alias("seq"), F.lit(now).cast("long").alias("ts"))
        staged = self._staged(numbered.select("seq", "ts", "path", "kind", "detail"))
        newest = staged.agg(F.max("seq")).first()[0]
        return {} if newest is None else {"append": {"event": staged}, "last_seq": newest}

    def _manifests(self) -> None:
        """The checksum list, the full listing and the marks as text under the state, each replaced in one step."""
        for name, lines in (("MANIFEST.txt", manifest.sum_lines(self.table("file"))), ("MANIFEST.tsv", manifest.tsv_lines(self.table("file"))), ("MARKS", manifest.mark_lines(self.table("parity_mark")))):
            fresh, place = os.path.join(self.state, f"{name}.{uuid.uuid4().hex}"), os.path.join(self.state, name)
            lines.orderBy(F.encode("path", "UTF-8")).select("line").write.text(fresh)
            shutil.rmtree(place, ignore_errors=True)
            os.replace(fresh, place)

    # ------------------------------------------------------------ scan and check

    def _damaged_stripes(self, wanted: DataFrame) -> DataFrame:
        """g, stripe of the wanted sets (g) whose recorded block digests aren't those that were written."""
        shape = self.sets.join(wanted.select("g").distinct(), "g", "left_semi")
        known = self.table("block_hash").withColumnRenamed("g", "b").withColumn("g", F.col("set_id"))
        return sets.damaged_stripes(shape, known, self.table("stripe_digest").withColumn("g", F.col("set_id")), "blocks")

    def _blocks_of(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows (path, content_hash, size and mtime_ns on disk) with a live membership, read once.

        Whole files: path, hash, settled, error; and their damage: path, n_blocks, m_size, bad, unreadable, margin_ok, table_ok.
        """
        place = self.live().select("content_hash", "g", F.col("size").alias("m_size"), "first_block", "n_blocks").join(self.sets.select("g", "block_size", "blocks_per_stripe"), "g")
        where = self._staged(rows.select("path", "content_hash", "size", "mtime_ns").join(place, "content_hash"))
        found = self._staged(source.digested_blocks(where, self.root, self.config.algo, ["path", "g", "first_block", "blocks_per_stripe"]))
        whole = found.where("b is null").select("path", "hash", "settled", "error")
        each = found.where("b is not null").select("path", "g", (F.col("first_block") + F.col("b")).alias("b"), "blocks_per_stripe", "now", "unreadable")
        known = self.table("block_hash").select(F.col("set_id").alias("g"), F.col("g").alias("b"), "hash")
        pairs = each.join(known, ["g", "b"], "left").withColumn("stripe", geometry.floor_div(F.col("b"), F.col("blocks_per_stripe")))
        bad = pairs.where(F.col("now").isNull() | F.col("hash").isNull() | (F.col("now") != F.col("hash")))
        margin = sets.margins(bad, sets.dead_blocks(self.members, self.sets), self.sets, ["path"])
        counts = bad.groupBy("path").agg(F.count("*").alias("bad"), F.count_if("unreadable").alias("unreadable"))
        torn = pairs.join(self._damaged_stripes(where), ["g", "stripe"], "left_semi").select("path", F.lit(False).alias("table_ok")).distinct()
        out = where.select("path", "n_blocks", "m_size").join(counts, "path", "left").join(margin, "path", "left").join(torn, "path", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        yes = lambda c: F.coalesce(c, F.lit(True)).alias(c)
        return whole, out.select("path", "n_blocks", "m_size", zero("bad"), zero("unreadable"), yes("margin_ok"), yes("table_ok"))

    def _read(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """_blocks_of() for rows (path, content_hash, size, mtime_ns) with live parity, and the digests of the others too; every file is read once."""
        held = self.live().select("content_hash")
        whole, found = self._blocks_of(rows.join(held, "content_hash", "left_semi"))
        plain = source.digested(rows.join(held, "content_hash", "left_anti"), self.root, self.config.algo).select("path", "hash", "settled", "error")
        return whole.unionByName(plain), found

    def scan(self, roots: list[str] | None = None, accept_changes: bool = True, parity: bool = True, assume: str = "no", skipped: bool = False) -> DataFrame:
        """Brings the index up to date; a row for each file with its outcome, and for each name or directory that can't be read (with `skipped`, links too).

        assume: yes drops files that are gone, no marks them missing.
        """
        with self._locked():
            roots, now = self._roots(roots, must_exist=True), int(time.time())
            tree = self._staged(self._tree(roots))
            failed = [r["path"] for r in tree.where("kind = 'unreadable'").select("path").collect()]
            disk = tree.where("kind = 'file'").withColumn("hash", F.lit(None).cast("string"))
            files = report.listed(self.table("file"), roots)
            pairs = coverage.covered(classify.matched(disk, files), self.table("parity_mark"), self.config.parity_default)
            held = self.live().select("content_hash", F.lit(True).alias("has_parity"))
            pairs = pairs.join(held, "content_hash", "left").withColumn("has_parity", F.coalesce("has_parity", F.lit(False))).withColumn("covered", (F.col("mode") == "include") & F.lit(parity))
            acts = self._staged(classify.scan_actions(pairs, accept_changes))
            shape = lambda which: acts.where(which).select("path", "content_hash", F.col("d_size").alias("size"), F.col("d_mtime_ns").alias("mtime_ns"))
            plain = source.digested(shape("action not in ('unchanged', 'gone', 'declined', 'check-blocks')"), self.root, self.config.algo).select("path", "hash", "settled", "error")
            whole, checked = self._blocks_of(shape("action = 'check-blocks'"))
            got = whole.unionByName(plain).withColumnRenamed("hash", "_hash")
            rows = self._staged(acts.join(got, "path", "left").withColumn("d_hash", F.col("_hash")).drop("_hash"))
            # with a damaged block table nothing is known of single blocks: the whole file's digest decides
            rows = classify.outcomes(rows.join(checked.where("table_ok").drop("table_ok"), "path", "left"))
            suspect = classify.suspected(F.col("bad"), F.col("unreadable"), F.col("n_blocks"), F.col("margin_ok"), F.col("d_hash") == F.col("content_hash"))
            outcome = F.when(F.col("error").isNotNull(), "read-error").when(F.col("settled") == F.lit(False), "changed while scanning").when(F.col("bad").isNotNull(), suspect).otherwise(F.col("outcome"))
            rows = self._staged(rows.withColumn("outcome", outcome).join(disk.select("path", "inode"), "path", "left"))
            gone = classify.removed(rows, failed)
            moves = classify.moved(gone, rows.where("outcome = 'added'"))
            fresh = rows.where("outcome in ('added', 'modified', 'touched', 'verified', 'reappeared') and d_hash is not null")
            fresh = fresh.select("path", F.col("d_hash").alias("content_hash"), F.col("d_size").alias("size"), F.col("d_mtime_ns").alias("mtime_ns"), "inode")
            index = catalog.upserted(self.table("file"), catalog.verified_rows(fresh, now))
            index = index.join(moves.select("path"), "path", "left_anti")
            lost = gone.join(moves.select("path"), "path", "left_anti")
            if assume == "yes":
                index = catalog.deleted(index, lost)
            wrong = rows.where("outcome in ('corrupt', 'unrecoverable') or (outcome = 'read-error' and indexed) or action = 'declined'").select("path", F.when(F.col("outcome") == "read-error", "unrecoverable").when(F.col("action") == "declined", "modified").otherwise(F.col("outcome")).alias("new_state"), F.when(F.col("action") == "check-blocks", F.col("d_mtime_ns")).alias("m"))
            states = wrong.select("path", "new_state").union(lost.select("path", F.lit("missing")))
            index = catalog.with_state(index, states, now)
            index = index.join(wrong.where("m is not null").select("path", "m"), "path", "left").withColumn("mtime_ns", F.coalesce("m", "mtime_ns")).drop("m")
            index = self._staged(index)
            kinds = rows.where("outcome not in ('unchanged', 'gone', 'touched', 'changed while scanning')").select("path", F.col("outcome").alias("kind"), F.when(F.col("outcome") == "added", F.concat(F.lit(self.config.algo + ":"), "d_hash")).alias("detail"))
            kinds = kinds.union(moves.select(F.col("moved_to"), F.lit("moved"), F.concat(F.lit("from "), "path"))).union(lost.select("path", F.lit("removed" if assume == "yes" else "missing"), F.lit(None).cast("string")))
            self._save(index, **self._events(kinds, now))
            if parity:
                self._parity_phase(now)
            self._manifests()
            odd = tree.where("kind in ('badname', 'unreadable', 'link', 'other')").select("path", F.when(F.col("kind") == "badname", "name isn't UTF-8").when(F.col("kind") == "unreadable", "unreadable").otherwise("skipped").alias("outcome"))
            if not skipped:
                odd = odd.where("outcome <> 'skipped'")
            final = odd.union(rows.select("path", "outcome").join(moves.select("path", F.lit("moved").alias("o")), "path", "left").select("path", F.coalesce("o", "outcome").alias("outcome")))
            return self._kept(final)

    def _kept(self, rows: DataFrame) -> DataFrame:
        """A result in a folder of its own, which outlives the scratch tables; those older than a day go."""
        top = os.path.join(self.state, "results")
        os.makedirs(top, exist_ok=True)
        for name in os.listdir(top):
            with contextlib.suppress(OSError):
                if os.stat(os.path.join(top, name)).st_mtime < time.time() - 86400:
                    shutil.rmtree(os.path.join(top, name), ignore_errors=True)
        path = os.path.join(top, uuid.uuid4().hex)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _save(self, index: DataFrame, **more) -> None:
        """Commits the index, with its contents, and marks members dead whose content no file holds."""
        members = self.members.drop("g")
        held = index.select("content_hash").distinct()
        dead = members.join(held, "content_hash", "left_anti").select("content_hash")
        stamp = catalog.meta_set(self.table("meta"), {"saved_at": str(int(time.time())), "algo": self.config.algo})
        self.catalogue.commit(file=index, content=catalog.contents(index, self.config.algo), parity_member=self._staged(catalog.marked_dead(members, dead)), meta=self._staged(stamp), **more)

    def check(self, roots: list[str] | None = None, older_than: str | None = None, budget: str | int | None = None, repair: bool = False) -> DataFrame:
        """path, new_state, message of the files read; states and times of verification are recorded."""
        with self._locked():
            now = int(time.time())
            files = report.listed(self.table("file"), self._roots(roots))
            if older_than:
                files = report.due(files, now - formats.parse_duration(older_than))
            if budget is not None:
                files = files.join(report.within_budget(files, budget if isinstance(budget, int) else formats.parse_size(budget)).select("path"), "path", "left_semi")
            files = self._staged(files)
            disk = self._staged(self._here(files))
            pairs = classify.matched(disk.withColumn("hash", F.lit(None).cast("string")), files).where("indexed")
            due = pairs.where("on_disk and mtime_ns = d_mtime_ns").select("path", "content_hash", F.col("d_size").alias("size"), F.col("d_mtime_ns").alias("mtime_ns"))
            whole, found = self._read(due)
            rows = pairs.join(self._staged(whole.withColumnRenamed("hash", "_hash")), "path", "left").withColumn("d_hash", F.col("_hash")).join(found, "path", "left")
            rows = rows.withColumn("has_parity", F.col("n_blocks").isNotNull()).withColumn("extra_bytes", F.greatest(F.col("d_size") - F.col("m_size"), F.lit(0).cast("long")))
            rows = self._staged(classify.checked(rows).withColumn("new_state", F.when(F.col("error").isNotNull() & ~F.col("has_parity"), "unrecoverable").when(F.col("error").isNull() & ~F.col("settled"), "modified").otherwise(F.col("new_state"))))
            good = rows.where("new_state = 'ok'").select("path", "new_state")
            changed = rows.where("new_state <> state and new_state <> 'ok'").select("path", "new_state")
            index = catalog.with_state(catalog.with_state(self.table("file"), good, now, verified=True), changed, now)
            told = rows.where("new_state <> state").select("path", F.when(F.col("new_state") == "ok", "verified").when(F.col("new_state").isin("missing", "modified"), F.col("new_state")).otherwise("corrupt").alias("kind"), F.col("message").alias("detail"))
            self.catalogue.commit(file=self._staged(index), **self._events(told, now))
            self._manifests()
            out = self._kept(rows.select("path", "new_state", "message"))
        if repair:
            self.repair(roots)
        return out

    def accept(self, roots: list[str]) -> DataFrame:
        """Records flagged files (or those named) as they are now."""
        with self._locked():
            now, named = int(time.time()), self._roots(roots, must_exist=True)
            disk = self._disk(named)
            flagged = report.listed(self.table("file"), named).where((F.col("state") != "ok") | F.col("path").isin(named)).select("path")
            rows = self._staged(source.digested(disk.join(flagged, "path", "left_semi"), self.root, self.config.algo).where("settled"))
            fresh = rows.select("path", F.col("hash").alias("content_hash"), "size", "mtime_ns")
            index = self._staged(catalog.upserted(self.table("file"), catalog.verified_rows(fresh, now)))
            self._save(index, **self._events(rows.select("path", F.lit("accepted").alias("kind"), F.lit(None).cast("string").alias("detail")), now))
            self._manifests()
            return self._kept(fresh.select("path"))

    # ------------------------------------------------------------ parity

    def mark(self, directories: list[str], mode: str | None) -> None:
        """mode: include, exclude, or None to take the marks away."""
        with self._locked():
            rel = [self.relative(d) for d in directories]
            old = self.table("parity_mark").where(~F.col("path").isin(rel))
            now = int(time.time())
            new = self.spark.createDataFrame([(d, mode, now) for d in rel] if mode else [], catalog.SCHEMAS["parity_mark"])
            self.catalogue.commit(parity_mark=self._staged(old.unionByName(new)))
            self._manifests()

    def coverage(self) -> DataFrame:
        return coverage.report(self.table("file"), self.table("parity_mark"), self.live(), self.config.parity_default)

    def parity_sync(self, prune: bool = False) -> None:
        with self._locked():
            if prune:
                files = coverage.covered(self.table("file"), self.table("parity_mark"), self.config.parity_default)
                stale = sets.uncovered(files, self.members.where("not dead"))
                self.catalogue.commit(parity_member=self._staged(catalog.marked_dead(self.members.drop("g"), stale)))
            self._parity_phase(int(time.time()))

    def _parity_phase(self, now: int, excluded: DataFrame | None = None) -> None:
        """Converges duplicates, encodes what lacks parity together with what worn and underfull sets hold, drops sets that are rehomed."""
        created = self.sets.select("set_id", "created_at")
        members = self._staged(sets.converged(self.members, created)) if self.members.take(1) else self.members
        files = coverage.covered(self.table("file"), self.table("parity_mark"), self.config.parity_default)
        disk = self._staged(self._disk([""]))
        live = sets.live_membership(members)
        wanted = files.where("mode = 'include' and state = 'ok' and size > 0").join(live.select("content_hash"), "content_hash", "left_anti")
        wanted = wanted.join(disk.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_semi")
        if excluded is not None:
            wanted = wanted.join(excluded, "content_hash", "left_anti")
        new = sets.distinct_contents(wanted)
        origin = sets.sources(members, self.table("file"), disk, excluded)
        good = sets.eligible(origin).where("eligible").select("g")
        placed = origin.join(members.select("g", "ord", "size"), ["g", "ord"]).join(good, "g", "left_semi").select(F.col("content_hash").alias("hash"), "size", F.col("source").alias("path"), "g")
        worn = sets.degraded(self.sets, members).select("g").join(good, "g", "left_semi")
        low = sets.underfull(self.sets, self.config).select("g").join(good, "g", "left_semi")
        parts = [new, placed.join(worn, "g", "left_semi")]
        if sets.pool(parts).take(1) or low.count() >= 2:
            parts.append(placed.join(low, "g", "left_semi"))
            worn = worn.union(low).distinct()
        pool = self._staged(sets.pool(parts))
        part = self.catalogue.fresh()
        tables: dict[str, DataFrame] = {"parity_set": self.sets.drop("g"), "parity_member": members.select(*self.table("parity_member").columns)}
        append: dict[str, DataFrame] = {}
        groups = self._staged(sets.packed(pool, self.config.stripe_size)) if pool.take(1) else None
        for _ in range(3):  # a member that changed meanwhile is ejected and its set laid out again without it
            if groups is None or not groups.take(1):
                break
            shape = self._staged(geometry.set_geometry(groups, self.config))
            rows = sets.members(groups, shape)
            ids = self._staged(sets.set_ids(rows, shape))
            known = self._staged(ids.join(tables["parity_set"].select("set_id"), "set_id", "left_anti"))
            name = lambda x: x.join(known, "g").drop("g")  # noqa: E731, B023
            named = self._staged(name(rows).withColumn("dead", F.lit(False)))
            shape_of = self._staged(name(shape).withColumn("created_at", F.lit(now).cast("long")).withColumn("algo", F.lit(self.config.algo)).withColumn("part", F.lit(part)))
            # an orphan in the store with the same id and all its digests is taken up instead of being encoded anew
            again = self._staged(self._adoptable(shape_of))
            fresh = shape_of.join(again.select("set_id"), "set_id", "left_anti").withColumn("g", F.col("set_id"))
            place = named.withColumn("g", F.col("set_id")).join(pool.select(F.col("hash").alias("content_hash"), "path"), "content_hash").join(fresh.select("g", "block_size", "blocks_per_stripe"), "g")
            blocks = source.file_blocks(place, self.root, ["g", "ord", "content_hash", "first_block", "block_size", "blocks_per_stripe"])
            at = F.col("first_block") + F.col("b")
            blocks = blocks.select("g", "ord", "content_hash", at.alias("b"), geometry.floor_div(at, F.col("blocks_per_stripe")).alias("stripe"), (at % F.col("blocks_per_stripe")).alias("j"), "bytes", "block_size")
            blocks = self._staged(blocks.join(geometry.stripes(fresh).select("g", "stripe", "parity_blocks"), ["g", "stripe"]))
            torn = self._staged(blocks.where("bytes is null").select("g", "ord", "content_hash").distinct())
            whole = blocks.join(torn, "g", "left_anti")
            keep = lambda x: x.join(torn.select(F.col("g").alias("set_id")), "set_id", "left_anti")  # noqa: E731, B023
            shards = self._staged(repair.shards(whole).withColumnRenamed("g", "set_id").withColumn("part", F.lit(part)))
            hashes = self._staged(whole.select(F.col("g").alias("set_id"), "stripe", F.col("b").alias("g"), sets.block_digest(F.col("bytes"), F.col("block_size")).alias("hash"), F.lit(part).alias("part")))
            digests = sets.stripe_digests(hashes, shards).withColumn("part", F.lit(part))
            new = {"block_hash": hashes, "parity_shard": shards, "stripe_digest": digests}
            append = {k: append[k].unionByName(v) if k in append else v for k, v in new.items()}
            old_part = again.select("set_id", F.col("part").alias("_part"))
            shape_of = shape_of.join(old_part, "set_id", "left").withColumn("part", F.coalesce("_part", "part")).drop("_part")
            tables["parity_set"] = self._staged(tables["parity_set"].unionByName(keep(shape_of), allowMissingColumns=True))
            tables["parity_member"] = self._staged(tables["parity_member"].unionByName(keep(named), allowMissingColumns=True))
            if not torn.take(1):
                break
            lost = torn.join(known, torn["g"] == known["set_id"]).select(known["g"].alias("g"), "ord")
            groups = self._staged(sets.ejected(groups, lost))
        after = self._staged(tables["parity_member"])
        homes = after.withColumn("g", F.col("set_id"))
        if excluded is not None:
            homes = self._staged(catalog.marked_dead(homes, excluded))
        moved = sets.rehomed(homes.join(worn, "g", "left_semi"), homes).where("rehomed").select(F.col("g").alias("set_id"))
        empty = homes.groupBy("set_id").agg(F.bool_and("dead").alias("d")).where("d").select("set_id")
        drop = self._staged(moved.union(empty).distinct())
        # sets and members are small tables; of blocks and shards only the new ones are written
        self.catalogue.commit(append={k: v for k, v in append.items() if v.take(1)}, part=part, parity_set=tables["parity_set"].join(drop, "set_id", "left_anti"), parity_member=homes.drop("g").join(drop, "set_id", "left_anti"))

    def _adoptable(self, shape: DataFrame) -> DataFrame:
        """set_id, part of the wanted sets (shape) that the store holds already, whole: all stripes there with the digests that were written."""
        stored = self.catalogue.stored("stripe_digest").join(shape.select("set_id"), "set_id", "left_semi")
        if not stored.take(1):
            return self.spark.createDataFrame([], "set_id string, part string")
        of = lambda name: self.catalogue.stored(name).join(stored.select("set_id", "part").distinct(), ["set_id", "part"], "left_semi")
        return sets.adoptable(shape, stored, of("block_hash"), of("parity_shard"))

    def rm(self, roots: list[str], force: bool = False) -> DataFrame:
        """Deletes files once the sets that need their contents are built anew without them."""
        with self._locked():
            now = int(time.time())
            doomed = self._staged(report.listed(self.table("file"), self._roots(roots)).select("path"))
            if not doomed.take(1):
                raise FileNotFoundError("nothing of that is in the index")
            dying = self._staged(sets.dying(self.table("file"), doomed))
            hit = sets.affected(dying, self.members)
            origin = sets.sources(self.members.join(hit, "g", "left_semi"), self.table("file"), self._here(self.table("file")), dying)
            held = [r["g"] for r in sets.eligible(origin).where("not eligible").select("g").limit(20).collect()]
            if held and not force:
                raise RuntimeError(f"{len(held)} parity set(s) can't be built anew: repair first, or force")
            members = self._staged(catalog.marked_dead(self.members.drop("g"), dying))
            self.catalogue.commit(parity_member=members)
            self._parity_phase(now, dying)
            index = self._staged(catalog.deleted(self.table("file"), doomed))
            told = doomed.select("path", F.lit("removed").alias("kind"), F.lit(None).cast("string").alias("detail"))
            root = self.root

            def unlink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for p in b.column(0).to_pylist():
                        with contextlib.suppress(FileNotFoundError):
                            os.remove(os.path.join(root, p))
                    yield b

            doomed.mapInArrow(unlink, "path string").count()
            self._save(index, **self._events(told, now))
            self._manifests()
            return self._kept(doomed)

    def repair(self, roots: list[str] | None = None, keep_corrupt: bool = False, dry_run: bool = False) -> DataFrame:
        """path, outcome: rebuilds damaged, missing and named files from their sets; nothing replaces a file before its digest is right."""
        with self._locked():
            now, named = int(time.time()), self._roots(roots)
            files = self.table("file")
            wanted = report.listed(files, named).where(F.col("state").isin("corrupt", "unrecoverable", "missing") | F.col("path").isin([r for r in named if r]))
            disk = self._staged(self._here(files)).select("path", F.col("mtime_ns").alias("d_mtime_ns"))
            wanted = wanted.join(disk, "path", "left")
            edited = F.col("d_mtime_ns").isNotNull() & (F.col("d_mtime_ns") != F.col("mtime_ns"))
            wanted = self._staged(wanted.withColumn("edited", edited))
            todo = wanted.where("not edited")
            hit = self.live().join(todo.select("content_hash"), "content_hash", "left_semi").select("g").distinct()
            rows = self.members.join(hit, "g", "left_semi").join(self.sets.select("g", "block_size", "blocks_per_stripe"), "g")
            # a member is read from the file to repair if it is there, else from the first file that is as recorded
            held = files.where("state <> 'missing'").join(disk, "path").where("mtime_ns = d_mtime_ns").join(todo.select("path", F.lit(0).alias("own")), "path", "left")
            best = held.groupBy("content_hash").agg(F.min(F.struct(F.coalesce("own", F.lit(1)).alias("own"), "path")).alias("s")).select("content_hash", F.col("s.path").alias("path"))
            place = rows.join(best, "content_hash", "left")
            blocks = source.file_blocks(place, self.root, ["g", "ord", "first_block", "block_size", "blocks_per_stripe"])
            at = F.col("first_block") + F.col("b")
            known = self.table("block_hash").select(F.col("set_id").alias("g"), F.col("g").alias("at"), "hash")
            # where the recorded block digests are damaged, bytes are taken as they are: the whole file's digest decides in the end
            torn = self._staged(self._damaged_stripes(rows)).withColumn("_torn", F.lit(True))
            blocks = blocks.withColumn("at", at).withColumn("stripe", geometry.floor_div(at, F.col("blocks_per_stripe"))).join(known, ["g", "at"], "left").join(torn, ["g", "stripe"], "left")
            blocks = blocks.withColumn("bytes", F.when(F.col("_torn") | (sets.block_digest(F.col("bytes"), F.col("block_size")) == F.col("hash")), F.col("bytes")))
            blocks = self._staged(blocks.select("g", "ord", "b", "stripe", (F.col("at") % F.col("blocks_per_stripe")).alias("j"), "bytes"))
            wrong = sets.damaged_shards(self.sets.join(hit, "g", "left_semi"), self.table("parity_shard").withColumn("g", F.col("set_id")).join(hit, "g", "left_semi"), self.table("stripe_digest").withColumn("g", F.col("set_id")))
            shards = self.table("parity_shard").withColumnRenamed("set_id", "g").join(hit, "g", "left_semi").join(self._staged(wrong), ["g", "stripe"], "left_anti")
            fixed = self._staged(repair.rebuilt(blocks, shards))
            fixed = fixed.select("g", "stripe", "j", F.col("bytes").alias("fixed"))
            whole = blocks.join(fixed, ["g", "stripe", "j"], "left").select("g", "ord", "b", F.coalesce("bytes", "fixed").alias("bytes"))
            goal = todo.select("path", "content_hash", "size", "mtime_ns").join(self.live().select("content_hash", "g", "ord"), "content_hash")
            out = whole.join(goal, ["g", "ord"]).repartition("path").sortWithinPartitions("path", "b").select("path", "content_hash", "size", "mtime_ns", "b", "bytes")
            done = self._staged(out.mapInArrow(_writer(self.root, self.state, self.config.algo, keep_corrupt, dry_run), "path string, outcome string"))
            rest = wanted.select("path", "state", "edited").join(done, "path", "left")
            none = F.when(F.col("edited"), "edited since it was recorded").when(F.col("state") == "ok", "nothing recorded against it").otherwise("no parity")
            rest = self._staged(rest.select("path", F.coalesce("outcome", none).alias("outcome")))
            if not dry_run:
                states = rest.where("outcome in ('repaired', 'restored', 'intact', 'failed')").select("path", F.when(F.col("outcome") == "failed", "unrecoverable").otherwise("ok").alias("new_state"))
                told = rest.where("outcome in ('repaired', 'restored')").select("path", F.col("outcome").alias("kind"), F.lit(None).cast("string").alias("detail"))
                self.catalogue.commit(file=self._staged(catalog.with_state(files, states, now)), **self._events(told, now))
                self._manifests()
            return self._kept(rest)

    # ------------------------------------------------------------ reports

    def status(self) -> DataFrame:
        return report.totals(self.table("file"), self.live(), self.sets, self.members, self.table("event"))

    def ls(self, roots: list[str] | None = None, state: str | None = None, parity: bool | None = None) -> DataFrame:
        return report.listed(self.table("file"), self._roots(roots), state, self.live(), parity).orderBy(F.encode("path", "UTF-8"))

    def show(self, path: str) -> DataFrame:
        row = coverage.covered(self.table("file").where(F.col("path") == self.relative(path)), self.table("parity_mark"), self.config.parity_default)
        first = row.first()
        if first is None:
            raise FileNotFoundError(path)
        copies = self.table("file").where(F.col("content_hash") == first["content_hash"]).groupBy("content_hash").agg(F.array_sort(F.collect_list("path")).alias("same_content"))
        own = self.members.where((F.col("content_hash") == first["content_hash"]) & ~F.col("dead"))
        safe = sets.loss_protected(self.members.join(own.select("g"), "g", "left_semi"), self.sets)
        member = sets.live_membership(own).select("content_hash", "g", "ord").join(safe, ["g", "ord"]).select("content_hash", F.col("g").alias("set_id"), "protected")
        return row.join(copies, "content_hash").join(member, "content_hash", "left")

    def history(self, path: str | None = None, since: str | None = None, limit: int = 200) -> DataFrame:
        start = int(time.time()) - formats.parse_duration(since) if since else None
        return report.history(self.table("event"), self.relative(path) if path else None, start, limit)

    def export(self, output: str, format: str = "sum") -> None:
        files = self.table("file")
        if format == "sum":
            rows = manifest.sum_lines(files)
        elif format == "json":
            rows = files.select("path", F.to_json(F.struct("path", "content_hash", "size", "mtime_ns", "state")).alias("line"))
        elif format == "tsv":
            rows = manifest.tsv_lines(files)
        elif format == "marks":
            rows = manifest.mark_lines(self.table("parity_mark"))
        else:
            raise ValueError("format is sum, json, tsv or marks")
        rows.orderBy(F.encode("path", "UTF-8")).select("line").coalesce(1).write.mode("overwrite").text(output)

    def import_list(self, file: str, algo: str | None = None, relative_to: str = "", trust: bool = False) -> DataFrame:
        """path, outcome of a checksum list; files that match are indexed."""
        with self._locked():
            now, prefix = int(time.time()), self.relative(relative_to)
            listed = manifest.parsed_sums(self.spark.read.text(file), "value")
            manifest.one_length(listed)
            listed = self._staged(listed.withColumn("path", paths.normalized(F.concat(F.lit(prefix + "/" if prefix else ""), "path"))))
            algo, native = algo or self.config.algo, self.config.algo
            files = self.table("file")
            there = self._staged(self._here(listed))
            # of a list of the archive's own kind, files that the index answers for aren't read, nor is anything that is trusted
            read = there
            if algo == native:
                read = there.where(F.lit(not trust)).join(files.select("path"), "path", "left_anti")
            got = self._staged(source.digested(read, self.root, native, *([algo] if algo != native else [])))
            got = got.withColumn("foreign", F.col("hash_1") if algo != native else F.col("hash"))
            disk = there.join(got.select("path", "hash", "foreign"), "path", "left")
            rows = self._staged(classify.imported(listed, disk, files, algo, native, trust))
            good = rows.where("outcome in ('indexed', 'trusted')").join(disk.select("path", "hash", "size", "mtime_ns"), "path").join(listed.select("path", "digest"), "path")
            # a trusted digest is the list's, so that a later check finds a false list
            new = good.select("path", F.when(F.col("outcome") == "trusted", F.col("digest")).otherwise(F.col("hash")).alias("content_hash"), "size", "mtime_ns", "outcome").dropDuplicates(["path"])
            fresh = catalog.verified_rows(new, now).withColumn("last_verified_at", F.when(F.col("outcome") == "indexed", F.col("last_verified_at"))).drop("outcome")
            self._save(self._staged(catalog.upserted(files, fresh)), **self._events(new.select("path", F.lit("added").alias("kind"), F.lit("import").alias("detail")), now))
            self._manifests()
            return self._kept(rows)

    def fsck(self, deep: bool = False, fix: bool = False) -> DataFrame:
        """set_id, finding: sets against the stored tables, and the digests of the state's files; deep recomputes set ids and the digests of all blocks and shards too."""
        stored = self.table("block_hash").groupBy("set_id").agg(F.count("*").alias("n_blocks"))
        rows = catalog.store_findings(self.sets.select("set_id", "n_blocks"), stored, "set_id", ["n_blocks"])
        if deep:
            ids = sets.set_ids(self.members, self.sets).withColumnRenamed("set_id", "_id")
            rows = rows.union(ids.where("g <> _id").select(F.col("g").alias("set_id"), F.lit("id differs").alias("finding")))
            digests = self.table("stripe_digest").withColumn("g", F.col("set_id"))
            blocks = self._damaged_stripes(self.sets)
            shards = sets.damaged_shards(self.sets, self.table("parity_shard").withColumn("g", F.col("set_id")), digests)
            for found, told in ((blocks, "block table damaged"), (shards, "shards damaged")):
                rows = rows.union(found.select(F.col("g").alias("set_id"), F.lit(told).alias("finding")).distinct())
        torn = self.catalogue.verify(deep)
        if torn:
            rows = rows.union(self.spark.createDataFrame([(None, f"table damaged: {x}") for x in torn], "set_id string, finding string"))
        rows = self._kept(rows)
        if fix:
            with self._locked():
                drop = rows.where("finding <> 'ok' and set_id is not null").select("set_id").distinct()
                held = sets.sources(self.members, self.table("file"), self._here(self.table("file")))
                # a set that may be the only way to a content stays, unless it is nothing but leftovers
                sole = sets.eligible(held).where("not eligible").select(F.col("g").alias("set_id"))
                drop = self._staged(drop.join(sole, "set_id", "left_anti"))
                self.catalogue.commit(**{t: self._staged(self.table(t).join(drop, "set_id", "left_anti")) for t in ("parity_set", "parity_member")})
        return rows

    def rebuild(self, listing: str, marks: str | None = None) -> None:
        """Makes the index anew from a manifest (tab-separated, or a checksum list whose times are unknown), and the marks from theirs; members no file holds are dead."""
        with self._locked():
            now, lines = int(time.time()), self.spark.read.text(listing)
            first = lines.first()
            if first and len(first[0].split("\t")) == 5:
                rows = manifest.parsed_tsv(lines, "value")
            else:
                rows = manifest.parsed_sums(lines, "value").select(F.col("digest").alias("content_hash"), "path", F.lit(0).cast("long").alias("mtime_ns"), F.lit("ok").alias("state"))
            disk = self._staged(self._here(rows)).select("path", F.col("size").alias("d_size"))
            rows = rows.join(disk, "path", "left")
            size = F.coalesce("size", "d_size", F.lit(0)) if "size" in rows.columns else F.coalesce("d_size", F.lit(0))
            rows = rows.select("path", "content_hash", size.alias("size"), "mtime_ns", F.when(F.col("d_size").isNull(), "missing").otherwise(formats.state_of(F.col("state"))).alias("state"), F.lit(now).cast("long").alias("added_at"), F.lit(now).cast("long").alias("updated_at"))
            index = self._staged(rows)
            members = self._staged(catalog.rebuilt_members(self.members.drop("g"), index.select("content_hash")))
            told = self._events(self.spark.createDataFrame([("", "rebuilt", listing)], "path string, kind string, detail string"), now)
            more = {}
            if marks:
                stamp = F.lit(now).cast("long").alias("created_at")
                more["parity_mark"] = self._staged(manifest.parsed_marks(self.spark.read.text(marks), "value").select("path", "mode", stamp))
            self.catalogue.commit(file=index, content=catalog.contents(index, self.config.algo), parity_member=members, **more, **told)

    def set_config(self, key: str, value) -> None:
        if key == "algo" and value != self.config.algo and self.table("file").take(1):
            raise ValueError("the algorithm can't change once files are recorded")
        self.config = dataclasses.replace(self.config, **{key: value}).checked()
        _write_json(os.path.join(self.state, "config.json"), dataclasses.asdict(self.config))


def _write_json(path: str, value: dict) -> None:
    with open(path + ".new", "w") as f:
        json.dump(value, f, indent=1)
    os.replace(path + ".new", path)


def _writer(root: str, state: str, algo: str, keep_corrupt: bool, dry_run: bool):
    """Writes blocks, in order of path and place, next to each file and puts it in place once its digest is the recorded one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None

        def close():
            path, want, mtime, lost, h, temp = now
            out.close()
            full = os.path.join(root, path)
            there = os.path.exists(full)
            if lost or h.hexdigest() != want:
                os.remove(temp)
                return path, "failed"
            if dry_run:
                os.remove(temp)
                return path, "would repair" if there else "would restore"
            if there:
                with open(full, "rb") as f:
                    same = hashlib.file_digest(f, "sha256").hexdigest() == want if algo == "sha256" else False
                if same:
                    os.remove(temp)
                    return path, "intact"
                shutil.copystat(full, temp)
                if keep_corrupt:
                    kept = os.path.join(state, "quarantine", path)
                    os.makedirs(os.path.dirname(kept), exist_ok=True)
                    os.replace(full, kept)
            os.utime(temp, ns=(mtime, mtime))
            os.replace(temp, full)
            return path, "repaired" if there else "restored"

        for b in batches:
            done = []
            for path, want, size, mtime, place, data in zip(*(b.column(c).to_pylist() for c in ("path", "content_hash", "size", "mtime_ns", "b", "bytes"))):
                if now is None or now[0] != path:
                    if now is not None:
                        done.append(close())
                    full = os.path.join(root, path)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    temp = f"{full}{source.TEMPORARY}{uuid.uuid4().hex}"
                    out, now = open(temp, "wb"), [path, want, mtime, False, source.hasher(algo), temp]
                if data is None:
                    now[3] = True
                else:
                    data = data[: max(0, size - place * len(data))]
                    out.write(data)
                    now[4].update(data)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "outcome"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in close()], ["path", "outcome"])

    return run
