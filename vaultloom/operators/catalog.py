"""State of an archive: tables of one generation, changed set by set; generations are directories with one pointer.

Nothing is updated in place. A new generation is written next to the old one, then the pointer file is replaced in one
step; a run that breaks off leaves a directory that no pointer names. A table is a list of directories: small tables are
written anew, events and what belongs to parity sets are only added to. A set names the part that holds its blocks and shards,
so dropping a set writes no shard; a part that no set names goes. The pointer records the size and digest of every file.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archive as source

#: The tables and their columns.
SCHEMAS = {
    "meta": "key string, value string",
    "content": "hash string, algo string, size long, created_at long",
    "parity_set": "set_id string, algo string, block_size long, blocks_per_stripe long, parity_ppm long, min_parity_blocks long, n_members long, n_blocks long, n_stripes long, data_bytes long, created_at long, part string",
    "parity_member": "set_id string, ord long, content_hash string, size long, first_block long, n_blocks long, dead boolean",
    "file": "path string, content_hash string, size long, mtime_ns long, inode long, state string, added_at long, updated_at long, last_verified_at long",
    "event": "seq long, ts long, path string, kind string, detail string",
    "parity_mark": "path string, mode string, created_at long",
    "block_hash": "set_id string, part string, g long, hash string",
    "parity_shard": "set_id string, part string, stripe long, idx long, bytes binary",
    "stripe_digest": "set_id string, part string, stripe long, blocks string, shards string",
}
#: Tables that are only added to: those of sets, by part, and the log.
OF_SETS = ("block_hash", "parity_shard", "stripe_digest")
LOG_PARTS = 64


def contents(files: DataFrame, algo: str) -> DataFrame:
    return files.groupBy(F.col("content_hash").alias("hash")).agg(F.lit(algo).alias("algo"), F.max("size").alias("size"), F.min("added_at").alias("created_at"))


def orphans(content: DataFrame, files: DataFrame) -> DataFrame:
    """Contents that no file holds."""
    return content.join(files.select(F.col("content_hash").alias("hash")), "hash", "left_anti")


def meta_set(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    """meta (key, value) with the values in place of what was there under their keys."""
    new = meta.sparkSession.createDataFrame(sorted(values.items()), "key string, value string")
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old and the rows of new whose keys it doesn't have."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def verified_rows(rows: DataFrame, now: int) -> DataFrame:
    return rows.withColumn("state", F.lit("ok")).withColumn("updated_at", F.lit(now).cast("long")).withColumn("added_at", F.lit(now).cast("long")).withColumn("last_verified_at", F.lit(now).cast("long"))


def upserted(files: DataFrame, new: DataFrame) -> DataFrame:
    """files with the rows of new by path; only added_at stays from the old row."""
    first = files.select("path", F.col("added_at").alias("_added"))
    fresh = new.join(first, "path", "left").withColumn("added_at", F.coalesce("_added", "added_at")).drop("_added")
    return files.join(new.select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def deleted(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select("path"), "path", "left_anti")


def with_state(files: DataFrame, states: DataFrame, now: int, verified: bool = False) -> DataFrame:
    """states: path, new_state. verified sets last_verified_at and leaves updated_at alone."""
    rows = files.join(states.select("path", "new_state"), "path", "left")
    hit = F.col("new_state").isNotNull()
    stamp = "last_verified_at" if verified else "updated_at"
    return rows.withColumn(stamp, F.when(hit, F.lit(now).cast("long")).otherwise(F.col(stamp))).withColumn("state", F.coalesce("new_state", "state")).drop("new_state")


def marked_dead(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """Members of the contents are dead too; none comes back to life."""
    rows = members.join(hashes.select("content_hash", F.lit(True).alias("_d")).distinct(), "content_hash", "left")
    return rows.withColumn("dead", F.col("dead") | F.coalesce("_d", F.lit(False))).drop("_d")


def merged_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, a row for each place of a set; dead if either says so."""
    rows = old.unionByName(new)
    others = [F.first(c).alias(c) for c in rows.columns if c not in ("set_id", "ord", "dead")]
    return rows.groupBy("set_id", "ord").agg(*others, F.bool_or("dead").alias("dead")).select(*old.columns)


def without_sets(rows: DataFrame, gone: DataFrame, key: str = "set_id") -> DataFrame:
    """What is left of any table of sets once some are deleted."""
    return rows.join(gone.select(key), key, "left_anti")


def with_marks(marks: DataFrame, new: DataFrame) -> DataFrame:
    """marks (path, mode) with the new ones in place of the old; a null mode takes a mark away."""
    return marks.join(new.select("path"), "path", "left_anti").unionByName(new.where("mode is not null"), allowMissingColumns=True)


def looked_up(files: DataFrame, content: DataFrame) -> DataFrame:
    """Files with algo and created_at of their contents; null where the content isn't recorded."""
    return files.join(content.select(F.col("hash").alias("content_hash"), "algo", F.col("created_at").alias("known_since")), "content_hash", "left")


def store_findings(rows: DataFrame, stored: DataFrame, key: str, shape: list[str]) -> DataFrame:
    """key, finding: ok, missing in the store, orphan there, or another geometry."""
    there = stored.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in shape))
    both = rows.join(there, rows[key] == there["_key"], "full_outer")
    differs = F.lit(False)
    for c in shape:
        differs = differs | (F.col(c) != F.col(f"_{c}"))
    finding = F.when(F.col("_key").isNull(), "missing").when(F.col(key).isNull(), "orphan").when(differs, "geometry differs").otherwise("ok")
    return both.select(F.coalesce(key, "_key").alias(key), finding.alias("finding"))


def rebuilt_members(members: DataFrame, listed: DataFrame) -> DataFrame:
    rows = members.join(listed.select("content_hash", F.lit(True).alias("_held")).distinct(), "content_hash", "left")
    return rows.withColumn("dead", F.col("_held").isNull()).drop("_held")


class Catalogue:
    """Generations of the tables under a state directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @property
    def pointer(self) -> str:
        return os.path.join(self.root, "CURRENT")

    def current(self) -> dict:
        if not os.path.exists(self.pointer):
            return {"generation": 0, "tables": {}}
        with open(self.pointer) as f:
            return json.load(f)

    def stored(self, table: str) -> DataFrame:
        """All rows of a table's directories, also those of sets that are gone."""
        places = self.current()["tables"].get(table)
        if not places:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(os.path.join(self.root, p) for p in places))

    def read(self, table: str) -> DataFrame:
        rows = self.stored(table)
        return rows.join(self.stored("parity_set").select("set_id", "part"), ["set_id", "part"], "left_semi") if table in OF_SETS else rows

    def fresh(self) -> str:
        """A directory's name for a new generation."""
        return f"gen={self.current()['generation'] + 1}-{time.time_ns()}"

    def commit(self, append: dict[str, DataFrame] | None = None, part: str | None = None, last_seq: int | None = None, **tables: DataFrame) -> int:
        """Writes `tables` anew and adds `append` to theirs, as one new generation; the others stay as they are. Returns its number."""
        now = self.current()
        number, places, part = now["generation"] + 1, {t: list(p) for t, p in now["tables"].items()}, part or self.fresh()
        append = dict(append or {})
        if "event" in append and len(places.get("event", [])) >= LOG_PARTS:
            tables["event"] = self.stored("event").unionByName(append.pop("event"), allowMissingColumns=True)
        for name, rows in [*tables.items(), *append.items()]:
            place = os.path.join(part, name)
            kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
            have = set(rows.columns)
            rows.select(*(F.col(c).cast(k).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items())).write.parquet(os.path.join(self.root, place))
            places[name] = [*places.get(name, []), place] if name in append else [place]
        if "parity_set" in tables:
            named = {r["part"] for r in self.spark.read.schema(SCHEMAS["parity_set"]).parquet(os.path.join(self.root, places["parity_set"][0])).select("part").distinct().collect()}
            for name in OF_SETS:
                places[name] = [p for p in places.get(name, []) if p.split(os.sep)[0] in named]
        os.makedirs(self.root, exist_ok=True)
        if os.path.exists(self.pointer):
            self._put("PREVIOUS", now)
        old = now.get("parts", {})
        parts = self._digests([p for of in places.values() for p in of if p not in old]) | {p: old[p] for of in places.values() for p in of if p in old}
        self._put("CURRENT", {"generation": number, "tables": places, "parts": parts, "last_seq": now.get("last_seq", 0) if last_seq is None else last_seq})
        self._sweep()
        return number

    def _put(self, name: str, value: dict) -> None:
        fresh = os.path.join(self.root, f"{name}.{os.getpid()}")
        with open(fresh, "w") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, os.path.join(self.root, name))

    def _files(self, place: str) -> dict[str, int]:
        """The part files of a written table and their sizes."""
        top = os.path.join(self.root, place)
        return {n: os.path.getsize(os.path.join(top, n)) for n in sorted(os.listdir(top)) if n.endswith(".parquet")} if os.path.isdir(top) else {}

    def _digests(self, places: list[str]) -> dict[str, dict[str, list]]:
        """Size and SHA-256 of the files of each directory; large ones are read by the tasks."""
        out, large = {}, []
        for place in places:
            out[place] = {}
            for name, size in self._files(place).items():
                if size <= 1 << 20:
                    with open(os.path.join(self.root, place, name), "rb") as f:
                        out[place][name] = [size, hashlib.file_digest(f, "sha256").hexdigest()]
                else:
                    large.append((f"{place}/{name}", size, os.stat(os.path.join(self.root, place, name)).st_mtime_ns))
        if large:
            rows = self.spark.createDataFrame(large, "path string, size long, mtime_ns long").repartition(min(len(large), 4096))
            for r in source.digested(rows, self.root, "sha256").select("path", "size", "hash").collect():
                place, name = r["path"].rsplit("/", 1)
                out[place][name] = [r["size"], r["hash"]]
        return out

    def _sweep(self) -> None:
        """Deletes generations that neither the current nor the previous pointer names."""
        kept = set()
        for name in ("CURRENT", "PREVIOUS"):
            path = os.path.join(self.root, name)
            if os.path.exists(path):
                with open(path) as f:
                    kept |= {place.split(os.sep)[0] for of in json.load(f)["tables"].values() for place in of}
        for name in os.listdir(self.root):
            if name.startswith("gen=") and name not in kept:
                shutil.rmtree(os.path.join(self.root, name), ignore_errors=True)

    def verify(self, deep: bool = True) -> list[str]:
        """What differs between the files the pointer recorded and those there: sizes, and digests of all tables, of sets' parts only if deep."""
        now, problems = self.current(), []
        for table, places in now["tables"].items():
            there = self._digests(places) if deep or table not in OF_SETS else {p: {n: [size, None] for n, size in self._files(p).items()} for p in places}
            for place in places:
                recorded, found = now["parts"][place], there[place]
                for n in sorted(set(recorded) | set(found)):
                    one, two = recorded.get(n), found.get(n)
                    if one is None or two is None or one[0] != two[0] or (two[1] is not None and one[1] != two[1]):
                        problems.append(f"{table}: {n}")
        return problems

    def roll_back(self) -> None:
        """Makes the previous generation the current one."""
        with open(os.path.join(self.root, "PREVIOUS")) as f:
            self._put("CURRENT", json.load(f))
