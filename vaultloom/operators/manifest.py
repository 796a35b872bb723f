"""Checksum lists and manifests as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def sum_lines(files: DataFrame) -> DataFrame:
    """path, line of files that aren't missing: digest, two spaces, path; a leading backslash where the path is escaped."""
    escape = F.when(paths.needs_escape(F.col("path")), "\\").otherwise("")
    rows = files.where("state <> 'missing'")
    return rows.select("path", F.concat(escape, "content_hash", F.lit("  "), paths.escaped(F.col("path"))).alias("line"))


def tsv_lines(files: DataFrame) -> DataFrame:
    """path, line of all files: digest, size, time in ns, state, path."""
    return files.select("path", F.concat_ws("\t", "content_hash", F.col("size").cast("string"), F.col("mtime_ns").cast("string"), "state", paths.escaped(F.col("path"))).alias("line"))


def mark_lines(marks: DataFrame) -> DataFrame:
    return marks.select("path", F.concat_ws("\t", "mode", "path").alias("line"))


def parsed_sums(lines: DataFrame, line: str = "line") -> DataFrame:
    """algo (null if not named), digest, path of checksum lines; blank lines and those that begin with # or %%%% are left out.

    Forms: `hex  path`, `hex *path`, `algo:hex path`; a backslash in front says that the path is escaped.
    """
    text = F.regexp_replace(line, "\r$", "")
    rows = lines.select(text.alias("t")).where(F.trim("t") != "").where(~F.col("t").startswith("#") & ~F.col("t").startswith("%%%%"))
    shape = r"^(\\?)(?:([A-Za-z0-9-]+):)?([0-9A-Fa-f]+) [ *]?(?s:(.+))$"
    part = lambda k: F.regexp_extract("t", shape, k)
    rows = rows.where(F.col("t").rlike(shape)).select(F.nullif(part(2), F.lit("")).alias("algo"), F.lower(part(3)).alias("digest"), part(1).alias("esc"), part(4).alias("raw"))
    return rows.select("algo", "digest", F.when(F.col("esc") == "\\", paths.unescaped(F.col("raw"))).otherwise(F.col("raw")).alias("path"))


def parsed_tsv(lines: DataFrame, line: str = "line") -> DataFrame:
    part = F.split(line, "\t", 5)
    rows = lines.where(~F.col(line).startswith("#")).select(part.alias("p")).where(F.size("p") == 5)
    get = lambda k: F.get("p", F.lit(k))
    return rows.select(get(0).alias("content_hash"), get(1).try_cast("long").alias("size"), get(2).try_cast("long").alias("mtime_ns"), get(3).alias("state"), paths.unescaped(get(4)).alias("path"))


def parsed_marks(lines: DataFrame, line: str = "line") -> DataFrame:
    part = F.split(line, "\t", 2)
    rows = lines.where(~F.col(line).startswith("#")).select(part.alias("p")).where(F.size("p") == 2)
    return rows.select(F.get("p", F.lit(1)).alias("path"), F.get("p", F.lit(0)).alias("mode")).where(F.col("mode").isin("include", "exclude"))


def lengths(listed: DataFrame) -> DataFrame:
    """n_digits, lines: how many digests of each length a list holds."""
    return listed.groupBy(F.length("digest").cast("long").alias("n_digits")).agg(F.count("*").alias("lines"))


def one_length(listed: DataFrame) -> int:
    """Hex digits of all digests; ValueError unless they agree on 64."""
    found = [r["n"] for r in listed.select(F.length("digest").alias("n")).distinct().limit(3).collect()]
    if found != [64]:
        raise ValueError(f"digests of {sorted(found)} hex digits; 64 are wanted")
    return 64
