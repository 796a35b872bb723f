"""Archive paths as columns: relative, parts separated by /, the root is the empty string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def under(path: Column, directory: str) -> Column:
    """Whether a path is the directory or lies in it. The range keeps Parquet's min/max pruning; foo doesn't match foobar."""
    if not directory:
        return F.lit(True)
    return ((path >= f"{directory}/") & (path < f"{directory}0")) | (path == directory)


def under_any(path: Column, directories: list[str]) -> Column:
    out = F.lit(False)
    for d in directories:
        out = out | under(path, d)
    return out


def components(path: Column) -> Column:
    """Sort key by parts: a/b comes before a-b."""
    return F.split(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(directory: Column) -> Column:
    """The directory and all above it to the root, nearest first."""
    parts = F.split(directory, "/", -1)
    above = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(directory == "", F.array(F.lit(""))).otherwise(above)


def normalized(path: Column) -> Column:
    """Drops empty parts and dots; .. takes the part before it away."""
    start = F.expr("cast(array() as array<string>)")

    def step(acc: Column, part: Column) -> Column:
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), acc).when(part == "..", shorter).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/", -1), start, step), "/")


def normalize(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for a whole path; * and ? stay within a part, ** goes across."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:[^/]*/)*", k + 3
        elif pattern[k:] == "**" and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            body = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and "}" in pattern[k:]:
            end = pattern.index("}", k)
            out, k = out + "(?:" + "|".join(glob_regex(p) for p in pattern[k + 1 : end].split(",")) + ")", end + 1
        else:
            out, k = out + re.escape(c), k + 1
    return out


def exclude_regex(patterns: list[str]) -> str | None:
    """One expression that finds excluded paths: a match of a path or of any directory above it.

    A pattern without / is a name at any depth; one with / begins at the root.
    """
    found = [("" if "/" in p else "(?:.*/)?") + glob_regex(p.lstrip("/")) for p in patterns]
    return f"^(?:{'|'.join(found)})(?:/|$)" if found else None


def excluded(path: Column, patterns: list[str]) -> Column:
    regex = exclude_regex(patterns)
    return path.rlike(regex) if regex else F.lit(False)


def escaped(path: Column) -> Column:
    """Line ends and backslashes as two characters, the backslash first."""
    return F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def needs_escape(path: Column) -> Column:
    return F.instr(path, "\\").cast("boolean") | F.instr(path, "\n").cast("boolean") | F.instr(path, "\r").cast("boolean")


def unescaped(path: Column) -> Column:
    r"""One pass from left to right over \n, \r and \; other escapes stay as they are."""
    tokens = F.regexp_extract_all(path, F.lit(r"\\[\s\S]|[^\\]+|\\$"), F.lit(0))
    one = lambda t: F.when(t == "\\n", "\n").when(t == "\\r", "\r").when(t == "\\\\", "\\").otherwise(t)
    return F.array_join(F.transform(tokens, one), "")


def set_path(set_id: Column) -> Column:
    """Where the shards of a set lie: two levels of two hex digits."""
    return F.concat_ws("/", F.substring(set_id, 1, 2), F.substring(set_id, 3, 2), set_id)
