"""Sizes, ratios, durations and times: parsing on the driver, display as columns."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a file, a mark and a digest can be.
STATES = ("ok", "modified", "corrupt", "unrecoverable", "missing")
MODES = ("include", "exclude")
ALGORITHMS = {"blake3": 1, "sha256": 2}
EVENTS = ("added", "modified", "corrupt", "read-error", "reappeared", "moved", "removed", "missing", "verified", "repaired", "restored", "accepted", "parity-skip", "rebuilt")

_UNITS = {"": 1, "b": 1} | {f"{c}{i}b": (1024 if i else 1000) ** (k + 1) for k, c in enumerate("kmgtp") for i in ("", "i")} | {c: 1000 ** (k + 1) for k, c in enumerate("kmgtp")} | {f"{c}i": 1024 ** (k + 1) for k, c in enumerate("kmgtp")}
_SPANS = {1: "s sec secs second seconds", 60: "m min mins minute minutes", 3600: "h hr hrs hour hours", 86400: "d day days", 604800: "w week weeks", 2630016: "M month months", 31557600: "y year years"}


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(Decimal(m[1]) * _UNITS[m[2].lower()])


def parse_parity(text: str) -> int:
    """Parts per million of 5%, 5 or 0.05; a bare number below 1 is a fraction."""
    percent = text.strip().endswith("%")
    try:
        value = Decimal(text.strip().rstrip("%").strip())
    except ArithmeticError:
        raise ValueError(f"not a ratio: {text!r}") from None
    if not percent and value < 1:
        value *= 100
    if not 0 <= value <= 100:
        raise ValueError("parity goes from 0 to 100 percent")
    return int((value * 10_000).to_integral_value(ROUND_HALF_UP))


def parse_duration(text: str) -> int:
    """Seconds of 30d, 12h, 1h 30m."""
    by = {name: n for n, names in _SPANS.items() for name in names.split()}
    parts = re.findall(r"\s*([0-9]+)\s*([A-Za-z]+)", text)
    if not parts or "".join(f"{a}{b}" for a, b in parts) != re.sub(r"\s", "", text) or any(b not in by for _, b in parts):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(a) * by[b] for a, b in parts)


def sizes(text: Column) -> Column:
    """parse_size for a column; null where the text is no size, or one beyond a long."""
    shape = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"
    unit = F.lower(F.regexp_extract(text, shape, 2))
    by = F.lit(None).cast("long")
    for names, n in sorted({n: [u for u, m in _UNITS.items() if m == n] for n in _UNITS.values()}.items()):
        by = F.when(unit.isin(*n), F.lit(names).cast("long")).otherwise(by)
    number = F.regexp_extract(text, shape, 1).try_cast("decimal(20,6)")
    return F.when(text.rlike(shape), F.floor(number * by).try_cast("long"))


def parities(text: Column) -> Column:
    """parse_parity for a column; null where the text is no ratio."""
    plain = F.regexp_replace(F.trim(text), "\\s*%$", "")
    value = F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)?$"), plain.try_cast("decimal(20,8)"))
    value = F.when(~F.trim(text).endswith("%") & (value < 1), value * 100).otherwise(value)
    return F.when(value <= 100, F.round(value * 10_000, 0).cast("long"))


def durations(text: Column) -> Column:
    """parse_duration for a column; null where the text is no duration."""
    by = {name: n for n, names in _SPANS.items() for name in names.split()}
    one = r"\s*([0-9]+)\s*([A-Za-z]+)"
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(one), F.lit(1)), F.regexp_extract_all(text, F.lit(one), F.lit(2)), lambda n, u: F.struct(n.alias("n"), u.alias("u")))

    def seconds(p: Column) -> Column:
        out = F.lit(None).cast("long")
        for n in sorted(set(by.values())):
            out = F.when(p["u"].isin(*(u for u, m in by.items() if m == n)), p["n"].cast("long") * n).otherwise(out)
        return out

    return F.when(text.rlike(f"^(?:{one})+\\s*$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + seconds(p)))


def shown_bytes(n: Column) -> Column:
    """IEC units with one decimal; plain bytes below 1 KiB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        step = 1 << 10 * k
        tenths = F.floor((n.cast("decimal(38,0)") * 10 + step // 2) / step)
        out = F.when(n >= step, F.concat(F.format_string("%d.%d", F.expr("0") + (tenths / 10).cast("long"), (tenths % 10).cast("long")), F.lit(f" {unit}iB"))).otherwise(out)
    return out


def shown_time(seconds: Column, none: str = "never") -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(none))


def shown_ago(seconds: Column, now: Column) -> Column:
    d = now - seconds
    part = lambda by, unit: F.concat(F.expr("0") + F.floor(d / by), F.lit(f"{unit} ago"))
    return F.when(d < 0, "in the future").when(d < 120, part(1, "s")).when(d < 7200, part(60, "m")).when(d < 172800, part(3600, "h")).otherwise(part(86400, "d"))


def state_of(text: Column) -> Column:
    """A state as stored; anything unknown counts as ok."""
    return F.when(text.isin(*STATES), text).otherwise("ok")


def percent_of(ppm: Column) -> Column:
    return ppm / 10_000
