"""Secret scans with corpus-wide ownership, in built-in functions only.

Base kinds are found by pattern, leftmost and non-overlapping per kind: `assign`, `access`, `hex`. Other mixed tokens are
candidates: their hashes are counted over the whole corpus by distinct repositories and distinct owners, and those seen
with few of either, so owner-specific and live-looking, are added as spans of kind `owned`; widely copied ones are examples
and are left out. Base spans always stay; ownership only marks them live or copied.

Positions are code points, end exclusive. Matches and the gaps between them (regexp_extract_all and split) give positions
by summing lengths, so that no text leaves the JVM. Counts by (hash, repository, owner) are partly summed before the
shuffle, and spans meet their counts with hot hashes dealt over many tasks, so a value copied into a third of the corpus
doesn't gather in one. Positions and redacted texts are put together in two levels, in time near linear in the matches.

Defined results: null text counts as empty and has no spans; a null repository or owner is one of its own; ids may repeat or
be null (each row stands for itself); other columns are ignored unless kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CUT, cuts, let, numbered, running, scratch, spread_join

# The patterns of the base kinds, letters of the key words in either case.
KEYS = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = KEYS + """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: A run that may be a credential: long, with upper and lower case letters and digits (checked on the value).
MIXED = "[A-Za-z0-9_+/-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "struct<start:bigint,kind:int,end:bigint,hash:string>"


def spans_of(text: Column, pattern: str, kind: int, least: str | None = None, group: int = 0, keep=None) -> Column:
    """Array of SPAN for the matches of `pattern`; `least` is a cheaper pattern that any kept match implies."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    rows = F.zip_with(found, value, lambda a, b: F.struct(F.length(a).cast("bigint").alias("length"), b.alias("value")))
    rows = F.zip_with(F.slice(gaps, 1, F.size(found)), rows, lambda g, r: F.struct(g.alias("gap"), r["length"].alias("length"), r["value"].alias("value")))

    def placed(m: Column) -> Column:
        before = F.slice(running(F.transform(m, lambda x: x["gap"] + x["length"]), 0, lambda a, x: a + x), F.lit(1), F.size(m))
        spans = F.zip_with(m, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["length"]).alias("end"), x["value"].alias("value")))
        kept = F.filter(spans, lambda x: keep(x["value"])) if keep else spans
        return F.transform(kept, lambda x: F.struct(x["start"], x["kind"], x["end"], F.sha2(x["value"].cast("binary"), 256).alias("hash")).cast(SPAN))

    return F.when(text.rlike(least or pattern), let(rows, placed)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def candidates(df: DataFrame, text: str = "text", repository: str | Column | None = "source", owner: str | Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, row_id, repository, owner, base and extra (arrays of SPAN), written once as a scratch table."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    base = F.concat(
        spans_of(body, ASSIGN, 0, ASSIGN[:-1].replace("]+", "]{8,}") + ")", 1, lambda v: F.length(v) >= 8),
        spans_of(body, ACCESS, 1),
        spans_of(body, HEX, 2),
    )
    mixed = spans_of(body, MIXED, 3, None, 0, lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"))
    column = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    by = F.lit("") if repository is None else column(repository)
    named = df.select(*keep, F.col(text).alias("_text"), by.alias("_repository"), (by if owner is None else column(owner)).alias("_owner"))
    rows = named.select(*keep, "_repository", "_owner", F.monotonically_increasing_id().alias("_row"), base.alias("base"), mixed.alias("extra"))
    rows = rows.withColumn("extra", F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))))
    return scratch(rows, "secret-candidates")


def ownership(rows: DataFrame) -> DataFrame:
    """hash, repositories, owners, n: distinct counts and the number of spans over the whole corpus."""
    each = rows.select("_repository", "_owner", F.explode(F.concat("base", "extra")).alias("s"))
    each = each.groupBy(F.col("s.hash").alias("hash"), "_repository", "_owner").agg(F.count("*").alias("n"))
    return each.groupBy("hash").agg(F.countDistinct("_repository").alias("repositories"), F.countDistinct("_owner").alias("owners"), F.sum("n").alias("n"))


def found(df: DataFrame, text: str = "text", repository: str | Column | None = "source", owner: str | Column | None = None, keep: tuple[str, ...] = ("doc_id",), most_repositories: int = 2, most_owners: int = 2) -> DataFrame:
    """A row for each row of df: kept columns, base (array of SPAN) and spans: array of (start, kind, end, live), base and owned, by start, then kind."""
    rows = candidates(df, text, repository, owner, keep)
    each = rows.where((F.size("base") > 0) | (F.size("extra") > 0)).select("_row", F.explode(F.concat("base", "extra")).alias("s"))
    live = (F.col("repositories") <= most_repositories) & (F.col("owners") <= most_owners)
    owned = ownership(rows)
    judged = spread_join(each.withColumn("hash", F.col("s.hash")), owned.drop("n"), ["hash"], owned.select("hash", "n"), ["_row", "s"]).where((F.col("s.kind") < 3) | live)
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), live.alias("live"))
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,live:boolean>>)")
    return rows.join(spans, "_row", "left").select(*keep, "_row", "base", F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(rows: DataFrame) -> DataFrame:
    """found() with counts of the base kinds, a checksum of the base spans, all spans as text, and counts of live and copied ones."""
    def of(kind: int) -> Column:  # no default argument: a second parameter would be the element's index
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    count = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = _listed(F.filter("spans", lambda s: s["kind"] < 3))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return rows.select("doc_id", *count, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), live.alias("n_live"))


def redacted(df: DataFrame, text: str = "text", repository: str = "source", owner: str | None = None) -> DataFrame:
    """df with every span of found() replaced: live ones by [secret], widely copied ones by [example key]. n_chars, if there, follows."""
    plain, names = numbered(df)
    at = {name: f"_c{k}" for k, name in enumerate(names)}
    hit = found(plain, at[text], at.get(repository), at.get(owner), tuple(plain.columns))
    text = at[text]
    def clean(z: Column) -> Column:
        """z: spans, and for each the end of those before it. Cut into segments, so that no span is sought from the text's start."""
        spans, reach = z["spans"], z["reach"]
        segments = F.transform(cuts(spans), lambda k: F.struct(k.alias("k"), F.get(reach, k * CUT).alias("low"), F.get(reach, F.least((k + 1) * CUT, F.size(spans))).alias("high")))
        segments = F.transform(segments, lambda g: F.struct(g["k"].alias("k"), g["low"].alias("low"), F.substring(F.col(text), (g["low"] + 1).cast("int"), (g["high"] - g["low"]).cast("int")).alias("part")))

        def written(g: Column) -> Column:
            def one(i: Column) -> Column:
                s, at = F.get(spans, i), F.get(reach, i)
                gap = F.substring(g["part"], (at - g["low"] + 1).cast("int"), (s["start"] - at).cast("int"))
                return F.when(s["start"] < at, "").otherwise(F.concat(gap, F.when(s["live"], F.lit("[secret]")).otherwise(F.lit("[example key]"))))

            return F.array_join(F.transform(F.sequence(g["k"] * CUT, F.least((g["k"] + 1) * CUT, F.size(spans)) - 1), one), "")

        rest = F.substring(F.col(text), (F.element_at(reach, -1) + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(F.transform(segments, written), ""), rest)

    ends = running(F.transform("spans", lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x))
    clean = let(F.struct(F.col("spans").alias("spans"), ends.alias("reach")), clean)
    out = hit.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
    if "n_chars" in names:
        kind = df.schema["n_chars"].dataType
        out = out.withColumn(at["n_chars"], F.when(F.size("spans") > 0, F.length(text).cast(kind)).otherwise(F.col(at["n_chars"])))
    return out.select(*plain.columns).toDF(*names)


def _sql_spans(kind: int, pattern: str, keep: str, value: str = "m") -> str:
    p = pattern.replace("'", "''")
    return f"""select rid, doc_id, repository, source, st as s, {kind} as k, st + length(m) as e, sha256({value}) as h from (
      select *, (sum(length(g)) over w + coalesce(sum(length(m)) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0))::bigint as st
      from (select rid, doc_id, repository, source, unnest(regexp_extract_all(t, '{p}')) as m, unnest(regexp_extract_all(t, '{p}', 1)) as v,
                   unnest(string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) as g, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) as i from d)
      window w as (partition by rid order by i)) where {keep}"""


def oracle(most_repositories: int, most_owners: int) -> str:
    """The same over `documents` with source/lang as the repository and source as the owner."""
    group = lambda p: p if p.count("(") > p.count("(?:") else f"({p})"
    kinds = "case k when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'owned' end"
    return f"""with d as (select row_number() over () as rid, doc_id, concat_ws('/', source, lang) as repository, coalesce(source, '') as source, coalesce(text, '') as t from documents),
    base as ({_sql_spans(0, ASSIGN, "length(v) >= 8", "v")} union all {_sql_spans(1, group(ACCESS), "true")} union all {_sql_spans(2, group(HEX), "true")}),
    extra as (select * from ({_sql_spans(3, group(MIXED), "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')")}) x
              where not exists (select 1 from base b where b.rid = x.rid and b.s < x.e and x.s < b.e)),
    every as (select * from base union all select * from extra),
    own as (select h, count(distinct repository) <= {most_repositories} and count(distinct source) <= {most_owners} as live from every group by h),
    kept as (select every.*, live from every join own using (h) where k < 3 or live),
    per as (select rid, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c, count(*) filter (k = 3) as o, count(*) filter (live) as l,
              string_agg({kinds} || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 3) as base, string_agg({kinds} || ':' || s || ':' || e, ',' order by s, k, e) as spans from kept group by rid)
    select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, coalesce(o, 0) as n_owned, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(l, 0) as n_live
    from d left join per using (rid)"""
