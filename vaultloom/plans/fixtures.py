"""An archive made from the tables: what the index recorded (t0) and what the disk holds later (t1), in Spark and as SQL.

Documents with doc_id mod 31 = k and at least 64 bytes change: 0 removed, 1 moved, 2 edited and longer, 3 edited at the same
size, 4 first byte rotten with its time kept, 5 touched, 6 cut by 7 bytes, 7 first byte rotten with a new time, 8 longer with
its time kept, 9 two blocks rotten. Pages are new files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Config

CONFIG = Config(block_size=64, stripe_size=32 << 10, parity_ppm=50_000)
EPOCH = 1_700_000_000
MARKS = [("src1", "include"), ("src1/de", "exclude"), ("src2", "include"), ("src3", "include"), ("src3/en", "exclude"), ("moved", "include"), ("web", "include")]


def t0(spark: SparkSession, sf: str) -> DataFrame:
    """path, doc_id, k, content, hash, size, mtime_ns of the recorded files."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    rows = docs.select(
        F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))).alias("path"),
        "doc_id",
        F.encode("text", "UTF-8").alias("content"),
        (F.lit(EPOCH * 10**9) + F.col("doc_id") * 1_000_000_007).alias("mtime_ns"),
    )
    rows = rows.withColumn("size", F.octet_length("content").cast("long"))
    k = F.when(F.col("size") >= 128, (F.col("doc_id") % 31).cast("int")).otherwise(30)
    return rows.select("path", "doc_id", k.alias("k"), "content", F.sha2("content", 256).alias("hash"), "size", "mtime_ns")


def _flipped(hx, at: int):
    """The byte at `at` NOTed, in hex digits."""
    byte = F.translate(F.substring(hx, 2 * at + 1, 2), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(F.expr(f"left(hx, {2 * at})"), byte, F.expr(f"substring(hx, {2 * at + 3})"))


def t1(spark: SparkSession, sf: str) -> DataFrame:
    """path, content, hash, size, mtime_ns of the files on disk."""
    rows = t0(spark, sf).where("k <> 0").withColumn("hx", F.hex("content"))
    hx = F.col("hx")
    junk = F.lit("6A756E6B")
    changed = (
        F.when(F.col("k").isin(2, 8), F.concat(hx, junk))
        .when(F.col("k") == 3, F.translate(hx, "0123456789ABCDEF", "FEDCBA9876543210"))
        .when(F.col("k").isin(4, 7), _flipped(hx, 0))
        .when(F.col("k") == 6, F.expr("left(hx, length(hx) - 14)"))
        .when(F.col("k") == 9, F.concat(F.translate(F.substring(hx, 1, 2), "0123456789ABCDEF", "FEDCBA9876543210"), F.substring(hx, 3, 126), F.translate(F.substring(hx, 129, 2), "0123456789ABCDEF", "FEDCBA9876543210"), F.expr("substring(hx, 131)")))
        .otherwise(hx)
    )
    docs = rows.select(
        F.when(F.col("k") == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("k").isin(2, 3, 4, 6, 7, 8, 9), F.unhex(changed)).otherwise(F.col("content")).alias("content"),
        (F.col("mtime_ns") + F.when(F.col("k").isin(2, 3, 5, 7), 5 * 10**9).otherwise(0)).alias("mtime_ns"),
    )
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("html is not null")
    new = pages.select(F.concat(F.lit("web/p"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("path"), F.encode("html", "UTF-8").alias("content"), (F.lit(EPOCH * 10**9) + F.col("page_id")).alias("mtime_ns"))
    return docs.union(new).select("path", "content", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"), "mtime_ns")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """The index: path, content_hash, size, mtime_ns, state, added_at, updated_at, last_verified_at."""
    d = F.col("doc_id")
    state = F.when(F.col("k") == 10, "corrupt").when(F.col("k") == 11, "unrecoverable").when(F.col("k") == 12, "missing").when(F.col("k") == 13, "modified").otherwise("ok")
    verified = F.when(d % 7 == 0, F.lit(None).cast("long")).otherwise(F.lit(EPOCH) + d * 7919 % 5_000_000)
    return t0(spark, sf).select("path", F.col("hash").alias("content_hash"), "size", "mtime_ns", state.alias("state"), (F.lit(EPOCH) + d).alias("added_at"), (F.lit(EPOCH) + d).alias("updated_at"), verified.alias("last_verified_at"))


def marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKS, "path string, mode string")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event log: seq, ts (seconds), path, kind, detail."""
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select(F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("detail"))


# ---------------------------------------------------------------- the same as SQL

_NOT = "'0123456789ABCDEF', 'FEDCBA9876543210'"
SQL_T0 = f"""t0 as (select *, sha256(unhex(hx)) as hash from (select source || '/' || lang || '/d' || lpad(doc_id::varchar, 8, '0') as path, doc_id, hx, length(hx) // 2 as size,
  case when length(hx) // 2 >= 128 then doc_id % 31 else 30 end as k, {EPOCH * 10**9} + doc_id * 1000000007 as mtime_ns
  from (select doc_id, source, lang, hex(encode(text)) as hx from documents where text is not null)))"""
SQL_T1 = f"""t1 as (select path, hx, sha256(unhex(hx)) as hash, length(hx) // 2 as size, mtime_ns from (
  select case when k = 1 then 'moved/' || path else path end as path,
    case when k in (2, 8) then hx || '6A756E6B' when k = 3 then translate(hx, {_NOT}) when k in (4, 7) then translate(hx[1:2], {_NOT}) || hx[3:]
      when k = 6 then hx[1:length(hx) - 14] when k = 9 then translate(hx[1:2], {_NOT}) || hx[3:128] || translate(hx[129:130], {_NOT}) || hx[131:] else hx end as hx,
    mtime_ns + case when k in (2, 3, 5, 7) then 5000000000 else 0 end as mtime_ns from t0 where k <> 0
  union all select 'web/p' || lpad(page_id::varchar, 8, '0'), hex(encode(html)), {EPOCH * 10**9} + page_id from pages where html is not null))"""
SQL_FILES = f"""files as (select path, hash as content_hash, size, mtime_ns, case k when 10 then 'corrupt' when 11 then 'unrecoverable' when 12 then 'missing' when 13 then 'modified' else 'ok' end as state,
  {EPOCH} + doc_id as added_at, {EPOCH} + doc_id as updated_at, case when doc_id % 7 <> 0 then {EPOCH} + doc_id * 7919 % 5000000 end as last_verified_at from t0)"""
SQL_MARKS = "marks as (select * from (values " + ", ".join(f"('{p}', '{m}')" for p, m in MARKS) + ") m(path, mode))"
SQL_EVENTS = "log as (select event_id as seq, floor(epoch(ts))::bigint as ts, 'u' || (user_id % 50) || '/' || user_id as path, event_type as kind from events)"
#: Groups of distinct contents in order of path parts, closed at 32 KiB; members with their blocks; sets with their geometry.
SQL_SETS = f"""entry as (select hash, size, row_number() over (order by string_split(path, '/')) as i from (select hash, size, path from t0 where size > 0 qualify row_number() over (partition by hash order by string_split(path, '/')) = 1)),
fold as (select i, hash, size, 0::bigint as g, size as held, size >= {CONFIG.stripe_size} as alone from entry where i = 1
  union all select e.i, e.hash, e.size,
    f.g + case when f.held >= {CONFIG.stripe_size} or e.size >= {CONFIG.stripe_size} then 1 else 0 end,
    case when f.held >= {CONFIG.stripe_size} or e.size >= {CONFIG.stripe_size} then e.size else f.held + e.size end, e.size >= {CONFIG.stripe_size}
  from fold f join entry e on e.i = f.i + 1),
packed as (select g, hash, size, row_number() over (partition by g order by i) - 1 as ord from fold),
shape1 as (select g, count(*) as n_members, sum(size)::bigint as data_bytes from packed group by g),
shape2 as (select *, least(greatest(((least((data_bytes + 511) // 512, greatest(1, data_bytes // n_members)) + 63) // 64) * 64, 64), 64)::bigint as block_size from shape1),
shape3 as (select *, least(greatest(greatest({CONFIG.stripe_size}, block_size) // block_size, 1), 32768) as blocks_per_stripe from shape2),
shape4 as (select s.*, (select sum((size + s.block_size - 1) // s.block_size) from packed p where p.g = s.g)::bigint as n_blocks from shape3 s),
shape5 as (select *, greatest(1, (n_blocks + blocks_per_stripe - 1) // blocks_per_stripe) as n_stripes, {CONFIG.parity_ppm} as parity_ppm from shape4),
sets as (select *, least(greatest(0, (({CONFIG.stripe_size * CONFIG.parity_ppm // 1_000_000} + block_size - 1) // block_size + n_stripes - 1) // n_stripes), 32768) as min_parity_blocks from shape5),
members as (select p.g, ord, hash as content_hash, size, (size + block_size - 1) // block_size as n_blocks,
  (sum((size + block_size - 1) // block_size) over (partition by p.g order by ord) - (size + block_size - 1) // block_size)::bigint as first_block from packed p join sets using (g)),
stripe as (select g, stripe, least(n_blocks - stripe * blocks_per_stripe, blocks_per_stripe) as data_blocks, case when n_blocks > stripe * blocks_per_stripe then least(greatest((least(n_blocks - stripe * blocks_per_stripe, blocks_per_stripe) * parity_ppm + 999999) // 1000000, min_parity_blocks, 1), least(n_blocks - stripe * blocks_per_stripe, blocks_per_stripe)) else 0 end as parity_blocks
  from (select *, unnest(range(n_stripes)) as stripe from sets))"""


def sql(body: str, *parts: str) -> str:
    """A query over the named parts, in order: t0, t1, files, marks, events, sets."""
    known = {"t0": SQL_T0, "t1": SQL_T1, "files": SQL_FILES, "marks": SQL_MARKS, "events": SQL_EVENTS, "sets": SQL_SETS}
    return "with recursive " + ",\n".join(known.get(p, p) for p in parts) + "\n" + body
