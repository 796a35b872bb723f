"""Registered queries of the commands' steps: formats, lists, state changes, summaries, digests over sets, damaged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, geometry, paths
from ..operators import catalog, classify, coverage, manifest, report, sets
from . import fixtures
from .catalogue import NOW, SQL_BLOCKS, SQL_DEAD, SQL_SPREAD, Query, _checked_blocks, _sets, _worn
from .fixtures import CONFIG, sql

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


def _documents(s: SparkSession, sf: str) -> DataFrame:
    return s.read.parquet(f"{sf}/documents.parquet")


def _dealt(values: list[str]):
    """One of the values a document, by its id."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.col("doc_id"), F.lit(len(values))) + 1).cast("int"))


def _dealt_sql(values: list) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][doc_id % {len(values)} + 1]"


# ---------------------------------------------------------------- formats

_SIZES = {"": 1, "b": 1, " KiB": 1024, "kB": 1000, "MiB": 1 << 20, " GB": 10**9, "g": 10**9, "Ti": 1 << 40, "parsecs": None}


@query(f"select doc_id, doc_id || {_dealt_sql(list(_SIZES))} as said, doc_id * {_dealt_sql(list(_SIZES.values()))} as bytes from documents")
def parsed_sizes(s: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.col("doc_id").cast("string"), _dealt(list(_SIZES)))
    return _documents(s, sf).select("doc_id", said.alias("said"), formats.sizes(said).alias("bytes"))


@query("""select doc_id, said, case k when 0 then v * 10000 when 1 then case when v < 1 then 0 else v * 10000 end when 2 then v * 1000 when 3 then null else null end::bigint as ppm from (select doc_id, doc_id % 5 as k, doc_id % 100 as v,
  case doc_id % 5 when 0 then (doc_id % 100) || '%' when 1 then (doc_id % 100)::varchar when 2 then case when doc_id % 100 = 0 then '0.0' else '0.' || lpad((doc_id % 100)::varchar, 3, '0') end when 3 then '-' || (doc_id % 100) || '%' else (101 + doc_id % 100) || ' %' end as said from documents)""")
def parsed_parities(s: SparkSession, sf: str) -> DataFrame:
    """A percentage, a bare number, a fraction, and two that are no ratio."""
    v = (F.col("doc_id") % 100).cast("string")
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(v, F.lit("%"))).when(F.col("doc_id") % 5 == 1, v)
    said = said.when(F.col("doc_id") % 5 == 2, F.when(F.col("doc_id") % 100 == 0, "0.0").otherwise(F.concat(F.lit("0."), F.lpad(v, 3, "0"))))
    said = said.when(F.col("doc_id") % 5 == 3, F.concat(F.lit("-"), v, F.lit("%"))).otherwise(F.concat((F.col("doc_id") % 100 + 101).cast("string"), F.lit(" %")))
    return _documents(s, sf).select("doc_id", said.alias("said"), formats.parities(said).alias("ppm"))


_SPANS = {"s": 1, " min": 60, "h": 3600, "d": 86400, " weeks": 604800, "M": 2630016, "y": 31557600, "x": None}


@query(f"select doc_id, doc_id || {_dealt_sql(list(_SPANS))} || ' 30m' as said, doc_id * {_dealt_sql(list(_SPANS.values()))} + 1800 as seconds from documents")
def parsed_durations(s: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.col("doc_id").cast("string"), _dealt(list(_SPANS)), F.lit(" 30m"))
    return _documents(s, sf).select("doc_id", said.alias("said"), formats.durations(said).alias("seconds"))


@query("select doc_id, source || '/' || lang || '/d' || doc_id as path from documents")
def normalized_paths(s: SparkSession, sf: str) -> DataFrame:
    """Doubled slashes, dots and steps up go."""
    odd = F.concat(F.lit("./x/../"), "source", F.lit("//"), "lang", F.lit("/./y/.././d"), F.col("doc_id").cast("string"), F.lit("/"))
    return _documents(s, sf).select("doc_id", paths.normalized(odd).alias("path"))


@query(f"select doc_id, case when doc_id % 6 = 5 then 'ok' else {_dealt_sql([*formats.STATES, 'x'])} end as state from documents")
def stored_states(s: SparkSession, sf: str) -> DataFrame:
    """An unknown state counts as ok."""
    return _documents(s, sf).select("doc_id", formats.state_of(_dealt([*formats.STATES, "x"])).alias("state"))


@query(sql("select g, parity_ppm / 10000 as percent from sets", "t0", "sets"))
def parity_percent(s: SparkSession, sf: str) -> DataFrame:
    return _sets(s, sf)[0].select("g", formats.percent_of(F.col("parity_ppm")).alias("percent"))


# ---------------------------------------------------------------- lists


@query(sql("select path, mode from marks", "marks"))
def marks_parsed(s: SparkSession, sf: str) -> DataFrame:
    return manifest.parsed_marks(manifest.mark_lines(fixtures.marks(s)))


@query(sql("select n_digits, count(*) as lines from (select case when doc_id % 3 = 0 then 128 when doc_id % 3 = 1 then 32 else 64 end::bigint as n_digits from t0) group by 1", "t0"))
def digest_lengths(s: SparkSession, sf: str) -> DataFrame:
    """Lists of three algorithms in one: sha512, md5 and sha256."""
    third = F.col("doc_id") % 3
    digest = F.when(third == 0, F.sha2("content", 512)).when(third == 1, F.md5("content")).otherwise(F.sha2("content", 256))
    return manifest.lengths(manifest.parsed_sums(fixtures.t0(s, sf).select(F.concat(digest, F.lit(" *"), "path").alias("line"))))


SQL_TRUSTED = """said as (select path, case when doc_id % 5 = 0 then repeat('0', 64) else hash end as digest from t0 union all select path, repeat('0', 64) from t1 where path like 'web/%' union all select 'nowhere/x', repeat('0', 64)),
trusted as (select s.path, case when f.content_hash is not null then case when f.content_hash = s.digest then 'verified' else 'mismatch' end when t1.path is null then 'not found' else 'trusted' end as outcome, s.digest from said s left join files f using (path) left join t1 on t1.path = s.path)"""


def _trusted(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    zeros = F.lit("0" * 64)
    known = fixtures.t0(s, sf).select("path", F.when(F.col("doc_id") % 5 == 0, zeros).otherwise(F.col("hash")).alias("digest"))
    pages = fixtures.t1(s, sf).where("path like 'web/%'").select("path", zeros)
    said = known.union(pages).union(s.createDataFrame([("nowhere/x", "0" * 64)], "path string, digest string"))
    disk = fixtures.t1(s, sf).withColumn("foreign", F.lit(None).cast("string"))
    return said, classify.imported(said, disk, fixtures.files(s, sf), "sha256", "sha256", trust=True)


@query(sql("select path, outcome from trusted", "t0", "t1", "files", SQL_TRUSTED))
def import_trusted(s: SparkSession, sf: str) -> DataFrame:
    """Listed files that the index doesn't know are taken on trust; those it knows are held against it."""
    return _trusted(s, sf)[1]


@query(sql("select path, digest as content_hash from trusted where outcome = 'trusted'", "t0", "t1", "files", SQL_TRUSTED))
def import_trusted_digests(s: SparkSession, sf: str) -> DataFrame:
    """What is recorded on trust is the list's digest."""
    said, rows = _trusted(s, sf)
    return rows.where("outcome = 'trusted'").join(said, "path").select("path", F.col("digest").alias("content_hash"))


@query(sql("select outcome, count(*) as files, coalesce(sum(size), 0)::bigint as bytes from trusted left join files using (path) group by 1", "t0", "t1", "files", SQL_TRUSTED))
def import_summary(s: SparkSession, sf: str) -> DataFrame:
    return report.summary(_trusted(s, sf)[1].join(fixtures.files(s, sf).select("path", "size"), "path", "left"), "outcome")


# ---------------------------------------------------------------- state


@query(sql("""select hash, algo, size, case when src = 0 then created_at else (select min(mtime_ns) from t1 where t1.hash = x.hash) end as created_at from (
  select hash, 'sha256' as algo, max(size) as size, min(added_at) as created_at, 0 as src from (select content_hash as hash, size, added_at from files) group by 1
  union all select hash, 'sha256', max(size), null, 1 from t1 where hash not in (select content_hash from files) group by 1) x""", "t0", "t1", "files"))  # fmt: skip
def insert_contents(s: SparkSession, sf: str) -> DataFrame:
    """Contents found on disk are added where they aren't known; known ones keep their time."""
    new = catalog.contents(fixtures.t1(s, sf).select(F.col("hash").alias("content_hash"), "size", F.col("mtime_ns").alias("added_at")), CONFIG.algo)
    return catalog.inserted(catalog.contents(fixtures.files(s, sf), CONFIG.algo), new, "hash")


@query(sql("select f.path, 'sha256' as algo, min(g.added_at) as known_since from files f left join files g using (content_hash) group by f.path", "t0", "files"))
def content_lookup(s: SparkSession, sf: str) -> DataFrame:
    files = fixtures.files(s, sf)
    return catalog.looked_up(files, catalog.contents(files, CONFIG.algo)).select("path", "algo", "known_since")


@query(sql(f"select path, case when starts_with(path, 'src2/') then 'missing' else state end as state, case when starts_with(path, 'src2/') then {NOW} else updated_at end as updated_at, last_verified_at from files", "t0", "files"))
def set_state(s: SparkSession, sf: str) -> DataFrame:
    files = fixtures.files(s, sf)
    new = report.listed(files, ["src2"]).select("path", F.lit("missing").alias("new_state"))
    return catalog.with_state(files, new, NOW).select("path", "state", "updated_at", "last_verified_at")


@query(sql(f"select path, case when starts_with(path, 'src2/') then 'ok' else state end as state, updated_at, case when starts_with(path, 'src2/') then {NOW} else last_verified_at end as last_verified_at from files", "t0", "files"))
def set_verified(s: SparkSession, sf: str) -> DataFrame:
    files = fixtures.files(s, sf)
    new = report.listed(files, ["src2"]).select("path", F.lit("ok").alias("new_state"))
    return catalog.with_state(files, new, NOW, verified=True).select("path", "state", "updated_at", "last_verified_at")


@query(sql("select g as set_id, ord, content_hash, dead or ord % 4 = 1 as dead from worn", "t0", "t1", "sets", SQL_DEAD))
def merge_sets(s: SparkSession, sf: str) -> DataFrame:
    """A set inserted again: a member is dead if either copy says so."""
    rows = _worn(s, sf)[1].select(F.col("g").alias("set_id"), "ord", "content_hash", "dead")
    return catalog.merged_members(rows, rows.withColumn("dead", F.col("ord") % 4 == 1))


@query(sql("select g, ord, content_hash from worn where g not in (select g from worn where dead)", "t0", "t1", "sets", SQL_DEAD))
def delete_sets(s: SparkSession, sf: str) -> DataFrame:
    shape, rows = _worn(s, sf)
    return catalog.without_sets(rows, sets.degraded(shape, rows), "g").select("g", "ord", "content_hash")


@query(sql("select path, case when path in ('src1', 'src4') then 'exclude' else mode end as mode from (select * from marks union all select 'src4', 'exclude') where path <> 'src2'", "marks"))
def set_marks(s: SparkSession, sf: str) -> DataFrame:
    """One mark is turned, one is new, one is taken away."""
    new = s.createDataFrame([("src1", "exclude"), ("src4", "exclude"), ("src2", None)], "path string, mode string")
    return catalog.with_marks(fixtures.marks(s), new)


@query("select key, case when key in ('lang-en', 'lang-xx') then 'new' else value end as value from (select 'lang-' || lang as key, count(*)::varchar as value from documents group by 1 union all select 'lang-xx', 'new')")
def meta_upsert(s: SparkSession, sf: str) -> DataFrame:
    meta = _documents(s, sf).groupBy("lang").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("lang-"), "lang").alias("key"), "value").where("key is not null")
    return catalog.meta_set(meta, {"lang-en": "new", "lang-xx": "new"})


# ---------------------------------------------------------------- selections and summaries


@query(sql("select path, state from files where state in ('corrupt', 'unrecoverable', 'missing') and (starts_with(path, 'src1/') or starts_with(path, 'src2/'))", "t0", "files"))
def repair_candidates(s: SparkSession, sf: str) -> DataFrame:
    return report.flagged(fixtures.files(s, sf), ["src1", "src2"]).select("path", "state")


@query(sql("select path, state from files where state <> 'ok' and starts_with(path, 'src3/')", "t0", "files"))
def accept_candidates(s: SparkSession, sf: str) -> DataFrame:
    return report.acceptable(fixtures.files(s, sf), ["src3"]).select("path", "state")


@query(sql("select path, size from files where starts_with(path, 'src1/') order by encode(path) limit 20", "t0", "files"))
def rm_preview(s: SparkSession, sf: str) -> DataFrame:
    """A refusal shows the first 20; the limit is the feature."""
    return report.preview(report.listed(fixtures.files(s, sf), ["src1"]).select("path", "size"))


@query(sql("""select case when t1.path is null then 'missing' when t1.mtime_ns <> f.mtime_ns then 'modified' when t1.hash = f.content_hash then 'ok' else 'unrecoverable' end as outcome, count(*) as files, coalesce(sum(f.size), 0)::bigint as bytes
  from files f left join t1 using (path) group by 1""", "t0", "t1", "files"))  # fmt: skip
def check_summary(s: SparkSession, sf: str) -> DataFrame:
    """Without parity: the whole file's digest decides."""
    pairs = classify.matched(fixtures.t1(s, sf), fixtures.files(s, sf))
    plain = pairs.withColumn("has_parity", F.lit(False)).withColumn("table_ok", F.lit(True)).withColumn("margin_ok", F.lit(True))
    for c in ("bad", "extra_bytes", "unreadable", "n_blocks"):
        plain = plain.withColumn(c, F.lit(None).cast("long"))
    return report.summary(classify.checked(plain), "new_state")


@query(sql("select count(*) filter (not b) as made, count(*) filter (a and b) as kept, count(*) filter (not a) as dropped, coalesce(sum(data_bytes) filter (not b), 0)::bigint as made_bytes from (select g, g % 3 <> 0 as a, g % 4 <> 1 as b, data_bytes from sets) where a or b", "t0", "sets"))
def phase_summary(s: SparkSession, sf: str) -> DataFrame:
    rows = _sets(s, sf)[0].select(F.col("g").alias("set_id"), "data_bytes")
    return report.phase(rows.where("set_id % 4 <> 1"), rows.where("set_id % 3 <> 0"))


@query(sql("select count(*) as sets, count(*) filter (g in (select g from worn where dead)) as degraded, count(*) filter (data_bytes * 2 < 32768) as underfull, (select count(*) from worn) as members, (select count(*) from worn where dead) as dead from sets", "t0", "t1", "sets", SQL_DEAD))
def set_counts(s: SparkSession, sf: str) -> DataFrame:
    shape, rows = _worn(s, sf)
    return report.set_counts(shape, rows, sets.underfull(shape, CONFIG))


@query(sql("select path, case when starts_with(path, 'src1/de/') then 'tank/de' when starts_with(path, 'src1/') then 'tank' when starts_with(path, 'src2/') then 'pool' end as dataset from files", "t0", "files"))
def longest_mountpoint(s: SparkSession, sf: str) -> DataFrame:
    mounts = s.createDataFrame([("tank", "src1"), ("tank/de", "src1/de"), ("pool", "src2")], "name string, mountpoint string")
    return coverage.mounted(fixtures.files(s, sf), mounts)


# ---------------------------------------------------------------- digests over sets, damaged tables

SQL_CHUNKS = """chunk as (select g, first_block + b as b, (first_block + b) // blocks_per_stripe as stripe, sha256(unhex(rpad(hx[2 * bs * b + 1:2 * bs * (b + 1)], (2 * bs)::int, '0'))) as hash from (
  select m.g, first_block, block_size as bs, blocks_per_stripe, (select any_value(hx) from t0 where t0.hash = m.content_hash) as hx, unnest(range(m.n_blocks)) as b from members m join sets using (g)))"""


def _block_table(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sets, and the recorded digest of each of their blocks: g, b, stripe, hash."""
    shape, rows = _sets(s, sf)
    content = fixtures.t0(s, sf).groupBy(F.col("hash").alias("content_hash")).agg(F.first("content").alias("content"))
    where = rows.join(content, "content_hash").join(shape.select("g", "block_size", "blocks_per_stripe"), "g")
    each = sets.blocks(where.select("g", "first_block", "block_size", "blocks_per_stripe", "content"), F.col("block_size"))
    at = F.col("first_block") + F.col("b")
    return shape, each.select("g", at.alias("b"), geometry.floor_div(at, F.col("blocks_per_stripe")).alias("stripe"), sets.block_digest(F.col("bytes"), F.col("block_size")).alias("hash"))


@query(sql(", ".join(["", SQL_CHUNKS]) + " select g::varchar as set_id, stripe, sha256(unhex(string_agg(hash, '' order by b))) as blocks from chunk group by g, stripe", "t0", "sets"))
def stripe_digests(s: SparkSession, sf: str) -> DataFrame:
    _, table = _block_table(s, sf)
    hashes = table.select(F.col("g").cast("string").alias("set_id"), "stripe", F.col("b").alias("g"), "hash")
    none = s.createDataFrame([], "set_id string, stripe long, idx long, bytes binary")
    return sets.stripe_digests(hashes, none).select("set_id", "stripe", "blocks")


@query(sql("select distinct g, (b // blocks_per_stripe)::bigint as stripe from (select g, blocks_per_stripe, unnest(range(n_blocks)) as b from sets) where (g * 31 + b) % 1000 = 7", "t0", "sets"))
def damaged_stripes(s: SparkSession, sf: str) -> DataFrame:
    """One digest in a thousand is another than was written."""
    shape, table = _block_table(s, sf)
    written = sets.table_digest(table, ["g", "stripe"], "b").select("g", "stripe", F.col("table_digest").alias("blocks"))
    spoiled = table.withColumn("hash", F.when((F.col("g") * 31 + F.col("b")) % 1000 == 7, "00").otherwise(F.col("hash")))
    return sets.damaged_stripes(shape, spoiled.drop("stripe"), written)


@query(sql("select g, hash, size, row_number() over (partition by g order by ord) - 1 as ord from packed where (g + ord) % 11 <> 3 and g in (select g from packed where (g + ord) % 11 = 3)", "t0", "sets"))
def ejected_members(s: SparkSession, sf: str) -> DataFrame:
    """Members that changed while a set was read go; the others are laid out again."""
    groups = sets.packed(sets.distinct_contents(fixtures.files(s, sf)), CONFIG.stripe_size)
    return sets.ejected(groups, groups.where((F.col("g") + F.col("ord")) % 11 == 3).select("g", "ord"))


SQL_WORN_MARGIN = SQL_BLOCKS.replace("marg as (select path, bool_and(n <= parity_blocks) as margin_ok from (select path, g, stripe, count(*) as n from cmp where bad group by all) join stripe using (g, stripe) group by 1)", "marg as (select path, bool_and(n + coalesce(gone.dead, 0) <= parity_blocks) as margin_ok from (select path, g, stripe, count(*) as n from cmp where bad group by all) join stripe using (g, stripe) left join gone using (g, stripe) group by 1)")


@query(sql("select path, n_blocks, bad, margin_ok from chk where bad > 0", "t0", "t1", "files", "sets", SQL_DEAD, SQL_SPREAD, SQL_WORN_MARGIN))
def margin_with_dead(s: SparkSession, sf: str) -> DataFrame:
    """Bad blocks and the blocks of dead members share a stripe's parity."""
    return _checked_blocks(s, sf, worn=True).where("bad > 0").select("path", "n_blocks", "bad", "margin_ok")


@query(sql(f"""select f.path, case when t1.path is null then 'missing' when f.mtime_ns <> t1.mtime_ns then 'modified' when c.path is null or ascii(f.path[-1:]) % 3 = 1 then case when t1.hash = f.content_hash then 'ok' else 'unrecoverable' end
  when bad = 0 and c.hash1 = c.content_hash then 'ok' when margin_ok then 'corrupt' else 'unrecoverable' end as new_state,
  case when t1.path is not null and f.mtime_ns = t1.mtime_ns and c.path is not null and not (case when ascii(f.path[-1:]) % 3 = 1 then c.hash1 = c.content_hash else bad = 0 and c.hash1 = c.content_hash end) then
    case when extra_bytes > 0 and bad <= 1 then extra_bytes || ' extra bytes appended' when bad > 0 and ascii(f.path[-1:]) % 2 = 1 then bad || ' unreadable block(s)' else bad || ' bad block(s) of ' || n_blocks end end as message
  from files f left join t1 using (path) left join chk c using (path)""", "t0", "t1", "files", "sets", SQL_DEAD, SQL_SPREAD, SQL_WORN_MARGIN))  # fmt: skip
def check_classify_damaged(s: SparkSession, sf: str) -> DataFrame:
    """Damaged block tables (by the path's last letter), unreadable blocks and dead members in one check."""
    last = F.ascii(F.substring("path", -1, 1))
    pairs = classify.matched(fixtures.t1(s, sf), fixtures.files(s, sf)).join(_checked_blocks(s, sf, worn=True), "path", "left")
    pairs = pairs.withColumn("has_parity", F.col("n_blocks").isNotNull()).withColumn("table_ok", last % 3 != 1)
    return classify.checked(pairs.withColumn("unreadable", F.when(last % 2 == 1, F.col("bad")).otherwise(0))).select("path", "new_state", "message")


@query(sql("""select path, case when bad = 0 and hash1 = content_hash then 'touched' when bad > 0 and (margin_ok or lost > 0) and 2 * bad <= greatest(n_blocks, 1) then case when margin_ok then 'corrupt' else 'unrecoverable' end
  when lost > 0 then 'unrecoverable' else 'modified' end as new_state from (select *, case when ascii(path[-1:]) % 2 = 1 then bad else 0 end as lost from chk where mtime_ns <> mtime1 and size = size1)""", "t0", "t1", "files", "sets", SQL_DEAD, SQL_SPREAD, SQL_WORN_MARGIN))  # fmt: skip
def scan_postread_unreadable(s: SparkSession, sf: str) -> DataFrame:
    pairs = classify.matched(fixtures.t1(s, sf), fixtures.files(s, sf)).where("on_disk and indexed and mtime_ns <> d_mtime_ns and size = d_size")
    rows = pairs.join(_checked_blocks(s, sf, worn=True), "path").withColumn("lost", F.when(F.ascii(F.substring("path", -1, 1)) % 2 == 1, F.col("bad")).otherwise(0))
    state = classify.suspected(F.col("bad"), F.col("lost"), F.col("n_blocks"), F.col("margin_ok"), F.col("d_hash") == F.col("content_hash"))
    return rows.select("path", state.alias("new_state"))
