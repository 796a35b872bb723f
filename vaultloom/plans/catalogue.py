"""Registered queries of the archive engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, geometry, paths
from ..operators import catalog, classify, coverage, manifest, repair, report, sets
from . import fixtures
from .fixtures import CONFIG, EPOCH, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = EPOCH + 10_000_000
CUTOFF = EPOCH + 2_000_000
BUDGET = 200_000


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- catalogue


@query(sql("select * from files", "t0", "files"))
def file_index(s: SparkSession, sf: str) -> DataFrame:
    return fixtures.files(s, sf)


@query(sql("select content_hash as hash, 'sha256' as algo, max(size) as size, min(added_at) as created_at from files group by 1", "t0", "files"))
def content_table(s: SparkSession, sf: str) -> DataFrame:
    return catalog.contents(fixtures.files(s, sf), CONFIG.algo)


@query(sql("select state, count(*) as files from files group by 1", "t0", "files"))
def count_by_state(s: SparkSession, sf: str) -> DataFrame:
    return report.by_state(fixtures.files(s, sf))


@query(sql("select * from files where path >= 'src1/' and path < 'src10'", "t0", "files"))
def ls_under_prefix(s: SparkSession, sf: str) -> DataFrame:
    return report.listed(fixtures.files(s, sf), ["src1"])


@query(sql("select path, size, state from files where starts_with(path, 'src1/de/') or starts_with(path, 'src2/') or starts_with(path, 'src1/')", "t0", "files"))
def ls_multi_root(s: SparkSession, sf: str) -> DataFrame:
    return report.listed(fixtures.files(s, sf), ["src1/de", "src2", "src1"]).select("path", "size", "state")


@query(sql("select path, size from files where state = 'corrupt'", "t0", "files"))
def ls_state(s: SparkSession, sf: str) -> DataFrame:
    return report.listed(fixtures.files(s, sf), state="corrupt").select("path", "size")


@query(sql("select path, row_number() over (order by encode(path)) as place from files", "t0", "files"))
def order_bytes(s: SparkSession, sf: str) -> DataFrame:
    """The place is what the check compares; a listing itself needs only the sort."""
    return fixtures.files(s, sf).selectExpr("path", "cast(row_number() over (order by encode(path, 'UTF-8')) as long) as place")


@query(sql("select path, row_number() over (order by string_split(path, '/')) as place from files", "t0", "files"))
def order_components(s: SparkSession, sf: str) -> DataFrame:
    return fixtures.files(s, sf).selectExpr("path", "cast(row_number() over (order by split(path, '/')) as long) as place")


GLOBS = ["d0000001*", "src1/en", "**/es/d*5", "moved"]


@query(sql(r"select path from t1 where not regexp_matches(path, '^((.*/)?d0000001[^/]*|src1/en|(.*/)?es/d[^/]*5|(.*/)?moved)(/|$)')", "t0", "t1"))
def exclude_globs(s: SparkSession, sf: str) -> DataFrame:
    return fixtures.t1(s, sf).where(~paths.excluded(F.col("path"), GLOBS)).select("path")


@query(sql("select content_hash, count(*) as files, min(path) as first_path, max(path) as last_path from files group by 1 having count(*) > 1", "t0", "files"))
def duplicate_contents(s: SparkSession, sf: str) -> DataFrame:
    return report.copies(fixtures.files(s, sf))


@query(sql(f"""select path, size, last_verified_at, coalesce(sum(size) over (order by last_verified_at nulls first, string_split(path, '/') rows between unbounded preceding and 1 preceding), 0)::bigint as bytes_before
from files qualify coalesce(sum(size) over (order by last_verified_at nulls first, string_split(path, '/') rows between unbounded preceding and 1 preceding), 0) < {BUDGET}""", "t0", "files"))  # fmt: skip
def check_budget(s: SparkSession, sf: str) -> DataFrame:
    return report.within_budget(fixtures.files(s, sf), BUDGET)


@query(sql(f"select path, last_verified_at from files where last_verified_at is null or last_verified_at < {CUTOFF}", "t0", "files"))
def check_older_than(s: SparkSession, sf: str) -> DataFrame:
    return report.due(fixtures.files(s, sf), CUTOFF).select("path", "last_verified_at")


@query(sql("select seq, ts, path, kind from log order by seq desc limit 20", "events"))
def history_last_n(s: SparkSession, sf: str) -> DataFrame:
    return report.history(fixtures.events(s, sf), limit=20).select("seq", "ts", "path", "kind")


@query(sql("select seq, ts, path, kind from log where ts >= (select max(ts) - 86400 from log) and (path = 'u7' or starts_with(path, 'u7/')) order by seq desc limit 200", "events"))
def history_since(s: SparkSession, sf: str) -> DataFrame:
    log = fixtures.events(s, sf)
    newest = log.agg(F.max("ts")).first()[0] or 0
    return report.history(log, "u7", newest - 86400).select("seq", "ts", "path", "kind")


# ---------------------------------------------------------------- manifests


@query(sql("select path, content_hash || '  ' || path as line from files where state <> 'missing'", "t0", "files"))
def manifest_lines(s: SparkSession, sf: str) -> DataFrame:
    return manifest.sum_lines(fixtures.files(s, sf))


@query(sql("select path, concat_ws(chr(9), content_hash, size, mtime_ns, state, path) as line from files", "t0", "files"))
def manifest_tsv(s: SparkSession, sf: str) -> DataFrame:
    return manifest.tsv_lines(fixtures.files(s, sf))


@query("select doc_id, replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r') as escaped, true as same from documents where text is not null")
def manifest_escape_roundtrip(s: SparkSession, sf: str) -> DataFrame:
    text = s.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    rows = text.select("doc_id", "text", paths.escaped(F.col("text")).alias("escaped"))
    return rows.select("doc_id", "escaped", (paths.unescaped(F.col("escaped")) == F.col("text")).alias("same"))


@query(sql("select path, content_hash, size, mtime_ns, state from files", "t0", "files"))
def manifest_tsv_parsed(s: SparkSession, sf: str) -> DataFrame:
    return manifest.parsed_tsv(manifest.tsv_lines(fixtures.files(s, sf)))


@query(sql("""select d.path, case when f.content_hash is not null then case when f.content_hash = d.hash then 'verified' else 'mismatch' end else 'indexed' end as outcome from t1 d left join files f using (path)""", "t0", "t1", "files"))
def import_verify(s: SparkSession, sf: str) -> DataFrame:
    """A checksum list made from the disk is read back and held against the index."""
    disk = fixtures.t1(s, sf).withColumn("foreign", F.lit(None).cast("string"))
    listed = manifest.parsed_sums(disk.select(F.concat("hash", F.lit("  "), "path").alias("line")))
    return classify.imported(listed, disk, fixtures.files(s, sf), "sha256", "sha256")


@query(sql("""select d.path, case when f.content_hash is null then 'indexed' when f.content_hash = d.hash then 'verified' else 'verified, index differs' end as outcome from t1 d left join files f using (path)""", "t0", "t1", "files"))
def import_foreign(s: SparkSession, sf: str) -> DataFrame:
    """A list of another algorithm: both digests in one pass over the contents."""
    disk = fixtures.t1(s, sf).withColumn("foreign", F.sha2("content", 512))
    return classify.imported(disk.select("path", F.col("foreign").alias("digest")), disk, fixtures.files(s, sf), "sha512", "sha256")


# ---------------------------------------------------------------- scan

SQL_PAIRS = """pairs as (select coalesce(t1.path, files.path) as path, t1.path is not null as on_disk, files.path is not null as indexed, t1.size as d_size, t1.mtime_ns as d_mtime, t1.hash as d_hash, content_hash, files.size as size, files.mtime_ns as mtime, state
  from t1 full join files on t1.path = files.path),
act as (select *, case when not on_disk then 'gone' when not indexed and covered and d_size > 0 then 'encode' when not indexed then 'new' when mtime = d_mtime and size <> d_size then 'recheck-size'
  when mtime = d_mtime and state = 'missing' then 'recheck-reappeared' when mtime = d_mtime then 'unchanged' when has_parity and size = d_size then 'check-blocks' else 'hash' end as action
  from (select *, path like 'src2/%' or path like 'src3/%' and path not like 'src3/en/%' or path like 'src1/%' and path not like 'src1/de/%' or path like 'moved/%' or path like 'web/%' as covered from pairs)
  cross join lateral (select coalesce(covered and indexed, false) as has_parity))"""


def _actions(s: SparkSession, sf: str) -> DataFrame:
    """Files that marks cover have live parity, as after a first scan."""
    pairs = coverage.covered(classify.matched(fixtures.t1(s, sf), fixtures.files(s, sf)), fixtures.marks(s))
    pairs = pairs.withColumn("covered", F.col("mode") == "include").withColumn("has_parity", F.col("covered") & F.col("indexed"))
    return classify.scan_actions(pairs)


@query(sql("select path, action from act", "t0", "t1", "files", SQL_PAIRS))
def scan_classify(s: SparkSession, sf: str) -> DataFrame:
    return _actions(s, sf).select("path", "action")


SQL_OUTCOME = """case when action in ('new', 'encode') then 'added' when action in ('gone', 'unchanged') then action
  when action in ('recheck-size', 'recheck-reappeared') then case when d_hash <> content_hash then case when has_parity then 'corrupt' else 'unrecoverable' end when action = 'recheck-size' then 'verified' else 'reappeared' end
  when d_hash = content_hash then 'touched' else 'modified' end"""


@query(sql(f"select {SQL_OUTCOME} as outcome, count(*) as files, coalesce(sum(coalesce(d_size, size)), 0)::bigint as bytes from act group by 1", "t0", "t1", "files", SQL_PAIRS))
def scan_summary(s: SparkSession, sf: str) -> DataFrame:
    rows = classify.outcomes(_actions(s, sf))
    return rows.groupBy("outcome").agg(F.count("*").alias("files"), F.sum(F.coalesce("d_size", "size")).alias("bytes"))


@query(sql("select g.path, g.content_hash, n.moved_to from act g join (select d_hash, max(path) as moved_to from act where action in ('new', 'encode') group by 1) n on n.d_hash = g.content_hash where g.action = 'gone'", "t0", "t1", "files", SQL_PAIRS))
def scan_moved(s: SparkSession, sf: str) -> DataFrame:
    rows = _actions(s, sf)
    return classify.moved(rows.where("action = 'gone'"), rows.where("action in ('new', 'encode')"))


@query(sql("select path from act where action = 'gone' and not starts_with(path, 'src1/') and not starts_with(path, 'src4/en/')", "t0", "t1", "files", SQL_PAIRS))
def scan_removed_guarded(s: SparkSession, sf: str) -> DataFrame:
    return classify.removed(_actions(s, sf), ["src1", "src4/en"]).select("path")


# ---------------------------------------------------------------- coverage


@query(sql("""select path, coalesce(mode, 'exclude') as mode, mark from (select f.path, m.mode, m.path as mark, row_number() over (partition by f.path order by length(m.path) desc) as k
  from files f left join marks m on starts_with(f.path, m.path || '/')) where k = 1""", "t0", "files", "marks"))  # fmt: skip
def coverage_nearest_mark(s: SparkSession, sf: str) -> DataFrame:
    return coverage.covered(fixtures.files(s, sf).select("path"), fixtures.marks(s))


@query(sql("""c as (select f.*, coalesce((select m.mode from marks m where starts_with(f.path, m.path || '/') order by length(m.path) desc limit 1), 'exclude') = 'include' and size > 0 as want,
  content_hash in (select content_hash from files where path like 'src1/%' or path like 'src2/%') as has from files f where state <> 'missing')
select count(*) filter (want) as should_files, coalesce(sum(size) filter (want), 0)::bigint as should_bytes, count(*) filter (want and has) as have_files, coalesce(sum(size) filter (want and has), 0)::bigint as have_bytes,
  count(*) filter (not want and has) as stale_files, coalesce(sum(size) filter (not want and has), 0)::bigint as stale_bytes from c""".replace("c as (", ", c as (", 1), "t0", "files", "marks"))  # fmt: skip
def coverage_report(s: SparkSession, sf: str) -> DataFrame:
    files = fixtures.files(s, sf)
    return coverage.report(files, fixtures.marks(s), report.listed(files, ["src1", "src2"]).select("content_hash"))


# ---------------------------------------------------------------- blocks and sets


@query(sql("select path, b, sha256(unhex(rpad(hx[128 * b + 1:128 * b + 128], 128, '0'))) as hash from (select path, hx, unnest(range((size + 63) // 64)) as b from t0)", "t0"))
def block_hashes(s: SparkSession, sf: str) -> DataFrame:
    size = F.lit(64).cast("long")
    return sets.blocks(fixtures.t0(s, sf).select("path", "content"), size).select("path", "b", sets.block_digest(F.col("bytes"), size).alias("hash"))


@query(sql("""b as (select path, b, sha256(unhex(rpad(hx[128 * b + 1:128 * b + 128], 128, '0'))) as hash from (select path, hx, unnest(range((size + 63) // 64)) as b from t0))
select path, sha256(unhex(string_agg(hash, '' order by b))) as table_digest, count(*) as n_blocks from b group by 1""".replace("b as (", ", b as (", 1), "t0"))  # fmt: skip
def block_table_digest(s: SparkSession, sf: str) -> DataFrame:
    return sets.table_digest(block_hashes(s, sf), ["path"], "b")


def _groups(s: SparkSession, sf: str) -> DataFrame:
    return sets.packed(sets.distinct_contents(fixtures.files(s, sf)), CONFIG.stripe_size)


def _sets(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sets and their members, after a first scan of everything."""
    groups = _groups(s, sf)
    shape = geometry.set_geometry(groups, CONFIG)
    return shape, sets.members(groups, shape)


def _worn(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same once t1 is accepted: contents that no file holds any more are dead."""
    shape, rows = _sets(s, sf)
    held = fixtures.t1(s, sf).select(F.col("hash").alias("content_hash"), F.lit(True).alias("held")).distinct()
    return shape, rows.join(held, "content_hash", "left").withColumn("dead", F.col("held").isNull()).drop("held")


SQL_DEAD = "worn as (select m.*, content_hash not in (select hash from t1) as dead from members m)"
SQL_SPREAD = """spread as (select w.*, least(first_block + n_blocks, (stripe + 1) * s) - greatest(first_block, stripe * s) as overlap from
  (select w.*, blocks_per_stripe as s, unnest(range(first_block // blocks_per_stripe, (first_block + w.n_blocks - 1) // blocks_per_stripe + 1)) as stripe from worn w join sets using (g)) w),
gone as (select g, stripe, sum(overlap)::bigint as dead from spread where dead group by all)"""


@query(sql("select g, hash, size, ord from packed", "t0", "sets"))
def pack_groups(s: SparkSession, sf: str) -> DataFrame:
    return _groups(s, sf)


@query(sql("select g, n_members, data_bytes, block_size, blocks_per_stripe, n_blocks, n_stripes, parity_ppm::bigint as parity_ppm, min_parity_blocks from sets", "t0", "sets"))
def set_geometry(s: SparkSession, sf: str) -> DataFrame:
    return _sets(s, sf)[0]


@query(sql("select g, ord, content_hash, size, first_block, n_blocks from members", "t0", "sets"))
def set_members(s: SparkSession, sf: str) -> DataFrame:
    return _sets(s, sf)[1]


@query(sql("select g, stripe, data_blocks, parity_blocks from stripe", "t0", "sets"))
def stripe_geometry(s: SparkSession, sf: str) -> DataFrame:
    return geometry.stripes(_sets(s, sf)[0])


_LE = lambda x, n: " || ".join(f"substr(lpad(hex({x}::bigint), {2 * n}, '0'), {2 * k + 1}, 2)" for k in range(n - 1, -1, -1))


@query(sql(f"""select g, sha256(unhex({' || '.join(_LE(c, 4) for c in ('block_size', 'blocks_per_stripe', 'parity_ppm', 'min_parity_blocks', 'n_members'))} || '00000000'
  || (select string_agg(upper(content_hash) || {_LE('size', 8)}, '' order by ord) from members m where m.g = s.g))) as set_id from sets s""", "t0", "sets"))  # fmt: skip
def set_ids(s: SparkSession, sf: str) -> DataFrame:
    shape, rows = _sets(s, sf)
    return sets.set_ids(rows, shape)


@query(sql("select g, sum(parity_blocks)::bigint as parity_blocks, sum(parity_blocks * block_size)::bigint as parity_bytes from stripe join sets using (g) group by 1", "t0", "sets"))
def parity_totals(s: SparkSession, sf: str) -> DataFrame:
    shape = _sets(s, sf)[0]
    rows = geometry.stripes(shape).join(shape.select("g", "block_size"), "g")
    return rows.groupBy("g").agg(F.sum("parity_blocks").alias("parity_blocks"), F.sum(F.col("parity_blocks") * F.col("block_size")).alias("parity_bytes"))


@query(sql("select * from gone", "t0", "t1", "sets", SQL_DEAD, SQL_SPREAD))
def dead_blocks_per_stripe(s: SparkSession, sf: str) -> DataFrame:
    shape, rows = _worn(s, sf)
    return sets.dead_blocks(rows, shape)


@query(sql("select p.g, ord, bool_and(overlap + coalesce(gone.dead, 0) - case when p.dead then overlap else 0 end <= parity_blocks) as protected from spread p left join gone using (g, stripe) join stripe using (g, stripe) group by all", "t0", "t1", "sets", SQL_DEAD, SQL_SPREAD))
def loss_protected(s: SparkSession, sf: str) -> DataFrame:
    shape, rows = _worn(s, sf)
    return sets.loss_protected(rows, shape)


@query(sql("select g, n_members from sets where g in (select g from worn where dead)", "t0", "t1", "sets", SQL_DEAD))
def degraded_sets(s: SparkSession, sf: str) -> DataFrame:
    return sets.degraded(*_worn(s, sf)).select("g", "n_members")


@query(sql(f"select g, data_bytes from sets where data_bytes * 2 < {CONFIG.stripe_size}", "t0", "sets"))
def underfull_sets(s: SparkSession, sf: str) -> DataFrame:
    return sets.underfull(_sets(s, sf)[0], CONFIG).select("g", "data_bytes")


@query(sql("select g, ord, b, b - first_block as at from (select *, unnest(range(first_block, first_block + n_blocks)) as b from members)", "t0", "sets"))
def block_owner(s: SparkSession, sf: str) -> DataFrame:
    shape, rows = _sets(s, sf)
    wanted = shape.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"))
    return sets.block_owners(rows, wanted)


@query(sql("select g, substr(set_id, 1, 2) || '/' || substr(set_id, 3, 2) || '/' || set_id as place from (select g, sha256(g::varchar) as set_id from sets)", "t0", "sets"))
def set_places(s: SparkSession, sf: str) -> DataFrame:
    return _sets(s, sf)[0].select("g", paths.set_path(F.sha2(F.col("g").cast("string").cast("binary"), 256)).alias("place"))


@query(sql("select path, mode || chr(9) || path as line from marks", "marks"))
def mark_lines(s: SparkSession, sf: str) -> DataFrame:
    return manifest.mark_lines(fixtures.marks(s))


# ---------------------------------------------------------------- blocks on disk

SQL_BLOCKS = """rec as (select f.path, m.g, m.ord, f.size, m.first_block, m.n_blocks, f.mtime_ns, f.content_hash, block_size as bs, t0.hx as hx0, t1.hx as hx1, t1.size as size1, t1.mtime_ns as mtime1, t1.hash as hash1, blocks_per_stripe as s
  from files f join t0 using (path) join members m on m.content_hash = f.content_hash join sets using (g) join t1 on t1.path = f.path),
cmp as (select path, g, b, (first_block + b) // s as stripe, case when size1 >= least((b + 1) * bs, size) and hx0[2 * bs * b + 1:2 * least(bs * (b + 1), size)] = hx1[2 * bs * b + 1:2 * least(bs * (b + 1), size)] then false else true end as bad
  from (select *, unnest(range(n_blocks)) as b from rec)),
marg as (select path, bool_and(n <= parity_blocks) as margin_ok from (select path, g, stripe, count(*) as n from cmp where bad group by all) join stripe using (g, stripe) group by 1),
chk as (select rec.path, rec.n_blocks, bad, greatest(size1 - size, 0) as extra_bytes, coalesce(margin_ok, true) as margin_ok, mtime_ns, mtime1, content_hash, hash1, rec.size, size1 from rec join (select path, count(*) filter (bad) as bad from cmp group by 1) using (path) left join marg using (path))"""


def _checked_blocks(s: SparkSession, sf: str, worn: bool = False) -> DataFrame:
    """path, n_blocks, bad, extra_bytes, margin_ok of files on disk under their path: recorded digests against the blocks there; worn: with dead members."""
    shape, rows = _worn(s, sf) if worn else _sets(s, sf)
    size = F.col("block_size")
    recorded = fixtures.t0(s, sf).select("path", F.col("hash").alias("content_hash"), "size", "content")
    where = rows.select("content_hash", "g", "ord", "first_block", "n_blocks").join(shape.select("g", "block_size", "blocks_per_stripe"), "g")
    base = recorded.join(where, "content_hash")
    now = fixtures.t1(s, sf).select("path", F.col("content").alias("disk"), F.col("size").alias("d_size")).join(where.join(recorded.select("path", "content_hash", "size"), "content_hash"), "path")
    old = sets.blocks(base.select("path", "g", "ord", "size", "first_block", "blocks_per_stripe", "block_size", "content"), size)
    old = old.select("path", "g", "b", geometry.floor_div(F.col("first_block") + F.col("b"), F.col("blocks_per_stripe")).alias("stripe"), F.octet_length("bytes").alias("length"), sets.block_digest(F.col("bytes"), size).alias("hash"))
    # what is on disk is cut at the recorded size; bytes beyond are extra
    kept = now.withColumn("content", F.substring("disk", F.lit(1), F.col("size").cast("int")))
    new = sets.blocks(kept.select("path", "block_size", "content"), size).select("path", "b", F.octet_length("bytes").alias("d_length"), sets.block_digest(F.col("bytes"), size).alias("d_hash"))
    there = now.select("path", "n_blocks", F.greatest(F.col("d_size") - F.col("size"), F.lit(0).cast("long")).alias("extra_bytes"))
    pairs = old.join(there.select("path"), "path", "left_semi").join(new, ["path", "b"], "left")
    bad = pairs.where(~(F.coalesce(F.col("length") == F.col("d_length"), F.lit(False)) & F.coalesce(F.col("hash") == F.col("d_hash"), F.lit(False))))
    gone = sets.dead_blocks(rows, shape) if worn else s.createDataFrame([], "g long, stripe long, dead long")
    margin = sets.margins(bad, gone, shape, ["path"])
    counts = bad.groupBy("path").agg(F.count("*").alias("bad"))
    return there.join(counts, "path", "left").join(margin, "path", "left").select("path", "n_blocks", F.coalesce("bad", F.lit(0)).alias("bad"), "extra_bytes", F.coalesce("margin_ok", F.lit(True)).alias("margin_ok"))


@query(sql("select path, n_blocks, bad, extra_bytes, margin_ok from chk", "t0", "t1", "files", "sets", SQL_BLOCKS))
def check_block_report(s: SparkSession, sf: str) -> DataFrame:
    return _checked_blocks(s, sf)


@query(sql("""select f.path, case when t1.path is null then 'missing' when f.mtime_ns <> t1.mtime_ns then 'modified' when c.path is null then case when t1.hash = f.content_hash then 'ok' else 'unrecoverable' end
  when bad = 0 and c.hash1 = c.content_hash then 'ok' when margin_ok then 'corrupt' else 'unrecoverable' end as new_state,
  case when t1.path is not null and f.mtime_ns = t1.mtime_ns and c.path is not null and not (bad = 0 and c.hash1 = c.content_hash) then case when extra_bytes > 0 and bad <= 1 then extra_bytes || ' extra bytes appended' else bad || ' bad block(s) of ' || n_blocks end end as message
  from files f left join t1 using (path) left join chk c using (path)""", "t0", "t1", "files", "sets", SQL_BLOCKS))  # fmt: skip
def check_classify(s: SparkSession, sf: str) -> DataFrame:
    pairs = classify.matched(fixtures.t1(s, sf), fixtures.files(s, sf)).join(_checked_blocks(s, sf), "path", "left")
    pairs = pairs.withColumn("has_parity", F.col("n_blocks").isNotNull()).withColumn("table_ok", F.lit(True)).withColumn("unreadable", F.lit(0))
    return classify.checked(pairs).select("path", "new_state", "message")


@query(sql("""select path, case when bad = 0 and hash1 = content_hash then 'touched' when bad > 0 and margin_ok and 2 * bad <= greatest(n_blocks, 1) then 'corrupt' else 'modified' end as new_state
  from chk where mtime_ns <> mtime1 and size = size1""", "t0", "t1", "files", "sets", SQL_BLOCKS))  # fmt: skip
def scan_postread_classify(s: SparkSession, sf: str) -> DataFrame:
    pairs = classify.matched(fixtures.t1(s, sf), fixtures.files(s, sf)).where("on_disk and indexed and mtime_ns <> d_mtime_ns and size = d_size")
    rows = pairs.join(_checked_blocks(s, sf), "path")
    state = classify.suspected(F.col("bad"), F.lit(0), F.col("n_blocks"), F.col("margin_ok"), F.col("d_hash") == F.col("content_hash"))
    return rows.select("path", state.alias("new_state"))


@query(sql("select path, margin_ok from chk where bad > 0", "t0", "t1", "files", "sets", SQL_BLOCKS))
def margin_ok(s: SparkSession, sf: str) -> DataFrame:
    return _checked_blocks(s, sf).where("bad > 0").select("path", "margin_ok")


# ---------------------------------------------------------------- repair


def _stripe_blocks(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets, members with k (of the content's first file), and all blocks as they were: g, ord, b, stripe, j, bytes, parity_blocks, k."""
    shape, rows = _sets(s, sf)
    first = fixtures.t0(s, sf).groupBy(F.col("hash").alias("content_hash")).agg(F.min_by(F.struct("k", "content"), paths.components(F.col("path"))).alias("x"))
    rows = rows.join(first.select("content_hash", F.col("x.k").alias("k"), F.col("x.content").alias("content")), "content_hash").join(shape.select("g", "block_size", "blocks_per_stripe"), "g")
    size, at = F.col("block_size"), F.col("first_block") + F.col("b")
    each = sets.blocks(rows.select("g", "ord", "k", "first_block", "block_size", "blocks_per_stripe", "content"), size)
    each = each.select("g", "ord", "k", "b", geometry.floor_div(at, F.col("blocks_per_stripe")).alias("stripe"), (at % F.col("blocks_per_stripe")).alias("j"), sets.padded(F.col("bytes"), size).alias("bytes"))
    return shape, rows.drop("content"), each.join(geometry.stripes(shape).select("g", "stripe", "parity_blocks"), ["g", "stripe"])


def _repaired(s: SparkSession, sf: str, lost) -> DataFrame:
    """g, ord, content_hash, digest, failed of the members that lost blocks; lost: a condition on k and b."""
    _, rows, each = _stripe_blocks(s, sf)
    shards = repair.shards(each)
    after = each.withColumn("bytes", F.when(~lost, F.col("bytes")))
    hurt = after.where("bytes is null").select("g", "ord").distinct()
    return repair.restored(rows.join(hurt, ["g", "ord"], "left_semi"), after.join(hurt, ["g", "ord"], "left_semi"), repair.rebuilt(after, shards))


SQL_LOST = """own as (select m.*, block_size as bs, blocks_per_stripe as s, (select arg_min(k, string_split(path, '/')) from t0 where t0.hash = m.content_hash) as k from members m join sets using (g)),
blk as (select g, ord, content_hash, b, (first_block + b) // s as stripe, {lost} as lost from (select *, unnest(range(n_blocks)) as b from own)),
fit as (select g, stripe, count(*) filter (lost) <= max(parity_blocks) as ok from blk join stripe using (g, stripe) group by g, stripe)
select b.g, b.ord, content_hash, case when bool_and(ok or not lost) then content_hash end as digest, not bool_and(ok or not lost) as failed from blk b join fit using (g, stripe) group by b.g, b.ord, content_hash having bool_or(lost)"""


@query(sql(", " + SQL_LOST.format(lost="(k = 4 and b = 0) or (k = 9 and b in (0, 64 // bs))"), "t0", "sets"))
def rs_repair_blocks(s: SparkSession, sf: str) -> DataFrame:
    """Rotten blocks are rebuilt; the digest of each file put together again is the recorded one."""
    return _repaired(s, sf, ((F.col("k") == 4) & (F.col("b") == 0)) | ((F.col("k") == 9) & F.col("b").isin(0, 1)))


@query(sql(", " + SQL_LOST.format(lost="k = 0"), "t0", "sets"))
def rs_restore_missing_file(s: SparkSession, sf: str) -> DataFrame:
    """Whole files are gone: restored where parity covers all their stripes, else failed."""
    return _repaired(s, sf, F.col("k") == 0)


@query(sql(", " + SQL_LOST.format(lost="k in (0, 1, 2, 3, 4, 5)"), "t0", "sets"))
def rs_beyond_margin(s: SparkSession, sf: str) -> DataFrame:
    """A sixth of all files is gone: most stripes lost more than parity covers, and every member there fails."""
    return _repaired(s, sf, F.col("k") <= 5)


@query(sql("select g, stripe, parity_blocks as shards, parity_blocks * block_size as bytes from stripe join sets using (g)", "t0", "sets"))
def rs_parity_shard_counts(s: SparkSession, sf: str) -> DataFrame:
    _, _, each = _stripe_blocks(s, sf)
    return repair.shards(each).groupBy("g", "stripe").agg(F.count("*").alias("shards"), F.sum(F.octet_length("bytes")).alias("bytes"))


# ---------------------------------------------------------------- life of sets

SQL_TWO = f"""two as (select 'a' || lpad(g::varchar, 6, '0') as set_id, {EPOCH} + g as created_at, * from worn union all select 'b' || lpad((g // 3)::varchar, 6, '0'), {EPOCH} + 5000 - g // 3, g, ord + 1000 * (g % 3), content_hash, size, n_blocks, first_block, dead and ord % 2 = 0 from worn where ord % 5 = 0)"""


def _two(s: SparkSession, sf: str) -> DataFrame:
    """Every fifth content is a member of a second set too."""
    rows = _worn(s, sf)[1]
    number = lambda c: F.lpad(c.cast("string"), 6, "0")
    third = geometry.floor_div(F.col("g"), F.lit(3).cast("long"))
    a = rows.withColumn("set_id", F.concat(F.lit("a"), number(F.col("g")))).withColumn("created_at", F.lit(EPOCH) + F.col("g"))
    b = rows.where("ord % 5 = 0").withColumn("set_id", F.concat(F.lit("b"), number(third))).withColumn("created_at", F.lit(EPOCH + 5000) - third)
    return a.unionByName(b.withColumn("ord", F.col("ord") + 1000 * (F.col("g") % 3)).withColumn("dead", F.col("dead") & (F.col("ord") % 1000 % 2 == 0)))


@query(sql("select content_hash, set_id, ord from two where not dead qualify row_number() over (partition by content_hash order by set_id, ord) = 1", "t0", "t1", "sets", SQL_DEAD, SQL_TWO))
def live_membership(s: SparkSession, sf: str) -> DataFrame:
    return sets.live_membership(_two(s, sf)).select("content_hash", "set_id", "ord")


@query(sql("""select set_id, ord, content_hash, dead or row_number() over (partition by content_hash, dead order by worn, created_at, set_id, ord) > 1 as dead
  from two join (select set_id, sum(case when dead then n_blocks else 0 end) as worn from two group by 1) using (set_id)""", "t0", "t1", "sets", SQL_DEAD, SQL_TWO))  # fmt: skip
def converge_duplicates(s: SparkSession, sf: str) -> DataFrame:
    rows = _two(s, sf)
    created = rows.select("set_id", "created_at").distinct()
    return sets.converged(rows.drop("created_at"), created).select("set_id", "ord", "content_hash", "dead")


@query(sql("select set_id, ord, dead, created_at, row_number() over (order by created_at, set_id, ord) as place from two where content_hash = (select min(content_hash) from two where set_id like 'b%')", "t0", "t1", "sets", SQL_DEAD, SQL_TWO))
def memberships_by_age(s: SparkSession, sf: str) -> DataFrame:
    rows = _two(s, sf)
    wanted = rows.where("set_id like 'b%'").agg(F.min("content_hash")).first()[0] or ""
    found = sets.memberships(rows.drop("created_at"), rows.select("set_id", "created_at").distinct(), wanted)
    return found.selectExpr("set_id", "ord", "dead", "created_at", "cast(row_number() over (order by created_at, set_id, ord) as long) as place")


@query(sql("select content_hash, count(*) as memberships from two where not dead group by 1 having count(*) > 1", "t0", "t1", "sets", SQL_DEAD, SQL_TWO))
def duplicate_live_memberships(s: SparkSession, sf: str) -> DataFrame:
    return sets.duplicates(_two(s, sf))


SQL_SOURCES = """held as (select f.content_hash, f.path, case when state <> 'ok' then 'state is ' || state when t1.path is null then 'not on disk' when f.size <> t1.size or f.mtime_ns <> t1.mtime_ns then 'changed on disk' end as reason from files f left join t1 using (path)),
src as (select w.g, w.ord, w.content_hash, source, case when source is null then coalesce(reason, 'no file') end as blocker from worn w left join
  (select content_hash, min(path) filter (reason is null) as source, arg_max(reason, path) filter (reason is not null) as reason from held group by 1) h using (content_hash) where not w.dead)"""


@query(sql("select * from src", "t0", "t1", "files", "sets", SQL_DEAD, SQL_SOURCES))
def member_sources(s: SparkSession, sf: str) -> DataFrame:
    return sets.sources(_worn(s, sf)[1], fixtures.files(s, sf), fixtures.t1(s, sf))


@query(sql("select g, bool_and(source is not null) as eligible, count(blocker) as blockers from src group by 1", "t0", "t1", "files", "sets", SQL_DEAD, SQL_SOURCES))
def dissolve_eligibility(s: SparkSession, sf: str) -> DataFrame:
    return sets.eligible(member_sources(s, sf))


@query(sql("""el as (select g from src group by 1 having bool_and(source is not null)),
pool as (select content_hash as hash, size, path, 0 as part from files where size > 0 and path like 'src5/%' union all
  select w.content_hash, w.size, source, 1 from worn w join src using (g, ord) where w.g in (select g from el) and w.g in (select g from worn where dead) union all
  select w.content_hash, w.size, source, 2 from worn w join src using (g, ord) where w.g in (select g from el) and w.g in (select g from sets where data_bytes * 2 < 32768))
select hash, size, path, part from pool qualify row_number() over (partition by hash order by part, string_split(path, '/')) = 1""".replace("el as (", ", el as (", 1), "t0", "t1", "files", "sets", SQL_DEAD, SQL_SOURCES))  # fmt: skip
def pool_build(s: SparkSession, sf: str) -> DataFrame:
    """What is encoded anew: uncovered contents, then members of eligible degraded sets, then of underfull ones."""
    shape, rows = _worn(s, sf)
    source = sets.sources(rows, fixtures.files(s, sf), fixtures.t1(s, sf))
    good = sets.eligible(source).where("eligible").select("g")
    placed = source.join(good, "g", "left_semi").join(rows.select("g", "ord", "size"), ["g", "ord"]).select(F.col("content_hash").alias("hash"), "size", F.col("source").alias("path"), "g")
    part = lambda which: placed.join(which.select("g"), "g", "left_semi")
    new = report.listed(fixtures.files(s, sf), ["src5"]).where("size > 0").select(F.col("content_hash").alias("hash"), "size", "path")
    return sets.pool([new, part(sets.degraded(shape, rows)), part(sets.underfull(shape, CONFIG))]).select("hash", "size", "path", F.col("part").cast("int").alias("part"))


@query(sql("select g, bool_and(found) as rehomed from (select t.g, t.ord, bool_or(coalesce(o.set_id <> t.set_id, false)) as found from two t left join (select * from two where not dead) o using (content_hash) where not t.dead and t.set_id like 'a%' group by all) group by 1", "t0", "t1", "sets", SQL_DEAD, SQL_TWO))
def rehomed_check(s: SparkSession, sf: str) -> DataFrame:
    rows = _two(s, sf)
    return sets.rehomed(rows.where("set_id like 'a%'"), rows)


@query(sql("select content_hash from files group by 1 having bool_and(starts_with(path, 'src1/'))", "t0", "files"))
def dying_contents(s: SparkSession, sf: str) -> DataFrame:
    files = fixtures.files(s, sf)
    return sets.dying(files, report.listed(files, ["src1"]).select("path"))


@query(sql("select distinct g from worn where not dead and content_hash in (select content_hash from files group by 1 having bool_and(starts_with(path, 'src1/')))", "t0", "t1", "files", "sets", SQL_DEAD))
def affected_sets(s: SparkSession, sf: str) -> DataFrame:
    return sets.affected(dying_contents(s, sf), _worn(s, sf)[1])


@query(sql("select distinct hash from t0 where hash not in (select hash from t1)", "t0", "t1"))
def orphan_content(s: SparkSession, sf: str) -> DataFrame:
    known = catalog.contents(fixtures.files(s, sf), CONFIG.algo)
    return catalog.orphans(known, fixtures.t1(s, sf).select(F.col("hash").alias("content_hash"))).select("hash")


@query(sql("""select distinct content_hash from worn where not dead and content_hash not in (select content_hash from files f
  where coalesce((select m.mode from marks m where starts_with(f.path, m.path || '/') order by length(m.path) desc limit 1), 'exclude') = 'include')""", "t0", "t1", "files", "marks", "sets", SQL_DEAD))  # fmt: skip
def uncovered_content(s: SparkSession, sf: str) -> DataFrame:
    files = coverage.covered(fixtures.files(s, sf), fixtures.marks(s))
    return sets.uncovered(files, _worn(s, sf)[1].where("not dead"))


@query(sql("select path, size from files where content_hash in (select content_hash from worn where not dead)", "t0", "t1", "files", "sets", SQL_DEAD))
def ls_parity(s: SparkSession, sf: str) -> DataFrame:
    return report.listed(fixtures.files(s, sf), live=_worn(s, sf)[1].where("not dead"), parity=True).select("path", "size")


@query(sql("select f.path, f.size from files f where content_hash not in (select content_hash from worn where not dead)", "t0", "t1", "files", "sets", SQL_DEAD))
def ls_no_parity(s: SparkSession, sf: str) -> DataFrame:
    return report.listed(fixtures.files(s, sf), live=_worn(s, sf)[1].where("not dead"), parity=False).select("path", "size")


@query(sql("""select count(*) as files, coalesce(sum(size) filter (state <> 'missing'), 0)::bigint as bytes, count(distinct content_hash) as contents, count(*) filter (last_verified_at is null) as never_verified, min(last_verified_at) as oldest_verified,
  count(*) filter (has) as covered_files, coalesce(sum(size) filter (has), 0)::bigint as covered_bytes, (select count(*) from sets) as sets, (select count(distinct g) from worn where dead) as degraded_sets, (select count(*) from events) as events
  from (select f.*, content_hash in (select content_hash from worn where not dead) as has from files f)""", "t0", "t1", "files", "sets", SQL_DEAD))  # fmt: skip
def status_totals(s: SparkSession, sf: str) -> DataFrame:
    shape, rows = _worn(s, sf)
    return report.totals(fixtures.files(s, sf), rows.where("not dead"), shape, rows, fixtures.events(s, sf))


# ---------------------------------------------------------------- state and store


@query(sql("""select coalesce(n.path, f.path) as path, coalesce(n.hash, f.content_hash) as content_hash, coalesce(n.size, f.size) as size, coalesce(n.mtime_ns, f.mtime_ns) as mtime_ns, case when n.path is null then f.state else 'ok' end as state, coalesce(f.added_at, {0}) as added_at, case when n.path is null then f.updated_at else {0} end as updated_at, case when n.path is null then f.last_verified_at else {0} end as last_verified_at
  from files f full join (select * from t1 where path like 'src1/%' or path like 'web/%') n using (path)""".format(NOW), "t0", "t1", "files"))  # fmt: skip
def upsert_generation(s: SparkSession, sf: str) -> DataFrame:
    new = report.listed(fixtures.t1(s, sf), ["src1", "web"]).select("path", F.col("hash").alias("content_hash"), "size", "mtime_ns")
    return catalog.upserted(fixtures.files(s, sf), catalog.verified_rows(new, NOW))


@query(sql("select * from files where not starts_with(path, 'src1/')", "t0", "files"))
def delete_generation(s: SparkSession, sf: str) -> DataFrame:
    files = fixtures.files(s, sf)
    return catalog.deleted(files, report.listed(files, ["src1"]).select("path"))


@query(sql("select g, ord, content_hash, dead or content_hash in (select content_hash from files group by 1 having bool_and(starts_with(path, 'src1/'))) as dead from worn", "t0", "t1", "files", "sets", SQL_DEAD))
def members_marked_dead(s: SparkSession, sf: str) -> DataFrame:
    return catalog.marked_dead(_worn(s, sf)[1], dying_contents(s, sf)).select("g", "ord", "content_hash", "dead")


@query(sql("select coalesce(a.g, b.g) as g, case when b.g is null then 'missing' when a.g is null then 'orphan' when a.n_blocks <> b.n_blocks then 'geometry differs' else 'ok' end as finding from (select g, n_blocks from sets) a full join (select g + case when g % 10 = 0 then 100000 else 0 end as g, n_blocks + case when g % 7 = 3 then 1 else 0 end as n_blocks from sets) b on a.g = b.g", "t0", "sets"))
def fsck_sets_vs_store(s: SparkSession, sf: str) -> DataFrame:
    """Recorded sets against what lies in the store: every tenth moved away, some of another shape."""
    shape = _sets(s, sf)[0].select("g", "n_blocks")
    stored = shape.select((F.col("g") + F.when(F.col("g") % 10 == 0, 100000).otherwise(0)).alias("g"), (F.col("n_blocks") + F.when(F.col("g") % 7 == 3, 1).otherwise(0)).alias("n_blocks"))
    return catalog.store_findings(shape, stored, "g", ["n_blocks"])


@query(sql("select g, ord, content_hash, content_hash not in (select content_hash from files where state <> 'missing') as dead from members", "t0", "files", "sets"))
def rebuild_members_dead(s: SparkSession, sf: str) -> DataFrame:
    """Members read back from the store are dead unless a listed file holds their content."""
    listed = manifest.parsed_sums(manifest.sum_lines(fixtures.files(s, sf)))
    return catalog.rebuilt_members(_sets(s, sf)[1], listed.select(F.col("digest").alias("content_hash"))).select("g", "ord", "content_hash", "dead")


@query(sql(f"select path, case when size >= 1024 then ((size * 10 + 512) // 1024 // 10) || '.' || ((size * 10 + 512) // 1024 % 10) || ' KiB' else size || ' B' end as size, strftime(make_timestamp(added_at * 1000000), '%Y-%m-%d %H:%M:%S') as added, case when last_verified_at is null then null when {NOW} - last_verified_at < 172800 then (({NOW} - last_verified_at) // 3600) || 'h ago' else (({NOW} - last_verified_at) // 86400) || 'd ago' end as verified from files", "t0", "files"))
def ls_long(s: SparkSession, sf: str) -> DataFrame:
    return fixtures.files(s, sf).select("path", formats.shown_bytes(F.col("size")).alias("size"), formats.shown_time(F.col("added_at")).alias("added"), formats.shown_ago(F.col("last_verified_at"), F.lit(NOW)).alias("verified"))


@query(sql("select '{\"path\":\"' || path || '\",\"state\":\"' || state || '\",\"size\":' || size || '}' as line from files", "t0", "files"))
def ls_json(s: SparkSession, sf: str) -> DataFrame:
    return report.json_lines(fixtures.files(s, sf), "path", "state", "size")
