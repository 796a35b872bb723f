"""MinHash near-duplicates by bottom-k sketches from one hash function.

Each text is reduced to its set of distinct word shingles (64-bit hashes); texts with equal sets form a class, so copies of
any number are one row from then on. A class keeps its k smallest hashes. Inverted lists of the retained values give
overlaps; of each sketch only the rarest values are listed, as many as an overlap of at least `overlap` values cannot miss,
so passages that many documents share don't make long lists. The steps after that:

1. In each list every class meets the list's most central class (the one with most repeated values). The union sketch
   estimates their similarity, pairs near the threshold or above are compared on full sets, and links are joined to components.
2. Lists whose classes are still in several components are the rest. Their classes are searched exactly: prefix filtering
   on full sets, between components only; parity bits of the sets drop pairs that differ in too many elements within the
   join, without loss, and the pairs left are compared on full sets.

Joins by a shingle or a centre that very many classes share deal those classes over several tasks; values meet their counts as
four numbers a row, where Spark's own splitting of skewed partitions does.
A dense group of n near copies so costs about n comparisons instead of n squared, and no link between different texts is
lost but by chance: with k = 64 and overlap 36, two texts at the threshold of 0.85 miss each other with a probability
below 1e-7 (sets of at most k shingles are sketched whole).

Defined results: null text and text without words have an empty set and are linked with nothing; ids may repeat or be null
(a row each; a null id never names a component unless the whole component has none); ties go to the smaller id; columns that
aren't asked for are ignored; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, pieces, scratch, shingle_hashes, spread_join, word_hashes
from .graph import components

PARITIES = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    hashes, at, _, _ = word_hashes(data, offsets)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield np.unique(shingle_hashes(hashes[a:b], width).view(np.int64))


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketched(df: DataFrame, text: str, keep: tuple[str, ...], width: int, k: int) -> DataFrame:
    """Kept columns, _text, _row, _n (set size), _hi and _lo (128-bit key of the set), _sketch (k smallest), as a scratch table."""
    named = df.select(*keep, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            n, keys, sketches = [], [], []
            for s in shingle_sets(*buffers(b.column(len(keep))), width):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketches.append(s[:k])
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists_of(sketches)], [*b.schema.names, "_n", "_hi", "_lo", "_sketch"])

    return scratch(named.mapInArrow(run, f"{types}, _n long, _hi long, _lo long, _sketch array<long>"), "near-rows")


def parities(s: np.ndarray) -> np.ndarray:
    """64 * PARITIES bits: whether an odd number of the set's hashes falls on each. Two sets differ in at least as many elements as bits."""
    odd = np.bincount(s & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """(c, shingles, parity) of rows (_row, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            found = list(shingle_sets(*buffers(b.column(1)), width))
            yield pa.RecordBatch.from_arrays([b.column(0), lists_of(found), lists_of([parities(s) for s in found])], ["c", "shingles", "parity"])

    return rows.select("_row", "_text").mapInArrow(run, "c long, shingles array<long>, parity array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), read twice, whose full sets have 100 * intersection >= percent * union; the pairs of a centre b are dealt out."""
    left, right = sets.select(F.col("c").alias("a"), F.col("shingles").alias("_x")), sets.select(F.col("c").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    met = spread_join(pairs.join(left, "a"), right, ["b"], pairs.groupBy("b").agg(F.count("*").alias("n")), ["a"])
    return met.where(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def linked_classes(reps: DataFrame, texts: DataFrame, width: int, percent: int, k: int, overlap: int) -> DataFrame:
    """(node, label) of the classes that are linked. reps: c, n, sketch; texts: _row, _text."""
    each = reps.select("c", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    often = each.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    # a set of at most k values is sketched whole; its partner may have lost what goes beyond k
    least = F.expr(f"case when n > {k} then {overlap} else greatest(1, ({percent} * n + 99) div 100 - greatest(0, 100 * n div {percent} - {k})) end")
    ranked = each.join(often, "v").selectExpr("c", "n", "k", "v", "row_number() over (partition by c order by f, v) as rank", "count(*) over (partition by c) as r")
    listed = ranked.where(F.col("rank") <= F.col("k") - least + 1 - (F.col("k") - F.col("r"))).select("v", "c", "n", "r")
    listed = scratch(listed, "near-lists")
    shift = 1 << 52
    centre = listed.groupBy("v").agg(F.count("*").alias("m"), F.max(F.col("r") * shift + (shift - 1 - F.col("c"))).alias("code")).where("m > 1")
    centre = centre.select("v", (F.lit(shift - 1) - F.col("code") % shift).alias("p"))
    inside = listed.join(centre, "v")
    sets = scratch(full_sets(texts.join(inside.select(F.col("c").alias("_row")).distinct(), "_row", "left_semi"), width), "near-sets")

    sizes = reps.select(F.col("c").alias("p"), F.col("n").alias("pn"))
    fits = (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")).alias("fits")
    met = inside.where("c <> p").select("c", "n", "p").distinct().join(sizes, "p").where(fits)
    met = scratch(met.select(F.col("c").alias("a"), F.col("p").alias("b")), "near-met")
    of = met.groupBy("b").agg(F.count("*").alias("n"))
    met = spread_join(met.join(reps.select(F.col("c").alias("a"), F.col("sketch").alias("_s")), "a"), reps.select(F.col("c").alias("b"), F.col("sketch").alias("_t")), ["b"], of, ["a"])
    # estimate: the share of the union's k smallest values that both have
    union = F.slice(F.sort_array(F.array_union("_s", "_t")), 1, k)
    near = F.size(F.array_intersect(F.array_intersect("_s", "_t"), union)) * k >= overlap * F.size(union)
    near = scratch(met.where(near).select("a", "b"), "near-pairs")
    links = scratch(linked(near, sets, percent), "near-links")
    labels = components(links)

    # the rest: lists whose classes are still in several components, searched on full sets
    placed = inside.select("v", "c", "n").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    open_lists = placed.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    rest = scratch(placed.join(open_lists, "v").select("c", "n", "label").distinct(), "near-rest")
    every = rest.join(sets, "c").select("c", "n", "label", F.explode("shingles").alias("s"))
    counts = every.groupBy("s").agg(F.count("*").alias("f"))
    ranked = every.join(counts.where("f > 1"), "s").selectExpr("*", "row_number() over (partition by c order by f, s) as rank", "count(*) over (partition by c) as r").withColumn("rank", F.col("rank") + F.col("n") - F.col("r"))
    probe = F.expr(f"n - ({percent} * n + 99) div 100 + 1")  # overlap with any partner: at least percent of the set
    early = ranked.where(F.col("rank") <= probe).select("s", "c", "n", "label", "rank")
    exact = scratch(early.join(sets.select("c", "parity"), "c"), "near-prefix")
    by_label = exact.groupBy("s", "label").agg(F.count("*").alias("m"))
    main = scratch(by_label.groupBy("s").agg(F.count("*").alias("labels"), F.expr("max_by(label, m)").alias("main"), F.sum("m").alias("n")).where("labels > 1").select("s", "main", "n"), "near-main")
    of = main.select("s", "n")
    few = spread_join(exact, main.drop("n"), ["s"], of, ["c"]).where("label <> main").selectExpr("s", "c as a", "n as an", "label as al", "rank as ar", "parity as ap")
    crossing = spread_join(exact.selectExpr("s", "c as b", "n as bn", "label as bl", "rank as br", "parity as bp"), few, ["s"], of, ["b"])
    # the least overlap of such a pair; both must hold the value so early that this many are left from there on
    least = F.expr(f"({percent} * (an + bn) + {99 + percent}) div {100 + percent} - 1")
    # parities show pairs that differ in too many elements, so that they are dropped within the join
    differ = sum((F.bit_count(F.get("ap", F.lit(k)).bitwiseXOR(F.get("bp", F.lit(k)))) for k in range(PARITIES)), F.lit(0))
    crossing = crossing.where(differ <= F.col("an") + F.col("bn") - 2 * (least + 1))
    crossing = crossing.where((F.col("al") != F.col("bl")) & (F.col("an") - F.col("ar") >= least) & (F.col("bn") - F.col("br") >= least))
    pairs = crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch(pairs, "near-crossing")
    more = scratch(linked(pairs, sets, percent), "near-more")
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    out = components(stars.union(more))
    discard(listed, sets, near, links, rest, exact, main, pairs, more)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), width: int = 5, percent: int = 80, k: int = 64, overlap: int | None = None) -> DataFrame:
    """A row for each row of df: doc_id, kept columns, n_shingles, component_id (smallest doc_id reachable), _row and _component (numbers of this run)."""
    rows, named = _placed(df, doc_id, text, keep, width, percent, k, overlap)
    columns = ("doc_id", *(F.col(f"_keep_{c}").alias(c) for c in keep))
    full = rows.where("_n > 0").join(named, ["_hi", "_lo"]).select(*columns, F.col("_n").alias("n_shingles"), "component_id", "_row", "_component")
    empty = rows.where("_n = 0").select(*columns, F.col("_n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "_row", F.col("_row").alias("_component"))
    return full.unionByName(empty)


def _placed(df: DataFrame, doc_id: str, text: str, keep: tuple[str, ...], width: int, percent: int, k: int, overlap: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows as sketched(), and (_hi, _lo, _component, component_id) of the classes."""
    if overlap is None:  # about six standard deviations below the threshold
        share = percent / 100
        overlap = max(1, int(k * share - 6 * (k * share * (1 - share)) ** 0.5))
    plain = df.select(F.col(doc_id).alias("doc_id"), *(F.col(c).alias(f"_keep_{c}") for c in keep), F.col(text).alias("_text"))
    rows = sketched(plain, "_text", tuple(c for c in plain.columns if c != "_text"), width, k)
    classes = scratch(rows.where("_n > 0").groupBy("_hi", "_lo").agg(F.min("_row").alias("c"), F.min("doc_id").alias("least")), "near-classes")
    chosen = rows.select("_row", "_n", "_sketch").join(classes.select(F.col("c").alias("_row")), "_row", "left_semi")
    reps = scratch(chosen.select(F.col("_row").alias("c"), F.col("_n").alias("n"), F.col("_sketch").alias("sketch")), "near-reps")
    labels = linked_classes(reps, rows.select("_row", "_text"), width, percent, k, overlap)
    discard(reps)
    named = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("_component", F.coalesce("label", "c"))
    least = named.groupBy("_component").agg(F.min("least").alias("component_id"))
    return rows, named.join(least, "_component").select("_hi", "_lo", "_component", "component_id")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group of near-duplicates: the smallest doc_id (null last), the first row among equal ids."""
    others = tuple(c for c in df.columns if c not in (doc_id, text))
    rows, named = _placed(df, doc_id, text, others, width, percent, 64, None)
    placed = rows.where("_n > 0").select("_row", "doc_id", "_hi", "_lo").join(named, ["_hi", "_lo"])
    first = placed.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    columns = [F.col("doc_id" if c == doc_id else "_text" if c == text else f"_keep_{c}").alias(c) for c in df.columns]
    chosen = rows.where("_n > 0").join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi")
    return chosen.select(*columns).union(rows.where("_n = 0").select(*columns))


def oracle(width: int, percent: int) -> str:
    """Components over `documents` by comparing all pairs that share a shingle, as DuckDB SQL."""
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    s as (select distinct doc_id, unnest(case when len(w) >= {width} then list_transform(range(1, len(w) - {width - 2}), lambda i: {joined}) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as h from d),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
    e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
    e2 as (select a, b from e union all select b, a from e),
    reach as (select doc_id as v, doc_id as m from d union select e2.b, reach.m from reach join e2 on e2.a = reach.v)
    select d.doc_id, coalesce(n, 0) as n_shingles, m as component_id, m = d.doc_id as kept from d left join n using (doc_id) join (select v as doc_id, min(m) as m from reach group by 1) using (doc_id)"""
