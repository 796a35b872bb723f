import random
import re

from conftest_rows import SCHEMA, plain
from pyspark.sql import functions as F

from vaultloom.llm import dedup
from vaultloom.llm.graph import components
from vaultloom.llm.queries import QUERIES

UP = {c: c + 32 for c in range(65, 91)}


def brute(rows, width, percent):
    """doc_id to (set size, smallest linked id), all pairs compared."""
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UP))
        sets[d] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    ids, parent = sorted(sets), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def made(seed, groups=12, size=14):
    """Groups of near copies of texts of several lengths, chains of ever more edits, a shared passage, exact copies."""
    r = random.Random(seed)
    passage, rows = plain(40, seed=99).split(), []
    for g in range(groups):
        base = plain(r.choice([1, 2, 3, 8, 30, 70, 300, 900]), seed=seed * 1000 + g).split()
        now = base
        for _ in range(size):
            w = list(now if g % 2 else base)
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 40, len(w) // 15])):
                w[r.randrange(len(w))] = r.choice(["x", "y", "the"]) + str(r.randrange(99))
            now = w
            rows.append((len(rows), " ".join(w + passage * (g % 3 == 0))))
    r.shuffle(rows)
    return rows


def compare(spark, rows, width, percent, k=64, overlap=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(df, width=width, percent=percent, k=k, overlap=overlap).collect()}
    assert got == brute(rows, width, percent)


def test_like_brute_force(spark):
    compare(spark, made(1), 3, 85, 64, 36)


def test_like_brute_force_by_default(spark):
    compare(spark, made(2), 5, 80)


def test_dense_group_and_copies(spark):
    base = plain(200, seed=5).split()
    r = random.Random(4)
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(25)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, rows[3][1].upper()) for k in range(300)]
    compare(spark, rows, 3, 85, 64, 36)


def test_op8_on_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op8_minhash"](spark, sf).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in brute(rows, 3, 85).items()}


def test_odd_rows(spark, odd, none):
    got = dedup.near_duplicates(odd.withColumn("_row", F.lit(1)).withColumn("n", F.lit(2)), keep=("n",), width=3, percent=85).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(1, 4)] and by[5] == [(1, 5)]
    assert by[7] == [(48, 7)] * 2 and by[8] == [(48, 7)]
    assert dedup.near_duplicates(none).count() == 0 and dedup.deduplicated(none).count() == 0


def test_deduplicated(spark, odd):
    clash = odd.withColumn("_row", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("component_id", F.lit(0))
    assert dedup.deduplicated(clash).columns == clash.columns and dedup.deduplicated(clash).exceptAll(clash).count() == 0
    kept = dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.exceptAll(odd).count() == 0
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda d: (d is None, d))
    assert ids == [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, None, None]
    rows = spark.createDataFrame([(k, plain(30, seed=k // 2), "en", "s", 1) for k in range(20)], SCHEMA)
    assert sorted(r["doc_id"] for r in dedup.deduplicated(rows).collect()) == list(range(0, 20, 2))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b and sum(a in e for e in edges) == 1}
    assert got == {x: find(x) for e in edges for x in e if x not in loops}
