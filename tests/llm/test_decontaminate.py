import random

from conftest_rows import plain
from pyspark.sql import functions as F

from vaultloom.llm import decontaminate
from vaultloom.llm.queries import QUERIES


def slow(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row), row.index(min(row))


def test_edit_distance_like_the_table():
    r = random.Random(1)
    for _ in range(200):
        a = "".join(r.choice("abc ") for _ in range(r.randint(1, 70)))
        b = "".join(r.choice("abc ") for _ in range(r.randint(0, 90)))
        assert decontaminate.best_part(a, b) == slow(a, b)


def edited(text, rate, r, words):
    out = []
    for w in text.split():
        x = r.random()
        if x < rate / 2:
            out.append(r.choice(words))
        elif x < rate * 0.75:
            continue
        else:
            out += [w] + [r.choice(words)] * (x < rate)
    return " ".join(out)


def test_recall_of_edited_passages(spark, sf):
    """Against brute force: the exact edit distance of every item to every text."""
    r = random.Random(2)
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = plain(3000, seed=8).split()
    docs = []
    for rate in (0.0, 0.05, 0.1, 0.15, 0.2):
        for i, t in items:
            docs.append((len(docs), " ".join(r.sample(words, 40)) + " \n" + edited(t, rate, r, words).replace(" ", "  ", 3).upper() + " " + " ".join(r.sample(words, 40))))
    clean = [(10_000 + k, " ".join(r.sample(words, 120))) for k in range(100)]
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.matches(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_items=15).collect()}
    want = {}
    for k, (d, t) in enumerate(docs):
        i, p = items[k % len(items)]
        p = decontaminate.normal(p)
        distance = decontaminate.best_part(p, decontaminate.normal(t))[0]
        if distance <= 0.2 * len(p):
            want[d, i] = distance
    assert set(got) <= set(want) and len(want) > 150
    assert len(got) >= 0.97 * len(want) and all(got[k] == want[k] for k in got)


def noisy(text, rate, r):
    out = ""
    for c in text:
        x = r.random()
        out += r.choice("abcdeéñ ") if x < rate / 3 else "" if x < rate * 2 / 3 else c + r.choice("etaoin ") if x < rate else c
    return out


def test_recall_of_noisy_characters(spark, sf):
    """Characters put in, left out or replaced at 5 to 20 %: recall against brute force at each rate."""
    r = random.Random(5)
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = plain(3000, seed=8).split()
    rates = (0.05, 0.1, 0.15, 0.2)
    docs = [(k, " ".join(r.sample(words, 30)) + " " + noisy(decontaminate.normal(t), rate, r) + " " + " ".join(r.sample(words, 30))) for k, (rate, (_, t)) in enumerate((rate, x) for rate in rates for x in items)]
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for n, rate in enumerate(rates):
        want = {}
        for d, t in docs[n * len(items) : (n + 1) * len(items)]:
            i, p = items[d % len(items)]
            p = decontaminate.normal(p)
            distance = decontaminate.best_part(p, decontaminate.normal(t))[0]
            if distance <= 0.2 * len(p):
                want[d, i] = distance
        found = [k for k in want if k in got]
        assert len(want) > 15 and len(found) >= 0.9 * len(want) and all(got[k] == want[k] for k in found)


def test_short_items_without_loss(spark):
    """Items of one to eight words, verbatim and edited, at the ends of texts and inside longer ones: as by brute force."""
    r = random.Random(6)
    words = plain(400, seed=9).split()
    items = [(k, " ".join(r.sample(words, 1 + k % 8))) for k in range(48)]
    texts = []
    for k, t in items:
        for rate in (0.0, 0.1, 0.18):
            x = noisy(t, rate, r)
            texts += [x, " ".join(r.sample(words, 9)) + " " + x + " " + " ".join(r.sample(words, 9)), x + " " + " ".join(r.sample(words, 5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, p in items:
            p = decontaminate.normal(p)
            distance = decontaminate.best_part(p, decontaminate.normal(t))[0]
            if len(p) < decontaminate.WORD and distance <= 0.2 * len(p):
                want[d, i] = distance
    assert len(want) > 300 and {k: v for k, v in got.items() if len(decontaminate.normal(items[k[1]][1])) < decontaminate.WORD} == want


def test_chunk_distances():
    import numpy as np

    r = random.Random(4)
    for _ in range(60):
        a = "".join(r.choice("abc ") for _ in range(r.randint(1, 64)))
        b = "".join(r.choice("abc ") for _ in range(r.randint(0, 90)))
        mask = np.zeros((1, decontaminate.CLASSES), np.uint64)
        for k, c in enumerate(a):
            mask[0, ord(c)] |= np.uint64(1 << k)
        text = np.frombuffer(("xx" + b + "xx").encode(), np.uint8)
        got = decontaminate.chunk_distances(mask, np.array([len(a)]), np.array([0]), text, np.array([2]), np.array([2 + len(b)]))
        assert got[0] == slow(a, b)[0]


def test_characters_like_normal(odd):
    import numpy as np

    texts = [r["text"] or "" for r in odd.collect()] + [" a\t\nB  ", "É\u2003x", "\x00 ", ""]
    raw = [t.encode() for t in texts]
    data = b"".join(raw)
    classes, keep, at = decontaminate.characters(np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    for t, a, b in zip(texts, at, at[1:]):
        want = decontaminate.normal(t)
        assert len(want) == b - a and all(c < 128 and (chr(c) == w if ord(w) < 128 else 65 <= c <= 90) for c, w in zip(classes[a:b].tolist(), want))
    assert keep.sum() == len(classes) == at[-1]
    classes, keep, at = decontaminate.characters(np.frombuffer(b"a\xff  b\xc3", np.uint8), np.array([0, 5, 6]))
    assert at.tolist() == [0, 4, 5] and chr(classes[0]) == "a" and chr(classes[2]) == " " and chr(classes[3]) == "b"
    assert decontaminate.characters(np.zeros(0, np.uint8), np.array([0, 0]))[2].tolist() == [0, 0]


def test_trimmed_items_as_whole_documents(spark):
    """Items without their first and last words, each between two other documents of one task."""
    items = {k: decontaminate.normal(plain(120, seed=100 + k)) for k in range(12)}
    texts = [plain(60, seed=50)]
    for k, t in items.items():
        texts += [" ".join(t.split()[9 : -9 - k % 2]), "one", plain(60, seed=200 + k)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = decontaminate.matches(docs, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = {}
    for d, t in enumerate(texts):
        for k, p in items.items():
            distance = decontaminate.best_part(p, decontaminate.normal(t))[0]
            if distance <= 0.2 * len(p):
                want[d, k] = distance
    assert len(want) == 12 and {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()} == want
    kept = decontaminate.cleaned(docs, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, plain(50, seed=7)), (2, None), (3, "  "), (4, "one two"), (4, "one"), (None, plain(12, seed=3)), (5, "é \U0001f600")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["first_word"], r["end_word"]) for r in decontaminate.matches(odd.withColumn("item_id", F.lit(9)), items).collect()}
    assert got[7, 1] == got[8, 1] == (0, 0, 50) and got[5, 4] == (0, 0, 1) and got[4, 4] == (0, 0, 1)
    assert decontaminate.matches(odd, items).where("doc_id = 7").count() == 2
    blank = items.limit(0)
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(odd, blank).count() == 0
    kept = decontaminate.cleaned(odd, items)
    assert kept.columns == odd.columns and not {4, 5, 7, 8} & {r["doc_id"] for r in kept.collect()} and kept.where("doc_id = 6").count() == 1
    assert decontaminate.cleaned(odd, blank).count() == odd.count() and decontaminate.cleaned(none, items).count() == 0


def test_op4_like_brute_force(spark, sf):
    """Verbatim copies of every item, and all matches of the items whose id is divisible by 10 (100 among them), in all whole texts."""
    items = {x["item_id"]: decontaminate.normal(x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {x["doc_id"]: decontaminate.normal(x["text"] or "") for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert {(d, i) for d, t in docs.items() for i, p in items.items() if p in t} <= got
    few = [i for i in items if i % 10 == 0]
    assert {(d, i) for d, t in docs.items() for i in few if decontaminate.best_part(items[i], t)[0] <= 0.2 * len(items[i])} == {(d, i) for d, i in got if i in few}
