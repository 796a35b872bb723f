import numpy as np
from conftest_rows import SCHEMA, plain
from pyspark.sql import functions as F

from vaultloom.llm import langid
from vaultloom.llm.queries import QUERIES


def corpus(spark):
    rows = [(k, plain(30, lang, k), lang, "s", 1) for k in range(120) for lang in [("en", "de", "fr")[k % 3]]]
    return spark.createDataFrame(rows, SCHEMA)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_language"](spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, none):
    model = langid.trained(corpus(spark).unionByName(odd))
    assert model.languages == ["de", "en", "fr"] and 0.01 < model.temperature < 100
    got = langid.identified(odd.withColumn("lang_pred", F.lit("clash")), model, keep=("doc_id", "n_chars")).collect()
    assert len(got) == odd.count()
    blank = langid.identified(odd.where("text is null or not text rlike '\\\\p{L}'"), model).collect()
    assert blank and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in blank)
    assert langid.identified(none, model).count() == 0
    empty = langid.trained(none)
    assert {r["lang_pred"] for r in langid.identified(odd, empty).collect()} == {"und"}


def test_accepted_keeps_columns(spark, odd):
    docs = corpus(spark)
    model = langid.trained(docs)
    assert langid.accepted(docs, model).exceptAll(docs).count() == 0 and langid.accepted(docs, model).count() == docs.count()
    clash = docs.withColumn("lang_pred", F.lit(1)).withColumn("_text", F.lit("x"))
    assert langid.accepted(clash, model).exceptAll(clash).count() == 0
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = corpus(spark)
    other = docs.withColumn("lang", F.when(langid.remainder("doc_id", 5) == 0, "xx").otherwise(F.col("lang")))
    a, b = langid.trained(docs), langid.trained(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_elastic_net_gives_zeros(spark):
    rows = [(np.array([0, 1]), np.array([0.9, 0.1]), 0), (np.array([0, 2]), np.array([0.1, 0.9]), 1)] * 20
    w = langid.follow_the_leader(rows, 8, 2)
    assert (w[3:] == 0).all() and w[1:3].any()
    assert not langid.follow_the_leader(rows, 8, 2, l1=1e6).any()


def slow_grams(text, buckets):
    """gram_counts with loops over single characters and numbers of Python."""
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    if not text.strip():
        return None
    if text[0] == " ":
        text = text[1:] if text[1:2] == " " else text
    kept = [c for k, c in enumerate(text) if c != " " or (k and text[k - 1] != " ")]
    codes, m, counts = [32, *(ord(c) for c in kept), 32], (1 << 32) - 1, {}
    shift = 32 - (buckets.bit_length() - 1)
    a = [c * 0x9E3779B1 & m for c in codes]
    two = [((x ^ 0x5BD1E995) * 0x85EBCA6B + y) & m for x, y in zip(a, a[1:])]
    three = [((x ^ 0x27D4EB2F) * 0xC2B2AE35 + y) & m for x, y in zip(two, a[2:])]
    for values, factor in ((a, 0x165667B1), (two, 0x27220A95), (three, 0x9E3779B1)):
        for v in values:
            k = (v * factor & m) >> shift
            counts[k] = counts.get(k, 0) + 1
    return counts


def test_like_brute_force(spark, sf, odd):
    """Document frequencies and every prediction, computed with dictionaries and loops."""
    import math
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.where("length(text) < 10000 or text is null").select("doc_id", "text", "lang"))
    model = langid.trained(docs)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    buckets, seen, n = len(model.idf), {}, 0
    for d, t, lang in rows:
        grams = slow_grams(t, buckets) if t and lang and zlib.crc32(str(d).encode() if d is not None else b"") % 5 else None
        if grams:
            n += 1
            for k in grams:
                seen[k] = seen.get(k, 0) + 1
    assert all(abs(model.idf[k] - (math.log((1 + n) / (1 + seen.get(k, 0))) + 1)) < 1e-4 for k in range(buckets))
    got = {}
    for r in langid.identified(docs, model, keep=("doc_id", "text")).collect():
        got.setdefault((r["doc_id"], r["text"]), []).append((r["lang_pred"], r["score"]))
    for d, t, _ in rows:
        grams = slow_grams(t, buckets) if t else None
        if not grams:
            want = ("und", 0.0)
        else:
            x = {k: math.log1p(c) * float(model.idf[k]) for k, c in grams.items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            z = [sum(v / norm * float(model.weights[k, j]) for k, v in x.items()) / model.temperature for j in range(len(model.languages))]
            e = [math.exp(v - max(z)) for v in z]
            want = (model.languages[z.index(max(z))], max(e) / sum(e))
        for lang, score in got[d, t]:
            assert abs(score - want[1]) < 1e-3 and (lang == want[0] or abs(want[1] - 1 / 2) < 1e-2)
