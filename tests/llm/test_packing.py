import zlib

import numpy as np
from pyspark.sql import functions as F

from vaultloom.llm import packing, token_matrix, tokens
from vaultloom.llm.queries import QUERIES


def all_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokenizer_gives_the_ids_of_tokenizers(sf, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["", "a'll  \n\n x ", "<|endoftext|>", "½ ² １２ \x85", "é\u0301 \U0001f600", "a" * 50_000, " " * 5000]
    assert [list(x) for x in tokens.TextTokenizer(tokens.default_path()).encode(texts)] == all_ids(texts)


def test_long_runs_give_the_ids_of_tokenizers():
    texts = [" " * 3_000_000 + "a", "\n" * 3_000_000 + "x", "abcde" * 600_000, " \n\t" * 700_000 + "z"]
    assert [x.tolist() for x in tokens.TextTokenizer(tokens.default_path()).encode(texts)] == all_ids(texts)


def test_other_files_take_the_plain_way():
    import public_tokenizers

    t = tokens.TextTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert t.fast is None and len(t.encode(["Hello there"])[0]) > 0


def test_difference_keeps_all_parts_and_levels():
    sizes = [8, 7, 6, 5, 4]
    groups = packing.difference(sizes, 2)
    assert sorted(k for g in groups for k in g) == list(range(5))
    assert sorted(sum(sizes[k] for k in g) for g in groups) == [14, 16]
    r = np.random.default_rng(1)
    for n, w in ((1, 1), (3, 5), (200, 7), (500, 40)):
        sizes = r.integers(1, 500, n).tolist()
        groups = packing.difference(sizes, w)
        assert sorted(k for g in groups for k in g) == list(range(n)) and len(groups) <= w
    sums = [sum(sizes[k] for k in g) for g in groups]
    assert max(sums) - min(sums) <= 50


def test_window_count_rises_beyond_capacity():
    groups = packing.pack_pool([60, 60, 60], 100)
    assert len(groups) == 3 and packing.pack_pool([], 100) == []


def check(rows, texts):
    ids = {k: [*x, 1] for k, x in enumerate(all_ids(texts))}
    by_seq, tokens_of = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        tokens_of.setdefault(r["n_chars"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for k, parts in tokens_of.items():
        parts.sort()
        assert sum((p[1] for p in parts), []) == ids[k]
        assert [p[0] for p in parts] == np.cumsum([0, *(len(p[1]) for p in parts[:-1])]).tolist()
        assert {p[2] for p in parts} == {len(ids[k])}
    assert set(tokens_of) == set(ids)


def test_pieces_give_all_ids_once(odd, none):
    rows = odd.collect()
    numbered = odd.sparkSession.createDataFrame([(k, r["text"]) for k, r in enumerate(rows)], "n_chars long, text string")
    got = packing.packed(numbered.withColumn("ids", F.lit(1)).withColumn("doc_id", F.lit("x")), "n_chars").withColumnRenamed("doc_id", "n_chars").collect()
    check(got, [r["text"] for r in rows])
    assert packing.packed(none).count() == 0
    assert packing.packed(odd).select("doc_id").where("doc_id is null").count() >= 2


def test_op1(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(docs, all_ids(docs.values())))
    total, pads, sizes = 0, 0, {}
    for r in QUERIES["op1_pack"](spark, sf).collect():
        part = np.array([*ids[r["doc_id"]], 1], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) + 1
        total += r["length"]
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert total == sum(len(x) + 1 for x in ids.values())
    pads = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert pads < 0.03 * total


def brute_best_fit(sizes, capacity):
    rows = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in rows if r[0] >= sizes[k]]
        if not fits:
            rows.append([capacity, []])
            fits = rows[-1:]
        best = min(r[0] for r in fits)
        row = next(r for r in fits if r[0] == best)
        row[0] -= sizes[k]
        row[1].append(k)
    return [r[1] for r in rows]


def test_best_fit_like_brute_force():
    r = np.random.default_rng(2)
    for n in (0, 1, 50, 400):
        sizes = r.integers(1, 101, n).tolist()
        got, want = token_matrix.best_fit(sizes, 100), brute_best_fit(sizes, 100)
        assert [sum(sizes[k] for k in g) for g in got].count(100) == [sum(sizes[k] for k in g) for g in want].count(100)
        assert len(got) == len(want) and all(sum(sizes[k] for k in g) <= 100 for g in got)
        assert sorted(k for g in got for k in g) == list(range(n))


def test_matrix_round_trip(odd, none):
    rows = odd.collect()
    numbered = odd.sparkSession.createDataFrame([(k, r["text"]) for k, r in enumerate(rows)], "doc_id long, text string")
    want = {k: [*x, 50256] for k, x in enumerate(all_ids([r["text"] for r in rows]))}
    got = token_matrix.written(token_matrix.matrix_rows(numbered)).withColumn("p", token_matrix.position_ids(F.col("cu_seqlens"))).collect()
    found = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 2048 and r["cu_seqlens"][-1] == r["n_tokens"] and r["resets"] == r["cu_seqlens"][:-1] and len(r["p"]) == 2048
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
            assert r["p"][a:b] == list(range(b - a))
        assert not ids[r["n_tokens"] :].any()
    assert {k: sum((x for _, x in sorted(v)), []) for k, v in found.items()} == want
    assert token_matrix.matrix_rows(none).count() == 0


def test_op3_covers_all_documents(spark, sf):
    rows = QUERIES["op3_token_matrix"](spark, sf)
    docs = rows.select(F.explode("doc_ids").alias("doc_id")).distinct()
    assert docs.count() == spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count()
