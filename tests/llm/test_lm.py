import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from conftest_rows import plain
from pyspark.sql import functions as F

from vaultloom.llm import lm
from vaultloom.llm.queries import QUERIES

UP = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP)), " "]


def check_base(rows, got):
    train = collections.Counter()
    for d, t in rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2:
            train.update(tokens(t))
    total, kinds = sum(train.values()), len(train)
    want = collections.Counter()
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((train[x] + 1) / (total + kinds + 1)) for x in w)
        want[d, zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), total, round(base, 4)] += 1
    assert want == collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)


def test_op2(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_lm"](spark, sf).collect()
    check_base(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows_and_rare_words(spark, odd, none):
    """A table of 20 frequent words sends nearly all words through the join."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lm.scores(odd.withColumn("word", F.lit(1)), heads=20).collect()
    check_base(rows, got)
    full = lm.scores(odd).collect()
    assert all(r["score"] < 0 for r in got) and sorted(r["n_tokens"] for r in got) == sorted(r["n_tokens"] for r in full)
    assert lm.scores(none).count() == 0


def test_network_learns_from_every_training_row_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "trained", lambda texts, vocabulary, weights, rounds, rate: seen.append((rounds, texts.collect())) or weights)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    QUERIES["op2_lm"](spark, sf)
    rounds, rows = seen[0]
    want = [r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    assert sorted(r["text"] or "" for r in rows) == sorted(t or "" for t in want) and {r["part"] for r in rows} == set(range(rounds))


def setup(n=60):
    texts = [plain(3 + 7 * k % 90, seed=k) for k in range(n)]
    hashes, offsets = lm.token_streams(pa.array(texts))
    words, counts = np.unique(hashes, return_counts=True)
    vocabulary = lm.Vocabulary(words, counts, len(hashes), len(words))
    return vocabulary, vocabulary.find(hashes)[1], offsets


def test_probabilities_sum_to_one():
    v, _, _ = setup()
    w = lm.initial(v.id_counts)
    h = np.random.default_rng(1).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    total = np.exp(lm.outputs(w, np.repeat(h, lm.WORDS, 0), np.arange(lm.WORDS))[0]).sum()
    assert abs(total - 1) < 1e-4
    others = 10**-v.log_other * (v.other_total + v.other_kinds + 1)  # known other words and one unknown
    assert abs(others - 1) < 1e-9


def test_gradients():
    v, ids, _ = setup()
    w = {k: x.astype(np.float64) for k, x in lm.initial(v.id_counts).items()}
    x, y = ids[:40].reshape(8, 5), ids[40:80].reshape(8, 5)
    fresh, h = np.random.default_rng(1).random((8, 5)) < 0.2, np.zeros((5, lm.HIDDEN))
    grad, _, before = lm.backward(w, x, y, h, fresh)
    for k in w:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        w[k][at] += 1e-5
        after = lm.backward(w, x, y, h, fresh)[2]
        w[k][at] -= 1e-5
        assert abs((before - after) / 1e-5 - grad[k][at]) < 1e-2 * max(1, abs(grad[k][at]))


def test_state_is_carried_across_windows():
    v, ids, offsets = setup()
    adam = lm.Adam(lm.initial(v.id_counts), 0.01)
    before = lm.score_texts(adam.w, ids, offsets).sum()
    for _ in range(5):
        lm.train(adam, ids, offsets)
    whole = lm.score_texts(adam.w, ids, offsets, window=10**6)
    assert np.allclose(whole, lm.score_texts(adam.w, ids, offsets, window=3), rtol=1e-4) and whole.sum() > before
    alone = np.array([lm.score_texts(adam.w, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets, offsets[1:])])
    assert np.allclose(whole, alone, rtol=1e-4)
