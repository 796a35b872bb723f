"""Language-model scores: a gated recurrent network in numpy with a class-factored output softmax.

Words are counted over every training row (summed per task, then by word). The `heads` most frequent words, a bounded table,
go out with the tasks; counts of all other words stay a table and are joined by word, so the vocabulary has no bound.
The network knows the end mark, the most frequent words and one mark for any other word; these are dealt by rank into
classes, and a word's probability is that of its class times that within its class (times its smoothed share of the other
words, from the counts over all training rows). Training is truncated backpropagation over windows of `WINDOW` tokens with
the state carried on. The training rows are dealt into `rounds` parts by hash; in each round every task trains on its rows of
one part, from common weights, and the tasks' weights are averaged by their tokens. So every training row is trained on once,
and later rounds start from what earlier ones learned of the whole corpus. Scoring goes through whole documents window by
window, the state carried across.

Defined results: null text counts as empty and has the end token only; ids may repeat or be null (null counts as the empty
text in the split); other columns are ignored; an empty table gives no rows; with no training row every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix, one_thread, pieces, scratch, word_hashes
from .langid import remainder

END = int(mix(np.array([1], np.uint64)).view(np.int64)[0])
CLASSES, MEMBERS = 48, 48
WORDS = CLASSES * MEMBERS
HIDDEN = 16
STREAMS, WINDOW, CHUNK = 512, 20, 4096
PIECE = 5 << 20
FAN_IN = 64
END_ID, OTHER_ID = 0, 1
Weights = dict[str, np.ndarray]


def token_streams(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's words and then END; n + 1 offsets."""
    words, at, _, _ = word_hashes(*buffers(batch_text))
    return np.insert(words.view(np.int64), at[1:], END), at + np.arange(len(at))


# ---------------------------------------------------------------- network


def shapes() -> dict[str, tuple[int, ...]]:
    return {"inputs": (WORDS, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "classes": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "members": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}


def initial(counts: np.ndarray, seed: int = 5) -> Weights:
    """Random gates; output biases at the words' frequencies. counts: by id, 0 for ids that no word has."""
    random = np.random.default_rng(seed)
    w = {k: random.normal(0, 0.3 if k == "inputs" else s[0] ** -0.5 if len(s) == 2 else HIDDEN**-0.5, s).astype(np.float32) * (0.1 if k in ("classes", "members") else 1) for k, s in shapes().items()}
    share = (counts.reshape(CLASSES, MEMBERS) + 0.5).astype(np.float64)
    w["class_bias"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
    w["member_bias"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
    return {k: v.astype(np.float32) for k, v in w.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(w: Weights, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The next state of each row; x: word ids."""
    a, u = w["inputs"][x], h @ w["state"]
    gates = sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    v = u[:, 2 * HIDDEN :]
    n = np.tanh(a[:, 2 * HIDDEN :] + r * v)
    return h + z * (n - h), (x, h, z, r, v, n)


def softmax_parts(x: np.ndarray, y: np.ndarray, rows: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of column y of each row of logits x (changed in place), and, if wanted, the gradient of its negative."""
    np.clip(x, -60, 60, out=x)  # far beyond what a state of values within 1 gives; no row needs its maximum then
    chosen = x[rows, y]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    log = chosen - np.log(total)
    if not want:
        return log, None
    x *= (1 / total)[:, None]
    x[rows, y] -= 1
    return log, x


def outputs(w: Weights, h: np.ndarray, y: np.ndarray, grad: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each word y after state h; with grad, adds gradients and returns those of h."""
    order = np.argsort(y, kind="stable")
    h, y = h[order], y[order]
    c, m = y // MEMBERS, y % MEMBERS
    rows = np.arange(len(y))
    found, d = softmax_parts(h @ w["classes"] + w["class_bias"], c, rows, grad is not None)
    dh = None
    if grad is not None:
        grad["classes"] += h.T @ d
        grad["class_bias"] += d.sum(0)
        dh = d @ w["classes"].T
    borders = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    for k in range(CLASSES):
        a, b = borders[k], borders[k + 1]
        if a < b:
            second, d = softmax_parts(h[a:b] @ w["members"][k] + w["member_bias"][k], m[a:b], rows[: b - a], grad is not None)
            found[a:b] += second
            if grad is not None:
                grad["members"][k] += h[a:b].T @ d
                grad["member_bias"][k] += d.sum(0)
                dh[a:b] += d @ w["members"][k].T
    total = np.empty_like(found)
    total[order] = found
    if grad is not None:
        back = np.empty_like(dh)
        back[order] = dh
        dh = back
    return total, dh


def backward(w: Weights, x: np.ndarray, y: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Truncated backpropagation through one window. x, y: windows x streams of ids; h: states before it; fresh: where a text starts."""
    grad = {k: np.zeros(s, h.dtype) for k, s in shapes().items()}
    states, kept = [], []
    for t in range(len(x)):
        if fresh[t].any():
            h = np.where(fresh[t][:, None], np.zeros((), h.dtype), h)
        h, saved = step(w, x[t], h)
        states.append(h)
        kept.append(saved)
    total, dy = outputs(w, np.concatenate(states), y.reshape(-1), grad)
    dy = dy.reshape(len(x), -1, HIDDEN)
    dh, dh_state = np.zeros_like(h), np.zeros((HIDDEN, 3 * HIDDEN), h.dtype)
    da = np.empty((*x.shape, 3 * HIDDEN), h.dtype)
    back = np.ascontiguousarray(w["state"].T)
    for t in range(len(x) - 1, -1, -1):
        _, before, z, r, v, n = kept[t]
        dh += dy[t]
        dz, dr, dn = da[t, :, :HIDDEN], da[t, :, HIDDEN : 2 * HIDDEN], da[t, :, 2 * HIDDEN :]
        rest = 1 - z
        np.multiply(dh * z, 1 - n * n, out=dn)
        np.multiply(dh * (n - before), z * rest, out=dz)
        np.multiply(dn * v, r * (1 - r), out=dr)
        du = da[t].copy()
        du[:, 2 * HIDDEN :] *= r
        dh_state += before.T @ du
        dh *= rest
        dh += du @ back
        if fresh[t].any():
            dh[fresh[t]] = 0
    grad["state"] = dh_state
    da = da.reshape(-1, 3 * HIDDEN)
    ids = x.reshape(-1)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
    grad["inputs"][ids[order][first]] = np.add.reduceat(da[order], first)
    return grad, h, float(total.sum())


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.w, self.rate, self.k = w, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def apply(self, grad: Weights, scale: float, words: np.ndarray) -> None:
        """words: the ids that the window reads; only their input rows move."""
        self.k += 1
        rate = self.rate * (1 - 0.99**self.k) ** 0.5 / (1 - 0.9**self.k)
        for k, g in grad.items():
            at = words if k == "inputs" else slice(None)
            g = np.clip(g[at] * scale, -1, 1)
            m, v = self.m[k][at], self.v[k][at]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.w[k][at] -= rate * m / (np.sqrt(v) + 1e-6)
            if k == "inputs":
                self.m[k][at], self.v[k][at] = m, v


def train(adam: Adam, ids: np.ndarray, offsets: np.ndarray) -> int:
    """Trains on texts laid end to end in STREAMS streams; returns the tokens used (a rest shorter than a window of all streams is left)."""
    streams = min(STREAMS, max(1, len(ids) // WINDOW))
    long = len(ids) // streams // WINDOW * WINDOW
    if not long:
        return 0
    before = np.r_[END_ID, ids[:-1]]
    fresh = np.zeros(len(ids) + 1, bool)
    fresh[offsets] = True
    cut = lambda a: a[: streams * long].reshape(streams, long).T.copy()
    x, y, f = cut(before), cut(ids), cut(fresh[:-1])
    f[0] = True
    h = np.zeros((streams, HIDDEN), np.float32)
    for t in range(0, long, WINDOW):
        grad, h, _ = backward(adam.w, x[t : t + WINDOW], y[t : t + WINDOW], h, f[t : t + WINDOW])
        adam.apply(grad, 1 / (streams * WINDOW) ** 0.5, np.unique(x[t : t + WINDOW]))
    return streams * long


def score_texts(w: Weights, ids: np.ndarray, offsets: np.ndarray, window: int = 128) -> np.ndarray:
    """Natural log probability of each whole text (ids end with END_ID), states carried from window to window."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    total = np.zeros(len(order))
    before = np.r_[END_ID, ids[:-1]]
    before[offsets[:-1][lengths[np.argsort(order)] > 0]] = END_ID
    h = np.zeros((len(order), HIDDEN), np.float32)
    for t0 in range(0, int(lengths.max(initial=0)), window):
        states, targets, rows = [], [], []
        for t in range(t0, min(t0 + window, int(lengths[0]))):
            n = int(np.searchsorted(-lengths, -t, "left"))  # texts longer than t
            h = h[:n]
            at = starts[:n] + t
            h, _ = step(w, before[at], h)
            states.append(h)
            targets.append(ids[at])
            rows.append(np.arange(n))
        s, y, r = np.concatenate(states), np.concatenate(targets), np.concatenate(rows)
        for k in range(0, len(y), 1 << 16):
            part = slice(k, k + (1 << 16))
            total += np.bincount(r[part], outputs(w, s[part], y[part])[0], len(total))
    out = np.empty(len(order))
    out[order] = total
    return out


# ---------------------------------------------------------------- corpus


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): hash and count of each token of all texts, END among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text, 1 << 23):
            words, n = np.unique(token_streams(b.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["word", "n"])

    return texts.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words, sorted by hash, with counts and network ids; len(words) is bounded by `heads`."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int):
        rank = np.lexsort((words, -counts))
        rank = rank[words[rank] != END]
        ids = np.full(len(words), OTHER_ID, np.int32)
        ids[rank[: WORDS - 2]] = np.arange(2, min(len(rank), WORDS - 2) + 2)
        ids[words == END] = END_ID
        order = np.argsort(words)
        self.words, self.counts, self.ids = words[order], counts[order], ids[order]
        # where the words with the same leading bits begin: a few steps from there, not a search of the whole table
        bits = max(4, (8 * len(words)).bit_length())
        self.shift = 64 - bits
        of = (self.words >> self.shift) + (1 << (bits - 1))
        sizes = np.bincount(of, minlength=1 << bits)
        self.most = int(sizes.max(initial=0))
        self.begin = np.minimum(np.cumsum(sizes) - sizes, max(0, len(words) - 1))
        self.total, self.kinds = total, kinds
        self.id_counts = np.bincount(self.ids, self.counts, WORDS)
        named = self.ids != OTHER_ID
        self.other_total = total - int(self.counts[named].sum())
        self.other_kinds = kinds - int(named.sum())
        self.id_counts[OTHER_ID] = self.other_total
        self.log_all = np.log10(total + kinds + 1.0)
        self.log_other = np.log10(self.other_total + self.other_kinds + 1.0)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table and network id of each token; place -1 if it isn't there."""
        if not len(self.words):
            return np.full(len(tokens), -1), np.where(tokens == END, END_ID, OTHER_ID).astype(np.int32)
        at = self.begin[(tokens >> self.shift) + (len(self.begin) >> 1)]
        for _ in range(self.most):  # words with the same leading bits lie side by side
            at += self.words[at] < tokens
            np.minimum(at, len(self.words) - 1, out=at)
        hit = self.words[at] == tokens
        return np.where(hit, at, -1), np.where(hit, self.ids[at], np.where(tokens == END, END_ID, OTHER_ID)).astype(np.int32)


def trained(texts: DataFrame, vocabulary, weights: Weights, rounds: int, rate: float) -> Weights:
    """In each round, local training from common weights in each task, then averages by tokens. texts: (text, part), part below `rounds`."""
    spark = texts.sparkSession
    names = list(shapes())
    flat = lambda w: np.concatenate([w[k].ravel() for k in names])

    def unflat(x: np.ndarray) -> Weights:
        at, out = 0, {}
        for k, s in shapes().items():
            n = int(np.prod(s))
            out[k] = x[at : at + n].reshape(s).astype(np.float32)
            at += n
        return out

    for k in range(rounds):
        start = spark.sparkContext.broadcast(flat(weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            one_thread()
            words = vocabulary.value
            adam, used = Adam(unflat(start.value.copy()), rate / (1 + k)), 0  # noqa: B023
            for b in pieces(batches, "text", PIECE):
                tokens, offsets = token_streams(b.column(0))
                used += train(adam, words.find(tokens)[1], offsets)
            if used:
                x = flat(adam.w).astype(np.float64) * used
                parts = [x[i : i + CHUNK].tobytes() for i in range(0, len(x), CHUNK)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(parts, pa.binary()), pa.array([used] * n, pa.int64())], ["part", "task", "sums", "used"])

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in group.column("sums").to_pylist())
            return pa.table({"part": group.column("part")[:1], "task": pa.array([group.column("task")[0].as_py() // FAN_IN], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary()), "used": pa.array([sum(group.column("used").to_pylist())], pa.int64())})

        # a tree of sums: no group has more than FAN_IN rows of CHUNK numbers, however many tasks there are
        schema, tasks = "part int, task long, sums binary, used long", texts.rdd.getNumPartitions()
        sums = texts.where(F.col("part") == k).select("text").mapInArrow(run, schema)
        while True:
            sums = sums.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("_up")).applyInArrow(add, schema)
            if tasks <= FAN_IN:
                break
            tasks = -(-tasks // FAN_IN)
        got = sorted(sums.collect(), key=lambda r: r["part"])
        if got:
            weights = unflat(np.concatenate([np.frombuffer(r["sums"], np.float64) for r in got]) / got[0]["used"])
        start.unpersist()
    return weights


def scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, heads: int = 1 << 17, rounds: int = 2, rate: float = 0.015) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; learns from rows whose crc32(doc_id) mod `folds` is not `held_out`."""
    spark = df.sparkSession
    out = remainder(doc_id, folds) == held_out
    named = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), out.alias("held_out"))
    learn = named.where("not held_out")
    counts = scratch(word_counts(learn.select("text")), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(heads).toArrow()
    own = Vocabulary(top.column("word").to_numpy(), top.column("n").to_numpy(), sums["n"], sums["v"])
    vocabulary = spark.sparkContext.broadcast(own)
    chosen = learn.select("text", F.pmod(F.xxhash64(F.lit("lm"), "doc_id"), F.lit(rounds)).alias("part"))
    weights = spark.sparkContext.broadcast(trained(chosen, vocabulary, initial(own.id_counts), rounds, rate))
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        words, w = vocabulary.value, weights.value
        logs = np.r_[np.log10(words.counts + 1.0) - words.log_all, 0.0]  # a token that isn't in the table adds its part later
        other_logs = np.r_[np.where(words.ids == OTHER_ID, np.log10(words.counts + 1.0) - words.log_other, 0.0), 0.0]
        for b in pieces(batches, "text", PIECE):
            tokens, offsets = token_streams(b.column(1))
            place, ids = words.find(tokens)
            n = np.diff(offsets)
            of = np.repeat(np.arange(len(n)), n)
            by = lambda x: np.bincount(of, x, len(n))  # noqa: B023, E731
            missed = np.flatnonzero(place < 0)
            pair = np.lexsort((tokens[missed], of[missed]))
            t, o = tokens[missed][pair], of[missed][pair]
            first = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(o) != 0)]) if len(t) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(t)])
            borders = pa.array(np.searchsorted(o[first], np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(n), pa.array(by(place >= 0).astype(np.int64)), pa.array(by(logs[place])), pa.array(score_texts(w, ids, offsets) / np.log(10) + by(other_logs[place])), pa.ListArray.from_arrays(borders, pa.array(t[first])), pa.ListArray.from_arrays(borders, pa.array(times.astype(np.int64)))],
                ["doc_id", "held_out", "_row", "n_tokens", "known", "base", "lm", "words", "times"],
            )

    rows = named.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("_row")).mapInArrow(run, f"doc_id {kind}, held_out boolean, _row long, n_tokens long, known long, base double, lm double, words array<long>, times array<long>")
    rows = scratch(rows, "lm-rows")
    rare = rows.select("_row", F.explode(F.arrays_zip("words", "times")).alias("e")).select("_row", F.col("e.words").alias("word"), F.col("e.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    each = rare.join(counts, "word", "left").select("_row", F.when(c > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * (F.log10(c + 1) - float(own.log_all))).alias("base"), (F.col("times") * (F.log10(c + 1) - float(own.log_other))).alias("lm"))
    more = each.groupBy("_row").agg(F.sum("known").alias("known2"), F.sum("base").alias("base2"), F.sum("lm").alias("lm2"))
    zero = F.lit(0.0)
    return rows.join(more, "_row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(sums["n"]).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("lm") + F.coalesce("lm2", zero)).alias("score"))
