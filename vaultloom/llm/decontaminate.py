"""Benchmark decontamination: edit distance mapped to Hamming distance by random walks, bit sampling, exact verification.

The CGK walk reads characters: at step j it puts out the character under its pointer, and the pointer moves on if bit j of
that character is set. Two texts a few edits apart fall back into step, so their walks differ at few of the steps. A key is a
hash of the walk at `sampled` random steps of `steps`; each of the `repeats` has walk bits and sampled steps of its own.
A walk over a whole item is out of step for good once every fifth character is edited, so an item-sized window is keyed at all
its characters: every character of an item and every `stride`-th of a document begins a walk of `steps` steps, and one walk of
the window that meets is enough (tests/llm measures the recall).

A meeting is tested by the edit distance of the 64 characters of the item around it (bit vectors, many meetings at once); what
is left is verified by the exact character edit distance between the item and the best-fitting part of the document.
Items of fewer than 64 characters are searched without loss: cut into one piece more than the edits allowed, one piece must be unedited.

Items go out with the tasks in blocks of at most `block_items` (by hash of the id), about 20 kB an item, so the size of a
block is bounded and any number of items is served, at one pass over the documents a block; documents are never shuffled.

Defined results: null or blank texts and items match nothing; ids may repeat or be null (each row of documents stands for
itself, and items with one id are searched separately, the best one counting); other columns are ignored; empty tables give no
rows; whole texts are searched, at any character, also within words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, pieces

CLASSES, WORD = 128, 64
BORDER = 10
BLOCK = 1 << 14
_BLANKS = re.compile("[\t-\r ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def normal(text: str) -> str:
    """A-Z lower-cased, words [^\\x20\\x09-\\x0D]+ joined by one space."""
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return " ".join(w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w)


def best_part(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any part of the text, and where the first such part ends (Myers' bit vectors)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << m - 1
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    plus, minus, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, k
    return best, end


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of CLASSES values for each character of normal(text) of all texts, laid end to end, from their UTF-8 bytes.

    ASCII stands for itself, other characters share the values of A to Z, which no normal text has. Also returned: which
    bytes begin those characters, and the n + 1 places where texts begin.
    """
    n = len(raw)
    classes = _CLASS[raw]
    blank = classes == 32
    keep = raw & 0xC0 != 0x80
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    # a blank stays if a word of the same text came right before it and another one follows
    keep[1:] &= ~(blank[1:] & (blank[:-1] | edge[1:-1]))
    if n:
        keep[0] &= not blank[0]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        mixed = raw[lead].astype(np.uint32) * np.uint32(31) + raw[np.minimum(lead + 1, n - 1)] * np.uint32(7)
        wide = raw[lead] >= 0xE0
        mixed[wide] = mixed[wide] * np.uint32(13) + raw[np.minimum(lead[wide] + 2, n - 1)]
        classes[lead] = 65 + mixed % np.uint32(26)
    for k in np.flatnonzero(np.diff(offsets)).tolist():  # the blank at a text's end, before the blanks that went already
        at, begin = int(offsets[k + 1]) - 1, int(offsets[k])
        while at >= begin and not keep[at]:
            at -= 1
        if at >= begin and blank[at]:
            keep[at] = False
    counts = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
    np.cumsum(keep, out=counts[1:])
    return classes[keep], keep, counts[offsets].astype(np.int64)


def _class_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[9:14] = 32
    out[128:] = 65  # bytes within a character; its first one is set apart
    return out


_CLASS = _class_table()


class Walks:
    """Keys of walks that begin at given characters, one array a repeat."""

    def __init__(self, repeats: int, steps: int, sampled: int, seed: int = 11):
        random = np.random.default_rng(seed)
        self.repeats, self.steps = repeats, steps
        self.bits = random.integers(-(1 << 63), 1 << 63, (repeats, CLASSES), dtype=np.int64)
        self.order = random.permuted(np.tile(np.arange(62), (repeats, 1)), axis=1)  # the bit that moves the pointer at each step
        self.sampled = np.array([np.isin(np.arange(steps), random.choice(steps, min(sampled, steps), replace=False)) for _ in range(repeats)])

    def keys(self, classes: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
        """classes: of the characters, followed by at least `steps` of anything."""
        bits, at = self.bits[repeat][classes], starts.astype(np.int64)
        total, here, move = np.zeros(len(at), np.int64), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for j in range(self.steps):
            np.take(bits, at, out=here, mode="clip")
            if self.sampled[repeat, j]:
                total *= _FACTOR
                total += here
            np.right_shift(here, self.order[repeat, j % 62], out=move)
            move &= 1
            at += move
        return (total * _FACTOR).view(np.uint64)


_FACTOR = np.int64(0x5851F42D4C957F2D)


def chunk_distances(masks: np.ndarray, lengths: np.ndarray, which: np.ndarray, classes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least edit distance of pattern which[k] (up to 64 characters) to any part of classes[begin[k]:end[k]], all at once."""
    best = np.empty(len(which), np.int64)
    for at in range(0, len(which), 1 << 13):
        part = slice(at, at + (1 << 13))
        w, a, b = which[part], begin[part], end[part]
        high = (lengths[w] - 1).astype(np.uint64)
        flat, base, one = masks.reshape(-1), w * CLASSES, np.uint64(1)
        plus, minus = np.full(len(w), ~np.uint64(0)), np.zeros(len(w), np.uint64)
        score = lengths[w].astype(np.int64)
        least = score.copy()
        for j in range(int((b - a).max(initial=0))):
            eq = flat[base + classes[np.minimum(a + j, b - 1)]]
            eq[a + j >= b] = 0
            xv = eq | minus
            xh = ((eq & plus) + plus ^ plus) | eq
            ph = minus | ~(xh | plus)
            mh = plus & xh
            score += ((ph >> high) & one).astype(np.int64) - ((mh >> high) & one).astype(np.int64)
            ph <<= one
            mh <<= one
            plus, minus = mh | ~(xv | ph), ph & xv
            np.minimum(least, score, out=least)
        best[part] = least
    return best


class Items:
    """A block of items with the keys of all their walks (or of the pieces of short ones), and bit masks of their chunks."""

    def __init__(self, rows: list[tuple], share: float, repeats: int, steps: int, sampled: int, stride: int):
        self.ids = [r[0] for r in rows]
        self.texts = [normal(r[1]) for r in rows]
        self.share, self.stride = share, stride
        self.walks = Walks(repeats, steps, sampled)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.most = (self.lengths * share).astype(np.int64)
        each: list[tuple[list, list]] = [([], []) for _ in range(repeats)]
        short: dict[int, tuple[list, list]] = {}
        chunks, self.chunk_length, self.first_chunk = [], [], []
        for k, t in enumerate(self.texts):
            raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
            c = characters(raw, np.array([0, len(raw)]))[0]
            self.first_chunk.append(len(chunks))
            for a in range(0, max(len(c) - WORD // 2, min(1, len(c))), WORD // 2):
                a = max(0, min(a, len(c) - WORD))
                mask = np.zeros(CLASSES, np.uint64)
                np.bitwise_or.at(mask, c[a : a + WORD], np.uint64(1) << np.arange(len(c[a : a + WORD]), dtype=np.uint64))
                chunks.append(mask)
                self.chunk_length.append(len(c[a : a + WORD]))
            if not len(c):
                continue
            if len(c) < WORD:
                borders = np.linspace(0, len(c), int(self.most[k]) + 2).astype(int)
                for a, b in zip(borders, borders[1:]):
                    keys, refs = short.setdefault(min(4, b - a), ([], []))
                    keys.append(self.gram(c[a : a + 4], min(4, b - a))[0])
                    refs.append((k, a))
                continue
            for r, (keys, refs) in enumerate(each):  # walks that leave the item depend on what follows it
                found, other = (self.walks.keys(np.r_[c, np.full(steps, pad, np.uint8)], np.arange(len(c)), r) for pad in (BORDER, 0))
                at = np.flatnonzero(found == other)
                keys.append(found[at])
                refs.append(np.stack((np.full(len(at), k), at), 1))
        self.masks = np.array(chunks, np.uint64).reshape(-1, CLASSES)
        self.chunk_length, self.first_chunk = np.array(self.chunk_length, np.int64), np.array(self.first_chunk, np.int64)
        self.tables = [self._table(np.concatenate(k), np.concatenate(r)) if k else None for k, r in each]
        self.short = {size: self._table(np.array(k, np.uint64), np.array(r)) for size, (k, r) in short.items()}

    @staticmethod
    def gram(classes: np.ndarray, size: int) -> np.ndarray:
        """A number for the `size` (1 to 4) characters from each place on, spread over 64 bits."""
        n = len(classes) - size + 1
        packed = np.zeros(max(n, 0), np.uint64)
        for k in range(size):
            packed = packed << np.uint64(7) | classes[k : n + k]
        return (packed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _table(keys: np.ndarray, refs: np.ndarray) -> tuple:
        order = np.argsort(keys, kind="stable")
        keys, refs = keys[order], refs[order].astype(np.int32)
        bits = min(26, max(16, (16 * len(keys)).bit_length()))
        bitmap = np.zeros(1 << bits, bool)
        bitmap[keys >> np.uint64(64 - bits)] = True
        return keys, refs, np.uint64(64 - bits), bitmap

    @staticmethod
    def _met(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys in the table, and the (item, character) listed there."""
        known, refs, shift, bitmap = table
        at = np.flatnonzero(bitmap[keys >> shift])
        low, high = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), refs[which].astype(np.int64)

    def meetings(self, classes: np.ndarray) -> Iterator[np.ndarray]:
        """(place, item, its character) of the walks and pieces met, block by block. Every `stride`-th character begins walks."""
        padded = np.r_[classes, np.full(max(self.walks.steps, 4), BORDER, np.uint8)]
        block = BLOCK * self.stride
        for begin in range(0, len(classes), block):
            n = min(block, len(classes) - begin)
            starts, part = np.arange(0, n, self.stride), padded[begin : begin + n + self.walks.steps]
            for r, table in enumerate(self.tables):
                if table:
                    at, refs = self._met(table, self.walks.keys(part, starts, r))
                    yield np.c_[at * self.stride + begin, refs]
            for size, table in self.short.items():
                at, refs = self._met(table, self.gram(padded[begin : begin + n + size - 1], size))
                yield np.c_[at + begin, refs]

    def candidates(self, classes: np.ndarray) -> np.ndarray:
        """(place where the item would begin, item) of the meetings whose surroundings are near enough."""
        kept = []
        held, size = [], 0

        def test() -> None:
            m = np.concatenate(held)
            k, at = m[:, 1], m[:, 0] - m[:, 2]
            chunk = np.clip((m[:, 2] + 8 - WORD // 4) // (WORD // 2), 0, np.maximum(0, -(-(self.lengths[k] - WORD) // (WORD // 2))))
            _, first = np.unique(np.stack((at, k << 20 | chunk)), axis=1, return_index=True)
            k, at, chunk = k[first], at[first], chunk[first]
            begin = np.maximum(0, np.minimum(chunk * (WORD // 2), self.lengths[k] - WORD))
            which = self.first_chunk[k] + chunk
            length = self.chunk_length[which]
            most = np.where(self.lengths[k] <= WORD, self.most[k], (length * min(0.95, 1.6 * self.share)).astype(np.int64))
            low = np.maximum(0, at + begin - most)
            high = np.minimum(len(classes), at + begin + length + most)
            some = high > low
            k, at, which, low, high, most = (x[some] for x in (k, at, which, low, high, most))
            near = chunk_distances(self.masks, self.chunk_length, which, classes, low, high) <= most
            kept.append(np.stack((at[near], k[near]), 1))

        for m in self.meetings(classes):
            if not len(m):
                continue
            held.append(m)
            size += len(m)
            if size > 1 << 16:
                test()
                held, size = [], 0
        if held:
            test()
        return np.unique(np.concatenate(kept), axis=0) if kept else np.zeros((0, 2), np.int64)


def search(items: Items, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(text number, item number, distance, first word, last word + 1) of each text and item that match, the best place of each."""
    classes, keep, at = characters(raw, offsets)
    found = items.candidates(classes) if len(items.masks) else np.zeros((0, 2), np.int64)
    if not len(found):
        return
    byte = np.r_[np.flatnonzero(keep), len(raw)]
    # every text that the item would touch: a text may lack both ends of it
    length = items.lengths[found[:, 1]]
    low, high = (np.searchsorted(at, np.clip(found[:, 0] + n, 0, len(classes) - 1), "right") - 1 for n in (0, length - 1))
    n = high - low + 1
    which = np.repeat(np.arange(len(found)), n)
    text = low[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for t, i, p in zip(text.tolist(), found[which, 1].tolist(), found[which, 0].tolist()):
        places[t, i].append(p)
    for (t, i), begin in sorted(places.items()):
        pattern, most = items.texts[i], int(items.most[i])
        best = None
        begin.sort()
        groups, last = [], None
        for p in begin:  # places closer than the edits allowed are one region
            if last is None or p - last > most:
                groups.append([p, p])
            groups[-1][1] = last = p
        for low, high in groups:
            a, b = max(low - most, int(at[t])), min(high + len(pattern) + most, int(at[t + 1]))
            if b - a < len(pattern) - most:
                continue
            region = raw[byte[a] : min(byte[b], offsets[t + 1])].tobytes().decode("utf-8", "replace")
            region = _BLANKS.sub(" ", region).translate(_LOWER)[: b - a]
            same = region.find(pattern)
            distance, end = (0, same + len(pattern)) if same >= 0 else best_part(pattern, region)
            if distance <= most and (best is None or distance < best[0]):
                begins = same if same >= 0 else end - best_part(pattern[::-1], region[:end][::-1])[1]
                best = (distance, a + begins, a + end)
            if best and not best[0]:
                break
        if best:
            blanks = np.flatnonzero(classes[at[t] : best[2]] == 32) + at[t]
            first = int(np.searchsorted(blanks, best[1] + (classes[best[1]] == 32)))
            yield t, i, best[0], first, int(np.searchsorted(blanks, best[2] - 1)) + 1


def block_count(items: DataFrame, text: str, block_items: int) -> int:
    """Blocks of at most about block_items items and a thousand characters for each of them."""
    n, chars = items.agg(F.count("*"), F.sum(F.length(text))).first()
    return max(1, -(-n // block_items), -(-(chars or 0) // (block_items * 1000)))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, repeats: int = 3, steps: int = 30, sampled: int = 20, stride: int = 4, block_items: int = 4000, keep_row: bool = False) -> DataFrame:
    """doc_id, item_id, distance (characters), similarity, first_word, end_word of each document row and item that match."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    blocks = block_count(named, "text", block_items)
    kinds = {"doc_id": docs.schema[doc_id].dataType.simpleString(), "item_id": named.schema["item_id"].dataType.simpleString()}
    row = F.monotonically_increasing_id() if keep_row else F.lit(0).cast("long")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row.alias("_row"))
    out = None
    for block in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow() if blocks > 1 else named.toArrow()
        pairs = sorted(((r["item_id"], r["text"]) for r in rows.to_pylist()), key=lambda r: (r[0] is None, str(r[0]), r[1]))
        item_type = rows.schema.field("item_id").type
        shared = spark.sparkContext.broadcast(Items(pairs, 1 - similarity + 1e-9, repeats, steps, sampled, stride))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value  # noqa: B023
            for b in pieces(batches, "text"):
                best: dict[tuple, tuple] = {}
                for t, i, distance, first, end in search(block, *buffers(b.column(1))):
                    key, new = (t, block.ids[i]), (distance, first, end, 1 - distance / len(block.texts[i]))
                    best[key] = min(best.get(key, new), new)
                if best:
                    docs_at = pa.array([k[0] for k in best], pa.int64())
                    cols = list(zip(*best.values()))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(docs_at), b.column(2).take(docs_at), pa.array([k[1] for k in best], item_type), pa.array(cols[0], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],  # noqa: B023
                        ["doc_id", "_row", "item_id", "distance", "similarity", "first_word", "end_word"],
                    )

        one = plain.mapInArrow(run, f"doc_id {kinds['doc_id']}, _row long, item_id {kinds['item_id']}, distance long, similarity double, first_word long, end_word long")
        out = one if out is None else out.union(one)
    return out if keep_row else out.drop("_row")


def cleaned(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", similarity: float = 0.8, repeats: int = 3, steps: int = 30, sampled: int = 20, stride: int = 4, block_items: int = 4000) -> DataFrame:
    """The rows of docs that match no item, with all their columns; rows are judged where they are, without a join."""
    spark = docs.sparkSession
    named = items.select(F.col(item_text).alias("text")).where(F.col(item_text).isNotNull())
    blocks = block_count(named, "text", block_items)
    names = docs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs
    for block in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow() if blocks > 1 else named.toArrow()
        shared = spark.sparkContext.broadcast(Items([(None, t) for t in sorted(rows.column(0).to_pylist())], 1 - similarity + 1e-9, repeats, steps, sampled, stride))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value  # noqa: B023
            for b in pieces(batches, text):
                hit = {t for t, *_ in search(block, *buffers(b.column(names.index(text))))}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_())) if hit else b

        out = out.mapInArrow(run, types)
    return out
