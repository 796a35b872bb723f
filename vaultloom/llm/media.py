"""Media columns: Matroska written and parsed without other libraries.

mux() puts 8-bit PCM samples into a Matroska file: header, track, clusters of laced blocks, cues. packets() parses EBML
elements (variable-length ids and sizes, unknown sizes too), clusters, block groups, all four kinds of lacing and cues
into a packet table: track, timestamp in ns, byte offset and size, key flag, cluster and lace number.

Defined results: null text is empty and null media gives null; equal texts give equal rows; ids may repeat or be null;
other columns are ignored; a file that breaks off or is no Matroska raises ValueError in parse(), gives an error text with no
packets in packet_table(), and in media_digest() its own length and digest with nulls for what would be read from it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, pieces

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS = 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, DEFAULT_DURATION = 0x2AD7B1, 0xAE, 0xD7, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, ATTACHMENTS, TAGS}

UNIT = 64
RATE = 8000
FRAMES = 128
CLUSTER_FRAMES = 512


def size_vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; the all-ones value of a width means unknown and is not used."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> bytes:
    """The lacing head and the frames of a block body."""
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == "ebml":
        head += size_vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1))
            head += size_vint(d + (1 << 7 * w - 1) - 1, w)
    elif lacing == "fixed" and len({len(f) for f in frames}) > 1:
        raise ValueError("fixed lacing takes frames of one size")
    return head + b"".join(frames)


FLAGS = {"none": 0x00, "xiph": 0x02, "fixed": 0x04, "ebml": 0x06}


def block(frames: list[bytes], at: int, lacing: str, track: int = 1, key: bool = True) -> bytes:
    if len(frames) == 1:
        lacing = "none"
    body = frames[0] if lacing == "none" else laced(frames, lacing)
    return size_vint(track) + struct.pack(">hB", at, FLAGS[lacing] | 0x80 * key) + body


def mux(samples: bytes, lacing: str = "fixed") -> bytes:
    """Samples, a multiple of UNIT bytes, as a file: UNIT samples a frame, FRAMES frames a block, CLUSTER_FRAMES a cluster, a cue each."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    frame_ns = UNIT * 10**9 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"vaultloom") + element(0x5741, b"vaultloom"))
    audio = element(0xE1, element(0xB5, struct.pack(">f", RATE)) + number(0x9F, 1) + number(0x6264, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(DEFAULT_DURATION, frame_ns) + element(0x86, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at, ms, step = len(info) + len(tracks), frame_ns // 10**6, UNIT * FRAMES
    for c in range(0, len(samples), UNIT * CLUSTER_FRAMES):
        part = samples[c : c + UNIT * CLUSTER_FRAMES]
        start = c // UNIT * ms
        blocks = [element(SIMPLE_BLOCK, block([part[f : f + UNIT] for f in range(b, min(b + step, len(part)), UNIT)], b // UNIT * ms, lacing)) for b in range(0, len(part), step)]
        cluster = element(CLUSTER, number(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


# ---------------------------------------------------------------- parsing


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element id at {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"bad element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer; None if it is the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the size at {at} breaks off")
    n = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def children(data: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte of the element, of its body, end). An element of unknown size ends with its parent; stop ids end this level."""
    while at < end:
        begin = at
        kind, at = read_id(data, at)
        if kind in stop:
            return
        n, at = read_size(data, at)
        last = end if n is None else at + n
        if last > end:
            raise ValueError(f"the element at {begin} is longer than its parent")
        last = yield_end(data, kind, at, last, n)
        yield kind, begin, at, last
        at = last


def yield_end(data: bytes, kind: int, at: int, last: int, n: int | None) -> int:
    """Where a cluster of unknown size ends: at the next top-level element."""
    if n is not None or kind != CLUSTER:
        return last
    while at < last:
        k, body = read_id(data, at)
        if k in TOP:
            return at
        size, body = read_size(data, body)
        if size is None:
            raise ValueError("unknown size within a cluster")
        at = body + size
    return at


def unsigned(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first starts."""
    if not lacing:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if lacing == 2:  # fixed
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't divide the block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 1:  # xiph
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            size += data[at]
            at += 1
        else:
            width = 9 - data[at].bit_length()
            raw, at = read_size(data, at)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            size = raw if not k else sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0:
        raise ValueError("laced frames are longer than their block")
    return [*sizes, rest], at


def parse(data: bytes) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Packets (track, timestamp ns, offset, size, key, cluster, lace) and cues (timestamp ns, track, cluster's first byte)."""
    packets: list[tuple] = []
    cues: list[tuple[int, int, int]] = []
    scale, durations, cluster = 1_000_000, {}, -1
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")

    def add(at: int, end: int, time: int, key: bool | None, duration: int | None = None):
        track, at = read_size(data, at)
        relative, flags = struct.unpack_from(">hB", data, at)
        sizes, at = frame_sizes(data, at + 3, end, flags >> 1 & 3)
        each = durations.get(track, 0)
        if duration is not None and not each:
            each = duration * scale // len(sizes)
        for k, size in enumerate(sizes):
            packets.append((track, (time + relative) * scale + k * each, at, size, bool(flags & 0x80) if key is None else key, cluster, k))
            at += size

    for kind, _, at, end in top:
        if kind != SEGMENT:
            continue
        base = at
        for kind, begin, at, end in children(data, at, end):
            if kind == INFO:
                for k, _, a, e in children(data, at, end):
                    scale = unsigned(data, a, e) if k == TIMESTAMP_SCALE else scale
            elif kind == TRACKS:
                for k, _, a, e in children(data, at, end):
                    if k == TRACK_ENTRY:
                        got = {k: unsigned(data, a, e) for k, _, a, e in children(data, a, e) if k in (TRACK_NUMBER, DEFAULT_DURATION)}
                        if TRACK_NUMBER in got and DEFAULT_DURATION in got:
                            durations[got[TRACK_NUMBER]] = got[DEFAULT_DURATION]
            elif kind == CLUSTER:
                cluster, time = begin, 0
                for k, _, a, e in children(data, at, end, TOP):
                    if k == TIMESTAMP:
                        time = unsigned(data, a, e)
                    elif k == SIMPLE_BLOCK:
                        add(a, e, time, None)
                    elif k == BLOCK_GROUP:
                        inner = {k: (a, e) for k, _, a, e in children(data, a, e)}
                        if BLOCK in inner:
                            add(*inner[BLOCK], time, REFERENCE not in inner, unsigned(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None)
            elif kind == CUES:
                for k, _, a, e in children(data, at, end):
                    if k == CUE_POINT:
                        time = 0
                        for k, _, a, e in children(data, a, e):
                            if k == CUE_TIME:
                                time = unsigned(data, a, e)
                            elif k == CUE_POSITIONS:
                                got = {k: unsigned(data, a, e) for k, _, a, e in children(data, a, e)}
                                cues.append((time * scale, got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER, 0)))
    return packets, cues


def read_samples(data: bytes, packets: list[tuple], track: int = 1) -> bytes:
    """The track's bytes in order of time, from the packets' byte ranges."""
    return b"".join(data[p[2] : p[2] + p[3]] for p in sorted((p for p in packets if p[0] == track), key=lambda p: (p[1], p[2])))


def feature(samples: bytes, packets: list[tuple], cues: list[tuple]) -> str:
    """Packet and cue counts, length, and level figures of the samples (unsigned, silence at 0)."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / max(1, len(x))
    peaks = x.reshape(-1, UNIT).max(1) if len(x) % UNIT == 0 and len(x) else x
    clusters = {p[5] for p in packets}
    hits = sum(c[2] in clusters for c in cues)
    figures = (int(x.sum(dtype=np.int64)) / max(1, len(x)), float(-(share * np.log2(share)).sum()), float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0, float(peaks.mean()) if len(peaks) else 0.0)
    return f"packets={len(packets)};clusters={len(clusters)};cues={hits}/{len(cues)};ms={len(x) * 1000 // RATE};" + ";".join(f"{k}={v:.4f}" for k, v in zip(("mean", "entropy", "slope", "peak"), figures))


# ---------------------------------------------------------------- columns


def media_column(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lacing: str = "fixed") -> DataFrame:
    """The kept columns, n_bytes of the UTF-8 text, and media: the text padded to a positive multiple of UNIT, as a file."""
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            raw, offsets = buffers(b.column(b.num_columns - 1))
            raw = raw.tobytes()
            lengths = np.diff(offsets)
            files = []
            for k, n in enumerate(lengths.tolist()):
                payload = raw[offsets[k] : offsets[k + 1]]
                files.append(mux(payload + b"\0" * (-n % UNIT if n else UNIT), lacing))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lengths, pa.int64()), pa.array(files, pa.binary())], [*keep, "n_bytes", "media"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{types}, n_bytes long, media binary")


def packet_table(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each packet: kept columns, track, timestamp_ns, byte_offset, byte_size, key, cluster_offset, lace, error (null but for broken files)."""
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = ["track", "timestamp_ns", "byte_offset", "byte_size", "key", "cluster_offset", "lace", "error"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_media"):
            rows, of = [], []
            for k, data in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = [(*p, None) for p in parse(data)[0]]
                except (ValueError, IndexError, struct.error) as e:
                    found = [(None,) * 7 + (str(e) or "broken file",)]
                rows += found
                of += [k] * len(found)
            if rows:
                took = b.take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*took.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*keep, *names])

    return df.select(*keep, F.col(media).alias("_media")).mapInArrow(run, f"{types}, track long, timestamp_ns long, byte_offset long, byte_size long, key boolean, cluster_offset long, lace long, error string")


def media_digest(df: DataFrame) -> DataFrame:
    """Reads the samples of `media` back and describes them; takes media_column()'s rows with doc_id."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            rows = []
            for data in b.column(2).to_pylist():
                try:
                    packets, cues = parse(data) if data is not None else ([], [])
                    samples = read_samples(data, packets) if data is not None else None
                except (ValueError, IndexError, struct.error):
                    samples = None
                if samples is None:
                    rows.append((None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None))
                    continue
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, packets, cues)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
