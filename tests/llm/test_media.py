import hashlib
import os
import zlib

import pytest

from vaultloom.llm import media
from vaultloom.llm.queries import QUERIES


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
def test_round_trip(lacing):
    for n in (1, 2, 128, 129, 1025):
        samples = os.urandom(64 * n)
        packets, cues = media.parse(media.mux(samples, lacing if lacing != "none" else "fixed"))
        assert media.read_samples(b"" or media.mux(samples, lacing if lacing != "none" else "fixed"), packets) == samples
        assert len(packets) == n and [p[1] for p in packets] == [8_000_000 * k for k in range(n)]
        assert {c[2] for c in cues} == {p[5] for p in packets}


@pytest.mark.parametrize("lacing", ["xiph", "ebml"])
def test_frames_of_different_sizes(lacing):
    frames = [os.urandom(n) for n in (0, 1, 254, 255, 256, 600, 3, 40_000, 2)]
    body = media.block(frames, 0, lacing)
    sizes, at = media.frame_sizes(body, 4, len(body), {"xiph": 1, "ebml": 3}[lacing])
    assert sizes == [len(f) for f in frames] and len(body) - at == sum(sizes)


def test_unknown_sizes_and_block_groups():
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.block([b"abc"], 5, "none", track=300, key=False)) + media.number(media.BLOCK_DURATION, 7) + media.element(media.REFERENCE, b"\xff"))
    unknown = lambda kind, body: kind.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    cluster = unknown(media.CLUSTER, media.number(media.TIMESTAMP, 1000) + group)
    other = unknown(media.CLUSTER, media.number(media.TIMESTAMP, 2000) + media.element(media.SIMPLE_BLOCK, media.block([b"d"], -3, "none")))
    data = media.element(media.EBML, media.element(0x4282, b"matroska")) + unknown(media.SEGMENT, media.element(media.INFO, media.number(media.TIMESTAMP_SCALE, 1000)) + cluster + other)
    packets, _ = media.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4]) for p in packets] == [(300, 1_005_000, b"abc", False), (1, 1_997_000, b"d", True)]


def test_broken_files(spark, none):
    good = media.mux(bytes(64))
    rows = spark.createDataFrame([(1, good), (2, good[: len(good) // 2]), (3, b"no"), (4, None), (None, b"")], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.packet_table(rows).collect()}
    assert got[1]["error"] is None and got[1]["byte_size"] == 64
    assert got[2]["error"] and got[3]["error"] and got[None]["error"] and 4 not in got
    assert media.media_digest(media.media_column(none)).count() == 0
    digests = {r["doc_id"]: r for r in media.media_digest(rows.selectExpr("doc_id", "0L as n_bytes", "media")).collect()}
    assert digests[1]["payload_bytes"] == 64 and digests[4]["media_bytes"] is None and digests[4]["payload_sha256"] is None
    assert digests[3]["media_bytes"] == 2 and digests[3]["media_sha256"] == hashlib.sha256(b"no").hexdigest() and digests[3]["feature"] is None


def plain_feature(samples, packets, cues):
    """The feature by loops over single bytes."""
    import math

    n = len(samples)
    share = [samples.count(bytes([k])) / n for k in range(256)]
    peaks = [max(samples[a : a + 64]) for a in range(0, n, 64)]
    clusters = {p[5] for p in packets}
    figures = {
        "mean": sum(samples) / n, "entropy": -sum(x * math.log2(x) for x in share if x),
        "slope": sum(abs(a - b) for a, b in zip(samples, samples[1:])) / (n - 1), "peak": sum(peaks) / len(peaks),
    }
    return f"packets={len(packets)};clusters={len(clusters)};cues={sum(c[2] in clusters for c in cues)}/{len(cues)};ms={n * 1000 // 8000};" + ";".join(f"{k}={v:.4f}" for k, v in figures.items())


def test_digest_of_odd_rows(odd):
    rows = odd.collect()
    got = media.media_digest(media.media_column(odd.withColumnRenamed("source", "media"))).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.setdefault(r["doc_id"], set()).add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]


def test_op10(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    for r in QUERIES["op10_media"](spark, sf).collect():
        raw = text[r["doc_id"]].encode()
        assert r["payload_sha256"] == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()
        same = (r["media_bytes"], r["media_sha256"], r["feature"])
        payload = raw + bytes(-len(raw) % 64)
        file = media.mux(payload, "fixed")
        assert same == (len(file), hashlib.sha256(file).hexdigest(), plain_feature(payload, *media.parse(file)))
        assert seen.setdefault(raw, same) == same
