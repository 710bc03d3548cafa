import zlib

import numpy as np

from loamix.llm import shard as S


def slow_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * S.MULTIPLIER + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.array([0, 1, 2, -1, -(2**63), 2**63 - 1, *np.random.default_rng(1).integers(-(2**62), 2**62, 500)])
    for n in (1, 2, 8, 9, 100):
        assert S.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    many = np.arange(40_000)
    a, b = S.jump(many, 8), S.jump(many, 9)
    assert set(b[a != b]) == {8} and abs((a != b).mean() - 1 / 9) < 0.01
    assert np.bincount(a).min() > 4500


def test_assign(spark):
    rows = [(i, f"text {i % 7}", i, "s") for i in range(300)] + [(5, "text 5", 1, "s")] * 40 + [(None, None, 0, "s"), (7, "", 1, "s"), (8, "ü" * 9, 1, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string")
    out = S.assign(frame, 8).collect()
    assert len(out) == len(rows)
    for k in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == k)
        assert slots == list(range(len(slots)))
        ids = [r["doc_id"] for r in sorted((r for r in out if r["shard"] == k), key=lambda r: r["slot"]) if r["doc_id"] is not None]
        assert ids == sorted(ids)
    for r in out:
        assert r["shard"] == slow_jump(r["doc_id"] or 0, 8) and r["grown_shard"] == slow_jump(r["doc_id"] or 0, 9)
    got = {r["doc_id"]: r for r in out}
    assert got[None]["size"] == 1 and got[None]["text_crc32"] == 0
    assert {r["size"] for r in out if r["doc_id"] == 8} == {7, 19} and zlib.crc32(b"text 1") == got[1]["text_crc32"]
    assert S.assign(frame.limit(0), 8).count() == 0
