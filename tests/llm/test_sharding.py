"""Jump hashing against the published loop, and the laws of shards and slots."""

import zlib

from discloscope.llm.sharding import QUICK_JUMPS, assign_shards

SCHEMA = "doc_id long, text string, Shard string, size string"


def jump(key: int, shards: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_loop(spark):
    keys = [0, 1, 2, 17, 123456789, 2**62 + 5, -1, -987654321] + list(range(1000, 1400))
    docs = spark.createDataFrame([(k, "x", "old", "old") for k in keys], SCHEMA)
    for shards in (1, 2, QUICK_JUMPS + 1, 40, 1000):
        rows = assign_shards(docs, shards).collect()
        assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_sizes_slots_and_odd_rows(spark):
    rows = [(1, "añb", "c", "c"), (1, "añb", "c", "c"), (None, None, None, None), (3, "", "", ""), (None, "z", None, None)]
    out = assign_shards(spark.createDataFrame(rows, SCHEMA), 3)
    got = out.collect()
    assert len(got) == len(rows) and sorted(out.columns) == sorted(["doc_id", "text", "size", "text_crc32", "law", "shard", "grown_shard", "slot"])
    for r in got:
        body = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 16, zlib.crc32(body), "key") and r.grown_shard in (r.shard, 3)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert assign_shards(spark.createDataFrame([], SCHEMA), 3).count() == 0


def test_whole_table(spark, sf):
    rows = assign_shards(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, 40), jump(r.doc_id, 41)) for r in rows)
