import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chorus.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2 ** 64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def key(x):
    return int(hashlib.md5(str("" if x is None else x).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 100, 5000])
def test_jump_hash_equals_the_published_loop(spark, n):
    hi, lo = sharding.key_halves(F.col("id"))
    df = spark.range(400).withColumn("hi", hi).withColumn("lo", lo).select("id", sharding.jump_hash("hi", "lo", n).alias("s"))
    assert all(r["s"] == jump(key(r["id"]), n) for r in df.collect())


def test_slots_are_gapless_and_growth_moves_only_into_the_new_shard(docs):
    rows = [(i, "t" * (i % 13)) for i in range(500)] + [(7, "again"), (7, "again"), (None, None), (None, "")]
    got = sharding.jump_shards(docs(rows), 8, buckets=16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["shard"] == jump(key(r["doc_id"]), 8) and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want


def test_no_rows(docs):
    assert sharding.jump_shards(docs([])).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_hash("hi", "lo", 0)
