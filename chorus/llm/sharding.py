"""Sharding by jump consistent hashing (Lamping and Veach 2014), DataFrame functions only.

The shard follows from the key and the number of shards alone: no ring table, and one more shard takes
rows only into itself (about 1 in n + 1 of them).  The published 64-bit generator is evaluated in 32-bit
halves, because SQL multiplication does not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import stage

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_M32 = 0xFFFFFFFF
_FAST_STEPS = 24  # enough for nearly every key up to thousands of shards; the rest takes as many as it needs


def _step(n: int) -> str:
    """One draw of the generator on state struct(hi, lo, b, j), while j < n.  Products stay below 2**49."""
    k_hi, k_lo = MULTIPLIER >> 32, MULTIPLIER & _M32
    mid = f"((s.lo & 65535L) * {k_lo}L)"
    high = f"(shiftrightunsigned(s.lo, 16) * {k_lo}L)"
    low = f"(({mid} & {_M32}L) + shiftleft({high} & 65535L, 16) + 1L)"
    carry = f"(shiftrightunsigned({mid}, 32) + shiftrightunsigned({high}, 16) + shiftrightunsigned({low}, 32))"

    def times(x: str, k: int) -> str:  # x * k modulo 2**32, x and k below 2**32
        return f"(({x} * {k & 65535}L) + shiftleft(({x} * {k >> 16}L) & 65535L, 16))"
    hi = f"(({carry} + {times('s.hi', k_lo)} + {times('s.lo', k_hi)}) & {_M32}L)"
    return (f"(s, i) -> if(s.j >= {n}L, s, transform(array(named_struct('hi', {hi}, 'lo', {low} & {_M32}L, 'b', s.j)), "
            f"t -> named_struct('hi', t.hi, 'lo', t.lo, 'b', t.b, 'j', "
            f"cast(floor((t.b + 1) * (2147483648D / (shiftrightunsigned(t.hi, 1) + 1))) as bigint)))[0])")


def jump_hash(hi: str, lo: str, n: int) -> Column:
    """Shard in [0, n) of the 64-bit key ``hi * 2**32 + lo`` (names of long columns)."""
    if n < 1:
        raise ValueError("at least one shard")
    start = f"named_struct('hi', {hi}, 'lo', {lo}, 'b', -1L, 'j', 0L)"
    step = _step(n)
    fast = f"aggregate(sequence(1, {min(n + 1, _FAST_STEPS)}), {start}, {step})"
    if n + 1 <= _FAST_STEPS:
        return F.expr(f"cast({fast}.b as int)")
    return F.expr(f"transform(array({fast}), f -> if(f.j >= {n}L, f, aggregate(sequence(1, {n}), f, {step})))[0].b").cast("int")


def key_halves(key: Column) -> tuple[Column, Column]:
    """64 bits of a stable key of any type (first half of its md5), as two long columns."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def jump_shards(docs: DataFrame, shards: int = 8, buckets: int = 512, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for every row.

    ``slot`` counts the rows of a shard from 0 without gaps, in the order of a hash of the row; it comes from
    counts per (shard, bucket), so no task holds a whole shard.  Null ids share the key of the empty
    string, null texts are empty, repeated rows get a slot each, no rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hi, lo = key_halves(F.col(id_col))
    rows = (docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
            .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    hi, lo = key_halves(F.col("doc_id"))
    rows = rows.withColumn("hi", hi).withColumn("lo", lo)
    rows = rows.select("doc_id", "size", "text_crc32", "copies", jump_hash("hi", "lo", shards).alias("shard"),
                       jump_hash("hi", "lo", shards + 1).alias("grown_shard"),
                       F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")).alias("spread"))
    rows = stage(rows.withColumn("bucket", F.pmod(F.xxhash64("spread"), F.lit(buckets))), "shards")
    cells = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    end = F.sum("copies").over(Window.partitionBy("shard", "bucket").orderBy("spread", "doc_id", "size", "text_crc32")
                               .rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("end", end).join(cells, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard",
                    F.explode(F.expr("sequence(before + end - copies, before + end - 1)")).alias("slot"), "grown_shard"))
