"""Training-order materialisation: every token sequence gets a global slot by a keyed Feistel permutation
with cycle-walking, and range partitions write the sequences in slot order as fixed-stride shards.

* Sequences: texts are tokenised once and their ids dealt out by ranges of a hash of (id, checksum of the ids).
  Documents (ids with ``eos``) lie end to end in the order of that hash and are cut every ``seq_len`` ids; only the
  very last sequence is filled with ``pad``.  A document's place is the number of ids in the ranges before its
  own (one row a range) plus a running count, so the order follows from the data and the key alone, not from
  files, tasks or settings; equal rows are interchangeable.  Both the ranges' counts and the sequences are made from
  the one shuffle.
* Slots: a balanced Feistel network over the smallest even number of bits that holds ``n`` is a keyed
  permutation of ``[0, 2**bits)``; walking the cycle until the value is below ``n`` makes it one of
  ``[0, n)``.  A slot follows from (key, number, n) alone, so any reader can find any sequence, and the
  inverse gives the number back.
* Shards: slot ``s`` lies in shard ``s // shard_slots`` at record ``s % shard_slots``.  Every record has the
  same number of bytes (stride), so a run resumes at byte ``record * stride`` of a shard's payload; shards
  are written by tasks that own whole slot ranges, sorted, one Parquet file a shard.  ``write_binary`` turns them
  into plain files of fixed-stride records, read by one seek.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import chunks, ready
from chorus.session import ensure_checkpoint_dir

_MASK = (1 << 64) - 1


def _bits(n: int) -> int:
    """Half the width of the network: 2 * half bits hold every number below n."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _round_keys(key: int, rounds: int) -> list[int]:
    out, x = [], key & _MASK
    for _ in range(rounds):  # the splitmix64 sequence
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & low)
    return (left << np.uint64(half)) | right


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """Slots of sequence numbers in [0, n) (or numbers of slots, with ``inverse``)."""
    half, keys = _bits(n), _round_keys(key, rounds)
    x = np.asarray(numbers, np.uint64)
    if inverse:  # swapping the halves before and after runs the rounds backwards
        h, low = np.uint64(half), np.uint64((1 << half) - 1)
        turn = lambda v: ((v & low) << h) | (v >> h)
        step = lambda v: turn(_network(turn(v), half, keys[::-1]))
    else:
        step = lambda v: _network(v, half, keys)
    x = step(x)
    out = x >= np.uint64(n)
    while out.any():  # fewer than four steps a value on average
        x[out] = step(x[out])
        out = x >= np.uint64(n)
    return x.astype(np.int64)


def slot_of(number: Column, n: int, key: int, rounds: int = 6) -> Column:
    """``feistel`` as a column."""
    @F.pandas_udf("long")
    def udf(s):
        import pandas as pd
        return pd.Series(feistel(s.to_numpy(), n, key, rounds))
    return udf(number)


def _tokenised(path, eos):
    """Rows (doc_id, n, crc, ids) of documents; the checksum is over 32-bit ids."""
    def run(batches):
        enc = tokens.encoder(path)
        for whole in batches:
            for batch in chunks(whole, "text", 4 << 20):
                ids, at = enc.encode(batch.column("text"), eos)
                raw = ids.astype(ids.dtype.newbyteorder("<"))
                parts = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in parts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()),
                                                  pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "n", "crc", "ids"])
    return run


_PIECE = "slot long, number long, at int, doc_id long, start long, ids binary"
_COLS = [("number", pa.int64()), ("slot", pa.int64()), ("n_ids", pa.int32()), ("first_doc", pa.int64()), ("first_start", pa.int64()),
         ("last_doc", pa.int64()), ("ids", pa.binary())]


def _cut(seq_len, width, key, rounds):
    """Documents of a range, in order -> their parts of sequences.  ``before`` are the ids in earlier ranges, ``n_all`` all ids,
    ``last`` the checksum that must stand at the range's end."""
    def run(batches):
        part, done = None, 0
        for batch in batches:
            size, own = batch.column("n").to_numpy(), batch.column("part").to_numpy()
            if batch.num_rows == 0:
                continue
            if part is not None and (own != part).any() or (own != own[0]).any():
                raise RuntimeError("a task holds one range")
            part = own[0]
            n = -(-batch.column("n_all")[0].as_py() // seq_len)
            place = batch.column("before").to_numpy() + done + np.cumsum(size) - size
            done += int(size.sum())
            first, last = place // seq_len, (place + size - 1) // seq_len
            many = last - first + 1
            row = np.repeat(np.arange(len(place)), many)
            number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            low = np.maximum(number * seq_len - place[row], 0)  # in the document
            high = np.minimum((number + 1) * seq_len - place[row], size[row])
            at = place[row] + low - number * seq_len
            ids = batch.column("ids").to_pylist()
            parts = [ids[r][width * a:width * b] for r, a, b in zip(row.tolist(), low.tolist(), high.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(feistel(number, n, key, rounds)), pa.array(number), pa.array(at.astype(np.int32)),
                 batch.column("doc_id").take(pa.array(row)), pa.array(low), pa.array(parts, pa.binary())],
                names=["slot", "number", "at", "doc_id", "start", "ids"])
            end = batch.column("end")[0].as_py()
        if part is not None and done != end:
            raise RuntimeError("the input changed between two reads; write it to a table first")
    return run


def _joined(seq_len, width, pad):
    """Parts in (slot, at) order -> whole sequences; one sequence is held at a time."""
    def run(batches):
        fill, cur = int(pad).to_bytes(width, "little"), None

        def close(c):
            raw = b"".join(c["ids"])
            return (c["number"], c["slot"], len(raw) // width, c["first_doc"], c["first_start"], c["last_doc"],
                    raw + fill * (seq_len - len(raw) // width))

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_COLS)], names=[c for c, _ in _COLS])

        for batch in batches:
            rows = []
            for slot, number, doc, start, ids in zip(*(batch.column(c).to_pylist() for c in ("slot", "number", "doc_id", "start", "ids"))):
                if cur is None or cur["slot"] != slot:
                    if cur is not None:
                        rows.append(close(cur))
                    cur = {"slot": slot, "number": number, "first_doc": doc, "first_start": start, "ids": []}
                cur["ids"].append(ids)
                cur["last_doc"] = doc
            yield table(rows)
        if cur is not None:
            yield table([close(cur)])
    return run


def _ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (doc_id, n, crc, ids) in ``ranges`` tasks by the hash ``h``, each with its number ``part``, the ids ``before`` it,
    its own ``end`` and all ids ``n_all``."""
    h = F.xxhash64("doc_id", "crc")
    part = F.shiftright(F.shiftrightunsigned("h", 40) * F.lit(ranges), 24).cast("int")
    dealt = docs.withColumn("h", h).withColumn("part", part).repartitionById(ranges, F.col("part"))
    # the counts read every column, so that Spark finds the same shuffle on both sides and tokenises once
    counts = dealt.groupBy("part").agg(F.sum("n").alias("end"), F.max(F.struct("h", "doc_id", "crc", F.octet_length("ids").alias("size"))).alias("last"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = counts.select(F.col("part").alias("range"), "end", "last", F.coalesce(F.sum("end").over(earlier), F.lit(0)).alias("before"),
                           F.sum("end").over(Window.partitionBy()).alias("n_all"))
    return dealt.join(F.broadcast(counts), F.col("part") == F.col("range")).drop("range")


def _digest(width):
    def run(batches):
        for b in batches:
            ids = b.column("ids").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in ids]
            keep = [c for c in b.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])
    return run


def materialise(docs: DataFrame, path: str | None = None, seq_len: int = 2048, shard_slots: int = 4096, key: int = 0x5EED,
                rounds: int = 6, eos: int = 2, pad: int = 0, tokenizer: str | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> tuple[str, DataFrame]:
    """Write all documents as slot-ordered shards; returns (folder, index without the ids).

    The folder holds one Parquet file per ``shard=<k>``: slot, record, byte_offset, number, n_ids, first_doc,
    first_start (ids of that document in earlier sequences), last_doc, ids (``stride`` bytes each).  Null and
    empty texts are one ``eos``; repeated rows and null ids are kept; no rows write no shard.
    """
    spark = ready(docs)
    tok = tokenizer or tokens.default_path()
    path = path or f"{ensure_checkpoint_dir(spark)}/order-{uuid.uuid4().hex}"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.mapInArrow(_tokenised(tok, eos), "doc_id long, n long, crc long, ids binary")
    width = np.dtype(tokens.encoder(tok).dtype).itemsize
    stride = seq_len * width
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _ranged(rows, ranges).sortWithinPartitions(F.shiftrightunsigned("h", 1), "h", F.col("doc_id").asc_nulls_first(), "crc")
    parts = ordered.mapInArrow(_cut(seq_len, width, key, rounds), _PIECE).withColumn("shard", F.expr(f"cast(slot div {shard_slots} as int)"))
    parts = parts.repartition(ranges, "shard").sortWithinPartitions("slot", "at").drop("shard")
    seqs = parts.mapInArrow(_joined(seq_len, width, pad),
                            "number long, slot long, n_ids int, first_doc long, first_start long, last_doc long, ids binary")
    seqs = (seqs.withColumn("shard", F.expr(f"cast(slot div {shard_slots} as int)")).withColumn("record", F.expr(f"cast(slot % {shard_slots} as int)"))
            .withColumn("byte_offset", F.col("record").cast("long") * stride))
    # a task owns whole shards: one file per shard, in slot order
    seqs = seqs.sortWithinPartitions("shard", "slot")
    seqs.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    schema = ("number long, slot long, n_ids int, first_doc long, first_start long, last_doc long, ids binary, record int, "
              "byte_offset long, shard int")
    back = spark.read.schema(schema).parquet(path)
    return path, back


def index_of(written: DataFrame, id_bytes: int = 2) -> DataFrame:
    """The written sequences with a checksum (crc32 over 32-bit ids) in place of the ids."""
    ready(written)
    keep = [f for f in written.schema.fields if f.name != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", ids_crc32 long"
    return written.mapInArrow(_digest(id_bytes), schema)


def read_slots(spark: SparkSession, path: str, start: int, count: int, shard_slots: int = 4096) -> DataFrame:
    """Slots ``start`` to ``start + count - 1`` in order, reading only the shards they lie in."""
    first, last = start // shard_slots, (start + count - 1) // shard_slots
    return (spark.read.parquet(path).where(F.col("shard").between(first, last) & F.col("slot").between(start, start + count - 1))
            .orderBy("slot"))


def write_binary(written: DataFrame, path: str) -> None:
    """Plain shard files ``shard=<k>/part-*`` of fixed-stride records: the ids, little-endian, and one newline byte.
    Record r starts at byte ``r * (stride + 1)``, stride being the bytes of a sequence's ids."""
    (written.select(F.col("ids").cast("string").alias("value"), "shard", "slot").repartition("shard").sortWithinPartitions("shard", "slot")
     .select("value", "shard").write.partitionBy("shard").text(path))


def read_record(file: str, record: int, seq_len: int, dtype: str = "<u2") -> np.ndarray:
    """One record of a plain shard file: a seek and a read."""
    stride = seq_len * np.dtype(dtype).itemsize
    with open(file, "rb") as f:
        f.seek(record * (stride + 1))
        return np.frombuffer(f.read(stride), dtype)
