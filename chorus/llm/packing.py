"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of ``n`` ids belongs to the reciprocal-capacity class ``j = capacity // n`` (its length lies in
``(capacity/(j+1), capacity/j]``) and every bin of class ``j`` takes exactly ``j`` pieces, so a worker
fills the bins of each class from its own rows without talking to others.  Documents are cut where that
saves padding: a rest that would leave more than ``slack`` of its bins empty gives up a piece of exactly
``capacity // (j+1)`` ids first, and what remains shrinks quadratically (a greedy sum of unit
fractions), so a document ends up in a few pieces and full bins pad less than ``slack``.

Bins a worker could not complete hold at most one bin per class.  Their pieces (a bounded amount per
task) move on to fewer workers, level by level, and on the last level, one bounded task, the pieces are
laid end to end, so a whole run pads at most one unfinished sequence beyond the slack of full bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm import tokens
from chorus.llm.common import chunks, ready, stage, union_all

#: Ids 0 to 65535 are stored as two bytes, others as four; ``id_bytes`` says which.
_SCHEMA = ("doc_id long, start long, length long, ids binary, id_bytes int, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, sequence_length long, class long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("id_bytes", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()),
                    ("class", pa.int64())])


def cuts(n: int, capacity: int, slack: float, tail: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids (at least one id)."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if rest <= tail or (capacity - j * rest) <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


class _Bins:
    """Open bins of one worker, one per class; a bin closes when its class's count is reached."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open, self.out = capacity, first_id, {}, []

    def add(self, piece: tuple):
        j = self.capacity // piece[2]
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        if len(bin_) == j:
            self.close(self.open.pop(j))

    def close(self, bin_: list[tuple]):
        at, total = 0, sum(p[2] for p in bin_)
        for p in bin_:
            self.out.append((*p, self.next_id, at, total, self.capacity // p[2]))
            at += p[2]
        self.next_id += 1

    def batch(self, left: bool = False) -> pa.RecordBatch:
        rows, self.out = self.out, []
        if left:
            rows = [(*p, None, None, None, j) for j, b in sorted(self.open.items()) for p in b]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW],
            schema=_ARROW)


def _first_id(level: int) -> int:
    """Sequence ids are unique over levels and tasks: level, task and a counter share the 63 bits."""
    return (level << 58) | (TaskContext.get().partitionId() << 34)


def _tokenised(path: str, eos: int, capacity: int, slack: float, tail: int):
    def run(batches):
        enc = tokens.encoder(path)
        bins, width = _Bins(capacity, _first_id(0)), np.dtype(enc.dtype).itemsize
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids, at = enc.encode(batch.column("text"), eos)
                crc = ids.astype("<u4").tobytes()
                own = ids.astype(ids.dtype.newbyteorder("<")).tobytes()
                for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                    a, n = int(at[k]), int(at[k + 1] - at[k])
                    start = 0
                    for size in cuts(n, capacity, slack, tail):
                        s = a + start
                        bins.add((doc, start, size, own[s * width:(s + size) * width], width,
                                  zlib.crc32(crc[4 * s:4 * (s + size)]), n))
                        start += size
                yield bins.batch()
        yield bins.batch(left=True)
    return run


def _refill(level: int, capacity: int, last: bool):
    def run(batches):
        bins = _Bins(capacity, _first_id(level))
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in _ARROW.names[:7]]
            for piece in zip(*cols):
                bins.add(piece)
            yield bins.batch()
        if last:
            _lay_out(bins)
        yield bins.batch(left=not last)
    return run


def _lay_out(bins: _Bins):
    """The pieces of all unfinished bins end to end, cut at the capacity."""
    pieces = [p for _, b in sorted(bins.open.items()) for p in b]
    bins.open.clear()
    bin_, free = [], bins.capacity
    for doc, start, size, ids, width, crc, n in pieces:
        done = 0
        while done < size:
            take = min(free, size - done)
            part = ids[done * width:(done + take) * width]
            crc = zlib.crc32(np.frombuffer(part, f"<u{width}").astype("<u4").tobytes())
            bin_.append((doc, start + done, take, part, width, crc, n))
            done, free = done + take, free - take
            if not free:
                bins.close(bin_)
                bin_, free = [], bins.capacity
    if bin_:
        bins.close(bin_)


def harmonic_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, eos: int = 2,
                  slack: float = 0.01, tail: int = 64, fan_in: int = 64,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``capacity`` ids.

    Returns doc_id, start, length, ids (little-endian, ``id_bytes`` bytes each), ids_crc32 (over 32-bit
    ids), doc_tokens, sequence_id, offset, sequence_length, class.  Null and empty texts are one piece
    holding ``eos``; repeated rows are packed once per row; a null id stays null; no rows give no rows.
    ``slack`` is the share of a full bin that may stay empty before a rest is cut, rests of up to
    ``tail`` ids are never cut, ``fan_in`` workers' unfinished bins meet in one task of the next level.
    """
    ready(docs)
    path = tokenizer or tokens.default_path()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level, parts = 0, max(1, src.rdd.getNumPartitions())
    got = stage(src.mapInArrow(_tokenised(path, eos, capacity, slack, tail), _SCHEMA), "pack")
    done = [got.where("sequence_id is not null")]
    while True:
        level += 1
        parts = -(-parts // fan_in)
        left = got.where("sequence_id is null")
        left = left.repartition(parts, F.xxhash64("doc_id", "start"))
        left = left.sortWithinPartitions("doc_id", "start", "length", "ids_crc32")
        got = stage(left.mapInArrow(_refill(level, capacity, parts == 1), _SCHEMA), "pack")
        done.append(got.where("sequence_id is not null"))
        if parts == 1:
            return union_all(done)
