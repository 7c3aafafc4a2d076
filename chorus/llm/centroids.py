"""Centroid clustering (Lloyd's rounds) of integer vectors by scalar lookup tables.

Vectors are quantised once and stored in blocks of rows; a block keeps, for each dimension, the sorted integer
values that occur in it and each row's code, its value's place in that list.  A round tabulates, block by
block, the squared difference for each dimension, occurring value and centroid; a row's distances are then
gathers from that table by its codes, summed over the dimensions.  A table has at most ``block`` values a
dimension whatever the data's range, so memory is bounded; whole-number arithmetic is exact.

A round is one narrow job: every task gives one row per (centroid, dimension) with a sum and a count, Spark adds
them, and the driver takes the ``k * dim`` totals, a fixed number.  Rows are never shuffled.
"""

from __future__ import annotations

from decimal import Context

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import ready, stage

#: Components of this size and beyond are computed with Python's whole numbers instead of 64-bit ones:
#: below it, 2**6 squared differences and 2**34 summed rows stay within 63 bits.
_WIDE = 1 << 28
_LONG = (1 << 63) - 1
_BLOCK_SCHEMA = "ids array<long>, vals binary, sizes array<int>, codes binary, wide array<string>"
_ROUND = "cluster int, dim int, total decimal(38,0), n long"


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where 64 bits might not hold what follows."""
    v = np.floor(x.astype(np.float64) * scale)
    if v.size == 0 or np.abs(v).max() < _WIDE:
        return v.astype(np.int64)
    return np.array([[int(c) for c in row] for row in v], dtype=object)


def _encode(ids: list, v: np.ndarray):
    """A block as one row: the values that occur in each dimension, end to end, and the codes."""
    vals, sizes, codes = [], [], []
    for d in range(v.shape[1]):
        u, inv = np.unique(v[:, d], return_inverse=True)
        vals.append(u)
        sizes.append(len(u))
        codes.append(inv.astype(np.uint16))
    flat = np.concatenate(vals)
    wide = None if flat.dtype != object else [str(x) for x in flat]
    raw = b"" if wide is not None else flat.astype(np.int64).tobytes()
    return ids, raw, sizes, np.concatenate(codes).tobytes(), wide


def _blocks(dim: int, scale: int, block: int):
    def run(batches):
        for batch in batches:
            col, ids = batch.column("v"), batch.column("vec_id").to_pylist()
            flat = col.flatten().to_numpy(zero_copy_only=False)
            v = _whole(flat.reshape(len(ids), dim), scale)
            rows = [_encode(ids[a:a + block], v[a:a + block]) for a in range(0, len(ids), block)]
            types = (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                             names=["ids", "vals", "sizes", "codes", "wide"])
    return run


def _decoded(batches):
    """Blocks of a stream: ids, values, start of each dimension's values, codes (dimension by dimension)."""
    for batch in batches:
        for r in batch.to_pylist():
            vals = np.array([int(x) for x in r["wide"]], dtype=object) if r["wide"] is not None else np.frombuffer(r["vals"], np.int64)
            sizes = np.array(r["sizes"])
            codes = np.frombuffer(r["codes"], np.uint16).reshape(len(sizes), len(r["ids"]))
            yield r["ids"], vals, np.cumsum(sizes) - sizes, sizes, codes


def _distances(vals, starts, sizes, codes, centroids) -> np.ndarray:
    """rows x k: gathers from the table of squared differences (value x centroid, dimension by dimension)."""
    kind = np.int64 if vals.dtype == np.int64 and centroids.dtype == np.int64 else object
    table = (vals.astype(kind)[:, None] - np.repeat(centroids.T, sizes, axis=0).astype(kind)) ** 2
    out = np.zeros((codes.shape[1], centroids.shape[0]), kind)
    for d, s in enumerate(starts):
        out += table[s + codes[d].astype(np.int64)]
    return out


def _as_array(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < _WIDE for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def _round(shared):
    def run(batches):
        centroids = _as_array(shared.value)
        k, dim = centroids.shape
        totals, counts = [[0] * dim for _ in range(k)], np.zeros(k, np.int64)
        for ids, vals, starts, sizes, codes in _decoded(batches):
            near = _distances(vals, starts, sizes, codes, centroids).argmin(axis=1)
            n = np.bincount(near, minlength=k)
            counts += n
            order = np.argsort(near, kind="stable")
            present = np.flatnonzero(n)
            cuts = np.cumsum(n)[present] - n[present]
            for d, s in enumerate(starts):
                sums = np.add.reduceat(vals[s + codes[d].astype(np.int64)[order]], cuts)
                for c, x in zip(present, sums):
                    totals[c][d] += int(x)
        rows = [(c, d, totals[c][d], int(counts[c])) for c in range(k) if counts[c] for d in range(dim)]
        exact = Context(prec=38)
        cols = ([r[0] for r in rows], [r[1] for r in rows], [exact.create_decimal(r[2]) for r in rows], [r[3] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()))],
                                         names=["cluster", "dim", "total", "n"])
    return run


def _assign(shared):
    def run(batches):
        centroids = _as_array(shared.value)
        for ids, vals, starts, sizes, codes in _decoded(batches):
            dist = _distances(vals, starts, sizes, codes, centroids)
            near = dist.argmin(axis=1)
            best = dist[np.arange(len(near)), near]
            best = pa.array(best, pa.int64()) if best.dtype == np.int64 else pa.array([int(x) if x <= _LONG else None for x in best], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near.astype(np.int32)), best],
                                             names=["vec_id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, block: int = 4096,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): rows (vec_id, cluster, distance, cluster_inertia, inertia), one per vector kept.

    Kept are vectors of exactly ``dim`` components, none null or not finite; a component x counts as the whole
    number floor(scale * x), x in double precision.  Centroids start as the ``k`` kept vectors with the smallest
    SHA-256 of ``seed:vec_id`` (repeated ids: by the vector; null ids last; fewer vectors than k: all of them).
    Each round assigns every vector to the nearest centroid (ties: the smaller number) and replaces every
    non-empty centroid by floor(sum / count) of each component; empty ones stay.  Rounds end early when no centroid
    moved, since every further round would give the same.  Repeated rows count each time.  Other columns are
    ignored; an empty table gives no rows and no centroids.  A squared distance or inertia beyond a 64-bit long is
    null (it needs components over 2**28, which are computed exactly, but slowly); sums beyond 38 digits raise.
    """
    if not 1 <= block <= 65_536:
        raise ValueError("block must lie between 1 and 65536: codes have 16 bits")
    spark = ready(vectors)
    x = F.col(vec_col)
    whole = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    kept = vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("v"))
    blocks = stage(kept.mapInArrow(_blocks(dim, scale, block), _BLOCK_SCHEMA), "centroid-blocks")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = kept.orderBy(order, "v").limit(k).select("v").collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), []
    centroids = [[int(c) for c in row] for row in _whole(np.array([r["v"] for r in first]), scale)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)
        sums = blocks.mapInArrow(_round(sent), _ROUND).groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = [list(c) for c in centroids]
        for r in sums.collect():  # at most k * dim rows
            if r["total"] is None:
                raise OverflowError("a sum of components exceeds 38 digits")
            moved[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
        if moved == centroids:
            break
        centroids = moved
    sent = spark.sparkContext.broadcast(centroids)
    rows = stage(blocks.mapInArrow(_assign(sent), "vec_id long, cluster int, distance long"), "centroid-rows")
    known = F.count("distance") == F.count("*")
    per = rows.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()  # at most k rows
    total = None if any(r["s"] is None for r in per) else sum(r["s"] for r in per)
    as_long = lambda x: None if x is None or x > _LONG else int(x)
    sums = spark.createDataFrame([(r["cluster"], as_long(r["s"]), as_long(total)) for r in per], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids
