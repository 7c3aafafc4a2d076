"""Exact top-k by inner product with a three-phase uniform threshold (TPUT, Cao and Wang 2004).

The dimensions are split into ``lists``; a row's score is the sum of its parts in the lists.  For a block
of queries (bounded, sent to all tasks) over all rows, in place:

1. every task returns the k best parts of each list with their rows' scores, and the list's lowest part; the
   k-th best score among the listed rows is a safe score, which no answer falls below;
2. with parts counted from the list's lowest, a row whose every part is below ``safe / lists`` cannot
   reach the safe score: tasks send every row with a part at or above that cutoff, with bounds from
   above and below; rows whose upper bound stays under the new k-th lower bound go;
3. the scores of the rows left are computed exactly from their whole vectors.

No rows are sent between tasks but candidates; rows are read where they lie, once per phase and query
block.  The result is exact for any data; the cutoffs only decide how many rows phase 3 looks up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import ready, stage, union_all

_BLOCK = 256  # queries per matrix product


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """row, vec_id, v: floor(scale * x) per component; vectors that are null or hold null or non-finite
    components are left out, equal rows (same id, same vector) are one."""
    x = F.col(vec_col)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).distinct().select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """List column as a float64 matrix of ``dim`` columns (shorter vectors end in zeros)."""
    offsets = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    out = np.zeros((len(col), dim))
    if len(n) and (n == dim).all():
        out[:] = flat[offsets[0]:offsets[-1]].reshape(-1, dim)
    else:
        for i in range(len(n)):
            out[i, :n[i]] = flat[offsets[i]:offsets[i + 1]]
    return out


def _own(qid, ids):
    """Mask of (query, row) pairs with the same id."""
    return (qid[:, None] == ids[None, :]) if np.isin(ids, qid).any() else None


def _ids(col: pa.Array) -> np.ndarray:
    return col.fill_null(-1 << 62).to_numpy()


def _phase1(shared, spans, k):
    def run(batches):
        qid, q = shared.value
        n_lists = len(spans)
        best = [[(np.zeros(0), np.zeros(0, np.int64), np.zeros(0)) for _ in spans] for _ in qid]
        low = np.full((len(qid), n_lists), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ids = batch.column("row").to_numpy(), _ids(batch.column("vec_id"))
            x = _matrix(batch.column("v"), q.shape[1])
            for a in range(0, len(qid), _BLOCK):
                own = _own(qid[a:a + _BLOCK], ids)
                whole = q[a:a + _BLOCK] @ x.T
                for j, (s, e) in enumerate(spans):
                    part = q[a:a + _BLOCK, s:e] @ x[:, s:e].T
                    if own is not None:
                        np.minimum(low[a:a + _BLOCK, j], np.where(own, np.inf, part).min(1), out=low[a:a + _BLOCK, j])
                        part[own] = -np.inf
                    else:
                        np.minimum(low[a:a + _BLOCK, j], part.min(1), out=low[a:a + _BLOCK, j])
                    t = min(k, part.shape[1])
                    top = np.argpartition(-part, t - 1, axis=1)[:, :t]
                    val, tot = np.take_along_axis(part, top, 1), np.take_along_axis(whole, top, 1)
                    for i in range(val.shape[0]):
                        v0, r0, t0 = best[a + i][j]
                        v, r, t_ = np.concatenate([v0, val[i]]), np.concatenate([r0, rows[top[i]]]), np.concatenate([t0, tot[i]])
                        if len(v) > k:
                            o = np.argpartition(-v, k - 1)[:k]
                            v, r, t_ = v[o], r[o], t_[o]
                        best[a + i][j] = (v, r, t_)
        out = [(i, j, float(low[i, j]), int(r), float(v), float(t_)) for i in range(len(qid)) for j in range(n_lists)
               for v, r, t_ in zip(*best[i][j]) if v > -np.inf]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), _P1)] if out else [pa.array([], t) for t in _P1],
            names=["q", "list", "low", "row", "part", "total"])
    return run


_P1 = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
_P2 = [pa.int32(), pa.int64(), pa.float64(), pa.float64()]


def _phase2(shared, spans, exact):
    def run(batches):
        qid, q, safe, low = shared.value
        floor = low.sum(1)
        cut = (safe - floor) / len(spans)
        for batch in batches:
            rows, ids = batch.column("row").to_numpy(), _ids(batch.column("vec_id"))
            x = _matrix(batch.column("v"), q.shape[1])
            for a in range(0, len(qid), _BLOCK):
                c = cut[a:a + _BLOCK, None]
                below = above = np.repeat(floor[a:a + _BLOCK, None], len(rows), 1)
                any_seen = np.zeros(below.shape, bool)
                for j, (s, e) in enumerate(spans):
                    part = q[a:a + _BLOCK, s:e] @ x[:, s:e].T - low[a:a + _BLOCK, j:j + 1]
                    seen = part >= c
                    any_seen |= seen
                    below = below + np.where(seen, part, 0.0)
                    above = above + np.where(seen, part, c)
                keep = any_seen & (above >= safe[a:a + _BLOCK, None]) if exact else np.ones(below.shape, bool)
                keep |= ~np.isfinite(safe[a:a + _BLOCK, None])
                own = _own(qid[a:a + _BLOCK], ids)
                if own is not None:
                    keep &= ~own
                i, r = np.nonzero(keep)
                lo, hi = (below[i, r], above[i, r]) if exact else (np.full(len(i), -np.inf), np.full(len(i), np.inf))
                fin = np.isfinite(safe[a + i]) if len(i) else np.zeros(0, bool)
                lo, hi = np.where(fin, lo, -np.inf), np.where(fin, hi, np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((a + i, rows[r], lo, hi), _P2)],
                                                 names=["q", "row", "below", "above"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 2, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows of ``vectors``, itself excluded.

    Both inputs are ``quantised`` tables (row, vec_id, v), staged.  Ties go to the smaller vec_id (null ids
    last).  Shorter vectors count as ending in zeros.  A repeated query id with another vector is a query of
    its own; fewer rows than k give all of them; no rows or no queries give no rows.  A score beyond a
    64-bit long is null and ranks last.  More lists mean a lower cutoff for each: on vectors whose
    parts scatter around zero, two lists leave about a tenth of the pairs to phase 3, four about a half.
    """
    spark = ready(vectors)
    bounds = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()
    dim, most = bounds[0] or 0, bounds[1] or 0.0
    exact = dim * most * most < 2 ** 52  # every part and sum is then an exact float64 integer
    spans = [(int(s[0]), int(s[-1]) + 1) for s in np.array_split(np.arange(dim), min(lists, dim)) if len(s)] if dim else []
    blocks = max(1, -(-queries.count() // query_block))
    out = []
    for b in range(blocks):
        # at most about query_block rows: bounded whatever the table holds
        block = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "v").collect()
        if not block or not spans:
            continue
        qid = np.array([r["vec_id"] for r in block], np.int64)
        q = np.zeros((len(block), dim))
        for i, r in enumerate(block):
            q[i, :len(r["v"])] = r["v"]
        sent = spark.sparkContext.broadcast((qid, q))
        parts = vectors.mapInArrow(_phase1(sent, spans, k), "q int, list int, low double, row long, part double, total double")
        by_list = Window.partitionBy("q", "list")
        parts = (parts.withColumn("low", F.min("low").over(by_list))
                 .withColumn("n", F.row_number().over(by_list.orderBy(F.desc("part"), "row"))).where(f"n <= {k}"))
        parts = stage(parts.drop("n"), "topk")
        lows = parts.groupBy("q").agg(F.sort_array(F.collect_set(F.struct("list", "low"))).alias("lows"))
        known = parts.groupBy("q", "row").agg(F.max("total").alias("total"))
        nth = known.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "row"))).where(f"n = {k}")
        cut = lows.join(nth.select("q", "total"), "q", "left").collect()  # one row per query of the block
        low, safe = np.zeros((len(qid), len(spans))), np.full(len(qid), -np.inf)
        for r in cut:
            low[r["q"]] = [x["low"] for x in r["lows"]]
            if r["total"] is not None:
                safe[r["q"]] = r["total"]
        sent2 = spark.sparkContext.broadcast((qid, q, safe, low))
        cand = vectors.mapInArrow(_phase2(sent2, spans, exact), "q int, row long, below double, above double")
        order = Window.partitionBy("q").orderBy(F.desc("below"), "row")
        cand = cand.withColumn("n", F.row_number().over(order))
        cand = cand.withColumn("kth", F.max(F.when(F.col("n") == k, F.col("below"))).over(Window.partitionBy("q")))
        cand = cand.where("kth is null or above >= kth").select("q", "row")
        names = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(block)], "q int, query_row long")
        out.append(cand.join(names, "q").select("query_row", "row"))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pairs = (union_all(out).join(vectors, "row")
             .join(queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_row"))
    score = F.expr("""aggregate(zip_with(v, qv, (a, b) -> try_multiply(coalesce(a, 0L), coalesce(b, 0L))), 0L,
                                (s, p) -> try_add(s, p))""")
    best = pairs.withColumn("score", score).withColumn("rank", F.row_number().over(
        Window.partitionBy("query_row").orderBy(F.desc_nulls_last("score"), F.col("vec_id").asc_nulls_last(), "row")))
    return best.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
